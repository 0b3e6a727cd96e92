"""Which features a regression needs: errors without some of them, and with their rows shuffled.

Cross-validated fits come from moments by fold. Leaving features out takes no further reading: their rows and columns
of the moments are left out. Shuffling them gives each row the values of another one under a seeded permutation of their
numbers: blocks of rows send each other block's rows what they get, and all that comes back is moments by fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.store import checkpoint_folder
from .adaptive import adaptive_test
from .linmodel import gram, mse, ridge

Moments = dict[tuple, tuple[np.ndarray, np.ndarray, float, int]]


def explained(parts: Moments, use: Sequence[int], strengths: Sequence[float]) -> np.ndarray:
    """Share of the target's mean square that features explain in folds they were not fitted on, by ridge strength.

    The target is centred beforehand, so that this is the variance."""
    total = [sum(p[k] for p in parts.values()) for k in range(4)]
    at = np.ix_(use, use)
    out = []
    for reg in strengths:
        left = sum(mse(ridge(total[0][at] - p[0][at], total[1][list(use)] - p[1][list(use)], reg), p[0][at], p[1][list(use)], p[2], p[3]) * p[3] for p in parts.values())
        out.append(1 - left / total[2] if total[2] else np.nan)
    return np.array(out)


def centred(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Rows without nulls among the columns, features scaled to unit deviation and all of mean zero."""
    rows = df.dropna(subset=[*x, y])
    s = rows.agg(*(f(c).alias(f"{n}_{c}") for c in (*x, y) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if s[f"m_{y}"] is None:
        raise ValueError("there is no row")
    scaled = {c: (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in x}
    return rows.withColumns(scaled | {y: F.col(y) - s[f"m_{y}"]})


def leave_out(df: DataFrame, x: Sequence[str], y: str, fold: str, groups: Mapping[str, Sequence[str]], strengths: Sequence[float]) -> dict[str, dict[str, float]]:
    """For each group of features: what all features explain, what they do without the group, what the group does
    alone, and what is unique to it; each at its best ridge strength. One aggregate by fold is read."""
    parts = gram(centred(df, x, y), x, y, [fold])
    every = list(range(len(x)))
    whole = explained(parts, every, strengths).max()
    out = {}
    for name, own in groups.items():
        held = [k for k in every if x[k] in own]
        rest = [k for k in every if k not in held]
        without = explained(parts, rest, strengths).max() if rest else 0.0
        out[name] = {"all": float(whole), "without": float(without), "alone": float(explained(parts, held, strengths).max()), "unique": float(whole - without)}
    return out


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Add `_row`, numbers from 0 without gaps in the order of a key, from places in ordered parts and the parts' sizes."""
    checkpoint_folder(df.sparkSession)
    rows = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("_at", 33)
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(begun), "_part").withColumn("_row", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def permutation(n: int, seed: int, replicate: int) -> tuple[int, int]:
    """a and b of the permutation r -> (a r + b) mod n: a has no divisor in common with n."""
    rng = np.random.default_rng([seed, replicate])
    while True:
        a = int(rng.integers(1, max(n, 2)))
        if math.gcd(a, n) == 1:
            return a, int(rng.integers(0, n))


#: Rows of a block; rows that are sent at once; replicates of which a task holds a block's rows.
_BLOCK, _AT_ONCE, _REPLICATES = 1 << 16, 1 << 20, 16


def _sent(n: int, moves: Sequence[tuple[int, int, int]], k: int):
    """Batches of (_row, k features) to (block, replicate, first, data): what the rows of a block get from up to `_AT_ONCE` rows of a
    part, in the order of the rows that send it, the first of which is named."""
    small = np.uint16 if n // _BLOCK < 1 << 16 else np.int64

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        row, values = table.column(0).to_numpy(), np.stack([table.column(i + 1).to_numpy() for i in range(k)], axis=1)
        for r, a, b in moves:
            to = ((row * a + b) % n // _BLOCK).astype(small)
            order = np.argsort(to, kind="stable")
            to, moved = to[order], values[order]
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            data = [moved[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(to)), strict=True)]
            columns = [pa.array(to[cut].astype(np.int64)), pa.array(np.full(len(cut), r)), pa.array(np.full(len(cut), row[0])), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "replicate", "first", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= _AT_ONCE:
                yield from out(held)
                held, many = [], 0
        if many:
            yield from out(held)

    return run


def _received(n: int, moves: Sequence[tuple[int, int, int]], k: int, sent_k: int):
    """The rows (block, _row, fold, target, k features) of a block and what was sent to it, to (replicate, fold, moments): those of the
    sent features with all features, the sent ones and the target."""

    def run(own: pa.Table, sent: pa.Table) -> pa.Table:
        own = own.sort_by("_row")
        row, fold = own.column(1).to_numpy(), own.column(2).combine_chunks().dictionary_encode(null_encoding="encode")
        x = np.stack([own.column(i + 4).to_numpy() for i in range(k)], axis=1)
        wide = np.concatenate([x, np.zeros((len(x), sent_k)), own.column(3).to_numpy()[:, None]], axis=1)
        codes, names = fold.indices.to_numpy(), fold.dictionary
        members = [np.flatnonzero(codes == f) for f in range(len(names))]
        sent = sent.sort_by([("replicate", "ascending"), ("first", "ascending")])
        which, data, back = sent.column("replicate").to_numpy(), sent.column("data").to_pylist(), {r: (a, b) for r, a, b in moves}
        reps, folds, made = [], [], []
        for r in np.unique(which).tolist():
            a, b = back[r]
            begin, end = np.searchsorted(which, [r, r + 1])
            # the row whose values a row gets
            order = np.argsort((row - b) % n * pow(a, -1, n) % n if n > 1 else row)
            wide[order, k : k + sent_k] = np.frombuffer(b"".join(data[begin:end])).reshape(-1, sent_k)
            for f, at in enumerate(members):
                w = wide[at]
                reps.append(r)
                folds.append(f)
                made.append((w[:, k : k + sent_k].T @ w).ravel())
        flat = pa.array(np.concatenate(made) if made else np.zeros(0))
        lists = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * (sent_k * (k + sent_k + 1)), flat)
        return pa.table([pa.array(reps, pa.int32()), names.take(pa.array(folds, pa.int32())), lists], ["replicate", "fold", "moments"])

    return run


def shuffled_moments(rows: DataFrame, n: int, x: Sequence[str], y: str, fold: str, moves: Sequence[tuple[int, int, int]], sent_k: int) -> dict[tuple, np.ndarray]:
    """By (replicate, fold): products of each of the first `sent_k` features, shuffled, with all features, all shuffled ones and the target,
    summed over rows.

    `rows` are numbered (`_row`) from 0 to n - 1 without gaps, in order within their parts. Moves are (replicate, a, b): row r's features go to
    row (a r + b) mod n. A number is sent once for each feature and replicate, without a key, as the rows of a block know whence theirs
    come; a task holds a block's rows and what it gets."""
    k, kind = len(x), dict(rows.dtypes)[fold]
    features = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)]
    sent = rows.select("_row", *features[:sent_k]).mapInArrow(_sent(n, moves, sent_k), "block long, replicate long, first long, data binary")
    shown = rows.select(F.floor(F.col("_row") / _BLOCK).cast("long").alias("block"), "_row", F.col(fold).alias("fold"), F.col(y).cast("double").alias("y"), *features)
    got = shown.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_received(n, moves, k, sent_k), f"replicate int, fold {kind}, moments array<double>")
    cells = sent_k * (k + sent_k + 1)
    sums = got.groupBy("replicate", "fold").agg(*(F.sum(F.col("moments")[i]).alias(f"m{i}") for i in range(cells)))
    return {(r[0], r[1]): np.array(r[2:]).reshape(sent_k, k + sent_k + 1) for r in sums.collect()}


def shuffled_importance(df: DataFrame, x: Sequence[str], y: str, fold: str, key: str, groups: Mapping[str, Sequence[str]], strengths: Sequence[float], least: int = 8, most: int = 2048, alpha: float = 0.05, tolerance: float = 0.01, seed: int = 0) -> DataFrame:
    """(features, n, k, p_value, decided): do groups of features explain more than they do shuffled against the rest?

    A replicate gives each row the group's values of another one; permutations are linear in the row's number. All undecided groups
    share their shuffles, and moments by fold and replicate are all that comes of it. Draws stop for
    a group as soon as it is decided. k counts shuffles that explain more than the rows as they are."""
    rows = numbered(centred(df, x, y), key)
    n = rows.count()
    every = gram(rows, x, y, [fold])
    whole = float(explained(every, list(range(len(x))), strengths).max())
    spark = df.sparkSession
    listed = spark.createDataFrame([(g,) for g in groups], "features string")

    def sample(going: DataFrame, first: int, many: int) -> DataFrame:
        names = sorted({r[0] for r in going.select("features").collect()})
        moves = [(r, *permutation(n, seed, r)) for r in range(first, first + many)]
        used = [c for c in x if any(c in groups[name] for name in names)]
        fixed = [c for c in x if c not in used]
        columns = [*used, *fixed]
        found = {}
        for at in range(0, many if used else 0, _REPLICATES):
            found |= shuffled_moments(rows, n, columns, y, fold, moves[at : at + _REPLICATES], len(used))
        out = []
        for name in names:
            put = [k for k, c in enumerate(x) if c in groups[name]]
            for r, *_ in moves:
                own = {}
                for (f,), (g, c, yy, size) in every.items():
                    g, c = g.copy(), c.copy()
                    for i in put:
                        m = found[r, f][columns.index(x[i])]
                        for j in range(len(x)):
                            g[i, j] = g[j, i] = m[len(x) + used.index(x[j])] if j in put else m[columns.index(x[j])]
                        c[i] = m[-1]
                    own[f,] = g, c, yy, size
                out.append((name, r, whole - float(explained(own, list(range(len(x))), strengths).max())))
        return spark.createDataFrame(out, "features string, replicate int, value double")

    return adaptive_test(listed, sample, ["features"], alternative="greater", least=least, most=most, alpha=alpha, tolerance=tolerance)
