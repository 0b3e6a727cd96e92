"""Vectors as array columns, and matrices as long tables (row, col, value) with zeros left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.waveform import bound

# What a lambda takes from outside is worked out again for each element, so it is bound to a name first.


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def magnitude(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    return bound(v, lambda v: bound(magnitude(v), lambda n: F.transform(v, lambda x: x / n)))


def centred(v: Column) -> Column:
    return bound(v, lambda v: bound(mean(v), lambda m: F.transform(v, lambda x: x - m)))


def variance(v: Column, sample: bool = False) -> Column:
    return bound(v, lambda v: bound(mean(v), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m))) / (F.size(v) - (1 if sample else 0))))


def zscored(v: Column) -> Column:
    return bound(v, lambda v: bound(mean(v), lambda m: bound(F.sqrt(variance(v)), lambda s: F.transform(v, lambda x: (x - m) / s))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (magnitude(a) * magnitude(b))


def correlation(a: Column, b: Column) -> Column:
    return cosine(centred(a), centred(b))


def elementwise(a: Column, b: Column, kind: str) -> Column:
    """Sum, difference, product, quotient or power, element by element."""
    f = {"sum": lambda x, y: x + y, "dif": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y, "pow": F.pow}[kind]
    return F.zip_with(a, b, f)


def hill(x: Column, half: float) -> Column:
    return x / (x + half)


def box_sum(v: Column, size: int) -> Column:
    """Sums of `size` elements from each place on, as far as there are so many."""
    places = lambda v: F.filter(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1))), lambda k: k + size - 1 <= F.size(v))
    return bound(v, lambda v: F.transform(places(v), lambda k: total(F.slice(v, k, F.lit(size)))))


def padded(v: Column, n: int) -> Column:
    """Filled up with nulls, or cut, to n elements."""
    return bound(v, lambda v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(v, k)))


def invert_permutation(p: Column) -> Column:
    """Where each number from 0 on stands in p."""
    return bound(p, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.array_position(p, k.cast("long")) - 1))


def onehot(k: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j == k).cast("int"))


def edges(widths: Column, start: float = 0.0) -> Column:
    """Cumulative limits of widths, the start first."""
    return F.aggregate(widths, F.array(F.lit(start)), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + w)))


def centres(limits: Column) -> Column:
    return bound(limits, lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: (a + b) / 2))


def nondecreasing(v: Column) -> Column:
    """Elements that are not below any before them."""
    return F.aggregate(v, F.array().cast("array<double>"), lambda s, x: F.when((F.size(s) == 0) | (x >= F.element_at(F.concat(F.array(F.lit(float("-inf"))), s), -1)), F.concat(s, F.array(x))).otherwise(s))


def to_long(df: DataFrame, key: str, v: str) -> DataFrame:
    """Row key and array to (row, col, value)."""
    return df.select(F.col(key).alias("row"), F.posexplode(v).alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of long tables: a join on the inner index, partial sums before the shuffle."""
    right = b.select(F.col("row").alias("_k"), F.col("col"), F.col("value").alias("_b"))
    left = a.select("row", F.col("col").alias("_k"), F.col("value").alias("_a"))
    return left.join(right, "_k").groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def trace(m: DataFrame) -> DataFrame:
    return m.where("row = col").agg(F.sum("value").alias("trace"))


def frobenius(m: DataFrame) -> DataFrame:
    return m.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def relative_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference over the mean of both mean magnitudes, absent cells being zero."""
    met = a.join(b.withColumnRenamed("value", "_b"), ["row", "col"], "full").fillna(0.0, ["value", "_b"])
    return met.agg((F.sum(F.abs(F.col("value") - F.col("_b"))) / ((F.sum(F.abs("value")) + F.sum(F.abs("_b"))) / 2)).alias("error"))


#: Vectors in a block that meets other blocks.
BLOCK = 512


def _unit_rows(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _rms(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    # element by element, as products would leave something of equal vectors' difference
    return np.array([np.sqrt(((m - x) ** 2).sum(axis=1) / m.shape[1]) for x in q])


#: How blocks of vectors, one in a row, are measured against one another.
MEASURES = {
    "cosine": lambda q, m: _unit_rows(q) @ _unit_rows(m).T,
    "correlation": lambda q, m: _unit_rows(q - q.mean(axis=1, keepdims=True)) @ _unit_rows(m - m.mean(axis=1, keepdims=True)).T,
    "dot": lambda q, m: q @ m.T,
    "rms": _rms,
}


def _blocks(df: DataFrame, key: str, v: str, name: str) -> DataFrame:
    """(name, name_n, name_m): keys, lengths and elements of vectors by blocks of about BLOCK, in no order. Each task cuts
    its own rows."""
    kind = dict(df.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                cells = [pa.array([c.to_pylist()], pa.list_(t)) for c, t in zip(part.columns[:2], (part.schema.types[0], pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*cells, pa.array([part.column(2).flatten().to_numpy(zero_copy_only=False)], pa.list_(pa.float64()))], [name, f"{name}_n", f"{name}_m"])

    rows = df.where(F.col(v).isNotNull()).select(key, F.size(v).alias("n"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    return rows.mapInArrow(cut, f"{name} array<{kind}>, {name}_n array<int>, {name}_m array<double>")


def block_pairs(df: DataFrame, key: str, v: str, queries: DataFrame, measure: str, itself: bool = False) -> DataFrame:
    """(query, key, value) of a stated query set against all rows, or all others: vectors meet by blocks.

    There are as many pairs as queries times rows, so the work is theirs by nature; what a task holds is two blocks and
    their pairs, and what is shuffled are blocks: each one once for every block that it meets, dealt evenly."""
    kind = dict(df.dtypes)[key]
    asked, held = _blocks(queries, key, v, "_q"), _blocks(df, key, v, "_d")
    # block pairs are dealt by number, so that cores share them whatever the files
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    met = held.repartition(tasks).crossJoin(asked)
    of = MEASURES[measure]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                dk, dn, dm, qk, qn, qm = (c.slice(k, 1).flatten() for c in b.columns)
                sizes = set(dn.to_pylist()) | set(qn.to_pylist())
                if len(sizes) != 1:
                    raise ValueError("vectors of unlike lengths have no measure")
                width = sizes.pop()
                full = [np.array(m.to_numpy(zero_copy_only=False), dtype=float).reshape(-1, width) for m in (qm, dm)]
                values = of(*full)
                for row in range(0, len(qk), 64):
                    q = np.repeat(np.arange(row, min(row + 64, len(qk))), len(dk))
                    d = np.tile(np.arange(len(dk)), len(q) // len(dk))
                    left, right = qk.take(pa.array(q)), dk.take(pa.array(d))
                    out = pa.RecordBatch.from_arrays([left, right, pa.array(values[row : row + 64].ravel())], ["query", key, "value"])
                    yield out if itself else out.filter(pc.not_equal(left, right))

    return met.mapInArrow(pairs, f"query {kind}, {key} {kind}, value double")


def query_pairs(df: DataFrame, key: str, v: str, queries: DataFrame, measure: str = "cosine") -> DataFrame:
    """(query, key, value) of a stated query set against all other rows, by one of MEASURES."""
    return block_pairs(df, key, v, queries, measure)


#: One number from each pair of elements.
PAIRED = {
    "sum": lambda x, y: x + y, "dif": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y, "pow": F.pow,
    "and": lambda x, y: F.when(x + y >= 2.0, 1.0).otherwise(0.0), "nor": lambda x, y: F.when(x + y <= 0.0, 1.0).otherwise(0.0),
}
#: 1 or 0 for each element against a number.
COMPARED = {"lt": lambda x, c: x < c, "gt": lambda x, c: x > c, "eq": lambda x, c: x == c, "ne": lambda x, c: x != c, "le": lambda x, c: x <= c, "ge": lambda x, c: x >= c}


def paired(a: Column, b: Column, kind: str) -> Column:
    """Elements of two arrays taken together; the longer one's rest gives nulls."""
    return F.zip_with(a, b, PAIRED[kind])


def paired_rows(a: Column, b: Column, kind: str) -> Column:
    """The same for arrays of arrays."""
    return F.zip_with(a, b, lambda x, y: paired(x, y, kind))


def pairs_folded(pairs: Column, kind: str) -> Column:
    """One number from each pair of an array of two-element arrays."""
    return F.transform(pairs, lambda p: PAIRED[kind](p[0], p[1]))


def compared(v: Column, c: float, kind: str) -> Column:
    return F.transform(v, lambda x: COMPARED[kind](x, F.lit(c)).cast("int"))


def truth(v: Column, negated: bool = False) -> Column:
    """1 for elements of 1 and more, else 0; or the reverse."""
    return F.transform(v, lambda x: ((x < 1.0) if negated else (x >= 1.0)).cast("int"))


def within(v: Column, low: float, high: float) -> Column:
    """1 for elements from `low` to below `high`, else 0."""
    return F.transform(v, lambda x: ((x >= low) & (x < high)).cast("int"))


def zeroed_outside(v: Column, low: float, high: float) -> Column:
    """Elements from `low` to below `high`, zero for the others."""
    return F.transform(v, lambda x: F.when((x >= low) & (x < high), x).otherwise(F.lit(0.0)))


def scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * by)


def shifted(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x + by)


def linear_combination(a: Column, b: Column, wa: float, wb: float) -> Column:
    return F.zip_with(a, b, lambda x, y: wa * x + wb * y)


def deviation(v: Column, sample: bool = False) -> Column:
    return F.sqrt(variance(v, sample))


def standard_error(v: Column) -> Column:
    return F.sqrt(variance(v, True) / F.size(v))


def squared_magnitude(v: Column) -> Column:
    return total(F.transform(v, lambda x: x * x))


def squared_deviations(v: Column, c: Column | None = None) -> Column:
    """Squared distances of the elements from c, or from their mean."""
    return bound(v, lambda v: bound(mean(v) if c is None else c, lambda m: F.transform(v, lambda x: (x - m) * (x - m))))


def covariance(a: Column, b: Column, sample: bool = False) -> Column:
    return dot(centred(a), centred(b)) / (F.size(a) - (1 if sample else 0))


def unit_sum(v: Column) -> Column:
    """Divided by the sum, so that it is one."""
    return bound(v, lambda v: bound(total(v), lambda t: F.transform(v, lambda x: x / t)))


def flattened(v: Column) -> Column:
    return F.flatten(v)


def cut(v: Column, n: int) -> Column:
    """An array in pieces of n elements, the last one shorter."""
    return bound(v, lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / n).cast("int") - 1), lambda k: F.slice(v, k * n + 1, F.lit(n))))


def per_row(rows: Column, kind: str) -> Column:
    """One number for each array of an array: mean, variance or deviation."""
    one = {"mean": mean, "var": variance, "std": deviation}[kind]
    return F.transform(rows, lambda r: one(r))  # noqa: PLW0108  a function of two arguments would get the place too


def divided_up(a: Column, b: Column) -> Column:
    """a over b, rounded up to a whole number."""
    return F.ceil(a / b).cast("long")


def all_differences(v: Column, sums: bool = False) -> Column:
    """Element less element, or plus it, for all pairs: an array of rows, one for each element taken off (or added)."""
    return bound(v, lambda v: F.transform(v, lambda y: F.transform(v, lambda x: x + y if sums else x - y)))


def time_distances(df: DataFrame, t: str, v: str, queries: DataFrame, measure: str = "rms") -> DataFrame:
    """(query, t, value): root mean squared difference, or product sum, of a stated set of times' vectors with all times'."""
    return block_pairs(df, t, v, queries, measure, itself=True).withColumnRenamed(t, "t")
