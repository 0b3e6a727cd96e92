"""Approximate nearest neighbours by inner product, through a hierarchical k-means tree.

Equal vectors are one class with its smallest ids, as many as any answer can need, so copies cost nothing and lose
nothing. The tree is fitted on a bounded sample of the classes; every class is put into a leaf. A query takes nodes
off a priority queue, best product with the centroid first, until it has as many leaves as calibration asks for. That
number is the least one that reaches the recall aimed at for a bounded sample of queries, whose true neighbours
come from a scan of all vectors. Then blocks of a leaf's queries meet blocks of its classes by a join on the
leaf, and each pair of blocks is one matrix product. Hot leaves have more blocks, not larger ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import drop_table, materialize
from .texts import small_batches

#: Queries whose best rows a task holds at once.
HELD = 1 << 14


@dataclass(frozen=True)
class Search:
    """`k` neighbours; leaves of about `leaf` classes, up to sample / 8 leaves; nodes split into up to `branch`.

    `sample` bounds the classes the tree is fitted on, `probes` the queries that calibrate for `recall`. `block`
    bounds, on average, the classes or queries of a block."""

    k: int = 20
    leaf: int = 512
    branch: int = 8
    sample: int = 1 << 14
    probes: int = 256
    recall: float = 0.95
    block: int = 1024
    rounds: int = 8
    seed: int = 11


@dataclass
class Tree:
    """Nodes as arrays: centroids, children (empty for a leaf) and leaf numbers (-1 for others); 0 is the root."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    half: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.half = (self.centres**2).sum(axis=1) / 2

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf: down to the nearest child, level by level."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not len(below):
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.centres[below].T - self.half[below]).argmax(axis=1)
            todo += [(b, rows[near == i]) for i, b in enumerate(below.tolist()) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, n: int) -> np.ndarray:
        """The first `n` leaves of each query, best bin first."""
        n = min(n, self.leaves)
        out = np.empty((len(q), n), np.int32)
        for row, said in enumerate(-(q @ self.centres.T)):
            queue, got = [(said[0], 0)], 0
            while got < n:
                _, node = heappop(queue)
                if self.leaf[node] >= 0:
                    out[row, got] = self.leaf[node]
                    got += 1
                for b in self.children[node].tolist():
                    heappush(queue, (said[b], b))
        return out


def split(x: np.ndarray, parts: int, by: Search, rng: np.random.Generator) -> np.ndarray:
    """k-means: each row's part, from seeds far from one another by chance (k-means++)."""
    centres = x[[rng.integers(len(x))]]
    far = np.full(len(x), np.inf)
    for _ in range(parts - 1):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        if far.sum() <= 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    part = np.zeros(len(x), int)
    for _ in range(by.rounds):
        part = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        centres = np.array([x[part == c].mean(axis=0) if (part == c).any() else centres[c] for c in range(len(centres))])
    return part


def grow(x: np.ndarray, least: float, by: Search) -> Tree:
    """The tree of a sample: nodes of over 1.5 times `least` rows are split, into parts of no less on average."""
    rng = np.random.default_rng(by.seed)
    centres, children, leaf, todo = [x.mean(axis=0)], [np.zeros(0, int)], [-1], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        many = min(by.branch, round(len(rows) / least))
        part = split(x[rows], many, by, rng) if many > 1 else np.zeros(len(rows), int)
        parts = [rows[part == p] for p in np.unique(part)]
        if len(parts) < 2:
            leaf[node] = max(leaf) + 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(parts))
        todo += list(zip(children[node].tolist(), parts, strict=True))
        centres += [x[p].mean(axis=0) for p in parts]
        children += [np.zeros(0, int)] * len(parts)
        leaf += [-1] * len(parts)
    return Tree(np.array(centres), children, np.array(leaf))


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of numbers from packed vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def packed(vectors: DataFrame, width: int, kind: str) -> DataFrame:
    """(vec_id, vec): the valid vectors, filled up with zeros to `width`, as bytes."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            x = np.zeros((len(sizes), width), kind)
            x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").filter(pa.array(good)), "vec": pa.array([v.tobytes() for v in x[good]], pa.binary())})

    return small_batches(vectors).mapInArrow(run, "vec_id long, vec binary")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(vec, ids): the k + 1 smallest ids of each distinct vector, the most that any answer can need.

    The bound on ranks is pushed before the shuffle, so a hot vector sends k + 1 rows from each task."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fitted(all_classes: DataFrame, n: int, by: Search, kind: str) -> Tree:
    """A tree from the `sample` classes of the lowest hashes."""
    rows = all_classes.select("vec").orderBy(F.xxhash64("vec", F.lit(by.seed)), "vec").limit(by.sample).toArrow()
    x = matrix(rows.column("vec").combine_chunks(), kind)
    return grow(x, max(8.0, by.leaf * len(x) / n), by)


def merged(held: list[tuple[float, int]], q: np.ndarray, scores: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k best of those held, as (-score, id), and of a query's products with a block's classes.

    Block products differ from a pair's own in the last digits; so candidates are taken with some room below the k-th,
    and their scores are those of the pairs."""
    cut = -held[-1][0] if len(held) == k else -np.inf
    if len(scores) > k:
        cut = max(cut, np.partition(scores, -k)[-k])
    near = np.flatnonzero(scores >= cut - 1e-9 * (1 + abs(cut))) if np.isfinite(cut) else np.arange(len(scores))
    if not len(near):
        return held
    fresh = np.einsum("ij,j->i", x[near], q)
    return sorted(held + [(-s, i) for s, j in zip(fresh.tolist(), near.tolist(), strict=True) for i in ids[j]])[:k]


def calibrated(index: DataFrame, queries: DataFrame, tree: Tree, by: Search, kind: str) -> int:
    """Leaves to visit: the fewest by which the probes find the share `recall` of their true neighbours.

    Each task keeps the k best classes of each probe, so what meets is bounded by probes, k and tasks."""
    rows = queries.select("vec").orderBy(F.xxhash64("vec", F.lit(by.seed + 1)), "vec").limit(by.probes).toArrow()
    own = rows.column("vec").to_pylist()
    q = matrix(rows.column("vec").combine_chunks(), kind)
    at = {v: i for i, v in enumerate(own)}

    def scan(batches):
        scores, leaves = np.full((len(q), by.k), -np.inf), np.full((len(q), by.k), -1)
        for batch in batches:
            vecs = batch.column("vec")
            fresh = q @ matrix(vecs, kind).T
            for j, v in enumerate(vecs.to_pylist()):
                if v in at:
                    fresh[at[v], j] = -np.inf
            leaf = np.broadcast_to(batch.column("leaf").to_numpy(), fresh.shape)
            scores, leaves = np.hstack([scores, fresh]), np.hstack([leaves, leaf])
            keep = np.argpartition(-scores, by.k - 1, axis=1)[:, : by.k]
            scores, leaves = np.take_along_axis(scores, keep, 1), np.take_along_axis(leaves, keep, 1)
        probe, place = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_pydict({"probe": pa.array(probe, pa.int32()), "score": pa.array(scores[probe, place]), "leaf": pa.array(leaves[probe, place], pa.int32())})

    found = small_batches(index.select("vec", "leaf")).mapInArrow(scan, "probe int, score double, leaf int")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "leaf")
    true = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= by.k).select("probe", "leaf").toArrow()
    if not true.num_rows:
        return tree.leaves
    rank = tree.visits(q, tree.leaves).argsort(axis=1)
    ranks = np.sort(rank[true.column("probe").to_numpy(), true.column("leaf").to_numpy()])
    return int(ranks[int(np.ceil(by.recall * len(ranks))) - 1]) + 1


def placed(rows: DataFrame, tree: Tree, kind: str) -> DataFrame:
    """Add each class's leaf."""

    def run(batches):
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.place(matrix(batch.column("vec"), kind)), pa.int32()))

    return small_batches(rows).mapInArrow(run, "vec binary, ids array<long>, leaf int")


def visited(queries: DataFrame, tree: Tree, n: int, kind: str) -> DataFrame:
    """(leaf, key, vec): each query beside each leaf that it visits."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                leaves = tree.visits(matrix(part.column("vec"), kind), n)
                which = pa.array(np.repeat(np.arange(part.num_rows), leaves.shape[1]))
                yield pa.RecordBatch.from_pydict({"leaf": pa.array(leaves.ravel(), pa.int32()), "key": part.column("key").take(which), "vec": part.column("vec").take(which)})

    return small_batches(queries).mapInArrow(run, "leaf int, key binary, vec binary")


def blocks(rows: DataFrame, columns: list[str], name: str, size: int) -> DataFrame:
    """One row for about `size` rows of a leaf: the leaf and an array of structs. Dealt by the vector's hash."""
    n = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
    dealt = rows.join(F.broadcast(n), "leaf").withColumn("part", F.pmod(F.xxhash64("vec"), F.col("n")))
    return dealt.groupBy("leaf", "part").agg(F.collect_list(F.struct(*columns)).alias(name)).select("leaf", name)


def searched(pairs: DataFrame, k: int, kind: str) -> DataFrame:
    """(key, vec_id, score): the k best rows of each query over the pairs of blocks that a task has, by score and then id.

    A task holds the best of at most HELD queries besides a pair of blocks, and gives them out when there are more."""

    def given(held):
        rows = [(key, i, -s) for key, found in held.items() for s, i in found]
        yield pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.binary()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})

    def run(batches):
        held: dict[bytes, list[tuple[float, int]]] = {}
        for batch in batches:
            for asked, there in zip(batch.column("asked"), batch.column("there"), strict=True):
                asked, there = asked.values, there.values
                q, x, ids = matrix(asked.field("vec"), kind), matrix(there.field("vec"), kind), there.field("ids").to_pylist()
                for key, one, scores in zip(asked.field("key").to_pylist(), q, q @ x.T, strict=True):
                    held[key] = merged(held.get(key, []), one, scores, x, ids, k)
                if len(held) > HELD:
                    yield from given(held)
                    held = {}
        yield from given(held)

    return small_batches(pairs).mapInArrow(run, "key binary, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, by: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of `vectors` (vec_id, embedding) to each row of `queries`.

    Queries are rows of `vectors` too, and a query's own row is no candidate. Nearest is the largest inner
    product in double precision, ties to the smaller vec_id. Vectors that are null, zero or hold a null or non-finite
    component take no part, nor do rows without vec_id; shorter vectors count as filled up with zeros. Rows that
    repeat an id are candidates of their own, and repeated queries are answered once each. Empty tables give no row."""
    spark = vectors.sparkSession
    kind = "<f8" if isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, DoubleType) else "<f4"
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if width < 1:
        return empty
    use = lambda df: packed(df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), width, kind)
    there = materialize(classes(use(vectors), by.k), "classes")
    asked = materialize(use(queries).withColumn("key", F.unhex(F.md5("vec"))), "queries")
    n = there.count()
    distinct = asked.groupBy("key").agg(F.first("vec").alias("vec"))
    if not n or not asked.limit(1).count():
        return empty
    tree = fitted(there, n, by, kind)
    index = materialize(placed(there, tree, kind), "index")
    drop_table(there)
    distinct = materialize(distinct, "asked")
    leaves = calibrated(index, distinct, tree, by, kind)
    visits = materialize(visited(distinct, tree, leaves, kind), "visits")
    pairs = blocks(visits, ["key", "vec"], "asked", by.block).join(blocks(index, ["vec", "ids"], "there", by.block), "leaf").select("asked", "there")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    found = searched(pairs, by.k + 1, kind).withColumn("place", place).where(F.col("place") <= by.k + 1)
    found = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    rows = asked.select(F.col("vec_id").alias("query_id"), "key").join(found, "key")
    own = F.array_position(F.transform("found", lambda f: f["vec_id"]), F.col("query_id"))
    rest = F.when(own > 0, F.concat(F.slice("found", F.lit(1), (own - 1).cast("int")), F.slice("found", (own + 1).cast("int"), F.lit(by.k + 1)))).otherwise(F.col("found"))
    out = rows.select("query_id", F.posexplode(F.slice(rest, 1, by.k)).alias("at", "near"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))
