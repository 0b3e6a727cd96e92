"""Alignment of directions with covariances, against chance; synchrony of units by their distance.

Covariances by group come from one pass of moments. Chance is a table of random directions, each drawn from its number
and a seed, so the draws are spread over tasks and don't depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .curves import exponential_decay


def normed(cov: np.ndarray) -> np.ndarray:
    """Divided by its largest eigenvalue."""
    return cov / np.linalg.eigvalsh(cov)[-1]


def complement(cov: np.ndarray) -> np.ndarray:
    """What a covariance does not span: one less the normed covariance."""
    return np.eye(len(cov)) - normed(cov)


def expected_overlap(direction: np.ndarray, cov: np.ndarray) -> float:
    """The variance along a direction as a share of the largest along any."""
    d = direction / np.linalg.norm(direction)
    return float(d @ normed(cov) @ d)


def chance_overlap(cov: np.ndarray) -> float:
    """Mean overlap of random directions: the trace over the number of dimensions."""
    return float(np.trace(normed(cov)) / len(cov))


def alignment(direction: np.ndarray, cov: np.ndarray) -> float:
    """Root overlap, from 0 at chance to 1 along the leading axis."""
    x, e = math.sqrt(max(expected_overlap(direction, cov), 0.0)), math.sqrt(chance_overlap(cov))
    return (x - e) / (1 - e)


def first_axis_overlap(direction: np.ndarray, cov: np.ndarray) -> float:
    """Overlap with the leading axis alone, from 0 at chance to 1 along it."""
    d = direction / np.linalg.norm(direction)
    e = 1 / len(d)
    return 1 - (1 - float(d @ np.linalg.eigh(cov)[1][:, -1]) ** 2) / (1 - e)


def angle(direction: np.ndarray, cov: np.ndarray) -> float:
    """Degrees between a direction and what a covariance spans; 0 is along its leading axis."""
    x = expected_overlap(direction, cov)
    return math.degrees(math.atan2(math.sqrt(max(1 - x, 0.0)), math.sqrt(max(x, 0.0))))


def drawn_alignments(spark: SparkSession, cov: np.ndarray, n: int, like: np.ndarray | None = None, unit: bool = True, seed: int = 0) -> DataFrame:
    """(draw, overlap, alignment, angle) of `n` random directions with a covariance.

    Directions are even over the sphere, or those of normal draws with covariance `like`: the covariance itself, another
    or its complement. Without `unit` their lengths count."""
    e, v = np.linalg.eigh(np.eye(len(cov)) if like is None else like)
    root, sigma, level = v * np.sqrt(np.maximum(e, 0)), normed(cov), math.sqrt(chance_overlap(cov))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            z = np.array([np.random.default_rng([seed, i]).normal(size=len(e)) for i in ids.to_pylist()]).reshape(-1, len(e)) @ root.T
            if unit:
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
            x = np.einsum("ni,ij,nj->n", z, sigma, z)
            left = np.einsum("ni,ni->n", z, z) - x
            turn = np.degrees(np.arctan2(np.sqrt(np.maximum(left, 0)), np.sqrt(np.maximum(x, 0))))
            yield pa.RecordBatch.from_pydict({"draw": ids, "overlap": pa.array(x), "alignment": pa.array((np.sqrt(np.maximum(x, 0)) - level) / (1 - level)), "angle": pa.array(turn)})

    return spark.range(n).mapInArrow(run, "draw long, overlap double, alignment double, angle double")


def overlap_ratio(df: DataFrame, v: str, direction: Column, by: Sequence[str]) -> DataFrame:
    """(by, along, mean, ratio): variance of a group's vectors along its direction, over that along all axes on average.

    `direction` is an array column that is the same within a group; any length will do."""
    size = F.aggregate(direction, F.lit(0.0), lambda s, x: s + x * x)
    along = F.aggregate(F.zip_with(F.col(v), direction, lambda x, d: x.cast("double") * d), F.lit(0.0), lambda s, x: s + x) / F.sqrt(size)
    rows = df.select(*by, along.alias("_a"), F.posexplode(v).alias("_k", "_x"))
    axes = rows.groupBy(*by, "_k").agg(F.var_pop(F.col("_x").cast("double")).alias("_v"), F.var_pop("_a").alias("_along"))
    made = axes.groupBy(*by).agg(F.max("_along").alias("along"), F.avg("_v").alias("mean"))
    return made.withColumn("ratio", F.col("along") / F.col("mean"))


def synchrony_by_distance(phases: DataFrame, places: DataFrame, unit: str, t: str, phase: str, width: float, absolute: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """(bin, distance, synchrony, n): mean cosine of phase differences of pairs of units, by bins of distance.

    Units are compared at each time by a join on it, so there are as many rows as times and pairs of units there; only
    sums by pair and task go on. `absolute` takes opposite phases for synchronous. distance is the mean over the pairs
    and times of a bin; pairs of a unit without a place are left out."""
    one = phases.where(F.col(phase).isNotNull()).select(F.col(t).alias("_t"), F.col(unit).alias("_a"), F.col(phase).alias("_p"))
    both = one.join(one.select("_t", F.col("_a").alias("_b"), F.col("_p").alias("_q")), "_t").where("_a < _b")
    c = F.cos(F.col("_p") - F.col("_q"))
    pairs = both.groupBy("_a", "_b").agg(F.sum(F.abs(c) if absolute else c).alias("_s"), F.count(F.lit(1)).alias("_n"))
    at = lambda n: places.select(F.col(unit).alias(n), F.col(x).alias(f"_x{n}"), F.col(y).alias(f"_y{n}")).dropDuplicates([n])
    pairs = pairs.join(at("_a"), "_a").join(at("_b"), "_b")
    distance = F.sqrt(F.pow(F.col("_x_a") - F.col("_x_b"), 2) + F.pow(F.col("_y_a") - F.col("_y_b"), 2))
    rows = pairs.withColumn("_d", distance).withColumn("bin", F.floor(F.col("_d") / width + 0.5).cast("long"))
    made = rows.groupBy("bin").agg(F.sum(F.col("_d") * F.col("_n")).alias("_d"), F.sum("_s").alias("_s"), F.sum("_n").alias("n"))
    return made.select("bin", (F.col("_d") / F.col("n")).alias("distance"), (F.col("_s") / F.col("n")).alias("synchrony"), "n")


def length_constants(binned: DataFrame) -> DataFrame:
    """(bin, length): the distance over which synchrony falls by e, if it fell from one at distance zero as it has here."""
    fallen = -F.log(F.col("synchrony") + 1e-6)
    return binned.where("distance > 0 and synchrony > 0").select("bin", (F.col("distance") / fallen).alias("length"))


def fitted_length(binned: DataFrame, start: Sequence[float] | None = None) -> tuple[np.ndarray, float]:
    """(length, scale, offset) of an exponential fall of synchrony with distance, weighted by pairs; and its error."""
    if start is None:
        top, low, middle = binned.agg(F.max("synchrony"), F.min("synchrony"), F.avg("distance")).first()
        start = (max(middle or 1.0, 1e-9), (top or 0.0) - (low or 0.0), low or 0.0)
    return exponential_decay(binned, "distance", "synchrony", start, "n")

