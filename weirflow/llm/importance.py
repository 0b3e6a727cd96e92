"""Importance resampling of documents towards a target, over hashed n-gram features.

Every text is read once: its features' buckets are packed as uint16 streams of many documents each, with the
documents' offsets, and written to a table. Counts come from sorting each stream and run-length encoding it; Spark
merges the runs. A bucket's gain compares the target's share with the corpus's; weights gather gains along the
streams and sum them between offsets. Gumbel noise from the document's id makes the highest scores a sample without
replacement; ranks come from a range-ordered table and its partitions' sizes, so no task holds all scores.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import drop_table, materialize
from .texts import map_texts, raw_texts, small_batches

STREAMS = "ids array<long>, words array<int>, offsets array<int>, buckets binary"
#: Lower-cases A-Z and turns every other byte that is no part of a word into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Documents of a partition of the ordered table.
PER_PART = 1 << 20


@dataclass(frozen=True)
class Resample:
    """n-grams of 1 to `n` words in `buckets` (65,536 at most); `percent` of the documents of `least` words or more."""

    n: int = 1
    buckets: int = 10_000
    least: int = 20
    percent: int = 10
    seed: int = 2024

    def __post_init__(self) -> None:
        if not 0 < self.buckets <= 1 << 16:
            raise ValueError("buckets are packed as uint16")


def features(text: bytes, by: Resample) -> tuple[int, np.ndarray]:
    """A text's number of words, and its features' buckets as uint16."""
    words = text.translate(WORD_BYTES).split()
    runs = [words] + [[b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, by.n + 1)]
    return len(words), np.concatenate([np.fromiter(map(zlib.crc32, r), np.uint32, len(r)) % by.buckets for r in runs]).astype("<u2")


def packed(docs: DataFrame, by: Resample) -> DataFrame:
    """Rows of many documents each: ids, words, where each one's features begin (and the last ones end), and all buckets.

    A row holds what a slice of a batch of texts gives, so its size is bounded by the slice and one longest text."""

    def kernel(batch: pa.RecordBatch) -> dict:
        found = [features(t, by) for t in raw_texts(batch)]
        offsets = np.concatenate([[0], np.cumsum([len(f) for _, f in found])])
        return {
            "ids": pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "words": pa.array([[n for n, _ in found]], pa.list_(pa.int32())),
            "offsets": pa.array([offsets.tolist()], pa.list_(pa.int32())),
            "buckets": pa.array([np.concatenate([f for _, f in found]).tobytes()], pa.binary()),
        }

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], kernel, STREAMS)


def _runs(batches):
    for batch in batches:
        for stream in batch.column("buckets"):
            ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
            counts = np.diff(np.append(first, len(ordered)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(ordered[first], pa.int32()), "n": pa.array(counts, pa.int64())})


def counts(streams: DataFrame, by: Resample) -> np.ndarray:
    """Features by bucket over all streams: one array of as many numbers as buckets."""
    runs = small_batches(streams.select("buckets")).mapInArrow(_runs, "bucket int, n long")
    out = np.zeros(by.buckets, np.int64)
    for bucket, n in runs.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of smoothed shares, target over source, rounded down."""
    s, t, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(x + 1) * float(s + b) / (float(y + 1) * float(t + b)))) for x, y in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight). The gains have one number for each bucket."""

    def run(batches):
        for batch in batches:
            for ids, words, offsets, stream in zip(*batch.columns, strict=True):
                at = offsets.values.to_numpy()
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                weight = np.zeros(len(sizes), np.int64)
                if len(full):
                    weight[full] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], at[full])
                yield pa.RecordBatch.from_pydict({"doc_id": ids.values, "n_words": words.values.cast(pa.int64()), "n_features": pa.array(sizes, pa.int64()), "weight": pa.array(weight)})

    columns = [c.split()[0] for c in STREAMS.split(", ")]
    return small_batches(streams.select(*columns)).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, by: Resample) -> DataFrame:
    """Add rank to rows of (doc_id, n_words, n_features, weight, score): 1, 2, ... for those drawn, else null.

    Rows are range-ordered and written with their place in their partition; only the partitions' sizes meet."""
    rows = scored.withColumn("can", (F.col("n_words") >= by.least).cast("int"))
    order = [F.col("can").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").asc(), F.col("n_features").asc()]
    n = max(1, -(-scored.count() // PER_PART))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows, "ranked")
    part = F.shiftrightunsigned("at", 33)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum("can").alias("cans"))
    drawn = F.floor(F.sum("cans").over(Window.partitionBy()) * by.percent / 100)
    begun = sizes.select("part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"), drawn.alias("drawn"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    rank = F.when((F.col("can") == 1) & (place <= F.col("drawn")), place)
    return rows.withColumn("part", part).join(F.broadcast(begun), "part").select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, by: Resample = Resample()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of (doc_id, text), drawn towards (text).

    Words are runs of 0-9, a-z and characters beyond ASCII, A-Z in lower case. Null and empty texts have no
    feature and weight 0; a null doc_id counts as an empty one in the noise and goes first among ties; rows of one
    doc_id are documents of their own, with the same noise. An empty target leaves gains by smoothing alone; an empty
    table has no row."""
    streams = materialize(packed(docs, by), "buckets")
    goal = packed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), by)
    rows = materialize(weights(streams, gains(counts(streams, by), counts(goal, by))), "weights")
    drop_table(streams)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{by.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return ranked(rows.withColumn("score", F.col("weight") + noise), by)
