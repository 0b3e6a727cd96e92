"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Targets: a share of all words is dealt to sources by weight; sources are clamped at a maximum number of
epochs and the excess is dealt again by weight until none is above. In order of cap over weight, the
sources clamped are a prefix, so the level is found by running sums. Documents are then taken in seeded
order: whole epochs of all of them, and a last fractional epoch of the first ones in hash order, the one
on the border in part. Running sums go over hash buckets of a bounded number of documents, so a source
of any size is dealt out over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, words

#: Documents of a hash bucket over all sources, on average.
PER_BUCKET = 200


@dataclass(frozen=True)
class Mix:
    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.5
    epochs: float = 2.0
    seed: int = 7


def order_key(mix: Mix) -> Column:
    """Seeded place of a document within its source: 32 hex digits."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{mix.seed}")))


def bucket(key: Column, n: int) -> Column:
    """Bucket of 0 to n - 1 by a key's first 32 bits, rising with the key."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 32)).cast("long")


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """Add _size (words of the whole text) and _key to the rows."""
    return docs.withColumn("_size", F.size(words(F.col("text"))).cast("long")).withColumn("_key", order_key(mix))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) from rows (source, size), one row for each source, null included.

    The windows below go over one row for each source, not over documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in mix.weights))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("w", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(mix.weights)))))
    rows = rows.withColumn("cap", F.lit(mix.epochs) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.lit(mix.share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the first level that its own source can take is the water level for it and all after it
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def take(rows: DataFrame, sizes: DataFrame, mix: Mix) -> DataFrame:
    """Add source_size, target and taken to rows that have source, _size and _key.

    `sizes` are (source, size, key) of the same rows. Extra columns of `rows` pass through; they may not
    begin with an underscore or be named source_size, target or taken."""
    n = max(1, -(-sizes.count() // PER_BUCKET))
    sums = sizes.groupBy("source", bucket(F.col("key"), n).alias("_bucket")).agg(F.sum("size").alias("_in"))
    goal = targets(sizes, mix)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + 0.5).cast("long")
    name = [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name")]
    goal = goal.withColumn("_whole", whole).withColumn("_part", part).select(*name, "source_size", "target", "_whole", "_part")
    upto = Window.partitionBy("_none", "_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(*name, "_bucket", "_in").withColumn("_begun", F.coalesce(F.sum("_in").over(upto), F.lit(0))).drop("_in").join(goal, ["_none", "_name"])
    dealt = rows.withColumn("_bucket", bucket(F.col("_key"), n)).withColumn("_none", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    dealt = dealt.join(begun, ["_none", "_name", "_bucket"])
    inside = Window.partitionBy("_none", "_name", "_bucket").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_begun") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    taken = F.col("_whole") * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_part") - place))
    return dealt.withColumn("taken", taken.cast("long")).drop("_none", "_name", "_bucket", "_begun", "_whole", "_part")


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """How much of every row of (doc_id, text, source) the mix takes; other columns are ignored.

    Returns doc_id, size, source_size, target, taken. Null texts have size 0 and give 0; a null source is
    a source of its own, the last. Rows with the same doc_id are rows of their own. A source whose texts
    are all empty has target 0. Taken words of a source differ from its target by under one."""
    skinny = materialize(sized(docs.select("doc_id", "text", "source"), mix).select("doc_id", "source", "_size", "_key"), "mixsizes")
    out = take(skinny, skinny.select("source", F.col("_size").alias("size"), F.col("_key").alias("key")), mix)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: rows of `docs` with its columns, each as often as taken.

    A document taken one and a part times comes once whole and once with its first words, joined by
    single spaces, `n_chars` being that text's length. Documents not taken do not come."""
    columns = docs.columns
    rows = sized(docs, mix)
    skinny = materialize(rows.select("source", F.col("_size").alias("size"), F.col("_key").alias("key")), "mixsizes")
    got = take(rows, skinny, mix).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("_size")).cast("int"), (F.col("taken") % F.col("_size")).cast("int")
    head = F.array_join(F.slice(words(F.col("text")), F.lit(1), rest), " ")
    copies = F.array_repeat(F.col("text"), whole)
    got = got.withColumn("text", F.explode(F.when(rest > 0, F.concat(copies, F.array(head))).otherwise(copies)))
    if "n_chars" in columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*columns)
