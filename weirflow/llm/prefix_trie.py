"""Conversation prefix trie, built level by level.

Conversations of the same turns are one weighted class, so a hot group of copies costs one row a level.
Per depth, live classes are grouped by (parent node, next turn), and the smallest conv_id names the node: with
its depth it is unique. A class alone in its group leaves at once; the rest of its turns is a chain that one
pass emits. So there are as many rounds as two different conversations share turns, whatever the longest
one is. Then leaves and savings are rolled up by joins from the deepest level to the root.

Turns are told apart by the SHA-256 of role and text; only keys and lengths are shuffled, in blocks of a few turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import drop_table, materialize

#: Turns of a block: what a live row carries, and how often turns are read.
BLOCK = 8
#: Blocks whose digests are one digest, so that no array grows with a conversation.
BLOCKS = 256
#: Bits of turn numbers, and of conv_ids, that one bucket spans.
TURN_BITS, ID_BITS = 8, 12
#: A turn's key and its code points.
TURN = "array<struct<key:binary,len:long>>"
EMPTY = hashlib.sha256().hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, len): places from 1 in the order of turn, null first.

    Rows of one turn are ordered by key, equal rows are turns of their own. Numbers are given within buckets of
    turns and bucket counts are summed, so one long conversation is dealt over many tasks."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.length(text).cast("long").alias("len"),
    )
    rows = materialize(rows.withColumn("bucket", F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 62)))), "turns")
    upto = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = rows.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.join(begun, ["conv_id", "bucket"]).select("conv_id", (F.col("before") + F.row_number().over(inside)).alias("pos"), "key", "len")


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their block's first one.

    Conversation c gets the first h = crc32(c) mod `heads` turns of conversation c - c % `block` (all if it
    has fewer, none if it is absent; % keeps the sign of c), then its own turns after its first h. Returns
    (conv_id, n) with the number of turns, and (conv_id, block, turns) with arrays of at most BLOCK turns."""
    pos = materialize(numbered(turns), "numbered")
    own = pos.groupBy("conv_id").agg(F.max("pos").alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    bases = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.withColumn("n", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "k", "n"), "convs")
    after = pos.join(convs.select("conv_id", "h", "k"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "len")
    first = pos.where((F.col("conv_id") % block == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    first = first.join(convs.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "key", "len")
    turns = after.unionByName(first).groupBy("conv_id", F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    turns = turns.agg(F.sort_array(F.collect_list(F.struct("pos", "key", "len"))).alias("turns"))
    turns = turns.select("conv_id", "block", F.col("turns").cast("array<struct<pos:long,key:binary,len:long>>").alias("turns"))
    turns = materialize(turns.select("conv_id", "block", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["len"].alias("len"))).alias("turns")), "blocks")
    out = materialize(convs.select("conv_id", "n"), "lengths")
    for gone in (pos, convs):
        drop_table(gone)
    return out, turns


def digest(parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("", F.transform(parts, lambda p: F.hex(p))), 256))


def classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, class, n, w): the smallest conv_id of the same turns, their number, and the class's size."""
    keys = turns.select("conv_id", "block", digest(F.transform("turns", lambda t: t["key"])).alias("part"))
    for width in (BLOCKS, None):
        at = F.lit(0).cast("long") if width is None else F.floor(F.col("block") / width)
        keys = keys.groupBy("conv_id", at.alias("at")).agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
        keys = keys.select("conv_id", F.col("at").alias("block"), digest(F.transform("parts", lambda p: p["part"])).alias("part"))
    rows = convs.join(keys.select("conv_id", F.col("part").alias("key")), "conv_id", "left").withColumn("key", F.coalesce("key", F.lit(b"")))
    rows = materialize(rows, "keys")
    groups = rows.groupBy("key").agg(F.min("conv_id").alias("class"), F.count(F.lit(1)).alias("w"))
    out = materialize(rows.join(groups, "key").select("conv_id", "class", "n", "w"), "classes")
    drop_table(rows)
    return out


def _streamed(batches):
    """One SHA-256 for each class of rows sorted by class and part; it carries over from batch to batch."""
    name, state = None, hashlib.sha256()
    for batch in batches:
        names, said = [], []
        for c, ids in zip(batch.column("class").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if c != name:
                if name is not None:
                    names.append(name)
                    said.append(state.hexdigest())
                name, state = c, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"class": pa.array(names, pa.int64()), "ends_sha256": pa.array(said, pa.string())})
    if name is not None:
        yield pa.RecordBatch.from_pydict({"class": pa.array([name], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def ends(members: DataFrame) -> DataFrame:
    """(class, ends_sha256): SHA-256 of the members' ids, ascending, comma-joined.

    A digest reads in order, so each class's ids pass through one task, as strings of the at most 2^ID_BITS ids
    of a range, which earlier tasks join; the task holds one string and the digest's state."""
    alone = members.where("w = 1").select("class", F.sha2(F.col("class").cast("string"), 256).alias("ends_sha256"))
    parts = members.where("w > 1").groupBy("class", F.shiftright("conv_id", ID_BITS).alias("part"))
    parts = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    parts = parts.repartition("class").sortWithinPartitions("class", "part").select("class", "ids")
    return alone.unionByName(parts.mapInArrow(_streamed, "class long, ends_sha256 string"))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the conversations given as `rebuilt` returns them, as NODES."""
    spark = convs.sparkSession
    members = classes(convs, turns)
    top = members.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n")).first()
    if top["root"] is None:
        return spark.createDataFrame([], NODES)
    root = F.lit(top["root"]).cast("long")
    reps = members.where("conv_id = class").select("class", "n", "w")
    live = materialize(reps.where("n > 0").select("class", root.alias("node"), "n", "w"), "live")
    levels, d = [], 0
    while True:
        if d % BLOCK == 0:
            here = turns.where(F.col("block") == d // BLOCK).select(F.col("conv_id").alias("class"), "turns")
            going = live.drop("turns").join(here, "class")
        else:
            going = live
        turn = F.get("turns", F.lit(d % BLOCK))
        going, d = going.withColumns({"key": turn["key"], "len": turn["len"]}), d + 1
        groups = going.groupBy("node", "key").agg(
            F.min("class").alias("child"), F.count(F.lit(1)).alias("n_classes"), F.sum("w").alias("n_convs"), F.max("len").alias("len"),
            F.max("n").alias("n"), F.min(F.when(F.col("n") == d, F.col("class"))).alias("ended"),
        )
        groups = materialize(groups, f"level{d}")
        levels.append(groups)
        on = groups.where("n_classes > 1").select("node", "key", "child")
        if not on.limit(1).count():
            drop_table(live)
            break
        after = going.where(F.col("n") > d).join(on, ["node", "key"])
        after = materialize(after.select("class", F.col("child").alias("node"), "n", "w", "turns"), "live")
        drop_table(live)
        live = after
    return rolled_up(levels, turns, members, root, top["n"])


def chains(levels: list[DataFrame], turns: DataFrame) -> DataFrame:
    """Nodes from where a class is alone to its last turn: one leaf, and what its copies save further on.

    Sums of lengths go over blocks first, so a long conversation's are dealt over many tasks."""
    solo = None
    for d, level in enumerate(levels, 1):
        at = level.where("n_classes = 1").select(F.col("child").alias("conv_id"), F.lit(d).cast("long").alias("head"), F.col("node").alias("up"), "n_convs", "n")
        solo = at if solo is None else solo.unionByName(at)
    rows = turns.join(solo, "conv_id").where((F.col("block") + 1) * BLOCK >= F.col("head"))
    rows = rows.withColumn("lens", F.transform("turns", lambda t: t["len"]))
    total = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    rest = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    beyond = rows.where("n_convs > 1").select("conv_id", "block", F.coalesce(F.sum(total).over(rest), F.lit(0)).alias("beyond"))
    rows = rows.join(beyond, ["conv_id", "block"], "left").select("*", F.posexplode("lens").alias("at", "len"))
    depth = F.col("block") * BLOCK + F.col("at") + 1
    inside = F.aggregate(F.expr("slice(lens, at + 1, size(lens))"), F.lit(0).cast("long"), lambda a, x: a + x)
    saved = F.when(F.col("n_convs") > 1, (F.col("n_convs") - 1) * (F.coalesce("beyond", F.lit(0)) + inside)).otherwise(F.lit(0))
    rows = rows.withColumn("depth", depth).where("depth >= head")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("head"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), (F.col("depth") == F.col("head")).alias("head"),
    )


def rolled_up(levels: list[DataFrame], turns: DataFrame, members: DataFrame, root: Column, n: int) -> DataFrame:
    """Leaves, savings and children of every level's nodes, from the deepest level to the root."""
    single = materialize(chains(levels, turns), "chains")
    columns = [c for c in single.columns if c != "head"]
    nodes, below = single.select(columns), None
    for d in range(len(levels), -1, -1):
        heads = single.where(F.col("head") & (F.col("depth") == d + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        under = heads if below is None else heads.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = [F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under")]
        if d:
            here = levels[d - 1].where("n_classes > 1").select(F.col("child").alias("conv_id"), F.col("node").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("len")).alias("own"))
            here = here.join(under.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(*sums), "conv_id")
        else:  # all that is left hangs from the root
            here = under.agg(*sums).select("*", root.alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("own"))
        here = here.select(
            "conv_id", F.lit(d).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("under", F.lit(0))).alias("saved_tokens"),
        )
        below = materialize(here, f"nodes{d}")
        nodes = nodes.unionByName(below)
    # at most one class ends at a node, as a class has all conversations of its turns
    ended = members.where("conv_id = class and n = 0").select("class", F.lit(0).cast("long").alias("depth"), root.alias("conv_id"))
    for d, level in enumerate(levels, 1):
        alone = F.col("n_classes") == 1
        ended = ended.unionByName(level.select(F.when(alone, F.col("child")).otherwise(F.col("ended")).alias("class"), F.when(alone, F.col("n")).otherwise(F.lit(d)).alias("depth"), F.col("child").alias("conv_id")).where("class is not null"))
    said = ended.join(ends(members), "class").drop("class")
    return nodes.join(said, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def prefix_trie(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Every node of the trie of rebuilt conversations, from (conv_id, turn, role, text).

    Null role or text is empty; rows without conv_id are left out; other columns are ignored; an empty table has
    no node. Conversations may lose all turns by rebuilding; they end at the root."""
    return trie(*rebuilt(turns, block, heads))
