"""What the operators of this subpackage share: words, folding, shared-folder tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Java pattern of the white space that parts words.
SPACE = r"[\x20\x09-\x0D]+"


def fold(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Where it is unset (local tests) a temporary folder of this machine is set for the session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/weirflow-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: the lineage ends there, and a lost
    executor costs a reread instead of the work above. The table has no partitioning, so joins on it
    are dealt by exchanges that adaptive execution can split where a key is hot. The shuffle files of the
    write go when it ends, as the table takes their place, whenever the driver next collects its garbage."""
    path = shared_path(df.sparkSession, name)
    before = df.sparkSession.conf.get(CLEANUP, None)
    df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before or "false")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{k or ''}" for k in range(len(taken) + 1)) if n not in taken)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by `materialize` that nothing reads any more; other tables stay."""
    jvm = df.sparkSession._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not parent.rsplit("/", 1)[-1].startswith("weirflow-"):
            raise ValueError(f"{parent} is no table of this library")
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (a, b) of longs.

    Returns (node, root): each node that has an edge, and the smallest node it reaches. Every round
    lowers labels to the smallest among the neighbours and then jumps to the label's own label, so paths
    shorten geometrically. Labels are tables in the shared folder; only a count reaches the driver.
    Self-loops and repeated edges change nothing; null ends are left out."""
    both = edges.select("a", "b").where("a is not null and b is not null and a != b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("far")), "b")
        low = seen.groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        near = labels.join(low, "node").select("node", "root", F.least("root", "far").alias("next"))
        near = materialize(near, "near")
        jump = near.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        after = near.join(jump, "next").select("node", "root", F.least("next", "beyond").alias("to"))
        after = materialize(after, "labels")
        changed = after.where("to != root").limit(1).count()
        drop_table(near)
        drop_table(labels)
        labels = after.select("node", F.col("to").alias("root"))
        if not changed:
            drop_table(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
