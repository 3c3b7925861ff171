"""Shared helpers of the corpus operators: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Most bytes of an Arrow batch.
ARROW_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one is made only on a local master where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Spark deletes it with the result if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, else it stays there.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that rows of long texts do not fill a task's memory; a smaller bound stays as it is.

    Spark holds a batch several times over (vectors that double, the bytes sent, the texts in Python).
    """
    size = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(_BATCH, "64m").lower())
    if not size or int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] > ARROW_BYTES:
        spark.conf.set(_BATCH, f"{ARROW_BYTES}b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges``: columns u, v (comparable, not null), any direction, repeats allowed. Returns node, root: the smallest
    node reachable, one row for each node of an edge. A round is four shuffles, and none is run once every node hangs
    on its root alone; edges between rounds lie in the checkpoint folder, nothing but that state reaches the driver.
    """
    e = cut(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))
        if low.where("below > 1 or (below > 0 and above > 0)").isEmpty():
            break
        # a node has few smaller neighbours left after the large star, so both sides of the small star share one shuffle
        large = both.join(low.select("u", "m"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        e = cut(small)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
