"""Small helpers shared by the operators: table reading, tables in the shared folder, components of a link table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words and is stripped from line ends: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own switch to delete the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, one process alone may use its own."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place and re.match(r"local(\[|$)", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postmill-"))
        place = sc.getCheckpointDir()
    if not place:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing of it.

    What was shuffled to make the table isn't needed any more and goes with the query.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stored() made, once all that needs it is stored itself."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components: (node, component), component the smallest node reachable; only nodes that have links.

    Alternating large-star and small-star rounds on the link table, each round stored in the shared folder; ends when
    every node points at its root. A node's links are never gathered in one group: both steps are a min() aggregate, which
    combines before the shuffle, and a join that adaptive execution may split.
    """
    edges = stored(
        links.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct(), "links"
    )
    while True:  # each round lowers what some node points at, so the rounds end
        # large star: every neighbour above a node points at the least of the node and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the lower neighbours of a node, and the node, point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = (
            moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        after = stored(small, "links")
        discard(edges)
        edges = after
        # settled when no node has two links or stands on both sides: one link for each node, roots only on the right
        sides = edges.select(F.col("a").alias("node"), F.lit(1).alias("left"), F.lit(0).alias("right")).union(edges.select("b", F.lit(0), F.lit(1)))
        open_ = sides.groupBy("node").agg(F.sum("left").alias("left"), F.max("right").alias("right")).where("left > 1 or left > 0 and right > 0")
        if not open_.limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
