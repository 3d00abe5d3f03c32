"""Tables in the folder that driver and executors share: what several later steps need is computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a local session alone may use a folder of its own."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place and re.match(r"local(\[|$)", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postmill-"))
        place = sc.getCheckpointDir()
    if not place:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: it isn't computed again, and a lost executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its scan has fewer partitions than there are (a small file is one): for work that costs far more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
