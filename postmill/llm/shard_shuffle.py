"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into memory-sized buckets by a seeded hash. Pass two reads one bucket at a time, permutes
it with a seeded Fisher-Yates shuffle (Spark's shuffle() of an array) and deals the permuted records out. A record's rank
in the total order is its bucket's offset plus its place in the bucket; rank modulo the shard count is the shard, so the
shards' row counts differ by one at most (law `rows`). Only DataFrame functions are used. Copies of a text are separate
records and are dealt out like any others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS, SEED = 40, 20240229
#: Bytes of text that one bucket holds on average: a task has one bucket in memory, a few times over.
BUCKET_BYTES = 16 << 20


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def external_shuffle(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(shard int, slot long, record struct of all columns of docs), one row per input row.

    The same input, seed and bucket size give the same result. Columns of docs lie inside `record`, so that their names
    can't clash; they must be of types that can be ordered. Rows without an id are scattered by their text. An empty
    table gives an empty result.
    """
    of_bytes = docs.agg(F.sum(record_size(F.col(text_col)))).first()[0] or 0
    buckets = max(1, math.ceil(of_bytes / bucket_bytes))
    place = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col))).otherwise(F.xxhash64(F.lit(seed), F.col(text_col)))
    records = docs.select(F.pmod(place, F.lit(buckets)).cast("int").alias("bucket"), F.struct(*[docs[c] for c in docs.columns]).alias("record"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket: the only thing that one task sees of all data
    base = records.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # a bucket's offset travels with its records, so there is one shuffle and no join; a task has one bucket, none has two
    both = records.unionByName(base, allowMissingColumns=True).repartitionById(buckets, "bucket")
    one = F.when(F.col("record").isNotNull(), F.struct(F.xxhash64(F.lit(seed + 1), f"record.{id_col}").alias("k"), "record"))
    held = both.groupBy("bucket").agg(F.sort_array(F.collect_list(one)).alias("held"), F.max("base").alias("base"))
    dealt = held.select("base", F.posexplode(F.shuffle("held", seed)).alias("place", "one"))
    rank = F.col("base") + F.col("place")
    return dealt.select((rank % shards).cast("int").alias("shard"), F.floor(rank / shards).cast("long").alias("slot"), F.col("one.record").alias("record"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the records of external_shuffle() as Parquet, one folder per shard, in slot order within each file."""
    flat = shuffled.select("shard", "slot", "record").repartition("shard").sortWithinPartitions("shard", "slot")
    flat.write.partitionBy("shard").parquet(path)


def op5_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = external_shuffle(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return shuffled.select(
        F.col("record.doc_id").alias("doc_id"), record_size(F.col("record.text")).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
