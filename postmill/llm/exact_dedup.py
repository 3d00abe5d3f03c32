"""Exact dedup by content sort.

Sampled splitters range-partition the texts, an external sort in each range puts equal texts side by side, and full
comparisons of neighbours form the groups. Only DataFrame functions are used.

A text with very many copies would fill one range. Such texts are found first by counting 64-bit hashes (combined before
the shuffle); their rows get a salt that is part of the sort key, so a group lies in up to SALTS ranges, each range keeps
one survivor, and the few survivors are compared again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: A text is heavy if 1/HEAVY_PARTS of all rows hold it, or HEAVY_MOST rows, but for fewer than HEAVY_LEAST rows or
#: 1/HEAVY_BOUND of all: a task never gets many more copies than HEAVY_MOST, and HEAVY_BOUND texts are heavy at most.
HEAVY_PARTS, HEAVY_LEAST, HEAVY_MOST, HEAVY_BOUND = 1000, 64, 10_000, 1_000_000
SALTS = 128
#: Characters of the text in the sort key; ties are ordered by hash, then compared whole.
PREFIX = 48


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the largest id stays; null ids come last, and of rows that agree in id and
    text exactly one stays. Other columns of docs are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    total = rows.count()
    limit = max(HEAVY_LEAST, min(total // HEAVY_PARTS, HEAVY_MOST), total // HEAVY_BOUND)
    heavy = rows.groupBy("h").count().where(F.col("count") >= limit).select("h", F.lit(True).alias("heavy"))
    salted = rows.join(F.broadcast(heavy), "h", "left").withColumn(  # HEAVY_BOUND rows at most, by the limit above
        "salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    )
    key = [F.substring("text", 1, PREFIX).alias("prefix"), "h", "salt"]
    ranged = (
        salted.select(*key, "text", "doc_id")
        .repartitionByRange("prefix", "h", "salt")
        .sortWithinPartitions("prefix", "h", "salt", "text", F.col("doc_id").desc())
    )
    near = Window.partitionBy("prefix", "h", "salt", "text").orderBy(F.col("doc_id").desc())
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select(
        "doc_id", "h", "salt", "text",
        F.first("doc_id").over(whole).alias("run_keep"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
        F.row_number().over(near).alias("place"),
    )
    # survivors of the salted runs: at most HEAVY_BOUND * SALTS rows, compared by their whole text
    merged = (
        runs.where("salt > 0 and place = 1").groupBy("text")
        .agg(F.max("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
        .select(F.sha2("text", 256).alias("text_sha256"), "all_keep", "all_size")
    )
    out = runs.select("doc_id", "salt", "run_keep", "run_size", "place", F.sha2("text", 256).alias("text_sha256"))
    out = out.join(F.broadcast(merged), "text_sha256", "left")  # HEAVY_BOUND rows at most
    keep = F.when(F.col("salt") > 0, F.col("all_keep")).otherwise(F.col("run_keep"))
    return out.select(
        "doc_id", keep.alias("keep_id"),
        F.when(F.col("salt") > 0, F.col("all_size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("place") == 1) & F.col("run_keep").eqNullSafe(keep)).alias("kept"), "text_sha256",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc) = 1 as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
