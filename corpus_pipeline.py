"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents, other columns are not read. Stages are written as Parquet in the shared folder and read again; a
stage's table is deleted once its successor's is written. Rows are kept by their own verdict, so null and repeated ids
are rows like any others; null and empty texts fail the base rules of the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from postmill.llm.common import BLANK_RUN, discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep, each row by its own verdict; ids may be null or repeated."""
    rules = quality_rules.learn_rules(quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    rows = docs.select(F.struct(*COLUMNS).alias("record"), "text")
    return quality_rules.judge(rows, rules, "record").where("kept").select("doc_id.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, but for the largest id that holds one; n_chars follows."""
    cleaned = line_dedup.LineState.build(docs).clean(docs)
    return cleaned.select("record.doc_id", "text", "record.lang", "record.source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of least id, null ids last; rows without words all stay.

    Where ids are null or repeated, rows are known by a number instead, so texts that only share an id are no duplicates.
    Rows of such ids that agree in all columns are copies, of which one stays.
    """
    docs = docs.select(*COLUMNS)
    words = F.coalesce(F.regexp_replace("text", BLANK_RUN, "") != "", F.lit(False))
    some, wordless = docs.where(words), docs.where(~words)
    repeated = stored(some.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    if not some.where("doc_id is null").limit(1).count() and not repeated.limit(1).count():
        classes, _ = jaccard_join.jaccard_classes(some)
        kept = classes.where("doc_id = component_id").select("doc_id")
        return some.join(kept, "doc_id", "left_semi").unionByName(wordless)
    shared = some.join(repeated, F.col("doc_id") == F.col("again"), "left")
    alone = shared.where("doc_id is not null and again is null").select(*COLUMNS)
    rows = alone.unionByName(shared.where("doc_id is null or again is not null").select(*COLUMNS).dropDuplicates())
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    classes, _ = jaccard_join.jaccard_classes(rows, id_col="row")
    classes = classes.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    least = classes.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    return rows.join(least.select("least.row"), "row", "left_semi").select(*COLUMNS).unionByName(wordless)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their targets: a document is a row for each time that it is taken."""
    return mixing.mixture(mixing.mix(docs)).select(*[f"record.{c}" for c in COLUMNS])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixed), ("packing", packed),
]

#: The rules are learned, the mix and the packing are chosen by hashes: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
