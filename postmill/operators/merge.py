"""Set-based merge of one batch of fetches into listing state: at most one attempt of each endpoint in a batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import running


@dataclass
class Merged:
    """state: the next listing state. versions: all content versions. log: one row of counters for each fetch. fresh: the new versions."""

    state: DataFrame
    versions: DataFrame
    log: DataFrame
    fresh: DataFrame


def merge(state: DataFrame, versions: DataFrame, fetches: DataFrame, observed: DataFrame) -> Merged:
    """Merge observed listings of fetches into state.

    state: endpoint_id, external_id, content_hash, url, first_seen, last_seen, closed_at. versions: endpoint_id,
    external_id, content_hash, observed_at. fetches: endpoint_id, started_at, finished_at, complete, http_status,
    stale, suspicious_zero. observed: endpoint_id, external_id, content_hash, url. Stale attempts and 304s change
    nothing; incomplete attempts add and update but never close. A listing reopens if it is seen no earlier than it
    closed, and closes if a complete, unsuspicious 200 does not show it and it was last seen before that attempt began.
    """
    key = ["endpoint_id", "external_id"]
    live = fetches.where(~F.col("stale") & (F.col("http_status") != 304)).select("endpoint_id", "started_at", "finished_at", "complete", "http_status", "suspicious_zero")
    seen = observed.join(live, "endpoint_id").select(*key, F.col("content_hash").alias("new_hash"), F.col("url").alias("new_url"), F.lit(True).alias("seen"))
    joined = state.withColumn("known", F.lit(True)).join(seen, key, "full").join(live, "endpoint_id", "left")
    known, seen_ = F.coalesce(F.col("known"), F.lit(False)), F.coalesce(F.col("seen"), F.lit(False))
    changed = seen_ & (~known | (F.col("content_hash") != F.col("new_hash")))
    closes = (
        known & ~seen_ & F.col("closed_at").isNull() & F.col("complete") & (F.col("http_status") == 200) & ~F.col("suspicious_zero") & (F.col("last_seen") < F.col("started_at"))
    )
    reopens = known & seen_ & (F.col("closed_at") <= F.col("finished_at"))
    flags = joined.select(
        "*", changed.alias("is_changed"), F.coalesce(closes, F.lit(False)).alias("closes"), F.coalesce(reopens, F.lit(False)).alias("reopens"),
        (seen_ & ~known).alias("is_new"), seen_.alias("is_seen"),
    )
    # a listing counts as updated once, whatever it is that changes; one that was seen later already keeps its last_seen
    touched = known & (F.col("closes") | (F.col("is_seen") & (F.col("is_changed") | F.col("reopens") | (F.col("last_seen") < F.col("finished_at")))))
    flags = flags.withColumn("is_updated", F.coalesce(touched, F.lit(False)))
    after = flags.select(
        *key, F.when(F.col("is_changed"), F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("is_changed"), F.col("new_url")).otherwise(F.col("url")).alias("url"),
        F.coalesce("first_seen", "finished_at").alias("first_seen"),
        F.when(F.col("is_seen"), F.greatest("last_seen", "finished_at")).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.col("closes"), F.col("finished_at")).when(F.col("reopens"), F.lit(None)).otherwise(F.col("closed_at")).alias("closed_at"),
    )
    fresh = flags.where("is_changed").select(*key, F.col("new_hash").alias("content_hash"), F.col("finished_at").alias("observed_at"))
    fresh = fresh.join(versions, [*key, "content_hash"], "left_anti")  # a reverted text has its version already
    counts = flags.groupBy("endpoint_id").agg(
        F.count_if("is_seen").alias("seen"), F.count_if("is_new").alias("created"), F.count_if(F.col("is_changed") & ~F.col("is_new")).alias("changed"),
        F.count_if("closes").alias("closed"), F.count_if("reopens").alias("reopened"), F.count_if("is_updated").alias("updated"),
    )
    log = fetches.join(counts, "endpoint_id", "left").na.fill(0, ["seen", "created", "changed", "closed", "reopened", "updated"])
    return Merged(after, versions.unionByName(fresh), log, fresh)


def version_history(observations: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """Observations in order, which tells those of a key apart, to versions: is_new (content never seen for the key) and is_change (differs from the one before)."""
    first = observations.groupBy(key, content).agg(F.min(order).alias("_first"))  # combined before the shuffle
    same = observations[key].eqNullSafe(F.col("_key")) & observations[content].eqNullSafe(F.col("_content"))
    o = observations.join(first.select(F.col(key).alias("_key"), F.col(content).alias("_content"), "_first"), same)
    o = running(o.drop("_key", "_content"), [key], [order], {"_before": ("last", F.struct(content))}, inclusive=False)
    is_change = ~F.coalesce(F.col("_before")[content].eqNullSafe(F.col(content)) & F.col("_before").isNotNull(), F.lit(False))
    return o.withColumn("is_new", F.col(order) == F.col("_first")).withColumn("is_change", is_change).drop("_first", "_before")
