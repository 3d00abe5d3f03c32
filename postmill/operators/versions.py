"""Content versions with ids of their own, and the log of the runs that made them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merge, runs
from .scans import running

KEY = ["endpoint_id", "external_id"]


def numbered(rows: DataFrame, order: list[str], after: int = 0, name: str = "id") -> DataFrame:
    """Adds gapless numbers from after + 1 in the given order, which tells rows apart: the same under reruns.

    Many rows are counted by ranges, so no task ever has all of them (scans.running).
    """
    n = running(rows.withColumn("_all", F.lit(0)), ["_all"], order, {"_n": ("count", F.lit(1))})
    return n.withColumn(name, F.col("_n") + after).drop("_all", "_n")


@dataclass
class Recorded:
    """state and versions after a batch of runs, one log row for each run, and the versions that these runs created."""

    state: DataFrame
    versions: DataFrame
    log: DataFrame
    created: DataFrame


def record(state: DataFrame, versions: DataFrame, fetches: DataFrame, observed: DataFrame) -> Recorded:
    """Merge one fetch of each endpoint, give the new versions ids, and write the log.

    state, observed: as merge.merge() has them. versions: endpoint_id, external_id, content_hash, version_id, run_id,
    observed_at. fetches: merge.merge()'s, with run_id, etag, last_modified, `transport` (the code of a failure to fetch) and
    `invalid` (the fetch may not be stored). A text that comes back has its version already: the listing points at the old id.

    Log: a fetch that failed has status failed and no counts, without any HTTP facts where nothing was fetched; a stale one
    is incomplete and only says how many listings it saw; a complete 200 that isn't suspicious is complete.
    """
    failed = F.col("transport").isNotNull() | F.col("invalid")
    sound = fetches.where(~F.coalesce(failed, F.lit(False)))
    merged = merge.merge(state, versions.select(*KEY, "content_hash", "observed_at"), sound, observed)
    most = versions.agg(F.max("version_id")).first()[0] or 0
    made = merged.fresh.join(fetches.select("endpoint_id", "run_id"), "endpoint_id")
    created = numbered(made, KEY, most, "version_id").select(*KEY, "content_hash", "version_id", "run_id", "observed_at")
    whole = versions.select(*created.columns).unionByName(created)
    pointed = merged.state.join(whole.select(*KEY, "content_hash", F.col("version_id").alias("current_version_id")), [*KEY, "content_hash"], "left")
    sums = created.groupBy("endpoint_id").agg(F.count("*").alias("versions_created"))
    counted = [c for c in ("created", "changed", "updated", "closed", "reopened")]
    seen = observed.groupBy("endpoint_id").agg(F.count("*").alias("n"))  # of stale fetches, too
    log = fetches.join(merged.log.select("endpoint_id", *counted), "endpoint_id", "left").join(sums, "endpoint_id", "left").join(seen, "endpoint_id", "left")
    bad, unreached = F.coalesce(failed, F.lit(False)), F.col("transport").isNotNull()
    complete = F.col("complete") & (F.col("http_status") == 200) & ~F.col("stale") & ~F.col("suspicious_zero")
    code = F.when(F.col("invalid"), runs.INVALID).when(unreached, F.col("transport")).when(F.col("stale"), runs.STALE).when(F.col("suspicious_zero"), runs.SUSPICIOUS)
    fact = lambda c: F.when(~unreached | F.col("invalid"), F.col(c)).alias(c)
    log = log.select(
        "run_id", "endpoint_id", F.when(bad, "failed").when(complete, "complete").otherwise("incomplete").alias("status"), code.alias("code"), fact("http_status"), fact("etag"), fact("last_modified"),
        F.when(bad | (F.col("http_status") == 304), 0).otherwise(F.coalesce("n", F.lit(0))).alias("postings_seen"),
        *[F.coalesce(c, F.lit(0)).alias(f"postings_{c}") for c in counted], F.coalesce("versions_created", F.lit(0)).alias("versions_created"),
    )
    return Recorded(pointed, whole, log, created)


def of_run(versions: DataFrame, state: DataFrame, wanted: DataFrame) -> DataFrame:
    """The versions that each wanted (run_id, endpoint_id) created, numbered by id from 1: what a replay of it reports."""
    found = versions.join(state.select(*KEY), KEY, "left_semi").join(wanted.select("run_id", "endpoint_id").distinct(), ["run_id", "endpoint_id"], "left_semi")
    return running(found, ["run_id", "endpoint_id"], ["version_id"], {"place": ("count", F.lit(1))})
