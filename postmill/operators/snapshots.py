"""Inputs of evaluations: what a listing is judged on, whether it is sound, and whether a stored input still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluations import HEX

# fixed values: codes and states of actions
NOT_FOUND, NO_VERSION, UNSOUND, CLOSED = "filter.posting_not_found", "filter.current_version_invalid", "filter.persisted_input_invalid", "filter.posting_closed"
UNSUPPORTED, STALE = "filter.policy_unsupported", "filter.input_stale"
ACTIONS = ("recommended", "restored", "expired", "skipped", "applied")


def snapshot(targets: DataFrame, postings: DataFrame, versions: DataFrame, companies: DataFrame, actions: DataFrame) -> DataFrame:
    """For each posting_id of targets its input and `code`: why it can't be evaluated, else null.

    postings: posting_id, company_id, current_version_id, closed_at, first_seen_at, source_published_at. versions: version_id,
    posting_id, title, description_md, content_hash, locations (structs with a label). companies: company_id, blocked. actions:
    digest_item_id, posting_id, score_id, score_version_id, version_posting_id, state. Ids are unique; only the version that the
    posting names and owns counts. Actions are added up by posting, never collected.
    """
    v = versions.select(F.col("posting_id"), F.col("version_id").alias("current_version_id"), "title", "description_md", "content_hash", "locations", F.lit(True).alias("has_version"))
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    sound = positive("digest_item_id") & positive("score_id") & positive("score_version_id") & F.col("version_posting_id").eqNullSafe(F.col("posting_id")) & F.coalesce(F.col("state").isin(*ACTIONS), F.lit(False))
    bad = actions.groupBy("posting_id").agg(F.bool_or(~sound).alias("bad_action"), F.count("*").alias("actions"))
    j = targets.select("posting_id").join(postings.withColumn("has_posting", F.lit(True)), "posting_id", "left").join(v, ["posting_id", "current_version_id"], "left")
    j = j.join(companies.select("company_id", "blocked"), "company_id", "left").join(bad, "posting_id", "left")
    placed = F.coalesce(F.forall("locations", lambda p: F.coalesce(p["label"] != "", F.lit(False))), F.lit(False))
    text = (F.coalesce(F.col("title") != "", F.lit(False))) & F.coalesce(F.col("content_hash").rlike(HEX), F.lit(False)) & placed
    code = (
        F.when(F.col("has_posting").isNull(), NOT_FOUND).when(~positive("current_version_id") | F.col("has_version").isNull(), NO_VERSION).when(F.col("blocked").isNull(), UNSOUND)
        .when(F.col("closed_at").isNotNull(), CLOSED).when(F.col("first_seen_at").isNull() | ~text | F.coalesce("bad_action", F.lit(False)), UNSOUND)
    )
    return j.select(
        "posting_id", code.alias("code"), "company_id", "current_version_id", "closed_at", "first_seen_at", "source_published_at", F.col("blocked").alias("company_blocked"), "title", "description_md",
        "content_hash", "locations", F.coalesce("actions", F.lit(0)).alias("actions"),
    )


def stale(records: DataFrame, recorded: DataFrame, postings: DataFrame, versions: DataFrame, companies: DataFrame, actions: DataFrame, policy_hash: str) -> DataFrame:
    """(posting_id, code, differs) of stored inputs: why an input no longer holds and the first thing that differs, else nulls.

    records: posting_id (once each), policy_hash, version_id, run_id, content_hash, closed_at, company_blocked, first_seen_at,
    source_published_at. recorded: the actions in the input, posting_id, digest_item_id, score_version_id, state; actions as they are
    now have the same columns. versions also hold run_id, postings company_id. Equal actions are counted on both sides, so that a
    posting with very many is never one group.
    """
    fact = ["posting_id", "digest_item_id", "score_version_id", "state"]
    both = recorded.select(*fact, F.lit(1).alias("n")).unionByName(actions.select(*fact, F.lit(-1).alias("n")))
    moved = both.groupBy(*fact).agg(F.sum("n").alias("n")).where("n <> 0").select("posting_id").distinct().withColumn("moved", F.lit(True))
    p = postings.select("posting_id", "company_id", "current_version_id", *[F.col(c).alias(f"_{c}") for c in ("closed_at", "first_seen_at", "source_published_at")])
    v = versions.select("posting_id", F.col("version_id").alias("current_version_id"), F.col("content_hash").alias("_content_hash"), F.col("run_id").alias("_run_id"))
    j = records.join(p, "posting_id", "left").join(v, ["posting_id", "current_version_id"], "left").join(companies.select("company_id", F.col("blocked").alias("_company_blocked")), "company_id", "left")
    j = j.join(moved, "posting_id", "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    differs = F.when(~F.col("policy_hash").eqNullSafe(F.lit(policy_hash)), "policy").when(~same("run_id"), "run").when(~F.col("version_id").eqNullSafe(F.col("current_version_id")), "version")
    for c in ("content_hash", "closed_at", "company_blocked", "first_seen_at", "source_published_at"):
        differs = differs.when(~same(c), c)
    j = j.withColumn("differs", differs.when(F.col("moved"), "actions"))
    return j.select("posting_id", F.when(F.col("differs") == "policy", UNSUPPORTED).when(F.col("differs").isNotNull(), STALE).alias("code"), "differs")
