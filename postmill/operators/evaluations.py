"""Stored evaluations: what is written for a result, whether it is consistent, and replays against what was stored."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

HEX = r"^[0-9a-f]{64}\z"


def legal(outcome: Column) -> Column:
    """True if the policy knows the rule's status with that evidence."""
    known = [f"{r} {s} {e}" for r, by in rules.EVIDENCE.items() for s, es in by.items() for e in es]
    return F.concat_ws(" ", outcome["rule"], outcome["status"], outcome["evidence"]).isin(*known)


def problem(r: DataFrame) -> Column:
    """The first way in which a result contradicts itself, else null: order of rules, reasons, unknowns, eligibility, evidence."""
    of = lambda s, field: F.transform(F.filter(r["outcomes"], lambda o: o["status"] == s), lambda o: o[field])
    differs = lambda a, b: ~a.eqNullSafe(b)
    return (
        F.when(differs(F.transform(r["outcomes"], lambda o: o["rule"]), F.array(*map(F.lit, rules.RULES))), "rules").when(differs(r["rejections"], of("reject", "rule")), "reasons")
        .when(differs(r["unknowns"], of("unknown", "rule")), "unknowns").when(differs(r["eligible"], F.size(r["rejections"]) == 0), "eligible").when(~F.forall(r["outcomes"], legal), "evidence")
    )


def record(results: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evaluations, scores) of results without an error: one evaluation each, and one filter score for each that is rejected.

    inputs: posting_id, payload (canonical JSON). An evaluation is known by its input's hash, which covers the policy too; equal inputs
    are written once. The score's text is the output's canonical JSON.
    """
    # outcomes repeat so much that a table of them takes a few bytes a row; by its files' size it would be broadcast, and a row is 200 times that in memory
    r = results.where("error is null").hint("merge").join(inputs, "posting_id")
    output = F.to_json(F.struct("eligible", "outcomes", "rejections", "unknowns"))
    r = r.select("posting_id", F.sha2(F.concat_ws("\n", "policy_hash", "payload"), 256).alias("input_hash"), "policy_hash", "eligible", "rejections", "unknowns", "outcomes", output.alias("output"))
    r = r.dropDuplicates(["input_hash"]).withColumn("output_hash", F.sha2("output", 256))
    return r, scores(r)


def scores(evaluated: DataFrame) -> DataFrame:
    """The filter score of each rejected evaluation. Where both are used, keep the evaluations as a table first."""
    return evaluated.where("not eligible").select("posting_id", "input_hash", F.lit("filter").alias("stage"), F.lit("reject").alias("verdict"), F.col("output").alias("rationale"))


def replay(fresh: DataFrame, stored: DataFrame, scores: DataFrame) -> DataFrame:
    """(input_hash, state) of fresh evaluations against stored ones: new, same, or the first difference.

    A stored row differs by its target, its policy, its output's hash, a hash that is not the one of the output, or a score that is missing,
    doubled, of another text, or there though the evaluation is eligible. Scores are counted before they are joined.
    """
    kept = stored.select("input_hash", *[F.col(c).alias(f"_{c}") for c in ("posting_id", "policy_hash", "output", "output_hash", "eligible")])
    sums = scores.where("stage = 'filter'").groupBy("input_hash").agg(F.count("*").alias("n"), F.min("rationale").alias("least"), F.max("rationale").alias("most"))
    j = fresh.join(kept.hint("merge"), "input_hash", "left").join(sums.hint("merge"), "input_hash", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    n = F.coalesce("n", F.lit(0))
    bad_score = F.when(F.col("eligible"), n > 0).otherwise((n != 1) | ~F.col("least").eqNullSafe(F.col("output")) | ~F.col("most").eqNullSafe(F.col("output")))
    state = (
        F.when(F.col("_output_hash").isNull(), "new").when(differs("posting_id"), "target").when(differs("policy_hash"), "policy").when(~F.sha2("_output", 256).eqNullSafe(F.col("_output_hash")), "stored_hash")
        .when(differs("output_hash"), "output").when(bad_score, "score").otherwise("same")
    )
    return j.select("input_hash", state.alias("state"))


def checks(e: DataFrame) -> dict[str, Column]:
    """The constraints of stored evaluations, for integrity.checks()."""
    hashes = reduce(or_, [~F.col(c).rlike(HEX) for c in ("input_hash", "policy_hash", "output_hash")])
    return {"evaluation_ids": F.col("posting_id") > 0, "evaluation_hashes": ~hashes, "evaluation_outcomes": F.size("outcomes") == len(rules.RULES), "evaluation_eligible": F.col("eligible") == (F.size("rejections") == 0)}
