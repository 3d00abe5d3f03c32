"""Run outcomes and endpoint eligibility as conditional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligibility(status: Column, kind: Column, kinds: tuple[str, ...]) -> Column:
    """Why an endpoint may not run, or `eligible`."""
    return (
        F.when(status == "retired", "endpoint_retired").when(status == "paused", "endpoint_paused")
        .when(~kind.isin(*kinds), "unsupported_kind").otherwise("eligible")
    )


# fixed values: kinds of boards that wait for a decision or for an adapter, and the one that never gets one
DEFERRED, UNIMPLEMENTED, UNSUPPORTED = ("ashby",), ("workday", "workable", "smartrecruiters", "recruitee"), ("custom",)


def endpoint_refusal(status: Column, kind: Column, well_formed: Column) -> Column:
    """The code for which an endpoint may not run, the first that holds; null if it may."""
    said = lambda code: F.lit(f"runner.{code}")
    return (
        F.when(~F.coalesce(well_formed, F.lit(False)), said("endpoint_malformed")).when(status == "paused", said("endpoint_paused")).when(status == "retired", said("endpoint_retired"))
        .when(kind.isin(*DEFERRED), said("adapter_deferred")).when(kind.isin(*UNIMPLEMENTED), said("adapter_not_implemented")).when(kind.isin(*UNSUPPORTED), said("adapter_unsupported"))
    )


def outcome(http_status: Column, complete: Column, failed: Column, suspicious: Column) -> Column:
    """The run status that follows from a fetch."""
    return (
        F.when(failed, "failed").when(http_status == 304, "succeeded").when(http_status != 200, "failed")
        .when(suspicious, "partial").when(complete, "succeeded").otherwise("partial")
    )


def staleness(published: Column, first_seen: Column, as_of: Column, days: int = 45) -> Column:
    """pass, reject or invalid: exactly `days` old still passes, a date in the future is invalid."""
    when = F.coalesce(published, first_seen)
    return F.when(when > as_of, "invalid").when(when < as_of - F.expr(f"interval {days} days"), "reject").otherwise("pass")


def action(skipped: Column, applied: Column, expired_current: Column) -> Column:
    """The reason that holds first: skipped, applied, then expired where the linked version is the current one."""
    return F.when(skipped, "skipped").when(applied, "applied").when(expired_current, "expired").otherwise("none")


# fixed values: codes of reasons
SUSPICIOUS, STALE, INVALID = "ingestion.suspicious_zero", "ingestion.stale_observation", "ingestion.invalid_observation"
TRANSPORT = tuple(f"adapter.{x}" for x in "connect_timeout read_timeout write_timeout pool_timeout connect_error read_error write_error protocol_error tls_error transport_error".split())
RESULT_INVALID, INCOMPLETE = "runner.ingestion_result_invalid", "runner.fetch_incomplete"


def reason(error: Column) -> Column:
    """The code in an error's JSON, where it is one that a fetch may have; RESULT_INVALID for any other."""
    code = F.get_json_object(error, "$.code")
    return F.when(code.isNull() | code.isin(SUSPICIOUS, STALE, INVALID, *TRANSPORT), code).otherwise(RESULT_INVALID)


def matrix(fetch_status: Column, http_status: Column, code: Column, seen: Column, sound: Column) -> Column:
    """(status, failure) of a run, from its fetch.

    A fetch that is not sound (ids, HTTP status or counts out of range) or contradicts itself is an invalid result: complete
    without 200 or with a reason, failed without a reason or with one of an incomplete fetch, incomplete with a transport reason.
    An incomplete fetch is partial if it was stale, suspicious or saw anything; an unchanged one succeeds.
    """
    said = lambda status, failure: F.struct(F.lit(status).alias("status"), (F.lit(failure) if failure is None or isinstance(failure, str) else failure).cast("string").alias("failure"))
    wrong = said("failed", RESULT_INVALID)
    partial = F.coalesce(code.isin(SUSPICIOUS, STALE), F.lit(False))
    transport, none = F.coalesce(code.isin(*TRANSPORT), F.lit(False)), code.isNull()
    http = F.coalesce(http_status, F.lit(0))
    known = none | code.isin(SUSPICIOUS, STALE, INVALID, *TRANSPORT)
    of_complete = F.when((http == 200) & none, said("succeeded", None)).otherwise(wrong)
    of_failed = F.when(none | partial, wrong).otherwise(said("failed", code))
    of_incomplete = (
        F.when((http == 304) & none, said("succeeded", None)).when(partial, said("partial", code)).when(F.coalesce(code == INVALID, F.lit(False)), said("failed", code)).when(transport, wrong)
        .otherwise(F.when(seen > 0, said("partial", INCOMPLETE)).otherwise(said("failed", INCOMPLETE)))
    )
    ok = F.coalesce(sound, F.lit(False)) & known & (http_status.isNull() | http_status.between(100, 599))
    return F.when(~ok, wrong).when(fetch_status == "complete", of_complete).when(fetch_status == "failed", of_failed).when(fetch_status == "incomplete", of_incomplete).otherwise(wrong)


def terminal_problems(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, problem) of finished runs that do not follow from their fetch: the first of fetch_missing, target, counts, status, failure, step.

    stored and expected: run_id, endpoint_id, status, failure, counts (a struct), stored also step. Structs and failures are
    compared so that null equals null. Runs that agree are left out.
    """
    own = [F.col("run_id"), *[F.col(c).alias(f"_{c}") for c in ("endpoint_id", "status", "failure", "counts")]]
    j = stored.join(expected.select(*own, F.lit(True).alias("_there")), "run_id", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    problem = (
        F.when(F.col("_there").isNull(), "fetch_missing").when(differs("endpoint_id"), "target").when(differs("counts"), "counts").when(differs("status"), "status")
        .when(differs("failure"), "failure").when(~F.col("step").eqNullSafe(F.lit("source_fetch_recorded")), "step")
    )
    return j.select("run_id", problem.alias("problem")).where("problem is not null")
