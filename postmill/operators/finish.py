"""How runs end: a run's recorded fetch decides, else what stopped it before; a run that has ended is only checked and replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs as R
from .binding import AFTER_FETCH, ENDED, INCOMPATIBLE, KEYS, counts_shape, finish_time, reserved_counts, terminal_step

# fixed values: kinds of transport failures that a board's client tells apart, codes of failures by the step that they end at
TRANSPORT_KINDS = {
    "greenhouse": "connect_timeout read_timeout connect_error protocol_error".split(),
    "lever": "connect_timeout read_timeout write_timeout pool_timeout connect_error read_error write_error protocol_error".split(),
}
CLOCK = "runner.clock_invalid"
AT_SNAPSHOT = tuple(f"runner.{x}" for x in "endpoint_paused endpoint_retired adapter_deferred adapter_not_implemented adapter_unsupported endpoint_malformed endpoint_policy adapter_registry_defect adapter_defect cancelled".split())
AT_FETCH = (*AFTER_FETCH, R.RESULT_INVALID)
RECORDED, FETCHED, SNAPSHOTTED = "source_fetch_recorded", "adapter_fetch_completed", "endpoint_snapshotted"


def transport_code(category: Column) -> Column:
    """The closed code of a client's transport category; null for any other text."""
    codes = {f"{board}.transport.{k}": f"adapter.{k}" for board, kinds in TRANSPORT_KINDS.items() for k in kinds} | {f"{board}.transport_error": "adapter.transport_error" for board in TRANSPORT_KINDS}
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[category]


def attempt_counts(endpoint_id: Column, adapter_kind: Column, fetch: dict[str, Column]) -> Column:
    """The counts of a run that has fetched, as JSON; fetch: fetch_id, http_status, seen, new, changed."""
    values = (F.lit(1), endpoint_id, adapter_kind, F.lit(True), fetch["fetch_id"], fetch["http_status"], fetch["seen"], fetch["new"], fetch["changed"])
    return F.to_json(F.struct(*[v.alias(k) for k, v in zip(KEYS, values, strict=True)]), {"ignoreNullFields": "false"})


def ended_unfetched(status: Column, step: Column, code: Column, shape: Column) -> Column:
    """True if a run that ended without a fetch could have ended so: failed, by a code that ends at its step, its counts still reserved."""
    at = (code.isin(*AT_SNAPSHOT) & (step == SNAPSHOTTED)) | (code.isin(*AT_FETCH) & (step == FETCHED)) | ((code == CLOCK) & step.isin(SNAPSHOTTED, FETCHED))
    return F.coalesce((status == "failed") & at & (shape == "reserved"), F.lit(False))


_FETCH = ("fetch_id", "status", "http_status", "seen", "new", "changed")


def finish(runs: DataFrame, fetches: DataFrame, failures: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """(run_id, endpoint_id, result, status, step, failure, counts, finished_at) of each bound run.

    runs: run_id, endpoint_id, adapter_kind, status, step, error (JSON), counts (JSON), started_at, finished_at, clock (the time
    now, null if it can't be read). fetches: run_id, endpoint_id, fetch_id, status, http_status, seen, new, changed, error,
    finished_at. failures: run_id, code, fetched, floor (a time that the run can't end before, null for its start).
    fresh: run_id, endpoint_id, the columns of a fetch and code, as the attempt itself reported them. Ids are unique in each, as are
    run and endpoint in fetches; more columns are ignored.

    result is `replayed` for a run that had ended and agrees with its fetch, or could have ended without one; `incompatible` if it
    does not (its own fields stay, failure says why); `finished` for one that ends now; `running` if nothing is known of it yet.
    A recorded fetch goes before a failure. A report that differs from its record and a clock that is null or behind make a
    finished run fail, the clock last; the time is then that of the fetch or the floor.
    """
    taken = [F.col(c).alias(f"f_{c}") for c in (*_FETCH, "error", "finished_at")]
    j = runs.select("run_id", "endpoint_id", "adapter_kind", "status", "step", "error", "counts", "started_at", "finished_at", "clock")
    j = j.join(fetches.select("run_id", "endpoint_id", *taken, F.lit(True).alias("has_fetch")), ["run_id", "endpoint_id"], "left")
    j = j.join(failures.select("run_id", F.col("code").alias("stop"), "fetched", "floor"), "run_id", "left")
    j = j.withColumn("f_code", R.reason(F.col("f_error")))
    agrees = F.lit(True)
    if fresh is not None:
        said = fresh.select("run_id", F.struct("endpoint_id", *_FETCH, "code").alias("said"))
        j = j.join(said, "run_id", "left")
        record = F.struct(F.col("endpoint_id"), *[F.col(f"f_{c}").alias(c) for c in _FETCH], F.col("f_code").alias("code"))
        agrees = F.col("said").isNull() | F.col("said").eqNullSafe(record)
    fetch = {c: F.col(f"f_{c}") for c in _FETCH}
    has_fetch, over = F.coalesce("has_fetch", F.lit(False)), F.col("status").isin(*ENDED)
    sound = (fetch["fetch_id"] > 0) & (fetch["seen"] >= 0) & (fetch["new"] >= 0) & (fetch["changed"] >= 0)
    j = j.withColumn("m", R.matrix(fetch["status"], fetch["http_status"], F.col("f_code"), fetch["seen"], sound))
    j = j.withColumn("took", attempt_counts(F.col("endpoint_id"), F.col("adapter_kind"), fetch)).withColumn("code", F.get_json_object("error", "$.code"))

    # runs that had ended
    excused = F.coalesce(F.col("code").isin(CLOCK, R.RESULT_INVALID), F.lit(False))
    same_counts = F.to_json(F.try_parse_json("counts")).eqNullSafe(F.to_json(F.try_parse_json("took")))
    as_fetched = same_counts & F.col("step").eqNullSafe(F.lit(RECORDED)) & F.when(excused, F.col("status") == "failed").otherwise((F.col("status") == F.col("m.status")) & F.col("code").eqNullSafe(F.col("m.failure")))
    unfetched = ended_unfetched(F.col("status"), F.col("step"), F.col("code"), counts_shape(F.col("counts"), F.col("endpoint_id"), F.col("adapter_kind")))
    replays = F.when(has_fetch, as_fetched).otherwise(unfetched)

    # runs that end now
    stops = F.col("stop").isNotNull()
    ends = finish_time(F.col("clock"), F.when(has_fetch, F.col("f_finished_at")).otherwise(F.coalesce("floor", "started_at")))
    j = j.withColumn("ends", ends).withColumn("agrees", agrees)
    timely = F.col("ends.clock_valid")
    failure = F.when(~timely, CLOCK).when(has_fetch, F.when(~F.col("agrees"), R.RESULT_INVALID).otherwise(F.col("m.failure"))).otherwise(F.col("stop"))
    status = F.when(has_fetch & timely & F.col("agrees"), F.col("m.status")).otherwise("failed")
    now = (has_fetch | stops) & ~over
    result = F.when(over, F.when(replays, "replayed").otherwise("incompatible")).when(now, "finished").otherwise("running")
    j = j.select(
        "run_id", "endpoint_id", result.alias("result"), F.when(now, status).otherwise(F.col("status")).alias("status"),
        F.when(now, F.when(has_fetch, RECORDED).otherwise(terminal_step(failure, F.col("fetched")))).otherwise(F.col("step")).alias("step"),
        F.when(over & ~replays, INCOMPATIBLE).when(now, failure).otherwise(F.col("code")).alias("failure"),
        F.when(now, F.when(has_fetch, F.col("took")).otherwise(reserved_counts(F.col("endpoint_id"), F.col("adapter_kind")))).otherwise(F.col("counts")).alias("counts"),
        F.when(now, F.col("ends.finished_at")).otherwise(F.col("finished_at")).alias("finished_at"),
    )
    return j
