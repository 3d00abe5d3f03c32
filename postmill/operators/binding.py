"""Which run a request works on: a new one, one that waits, or one that has ended and is only replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.listings import kind, string, whole

# fixed values: keys of a run's counts, states of ended runs, failure codes and steps
COUNTED = ("postings_seen", "postings_new", "postings_changed")
KEYS = ("schema_version", "endpoint_id", "adapter_kind", "attempt_recorded", "source_fetch_id", "http_status", *COUNTED)
ENDED = ("succeeded", "partial", "failed")
MALFORMED = "malformed"
RUN_MISSING, ENDPOINT_MISSING, INCOMPATIBLE = "runner.pipeline_run_not_found", "runner.source_endpoint_not_found", "runner.pipeline_run_incompatible"
DELETED, CHANGED = "runner.endpoint_deleted", "runner.endpoint_changed"
AFTER_FETCH = (DELETED, CHANGED, "runner.ingestion_database_error", "runner.ingestion_input_error", "runner.ingestion_target_error")


def reserved_counts(endpoint_id: Column, adapter_kind: Column) -> Column:
    """The counts of a run that has not fetched yet, as JSON."""
    none, zero = F.lit(None).cast("long"), F.lit(0)
    values = (F.lit(1), endpoint_id, adapter_kind, F.lit(False), none, none, zero, zero, zero)
    return F.to_json(F.struct(*[v.alias(k) for k, v in zip(KEYS, values, strict=True)]), {"ignoreNullFields": "false"})


def counts_shape(counts: Column, endpoint_id: Column, adapter_kind: Column) -> Column:
    """`reserved` or `attempt` for the JSON of a run's counts; null if it is of neither shape or of another endpoint or kind."""
    v = F.try_parse_json(counts)
    number = lambda k: whole(v, f"$.{k}").cast("decimal(38,0)")
    every = lambda test: test(number(COUNTED[0])) & test(number(COUNTED[1])) & test(number(COUNTED[2]))
    null = lambda k: kind(v, f"$.{k}") == "VOID"
    own = F.array_sort(F.json_object_keys(counts)).eqNullSafe(F.array(*map(F.lit, sorted(KEYS)))) & (number("schema_version") == 1) & (number("endpoint_id") == endpoint_id)
    own = own & (string(v, "$.adapter_kind") == adapter_kind)
    recorded = F.when(kind(v, "$.attempt_recorded") == "BOOLEAN", F.try_variant_get(v, "$.attempt_recorded", "boolean"))
    reserved = ~recorded & null("source_fetch_id") & null("http_status") & every(lambda n: n == 0)
    attempt = recorded & (number("source_fetch_id") > 0) & (null("http_status") | number("http_status").between(100, 599)) & every(lambda n: n >= 0)
    return F.when(own & reserved, "reserved").when(own & attempt, "attempt")


def compatible(shape: Column, config_version: Column) -> Column:
    """True if a stored run may be bound: started by hand under that configuration, its times in order, its fields those of its status."""
    times = F.col("started_at").isNotNull() & (F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("started_at")))
    waits = (F.col("status") == "running") & (shape == "reserved") & F.col("finished_at").isNull() & F.col("step").isNull() & F.col("error").isNull()
    ended = F.col("status").isin(*ENDED) & F.col("finished_at").isNotNull() & shape.isNotNull()
    return F.coalesce(times & (F.col("run_kind") == "manual") & (F.col("config_version") == config_version) & (waits | ended), F.lit(False))


def bind(requests: DataFrame, runs: DataFrame, endpoints: DataFrame, attempts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(request_id, endpoint_id, run_id, adapter_kind, state, code, counts) of each request.

    requests: request_id, endpoint_id, run_id (null asks for a new run), config_version. runs: run_id, run_kind, status,
    config_version, counts, step, error, started_at, finished_at. endpoints: endpoint_id, kind. attempts: run_id, endpoint_id of
    recorded fetches. state is `created` (counts are those to store), `bound`, `replay` for a run that has ended or fetched,
    `failed` for a bound run whose endpoint is gone or of another kind, or `rejected`; code says why in the last two. A kind that
    is none of `kinds` counts as malformed. Ids of runs and endpoints are unique; requests may repeat, and each is judged by itself.
    """
    known = lambda c: F.when(c.isin(*kinds), c).otherwise(MALFORMED)
    wanted = requests.select("request_id", "endpoint_id", "run_id", F.col("config_version").alias("wanted"))
    own = runs.select("run_id", "run_kind", "status", "config_version", "counts", "step", "error", "started_at", "finished_at", F.lit(True).alias("has_run"))
    there = endpoints.select("endpoint_id", known(F.col("kind")).alias("now"), F.lit(True).alias("has_endpoint"))
    fetched = attempts.select("run_id", "endpoint_id").distinct().withColumn("fetched", F.lit(True))
    j = wanted.join(own, "run_id", "left").join(there, "endpoint_id", "left").join(fetched, ["run_id", "endpoint_id"], "left")
    stored = string(F.try_parse_json("counts"), "$.adapter_kind")
    j = j.withColumn("stored", F.when(stored.isin(*kinds, MALFORMED), stored))
    j = j.withColumn("fits", compatible(counts_shape(F.col("counts"), F.col("endpoint_id"), F.col("stored")), F.col("wanted")))
    is_new, over = F.col("run_id").isNull(), F.col("status").isin(*ENDED) | F.coalesce("fetched", F.lit(False))
    code = (
        F.when(is_new, F.when(F.col("has_endpoint").isNull(), ENDPOINT_MISSING)).when(F.col("has_run").isNull(), RUN_MISSING).when(~F.col("fits"), INCOMPATIBLE).when(over, F.lit(None))
        .when(F.col("has_endpoint").isNull(), DELETED).when(F.col("now") != F.col("stored"), CHANGED)
    )
    j = j.withColumn("code", code.cast("string")).withColumn("adapter_kind", F.when(is_new, F.col("now")).otherwise(F.col("stored")))
    state = F.when(F.col("code").isin(DELETED, CHANGED), "failed").when(F.col("code").isNotNull(), "rejected").when(is_new, "created").when(over, "replay").otherwise("bound")
    fresh = F.when(is_new & F.col("code").isNull(), reserved_counts(F.col("endpoint_id"), F.col("now"))).otherwise(F.col("counts"))
    return j.select("request_id", "endpoint_id", "run_id", "adapter_kind", state.alias("state"), "code", fresh.alias("counts"))


def recheck(snapshots: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(endpoint_id, code) after a fetch: why the endpoint is not what was snapshotted before it, else null. All columns of the snapshot count, null equals null."""
    columns = [c for c in snapshots.columns if c != "endpoint_id"]
    now = endpoints.select("endpoint_id", F.struct(*columns).alias("now"))
    j = snapshots.select("endpoint_id", F.struct(*columns).alias("before")).join(now, "endpoint_id", "left")
    return j.select("endpoint_id", F.when(F.col("now").isNull(), DELETED).when(~F.col("now").eqNullSafe(F.col("before")), CHANGED).alias("code"))


def terminal_step(code: Column, fetched: Column) -> Column:
    """The last step of a failed run: whether it came as far as a fetch."""
    return F.when(F.coalesce(fetched, F.lit(False)) | code.isin(*AFTER_FETCH), "adapter_fetch_completed").otherwise("endpoint_snapshotted")


def finish_time(clock: Column, floor: Column) -> Column:
    """(finished_at, clock_valid): never before the floor; a clock that is null or behind it is invalid."""
    sound = F.coalesce(clock >= floor, F.lit(False))
    return F.struct(F.when(sound, clock).otherwise(floor).alias("finished_at"), sound.alias("clock_valid"))
