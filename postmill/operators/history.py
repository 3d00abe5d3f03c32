"""Fetch history: prior averages, suspicious zeros, stale attempts, validators, first attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from .scans import running


def prior_average(fetches: DataFrame, threshold: float) -> DataFrame:
    """For each attempt the mean of `seen` over the endpoint's complete attempts with status 200 that had finished when it started.

    Adds prior_avg (null without history) and suspicious_zero: complete, nothing seen, yet the mean is above threshold.
    Starts and finishes (started_us, finished_us) are put in one order for each endpoint, where a finish comes before a
    start of the same time; a running sum over the finishes is then read at each start. No self join is needed.
    """
    columns = [fetches[c] for c in fetches.columns]
    counted = F.when(F.col("complete") & (F.col("http_status") == 200), F.col("seen")).cast("decimal(20,4)")
    none = F.lit(None)
    moments = F.array(
        F.struct(F.col("finished_us").alias("at"), F.lit(0).alias("kind"), counted.alias("value")), F.struct(F.col("started_us").alias("at"), F.lit(1).alias("kind"), none.cast("decimal(20,4)").alias("value"))
    )
    rows = fetches.select("endpoint_id", F.struct(*columns).alias("fetch"), F.explode(moments).alias("m")).where("m.at is not null or m.kind = 1")
    rows = rows.select("endpoint_id", F.when(F.col("m.kind") == 1, F.col("fetch")).alias("fetch"), "m")
    # decimal sums: exact in any order
    rows = running(rows.select("endpoint_id", "fetch", "m.*"), ["endpoint_id"], ["at", "kind"], {"total": ("sum", F.col("value")), "n": ("count", F.col("value"))})
    rows = rows.where("kind = 1").select("fetch.*", "total", "n")
    # an attempt that finished at its own start is no history of itself
    own = F.coalesce((F.col("finished_us") <= F.col("started_us")) & F.col("complete") & (F.col("http_status") == 200) & F.col("seen").isNotNull(), F.lit(False))
    total, n = F.col("total") - F.when(own, F.col("seen").cast("decimal(20,4)")).otherwise(0), F.col("n") - own.cast("int")
    above = total > F.lit(threshold).cast("decimal(20,4)") * F.when(n > 0, n).cast("decimal(12,0)")  # exact; the mean is rounded for reading only
    out = rows.withColumn("prior_avg", F.round(total.cast("double") / F.when(n > 0, n), 6)).withColumn("suspicious_zero", F.col("complete") & (F.col("seen") == 0) & F.coalesce(above, F.lit(False)))
    return out.drop("total", "n")


def stale(fetches: DataFrame) -> DataFrame:
    """Adds stale: another attempt of the endpoint, earlier by id, had no finish or one after this attempt's start."""
    before = running(fetches, ["endpoint_id"], ["id"], {"_open": ("max", F.col("finished_at").isNull()), "_end": ("max", F.col("finished_at"))}, inclusive=False)
    return before.withColumn("stale", F.coalesce("_open", F.lit(False)) | F.coalesce(F.col("_end") > F.col("started_at"), F.lit(False))).drop("_open", "_end")


def validators(fetches: DataFrame, names: tuple[str, ...] = ("etag",)) -> DataFrame:
    """For each endpoint and validator the newest usable value: a 200 sets it even to null, a 304 only to a value."""
    def newest(v: str):
        usable = (F.col("http_status") == 200) | ((F.col("http_status") == 304) & F.col(v).isNotNull())
        return F.max_by(F.col(v), F.when(usable, F.struct("finished_at", "id"))).alias(v)

    return fetches.groupBy("endpoint_id").agg(*[newest(v) for v in names])


def first_attempts(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first attempt of each key owns it; later ones are replays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return attempts.withColumn("owner", F.row_number().over(w) == 1)


def latest(fetches: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key; a null time counts as newest, as in a descending sort with nulls first."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_first(), F.col(tie).desc())
    return fetches.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def endpoint_health(fetches: DataFrame) -> DataFrame:
    """Adds endpoint_status (after the attempt), marked_failing, marked_active and alert to attempts in order of finish and id.

    fetches: endpoint_id, id, finished_at, complete, http_status, seen, suspicious_zero, initial_status. The second suspicious zero
    in a row makes an endpoint failing and raises an alert, unless it is failing; a complete 200 with rows makes a failing
    one active. Both are events, so the state is the last event so far; nothing is iterated.
    """
    key, order = ["endpoint_id"], ["finished_at", "id"]
    f = fetches.withColumn("_suspicious", F.coalesce("suspicious_zero", F.lit(False)))
    f = running(f, key, order, {"_previous": ("last", F.col("_suspicious"))}, inclusive=False)
    f = f.withColumn("_fails", F.col("_suspicious") & F.coalesce("_previous", F.lit(False)))
    recovers = F.coalesce(F.col("complete") & (F.col("http_status") == 200) & (F.col("seen") > 0), F.lit(False))
    f = running(f.withColumn("_event", F.when(F.col("_fails"), "failing").when(recovers, "active")), key, order, {"_failed": ("max", F.col("_fails"))})
    # a recovery changes an endpoint only if it is failing, at first or by an event
    f = f.withColumn("_event", F.when(F.col("_failed") | (F.col("initial_status") == "failing"), F.col("_event")))
    f = running(f, key, order, {"_last": ("last", F.col("_event"))}, inclusive=False)
    f = f.withColumn("_before", F.coalesce("_last", "initial_status")).withColumn("endpoint_status", F.coalesce("_event", "_before"))
    f = f.withColumn("marked_failing", F.col("_fails") & (F.col("_before") != "failing")).withColumn("marked_active", F.coalesce(F.col("_event") == "active", F.lit(False)) & (F.col("_before") == "failing"))
    return f.withColumn("alert", F.col("marked_failing")).drop("_suspicious", "_previous", "_fails", "_failed", "_event", "_last", "_before")


def fetch_problems(fetches: DataFrame, listings: DataFrame) -> DataFrame:
    """fetch_id, problem (null if the fetch may be stored) and the facts of it that stay valid by themselves.

    fetches: fetch_id, http_status, complete, etag, last_modified. listings: fetch_id, external_id, title, locations (null
    where a label is blank). A fetch with a problem is stored as failed, with no counts.
    """
    ids = listings.select("fetch_id", C.stripped(F.col("external_id")).alias("id"), C.inline(F.col("title")).alias("title"), F.col("locations").isNull().alias("unplaced"))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    # by id first, so that a fetch with very many listings is added up in parts
    each = ids.groupBy("fetch_id", "id").agg(F.count("*").alias("n"), F.bool_or(blank("id")).alias("no_id"), F.bool_or(blank("title")).alias("no_title"), F.bool_or("unplaced").alias("no_place"))
    sums = each.groupBy("fetch_id").agg(F.sum("n").alias("n"), (F.max("n") > 1).alias("twice"), *[F.bool_or(c).alias(c) for c in ("no_id", "no_title", "no_place")])
    valid = F.coalesce(F.col("http_status").between(100, 599), F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    problem = (
        F.when(F.col("complete").isNull(), "completeness").when(~valid, "http_status").when(F.col("complete") & (F.col("http_status") != 200), "complete_non_200")
        .when((F.col("http_status") == 304) & (F.col("n") > 0), "rows_of_304").when(yes("no_id"), "empty_id").when(yes("no_title"), "empty_title").when(yes("no_place"), "empty_label").when(yes("twice"), "duplicate_id")
    )
    return fetches.join(sums, "fetch_id", "left").select("fetch_id", problem.alias("problem"), F.when(valid, F.col("http_status")).alias("http_status"), "etag", "last_modified")
