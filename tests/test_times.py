"""ISO 8601 times against Python's own reader, and times in UTC whatever the session's zone."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from postmill.functions import canonical as C
from postmill.sources import listings

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def test_moments_are_those_of_python(spark):
    dates = ["2024-01-01", "20240229", "2023-02-29", "2024-W01-1", "2024W011", "2024-W01", "2020-W53-7", "2021-W53-1", "2024-W00-1", "2024-W01-0", "2024-W01-8", "2026-W53-4", "2019-W01-1", "2024-13-01"]
    times = ["T00:00:00Z", "T23:59:59+05:30", " 12:30-0800", "T1230Z", "T12Z", "T12:30:15.123456Z", "T12:30:15,5+00", "T24:01:00Z", "T12:61:00Z", "T12:30:15", ""]
    rows = [(d + t,) for d in dates for t in times] + [("",), ("x",), (None,), (" 2024-01-01T00:00:00Z ",)]
    got = spark.createDataFrame(rows, "t string").select("t", F.unix_micros(listings.moment(F.col("t"))).alias("us")).collect()
    for r in got:
        try:
            at = datetime.fromisoformat(r["t"].strip())
            want = (at - EPOCH) // (datetime.resolution) if at.tzinfo else None
        except (ValueError, AttributeError):
            want = None
        assert r["us"] == want, r["t"]


def test_written_times_are_utc(spark):
    one = spark.range(1).select(F.timestamp_micros(F.lit(1_700_000_000_123_456)).alias("t"), F.lit(None).cast("timestamp").alias("n"))
    for zone in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert tuple(one.select(C.rfc3339(F.col("t")), C.rfc3339(F.col("n"))).first()) == ("2023-11-14T22:13:20.123456Z", None)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_passwords_are_masked(spark):
    cases = {"postgresql://u:p%40ss@h:5432/d": "postgresql://u:***@h:5432/d", "postgresql://u@h/d": "postgresql://u@h/d", "postgresql://h/d": "postgresql://h/d", "postgresql://:p@h": "postgresql://:***@h", None: None}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", C.masked_url(F.col("u")).alias("m"))
    assert {r["u"]: r["m"] for r in rows.collect()} == cases
