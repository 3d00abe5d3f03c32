"""Running values of keys by windows and over ranges, against plain Python, with a key that holds half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from postmill import catalogue
from postmill.operators import history, scans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [scans.MOST_ROWS, 20])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, monkeypatch, most, inclusive):
    monkeypatch.setattr(scans, "MOST_ROWS", most)
    r = random.Random(8)
    rows = [("hot" if i % 2 else r.choice(["a", "b", None]), i, r.choice([None, 1, 2, 5]), r.choice([None, None, "x", "y"])) for i in range(400)]
    r.shuffle(rows)
    want, held = {}, {}
    for k, i, v, s in sorted(rows, key=lambda x: x[1]):
        total, n, top, last = held.get(k, (None, 0, None, None))
        after = (v if total is None else total + (v or 0), n + (v is not None), max((x for x in (top, v) if x is not None), default=None), s or last)
        want[i], held[k] = after if inclusive else (total, n, top, last), after
    df = spark.createDataFrame(rows, "k string, i long, v long, s string").repartition(7)
    measures = {"total": ("sum", F.col("v")), "n": ("count", F.col("v")), "top": ("max", F.col("v")), "last": ("last", F.col("s"))}
    got = scans.running(df, ["k"], ["i"], measures, inclusive)
    assert got.columns == ["k", "i", "v", "s", "total", "n", "top", "last"]
    assert {x["i"]: (x["total"], x["n"], x["top"], x["last"]) for x in got.collect()} == want
    assert scans.running(df.limit(0), ["k"], ["i"], measures, inclusive).count() == 0


def test_a_hot_key_is_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(scans, "MOST_ROWS", 20)
    seen = []
    real = scans.kept
    monkeypatch.setattr(scans, "kept", lambda df, label: seen.append(real(df, label)) or seen[-1])
    scans.running(spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("i")), ["k"], ["i"], {"n": ("count", F.col("i"))})
    sizes = [x["count"] for x in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) > 100 and max(sizes) <= 40


def test_history_is_the_same_over_ranges(spark, monkeypatch):
    f = catalogue.fetches(spark, SF).withColumn("finished_us", F.unix_micros("finished_at")).withColumn("started_us", F.unix_micros("started_at")).withColumn("initial_status", F.lit("active"))
    f = f.withColumn("endpoint_id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("endpoint_id")))  # one endpoint has half of all attempts
    found = []
    for most in (scans.MOST_ROWS, 20):
        monkeypatch.setattr(scans, "MOST_ROWS", most)
        averages = history.prior_average(f, 20)
        rows = history.stale(averages).select("id", "stale", "prior_avg", "suspicious_zero").collect()
        states = history.endpoint_health(averages.withColumn("suspicious_zero", F.col("complete") & (F.col("seen") < 20))).select("id", "endpoint_status", "marked_failing", "marked_active").collect()
        found.append((sorted(rows, key=str), sorted(states, key=str)))
    assert found[0] == found[1] and len(found[0][0]) == f.count()


def test_means_are_compared_exactly(spark):
    rows = [(i, 1, 20, True, 10 * i, 10 * i + 1, 200) for i in range(1, 60)] + [(60, 1, 21, True, 600, 601, 200), (61, 1, 0, True, 700, 701, 200), (70, 2, 20, True, 1, 2, 200), (71, 2, 0, True, 5, 6, 200)]
    f = spark.createDataFrame(rows, "id long, endpoint_id long, seen long, complete boolean, started_us long, finished_us long, http_status int")
    f = f.withColumn("seen", F.when(F.col("id") == 60, F.expr("20.0001")).otherwise(F.col("seen")).cast("decimal(20,4)"))
    got = {r["id"]: r["suspicious_zero"] for r in history.prior_average(f, 20).collect()}
    assert got[61] and not got[71]  # a mean of 20.00000167 is above 20, though it is 20.000002 or less when rounded
