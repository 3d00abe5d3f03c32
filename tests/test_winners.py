"""Durable winners as a stream against the batch operators, over a restart, with replayed, late and doubled attempts."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import history
from postmill.streaming import winners

SHAPE = "id long, endpoint_id long, run_id string, started_s long, finished_s long, complete boolean, http_status int, seen long, suspicious_zero boolean"


def attempts(n, first=0):
    r = random.Random(first + 1)
    rows = []
    for i in range(first, first + n):
        suspicious = r.random() < 0.5
        rows.append((i, r.choice([1, 1, 1, 2, 3]), f"r{r.randint(0, 40)}", 10 * i - r.choice([1, 1, 25]), 10 * i, True, r.choice([200, 200, 304]), 0 if suspicious else 5, suspicious))
    return rows


def timed(df):
    return df.select("*", F.timestamp_seconds("started_s").alias("started_at"), F.timestamp_seconds("finished_s").alias("finished_at"))


def run(spark, tmp_path, retention=None):
    stream = timed(spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out = winners.durable_winners(stream, retention)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.fixture
def provider(spark):
    for k, v in winners.PROVIDER.items():
        spark.conf.set(k, v)
    yield
    for k in winners.PROVIDER:
        spark.conf.unset(k)


def test_winners_are_those_of_the_batch(spark, tmp_path, provider):
    parts = [attempts(40), attempts(30, 40), attempts(30, 70)]
    for part in parts[:1]:
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, tmp_path)
    for part in parts[1:]:  # a new query goes on from the checkpoint
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path).collect()
    whole = timed(spark.createDataFrame([r for p in parts for r in p], SHAPE))
    owned = history.first_attempts(whole, ["endpoint_id", "run_id"], ["id"])
    state = history.endpoint_health(history.stale(owned.where("owner")).withColumn("initial_status", F.lit("active")))
    want = {r["id"]: (r["stale"], r["endpoint_status"]) for r in state.collect()}
    assert len(got) == 100 == len({r["id"] for r in got})
    assert {r["id"]: (r["stale"], r["endpoint_status"]) for r in got if r["owner"]} == want and 20 < len(want) < 100
    assert all(r["stale"] is None for r in got if not r["owner"])


def test_runs_are_forgotten_after_their_time(spark, tmp_path, provider):
    row = lambda i, run_id, at: (i, 1, run_id, at - 1, at, True, 200, 5, False)
    # each file is a micro-batch; the watermark of one holds in the next
    for i, rows in enumerate([[row(1, "a", 100)], [row(2, "a", 110)], [row(3, "b", 5000)], [row(4, "c", 5010)], [row(5, "a", 5020)]]):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run(spark, tmp_path, "10 minutes")
    assert {r["id"]: r["owner"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
