"""How runs end, case by case."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from postmill.operators import finish as E
from postmill.operators import integrity, runs
from postmill.operators.binding import CHANGED, INCOMPATIBLE

RUN = "run_id long, endpoint_id long, adapter_kind string, status string, step string, error string, counts string, started_at timestamp, finished_at timestamp, clock timestamp"
FETCH = "run_id long, endpoint_id long, fetch_id long, status string, http_status int, seen long, new long, changed long, error string, finished_at timestamp"
STOP = "run_id long, code string, fetched boolean, floor timestamp"
FRESH = "run_id long, endpoint_id long, fetch_id long, status string, http_status int, seen long, new long, changed long, code string"


def at(hour):
    return datetime.datetime(2024, 1, 1, hour)


def counts(endpoint=5, took=None):
    base = {"schema_version": 1, "endpoint_id": endpoint, "adapter_kind": "a", "attempt_recorded": took is not None, "source_fetch_id": None, "http_status": None, "postings_seen": 0, "postings_new": 0, "postings_changed": 0}
    return base | dict(zip(("source_fetch_id", "http_status", "postings_seen", "postings_new", "postings_changed"), took or (), strict=False))


def run(i, status="running", step=None, code=None, took=None, clock=9, ended=None):
    return (i, 5, "a", status, step, code and json.dumps({"code": code}), json.dumps(counts(took=took), indent=1), at(1), ended and at(ended), clock and at(clock))


def fetch(i, status="complete", http=200, seen=3, code=None, endpoint=5):
    return (i, endpoint, 10 + i, status, http, seen, 1, 2, code and json.dumps({"code": code}), at(4))


def done(spark, runs_, fetches=(), stops=(), fresh=None):
    made = [spark.createDataFrame(list(x), s) for x, s in ((runs_, RUN), (fetches, FETCH), (stops, STOP))]
    out = E.finish(*made, None if fresh is None else spark.createDataFrame(fresh, FRESH))
    return {r["run_id"]: r for r in out.collect()}


def test_ending_now(spark):
    got = done(
        spark, [run(1), run(2), run(3, clock=3), run(4, clock=None), run(5), run(6), run(7, clock=None), run(8), run(9, clock=1)],
        [fetch(1), fetch(2, "incomplete", 304, 0), fetch(3), fetch(4, "failed", None, 0, "adapter.tls_error"), fetch(5, endpoint=6), fetch(8)],
        [(5, "runner.adapter_defect", False, None), (7, CHANGED, True, at(5)), (8, CHANGED, True, None), (9, CHANGED, True, None)],
    )
    said = {i: (r["result"], r["status"], r["step"], r["failure"], r["finished_at"] and r["finished_at"].hour) for i, r in got.items()}
    assert said == {
        1: ("finished", "succeeded", E.RECORDED, None, 9), 2: ("finished", "succeeded", E.RECORDED, None, 9),
        3: ("finished", "failed", E.RECORDED, E.CLOCK, 4), 4: ("finished", "failed", E.RECORDED, E.CLOCK, 4),  # the clock goes last
        5: ("finished", "failed", E.SNAPSHOTTED, "runner.adapter_defect", 9),  # the fetch is another endpoint's
        6: ("running", "running", None, None, None),
        7: ("finished", "failed", E.FETCHED, E.CLOCK, 5), 8: ("finished", "succeeded", E.RECORDED, None, 9),  # a recorded fetch goes before a failure
        9: ("finished", "failed", E.FETCHED, CHANGED, 1),
    }
    assert json.loads(got[1]["counts"]) == counts(took=(11, 200, 3, 1, 2)) and json.loads(got[4]["counts"]) == counts(took=(14, None, 0, 1, 2))
    assert json.loads(got[5]["counts"]) == counts()


def test_reports(spark):
    report = lambda i, **other: tuple(({"run_id": i, "endpoint_id": 5, "fetch_id": 10 + i, "status": "complete", "http_status": 200, "seen": 3, "new": 1, "changed": 2, "code": None} | other).values())
    got = done(spark, [run(i) for i in range(1, 5)], [fetch(i) for i in range(1, 5)], fresh=[report(1), report(2, seen=4), report(3, endpoint_id=6), report(4, code=runs.STALE)])
    assert {i: (r["status"], r["failure"]) for i, r in got.items()} == {1: ("succeeded", None), **{i: ("failed", runs.RESULT_INVALID) for i in (2, 3, 4)}}


def test_replays(spark):
    took = (11, 200, 3, 1, 2)
    cases = {
        "as fetched": (run(1, "succeeded", E.RECORDED, took=took, ended=6), True), "other counts": (run(1, "succeeded", E.RECORDED, took=(11, 200, 4, 1, 2), ended=6), False),
        "other status": (run(1, "partial", E.RECORDED, took=took, ended=6), False), "other step": (run(1, "succeeded", E.FETCHED, took=took, ended=6), False),
        "clock": (run(1, "failed", E.RECORDED, E.CLOCK, took, ended=6), True), "clock, not failed": (run(1, "succeeded", E.RECORDED, E.CLOCK, took, ended=6), False), "made up": (run(1, "failed", E.RECORDED, "x", took, ended=6), False),
        "stopped": (run(2, "failed", E.SNAPSHOTTED, "runner.cancelled", ended=6), True), "stopped elsewhere": (run(2, "failed", E.FETCHED, "runner.cancelled", ended=6), False), "changed": (run(2, "failed", E.FETCHED, CHANGED, ended=6), True),
        "clock anywhere": (run(2, "failed", E.FETCHED, E.CLOCK, ended=6), True), "no code": (run(2, "failed", E.FETCHED, ended=6), False), "succeeded of nothing": (run(2, "succeeded", E.RECORDED, took=took, ended=6), False),
    }
    runs_, fetches = [], []
    for i, (r, _) in enumerate(cases.values()):
        number = i * 2 + r[0]  # odd ones have a fetch
        runs_.append((number, *r[1:]))
        if r[0] == 1:
            fetches.append((number, *fetch(1)[1:]))
    got = done(spark, runs_, fetches)
    assert len(got) == len(cases)
    for (name, (r, fits)), row in zip(cases.items(), (got[x[0]] for x in runs_), strict=True):
        assert row["result"] == ("replayed" if fits else "incompatible"), name
        assert row["failure"] == (r[5] and json.loads(r[5])["code"] if fits else INCOMPATIBLE) and (row["status"], row["step"], row["counts"]) == (r[3], r[4], r[6]), name


def test_empty(spark):
    assert done(spark, []) == {}
    assert done(spark, [], [fetch(1)], [(1, CHANGED, True, None)], []) == {}


@pytest.mark.parametrize("category,code", [
    ("lever.transport.pool_timeout", "adapter.pool_timeout"), ("greenhouse.transport.pool_timeout", None), ("greenhouse.transport_error", "adapter.transport_error"), ("lever.transport.tls_error", None), ("", None), (None, None),
])
def test_transport_codes(spark, category, code):
    assert spark.createDataFrame([(category,)], "c string").select(E.transport_code(F.col("c")).alias("x")).first()["x"] == code


def test_references_by_columns(spark):
    d = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 1), (2, None)], "a int, b int")
    other = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, 3, "x")], "b int, k int, c string")
    # pairs (1, 1) and (1, 3) are there as (k, b) = (1, 1), (3, 1)
    assert integrity.references(d, "r", ("a", "b"), other, ("k", "b")).collect() == [("r", 2)]
    assert integrity.references(d, "r", "a", other, "k").collect() == [("r", 2)]
    assert integrity.references(d.limit(0), "r", ("a", "b"), other, ("k", "b")).collect() == [("r", 0)]
