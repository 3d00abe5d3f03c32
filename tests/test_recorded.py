"""The data source of recorded pages against the operators on the same bodies."""

import json

import pytest
from pyspark.sql import functions as F

from postmill.sources import listings, payloads, recorded

SHAPE = "endpoint_id long, fetch_id long, page int, http_status int, token string, region string, body string"


def page(*ids, full=False):
    return json.dumps([{"id": str(i)} for i in ids] + [{"id": f"{ids[0]}-{k}"} for k in range(payloads.PAGE_ROWS - len(ids))] * full)


def pages():
    big = json.dumps([{"id": "x", "pad": "y" * payloads.BODY_BYTES}])
    bodies = {
        10: [page("a", full=True), page("b")], 11: [page("a")], 12: [page("a", full=True), page("b"), page("c")], 13: [page("a", full=True), page("a", full=True)], 14: [page("a", full=True), json.dumps([{"id": "a"}])],
        15: ["{}"], 16: [big], 17: [page("a", full=True), big], 18: ["[]"], 19: [page("a", full=True), None], 20: ['[{"id": "a", "id": "b"}]'], 21: [json.dumps([{"id": f"r{k}"} for k in range(101)])], 22: ["[1, null]"],
    }
    rows = [(f % 4, f, n, 200, "board", "global", b) for f, of in bodies.items() for n, b in enumerate(of)]
    return rows + [(7, 30, 0, 200, "t", "eu", page("a", full=True)), (7, 30, 1, 500, "t", "eu", page("b")), (7, 31, 1, 200, "t", "eu", page("b"))]


@pytest.fixture
def source(spark):
    spark.dataSource.register(recorded.RecordedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return lambda path, **options: spark.read.format("recorded_pages").options(**options).load(str(path))


def test_counted_pages_are_those_of_the_operator(spark, tmp_path, source):
    rows = spark.createDataFrame(pages(), SHAPE)
    for part in (rows.where("page = 0").repartition(3), rows.where("page > 0").repartition(2, "endpoint_id")):  # an endpoint's pages lie in several files
        part.write.format("recorded_pages").mode("append").save(str(tmp_path / "p"))
    want = {(r["fetch_id"], r["page"], r["last"]) for r in listings.paged(rows.withColumn("body", F.coalesce("body", F.lit("")))).where("kept").collect()}
    got = source(tmp_path / "p")
    assert {(r["fetch_id"], r["page"], r["last"]) for r in got.collect()} == want and (10, 1, True) in want and (17, 0, False) in want
    assert got.rdd.getNumPartitions() == 5  # one for each endpoint
    listed = lambda df: sorted((r["fetch_id"], r["external_id"]) for r in listings.board_two(df).collect())
    assert listed(got) == listed(listings.paged(rows).where("kept"))


def test_all_pages_come_back_whole_and_filters_prune(spark, tmp_path, source):
    rows = spark.createDataFrame(pages(), SHAPE)
    rows.write.format("recorded_pages").mode("append").save(str(tmp_path / "p"))
    every = source(tmp_path / "p", pages="all")
    assert every.exceptAll(rows.withColumn("body", F.coalesce("body", F.lit(""))).withColumn("last", F.lit(None).cast("boolean"))).count() == 0 and every.count() == rows.count()
    some = every.where("endpoint_id = 7 and page = 0")
    assert some.rdd.getNumPartitions() == 1 and [r["fetch_id"] for r in some.collect()] == [30]
    assert every.where("endpoint_id in (1, 2)").rdd.getNumPartitions() == 2 and every.where("endpoint_id = 99").count() == 0


def test_overwriting_and_missing_folders(spark, tmp_path, source):
    rows = spark.createDataFrame(pages()[:2], SHAPE)
    for _ in range(2):
        rows.write.format("recorded_pages").mode("overwrite").save(str(tmp_path / "p"))
    assert source(tmp_path / "p", pages="all").count() == 2 and source(tmp_path / "none").count() == 0
    rows.limit(0).write.format("recorded_pages").mode("append").save(str(tmp_path / "e"))
    assert source(tmp_path / "e").count() == 0


def test_no_more_bytes_are_read_than_the_limit(tmp_path, monkeypatch):
    monkeypatch.setattr(payloads, "BODY_BYTES", 100)
    loop = recorded.PageLoop(left=100)
    assert loop.take(0, 200, b"[" + b" " * 100 + b"]") is None and loop.ended
    sizes = []
    writer = recorded.PagesWriter(str(tmp_path / "p"), [c.split()[0] for c in SHAPE.split(", ")], False)
    writer.commit([writer.write(iter([(1, 1, 0, 200, None, None, "x" * 5000)]))])
    reader = recorded.PagesReader(str(tmp_path / "p"), True)
    monkeypatch.setattr(recorded, "PageLoop", lambda: recorded_loop(sizes))
    assert list(reader.read(reader.partitions()[0])) == [] and sizes == [101]


def recorded_loop(sizes):
    class Seen:
        left, ended = 100, False

        def take(self, page, status, body):
            sizes.append(len(body))

    return Seen()
