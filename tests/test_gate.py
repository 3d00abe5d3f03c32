"""The gate over recorded responses with documents."""

from pyspark.sql import functions as F

from postmill.sources import gate

PDF = {"Content-Type": "application/pdf"}


def test_first_failure_wins(spark):
    cases = [
        (200, PDF, 9, b"%PDF-", "ok", None, 9), (200, {"content-type": " Application/PDF ; q=1"}, 9, b"%PDF-", "ok", None, 9), (304, {}, None, None, "not_modified", None, None), (404, {}, 9, b"%PDF-", "rejected", "non_200_status", None),
        (None, PDF, 9, b"%PDF-", "rejected", "non_200_status", None), (200, {"content-type": "text/html"}, 9, b"%PDF-", "rejected", "wrong_media_type", None), (200, {}, 9, b"%PDF-", "rejected", "wrong_media_type", None),
        (200, {**PDF, "Content-Length": "x"}, 9, b"%PDF-", "rejected", "invalid_content_length", None), (200, {**PDF, "Content-Length": ""}, 9, b"%PDF-", "rejected", "invalid_content_length", None),
        (200, {**PDF, "Content-Length": " 101 "}, 9, b"%PDF-", "rejected", "content_length_exceeds_limit", 101), (200, {**PDF, "Content-Length": "9" * 30}, 9, b"%PDF-", "rejected", "content_length_exceeds_limit", None),
        (200, {**PDF, "Content-Length": "-5"}, 9, b"%PDF-", "ok", None, 9), (200, {**PDF, "content-length": "1_00"}, 9, b"%PDF-", "ok", None, 9), (200, {**PDF, "Content-Length": "9"}, 101, b"%PDF-", "rejected", "streamed_overflow", 101), (200, PDF, 100, b"%PDF-", "ok", None, 100),
        (200, PDF, 0, b"", "rejected", "empty_body", 0), (200, PDF, None, None, "rejected", "empty_body", 0), (200, PDF, 4, b"%PDF", "rejected", "missing_pdf_signature", 4), (200, PDF, 9, b"<html", "rejected", "missing_pdf_signature", 9),
    ]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, status int, headers map<string,string>, length long, head binary")
    got = {r["i"]: r["g"] for r in rows.select("i", gate.gate(F.col("status"), F.col("headers"), F.col("length"), F.col("head"), 100).alias("g")).collect()}
    for i, c in enumerate(cases):
        assert (got[i]["outcome"], got[i]["reason"], got[i]["byte_count"]) == (c[4], c[5] and f"fetcher.{c[5]}", c[6]), c


def test_validators_of_taken_responses(spark):
    held = {"ETag": "e", "Last-Modified": "Mon, 01 Jan 2024 00:00:00 GMT"}
    rows = spark.createDataFrame([(304, held), (304, {"Last-Modified": "soon"}), (500, held)], "status int, headers map<string,string>")
    gated = rows.select(gate.gate(F.col("status"), F.col("headers"), F.lit(None), F.lit(None).cast("binary")).alias("g"))
    got = [(r["g"]["etag"], r["f"]["etag"], r["f"]["last_modified"]) for r in gated.select("g", gate.flags(F.col("g")).alias("f")).collect()]
    assert got == [("e", True, True), (None, False, False), (None, False, False)]


def test_bodies_are_read_by_their_first_bytes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.pdf").write_bytes(b"%PDF-1.7" + b"x" * 5000)
    (tmp_path / "two").write_bytes(b"%P")
    (tmp_path / "three").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], bytes(r["head"])) for r in gate.recorded_bodies(spark, str(tmp_path)).collect()}
    assert got == {"one.pdf": (5008, b"%PDF-"), "two": (2, b"%P")}
    plan = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # the column of whole contents isn't read
