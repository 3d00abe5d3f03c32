"""Redirects over recorded responses."""

from pyspark.sql import functions as F

from postmill.sources import redirects


def test_locations_are_resolved(spark):
    base = "https://a.org/x/y?q=1#f"
    cases = {
        "https://b.org/z": "https://b.org/z", "//b.org/z": "https://b.org/z", "/z?p": "https://a.org/z?p", "?p=2": "https://a.org/x/y?p=2", "z": "https://a.org/x/z", "z/w?p": "https://a.org/x/z/w?p", "mailto:x": "mailto:x",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "l string").select("l", redirects.resolved(F.lit(base), F.col("l")).alias("to"))
    assert {r["l"]: r["to"] for r in rows.collect()} == cases
    assert rows.select(redirects.resolved(F.lit("https://a.org"), F.lit("z")).alias("x")).first()["x"] == "https://a.org/z"


def test_hops_stay_where_they_may(spark):
    start = "https://a.org/p?x=1&y=2&x=1"
    cases = {
        "https://a.org/p?x=1&x=1&y=2": (True, True), "https://A.ORG:443/p?y=2&x=1&x=1": (True, True), "https://a.org/p?x=1&y=2": (True, False), "https://a.org/p?x=1&y=2&y=2": (True, False), "https://a.org/q?x=1&y=2&x=1": (True, False),
        "http://a.org/p?x=1&y=2&x=1": (False, False), "https://b.org/p?x=1&y=2&x=1": (False, False), "https://u@a.org/p?x=1&y=2&x=1": (False, False), "https://@a.org/p?x=1&y=2&x=1": (False, False), "https://a.org:444/p?x=1&y=2&x=1": (False, False),
        "https://a.org/p ?x=1&y=2&x=1": (False, False), "https://a.org\\@b.org/p": (False, False), "https://a.org/../p?x=1&y=2&x=1": (False, False), "https://a.org.b.org/p": (False, False), "": (False, False), None: (False, False),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    got = rows.select("u", *[redirects.allowed(F.lit(start), F.col("u"), F.lit(e)).alias(n) for n, e in (("origin", False), ("exact", True))]).collect()
    assert {r["u"]: (r["origin"], r["exact"]) for r in got} == cases


def test_chains(spark):
    a = "https://a.org/"
    responses = [(a + "0", 200, None), (a + "1", 301, "/0"), (a + "2", 302, "1"), (a + "3", 307, a + "2"), (a + "4", 308, "3"), (a + "loop", 303, "loop"), (a + "off", 302, "https://b.org/0"), (a + "none", 302, " "), (a + "gone", 301, "nowhere"), (a + "304", 304, "/0")]
    r = spark.createDataFrame(responses, "url string, status int, location string")
    starts = spark.createDataFrame([(i, u, False) for i, u in enumerate([a + x for x in ("0", "1", "3", "4", "loop", "off", "none", "gone", "304")] + [None])] + [(20, a + "1", True)], "fetch_id long, url string, exact boolean")
    got = {x["fetch_id"]: (x["url"], x["status"], x["hops"], x["outcome"]) for x in redirects.follow(starts, r).collect()}
    assert got == {
        0: (a + "0", 200, 0, "final"), 1: (a + "0", 200, 1, "final"), 2: (a + "0", 200, 3, "final"), 3: (a + "1", 301, 3, "too_many"), 4: (a + "loop", 303, 3, "too_many"), 5: (a + "off", 302, 0, "unsafe"), 6: (a + "none", 302, 0, "no_location"),
        7: (a + "nowhere", None, 1, "not_recorded"), 8: (a + "304", 304, 0, "final"), 9: (None, None, 0, "not_recorded"), 20: (a + "1", 301, 0, "unsafe"),
    }
