import hashlib
import json
import random

from pyspark.sql import functions as F

from postmill.functions import canonical as C
from postmill.functions import fields
from postmill.functions import tokens as T
from postmill.functions.markup import markdown
from postmill.functions.scopes import broad_scope, named_scopes
from postmill.operators import binding, deletes, documents, evaluations, history, integrity, merge, rules, runs, snapshots
from postmill.sources import listings


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def staged(spark, text, first, then):
    """As one(), with a Python column made before the expressions that use it in lambdas."""
    return spark.createDataFrame([(text,)], "t string").select(first(F.col("t")).alias("v")).select(then(F.col("v")).alias("x")).first()["x"]


def test_description(spark):
    assert one(spark, "\r\n\na  \r\n\n\n\n\nb\t\n\n", C.description) == "a\n\n\nb"
    assert one(spark, None, C.description) is None
    assert one(spark, "", C.description) == ""


def test_inline_and_folding(spark):
    assert one(spark, " a \x1c b\n", C.inline) == "a b"
    assert one(spark, "ﬁx Å", C.nfkc) == "fix Å"
    assert one(spark, "Straße", C.casefold) == "strasse"


def test_canonical_text_is_composed(spark):
    assert one(spark, "\u00a0ﬁx\u2003Å\u00a0", C.inline) == "fix Å"
    assert one(spark, "ﬁ \u2028b\u00a0\nc", C.description) == "fi \u2028b\nc"
    assert one(spark, "ＳＴＲＡＳＳＥ ΣΑΣ", C.title_norm) == "strasse σασ"
    assert one(spark, "x", lambda t: C.locations(F.array(F.lit("Ｂ"), F.lit("B\u00a0"), F.lit(None).cast("string"), F.lit(" "), t))) == ["B", "x"]
    same = lambda title: one(spark, title, lambda t: C.content_hash(t, t, C.locations(F.array(t))))
    assert same("ﬁx\u00a0") == same("fix")


def test_markdown_lines(spark):
    cases = {
        None: None, "": "\n", "\n \n": "\n", "a\nb": "a b\n", "a.\nb": "a.\nb\n", "a\n\n\n\nb\n": "a\n\nb\n", "one\r\ntwo\rthree": "one two three\n",
        "so\u00adft \u200bzero\ufeff\x00": "soft zero\n", "a\u00a0\u2003\u3000\tb\u2028c": "a b c\n", "ﬁn Ａ…\nx": "fin A...\nx\n", "a\x0bb\x1cc\x85d": "abcd\n",
        "• a\nb\n– c\n·d\n2) e": "- a b\n- c ·d\n2. e\n", "-\n- \nx": "- - x\n", "* - a": "- - a\n", "\u200b\na\n\u00ad\nb": "a\n\nb\n", "wrap-\nped:\n3.x\n3. x": "wrap- ped:\n3.x\n3. x\n",
        "٣) x\ny;\nz": "٣. x y;\nz\n",
    }
    for text, want in cases.items():
        assert one(spark, text, C.markdown_lines) == want, text


def test_tokens_and_segments(spark):
    assert one(spark, "Don't stop. Now", T.tokens) == ["dont", "stop", "now"]
    assert one(spark, "a. b!\n\nc", lambda t: F.size(T.segments(t))) == 3
    assert staged(spark, "the end of the day", T.tokens, lambda w: T.unsuppressed(w, "the", ("of the",))) == [1]
    assert staged(spark, "one two", T.tokens, lambda w: T.places(w, "one two three")) == []
    assert staged(spark, "x a b c y", T.tokens, lambda w: T.near(w, "x", "y", 4)) is True


def test_markdown(spark):
    assert one(spark, "<h1>A</h1><script>x</script><ul><li>b &amp; c</li></ul>", lambda t: C.description(markdown(t))) == "# A\n\n* b & c"


def ts(n):
    return F.lit(f"2024-01-{n:02d}").cast("timestamp")


def test_merge(spark):
    state = spark.createDataFrame([(1, "a", "h1", "u1"), (1, "b", "h2", "u2"), (2, "c", "h3", "u3")], "endpoint_id long, external_id string, content_hash string, url string")
    state = state.select("*", ts(1).alias("first_seen"), ts(1).alias("last_seen"), F.when(F.col("external_id") == "b", ts(2)).alias("closed_at"))
    versions = spark.createDataFrame([(1, "a", "h1"), (1, "a", "h9"), (1, "b", "h2"), (2, "c", "h3")], "endpoint_id long, external_id string, content_hash string").withColumn("observed_at", ts(1))
    fetches = spark.createDataFrame([(1, True), (2, False)], "endpoint_id long, complete boolean").select(
        "*", ts(3).alias("started_at"), ts(4).alias("finished_at"), F.lit(200).alias("http_status"), F.lit(False).alias("stale"), F.lit(False).alias("suspicious_zero")
    )
    seen = spark.createDataFrame([(1, "a", "h9", "x"), (1, "b", "h2", "x"), (1, "d", "h4", "x")], "endpoint_id long, external_id string, content_hash string, url string")
    out = merge.merge(state, versions, fetches, seen)
    rows = {r["external_id"]: r for r in out.state.collect()}
    assert rows["a"]["content_hash"] == "h9" and rows["a"]["url"] == "x"  # changed back to an older text
    assert rows["b"]["closed_at"] is None and rows["b"]["url"] == "u2"  # reopened, unchanged
    assert rows["c"]["closed_at"] is None  # an incomplete attempt closes nothing
    assert out.versions.count() == 5  # only d is new
    log = {r["endpoint_id"]: r for r in out.log.collect()}
    assert (log[1]["created"], log[1]["changed"], log[1]["reopened"], log[2]["closed"]) == (1, 1, 1, 0)


def test_history(spark):
    cases = [
        (1, 7, 50, True, 0, 10, 200), (2, 7, 0, True, 10, 20, 200),  # 1 had finished when 2 started
        (3, 7, 0, True, 15, 100, 200), (4, 7, 0, True, 5, 30, 200),  # nothing had finished when 4 started
        (5, 7, 900, True, 16, 90, 304), (6, 7, 900, False, 17, 91, 200), (7, 7, 0, True, 95, 99, 200), (8, 8, 0, True, 99, 99, 200), (9, 7, 0, True, 40, None, 200),
    ]
    f = spark.createDataFrame(cases, "id long, endpoint_id long, seen long, complete boolean, started_us long, finished_us long, http_status int")
    got = {r["id"]: (r["prior_avg"], r["suspicious_zero"]) for r in history.prior_average(f, 20).collect()}
    assert got[2] == (50.0, True) and got[3] == (50.0, True) and got[4] == (None, False)
    assert got[7] == (round(50 / 3, 6), False) and got[8] == (None, False) and got[9] == (round(50 / 3, 6), False) and len(got) == 9


def test_rules(spark):
    p = rules.Policy(titles=("data engineer",), low_seniority=("junior",), excluded_regions=("canada",), included_regions=("united states",))
    cases = [
        (1, "Data Engineer", "Remote.", ["US"]), (2, "Junior Data Engineer", "Remote.", ["CA"]), (3, "Data Engineer", "Hybrid, not remote.", []),
        (4, "Data Engineer", "Not remote. Remote possible.", []), (5, "Cook", None, None),
    ]
    rows = spark.createDataFrame(cases, "posting_id long, title string, description string, country_codes array<string>").select(
        "*", F.lit(None).cast("string").alias("workplace"), ts(1).alias("published_at"), ts(1).alias("first_seen_at"), F.lit("none").alias("action"), F.lit(False).alias("company_blocked")
    )
    got = {r["posting_id"]: r for r in rules.evaluate(rows, p, ts(20)).collect()}
    assert got[1]["eligible"] and [o["rule"] for o in got[1]["outcomes"]] == list(rules.RULES)
    assert got[2]["rejections"] == ["seniority", "geography"]
    assert got[3]["rejections"] == ["remote"] and "remote" in got[4]["unknowns"]
    assert got[5]["rejections"] == ["title"]
    assert rules.evaluate(rows, p, F.lit("2023-12-01").cast("timestamp")).first()["error"] == "invalid_date"


def test_named_scopes(spark):
    def found(text):
        return tuple(staged(spark, text, fields.marked_text, lambda t: named_scopes(t, ("us", "united states"), ("canada", "united kingdom"), ("remote in", "candidates must be based in"))))

    assert found("Remote in Canada.") == (False, True)
    assert found("Remote in the moon") == (False, False)
    assert found("Candidates must be based in United States, Canada or United Kingdom. More") == (True, False)
    assert found("Remote in Canada, and US") == (True, False)
    assert found("Remote in Canada and elsewhere") == (False, False)  # an unknown item voids the list
    assert found("Remote in Canada today") == (False, False)
    assert found("Remote. In Canada") == (False, False)  # the prefix crosses a segment
    assert found("Remote in Canada and. Then") == (False, True)
    assert found("remote in canada ------------ us") == (False, False)
    assert found(None) == found("") == (False, False)
    assert found("-" * 200_000) == (False, False)


def test_broad_scopes(spark):
    def found(text, *after):
        return staged(spark, text, fields.marked_text, lambda t: broad_scope(t, ("worldwide", "north america"), after or ("remote", "remote role", "open to candidates", "this job is remote")))

    assert not staged(spark, "remote worldwide", fields.marked_text, lambda t: broad_scope(t, ("worldwide",), ()))
    assert found("Open to candidates worldwide.") and found("Remote (North America)") and found("This job is remote, from\nnorth america!") and found("Remote role across worldwide")
    assert not found("Remote. Worldwide") and not found("Remote in all of north america") and not found("Remote in north. America") and not found("worldwide remote") and not found(None)
    assert not found("Open to candidates worldwide", "remote", "remote role") and found("remote role worldwide", "remote", "remote role")


def test_rules_by_scope_and_field(spark):
    p = rules.Policy(
        titles=("engineer",), remote=("fully remote",), included_regions=("united states",), excluded_regions=("outside united states", "no united states"),
        broad=("worldwide",), named_inside=("us",), named_outside=("canada",), list_after=("remote in",), broad_after=("remote", "open to candidates"),
        discipline_pairs=(("cloud", "network"),),
    )
    cases = [
        (1, "Engineer", "Fully remote. Open to candidates worldwide.", ["CA"], "pass", "pass"), (2, "Engineer", "Remote, worldwide", ["CA"], "pass", "pass"),
        (3, "Engineer", "Remote in Canada", [], "pass", "reject"), (4, "Engineer", "Remote in US", [], "pass", "pass"), (5, "Engineer", "Remote", ["CA"], "unknown", "unknown"),
        (6, "Engineer", "Fully remote, outside United States", [], "pass", "reject"), (7, "Engineer", "Fully remote worldwide, no United States", [], "pass", "reject"),
        (8, "Engineer fully", "remote work", [], "unknown", "unknown"), (9, "Engineer, no security", "clearance", [], "unknown", "unknown"), (10, None, None, None, "unknown", "unknown"),
        (11, "Engineer", "Not remote. Remote worldwide", ["CA"], "reject", "pass"), (12, "Engineer outside United States", "Fully remote in the United States", [], "pass", "unknown"),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "posting_id long, title string, description string, country_codes array<string>").select(
        "*", F.lit(None).cast("string").alias("workplace"), ts(1).alias("published_at"), ts(1).alias("first_seen_at"), F.lit("none").alias("action"), F.lit(False).alias("company_blocked")
    )
    got = {r["posting_id"]: {o["rule"]: o["status"] for o in r["outcomes"]} for r in rules.evaluate(rows, p, ts(20)).collect()}
    assert {i: (o["remote"], o["geography"]) for i, o in got.items()} == {c[0]: c[4:] for c in cases}
    assert got[9]["clearance"] == "unknown"
    titled = rules.evaluate(rows.where("posting_id = 1").withColumn("title", F.lit("Engineer cloud network")), p, ts(20)).first()  # a pair may lie in the title
    assert "discipline" in titled["rejections"]


def test_weekly_attendance(spark):
    classes, no_labels = rules.wanted(rules.Policy(titles=())), F.lit(None).cast("array<string>")

    def found(text):
        return staged(spark, text, lambda t: fields.searched(F.lit(""), t, no_labels, classes)["spans"], lambda s: rules.weekly_attendance(rules.Found(s, classes)))

    assert found("You must work three days per week in the office.") and found("Attendance: 2 days weekly, onsite") and found("Report to the office 4 days each week")
    assert not found("Three days per week in the office.")  # nobody has to
    assert not found("You must work three days per week in the home office") and not found("You must be here. Three days per week in the office")
    assert not found("Must have three years of experience; one day a year in the office") and not found("required: many days per week in the office")
    assert not found(None) and not found("")


def test_document_sync(spark):
    kinds = "id long, variant string, source_kind string, source_url string, http_status int, complete boolean, content_hash string, raw_sha256 string, etag string, last_modified string"
    fetches = spark.createDataFrame(
        [
            (1, "base", "web", "a", 200, True, "new", "r1", None, "m1"), (2, "base", "web", "b", 200, True, "new", "r2", "e2", None), (3, "other", "web", "c", 200, True, "new", "r3", None, None),
            (4, "other", "web", "d", 304, True, None, None, "e4", None), (5, "other", "web", "e", 200, False, "x", "r5", None, None), (6, "other", None, "f", 200, True, "old", "r6", None, None),
            (7, "base", "web", "g", None, None, None, None, None, None), (8, "base", "web", "h", 200, True, "more", "r8", None, None),
        ],
        kinds,
    )
    versions = spark.createDataFrame([("old", "other", None, True)], "content_hash string, variant string, source_kind string, active boolean")
    state = spark.createDataFrame(
        [("base", "web", "a", "r1", "e1", None), ("other", "web", "d", "r4", "e0", "m4"), ("other", "web", "e", "r0", "e5", None)],
        "variant string, source_kind string, source_url string, raw_sha256 string, etag string, last_modified string",
    )
    out = documents.sync(fetches, versions, state)
    got = {r["id"]: r for r in out.decisions.collect()}
    assert [got[i]["status"] for i in range(1, 9)] == ["inserted", "unchanged", "provenance_conflict", "not_modified", "incomplete", "unchanged", "failed", "inserted"]
    assert [i for i in got if got[i]["activates"]] == [1] and not got[1]["raw_changed"] and got[2]["raw_changed"]
    after = {r["source_url"]: (r["raw_sha256"], r["etag"], r["last_modified"]) for r in out.state.collect()}
    assert after == {"a": ("r1", None, "m1"), "b": ("r2", "e2", None), "d": ("r4", "e4", "m4"), "e": ("r0", "e5", None), "f": ("r6", None, None), "h": ("r8", None, None)}
    assert {(r["content_hash"], r["active"]) for r in out.versions.collect()} == {("old", True), ("new", True), ("more", False)}
    again = documents.decide(fetches, out.versions.where("content_hash = 'more'"))  # an inactive base version blocks activation
    assert not again.where("activates").count()


def test_deletes(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long").where("k = 1").withColumn("root", F.col("k"))
    b = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k long, a long")
    c = spark.createDataFrame([(9, 1), (8, 2), (7, None)], "k long, b long")
    gone = deletes.referring(b, "a", a, "k")
    assert [(r["k"], r["root"]) for r in gone.collect()] == [(1, 1)]
    assert [(r["k"], r["root"]) for r in deletes.referring(c, "b", gone, "k").collect()] == [(9, 1)]
    assert sorted(r["k"] for r in deletes.survivors(c, "b", gone, "k").collect()) == [7, 8]
    assert deletes.referring(c, "b", gone.limit(0), "k").count() == 0


def test_golden_content_hash(spark):
    place = "array<struct<label:string,country_code:string,region:string,city:string,workplace_type:string>>"
    rows = spark.createDataFrame(
        [
            (1, "Senior Product Manager", "Build things.\r\n\r\nShip them.", [("Remote — US", "US", None, None, "remote")]),
            (2, " Ｓｅｎｉｏｒ  product manager", "Build things.\n\nShip them.\n", [("Remote — US", "US", " ", "", "remote"), ("Remote  — US ", "US", None, None, "remote")]),
            (3, "x", "", [(" ", None, None, None, None)]), (4, "x", "", []), (5, "x", "", [("b", None, None, "z", None), ("b", None, None, None, None), ("a", "US", None, None, None)]),
        ],
        f"id long, title string, text string, places {place}",
    ).select("*", C.five_field_locations(F.col("places")).alias("five"))
    got = {r["id"]: r for r in rows.select("*", C.content_json(F.col("title"), F.col("text"), F.col("five")).alias("json"), C.content_hash(F.col("title"), F.col("text"), F.col("five")).alias("h")).collect()}
    want = r'{"description_md":"Build things.\n\nShip them.","locations":[{"city":null,"country_code":"US","label":"Remote — US","region":null,"workplace_type":"remote"}],"title":"senior product manager"}'
    assert got[1]["json"] == got[2]["json"] == want
    assert got[1]["h"] == got[2]["h"] == hashlib.sha256(want.encode()).hexdigest() == "5695c190b2412ffbbde7ef1728e01bde6fc2a10f1234d189adc265df82b0a8e7"
    assert got[3]["five"] is None and got[4]["five"] == []
    assert [(p["label"], p["city"]) for p in got[5]["five"]] == [("a", None), ("b", None), ("b", "z")]


def test_board_one(spark):
    good = {"id": 7, "title": " T ", "content": "&lt;p&gt;a &amp;amp; b&lt;/p&gt;", "absolute_url": "https://x.org:80/a?b#c"}
    rows = [
        good | {"location": {"name": " Here "}, "departments": [1, {"name": " "}, {"name": "D "}], "first_published": "2024-01-02T03:04:05.5Z", "updated_at": "2024-01-02T03:04:05"},
        good | {"id": 1.0}, good | {"id": True}, good | {"id": 0}, good | {"id": "7"}, good | {"title": " "}, good | {"content": None}, good | {"absolute_url": "https://a@x.org"},
        good | {"absolute_url": "https://x.org:99999/"}, 5, good | {"id": 12345678901234567890, "location": "x", "updated_at": "20240102T0304+0530"},
    ]
    bodies = [
        (1, json.dumps({"jobs": rows, "meta": {"total": len(rows)}})), (2, json.dumps({"jobs": [good], "meta": {"total": 2}})), (3, "[1]"), (4, "{bad"), (5, None),
        (6, json.dumps({"jobs": [good], "meta": None})), (7, json.dumps({"jobs": [], "meta": {}})), (8, json.dumps({"jobs": [good], "meta": {"total": True}})), (9, json.dumps({"jobs": {}})), (10, json.dumps({"jobs": [], "meta": 3})),
    ]
    df = spark.createDataFrame(bodies, "fetch_id long, body string")
    got = listings.board_one(df).cache()
    r = {x["place"]: x for x in got.where("fetch_id = 1").collect()}
    assert [i for i in sorted(r) if r[i]["valid"]] == [0, 10] and len(r) == 11
    assert (r[0]["external_id"], r[0]["title"], r[0]["description_md"], r[0]["department"], r[0]["locations"][0]["label"]) == ("7", "T", "a & b", "D", "Here")
    assert r[0]["source_published_at"].isoformat() == "2024-01-02T03:04:05.500000" and r[0]["source_updated_at"] is None and r[0]["apply_url"] == r[0]["posting_url"] == "https://x.org:80/a?b#c"
    assert r[10]["external_id"] == "12345678901234567890" and r[10]["locations"] == [] and r[10]["source_updated_at"].isoformat() == "2024-01-01T21:34:00"
    done = {x["fetch_id"]: (x["complete"], x["n_rows"]) for x in listings.completeness(df, listings.envelope(F.col("body")), got).collect()}
    assert done == {1: (False, 2), 2: (False, 0), 3: (False, 0), 4: (False, 0), 5: (False, 0), 6: (True, 1), 7: (True, 0), 8: (False, 0), 9: (False, 0), 10: (False, 0)}


def test_board_two(spark):
    url = "https://jobs.lever.co/tok/a%20b"
    good = {"id": " a b ", "text": "T", "description": "<p>one</p>", "hostedUrl": url, "applyUrl": url + "/apply"}
    rows = [
        good | {"lists": [{"text": " Needs \t it", "content": "<li>x</li>"}], "additional": "<b>z</b>", "country": "US", "workplaceType": "remote", "categories": {"allLocations": ["B ", "A", "B", " "], "department": " D "}},
        good | {"categories": {"allLocations": ["A", 1], "location": " L "}, "country": "usa", "workplaceType": "x", "additional": ""}, good | {"lists": [{"text": "a"}]}, good | {"lists": {}}, good | {"additional": 3},
        good | {"hostedUrl": url.replace("tok", "other")}, good | {"hostedUrl": url.replace("https", "http")}, good | {"hostedUrl": url.replace(".co", ".co:8080")}, good | {"hostedUrl": url.replace("%20", "%2")},
        good | {"hostedUrl": url.replace("%20", "+")}, good | {"applyUrl": None}, good | {"id": 3}, good | {"hostedUrl": url.replace(".co", ".co:443") + "?q"}, good | {"hostedUrl": "https://jobs.eu.lever.co/tok/a%20b"}, 4,
    ]
    df = spark.createDataFrame([(1, json.dumps(rows), "tok", "global"), (2, "{}", "tok", "global"), (3, None, "tok", "eu")], "fetch_id long, body string, token string, region string")
    r = {x["place"]: x for x in listings.board_two(df).collect()}
    assert len(r) == len(rows) and [i for i in sorted(r) if r[i]["valid"]] == [0, 1, 12]
    assert r[0]["description_md"] == "one\n\n## Needs it\n\n* x\n\n**z**" and r[0]["external_id"] == "a b" and r[0]["department"] == "D"
    assert [(p["label"], p["country_code"], p["workplace_type"]) for p in r[0]["locations"]] == [("B", "US", "remote"), ("A", "US", "remote")]
    assert [(p["label"], p["country_code"], p["workplace_type"]) for p in r[1]["locations"]] == [("L", None, None)]


def test_pages_of_board_two(spark):
    page = lambda start, n: json.dumps([{"id": f"i{k}"} for k in range(start, start + n)])
    rows = [
        (1, 0, 200, page(0, 100)), (1, 1, 200, page(100, 3)), (1, 2, 200, page(200, 3)), (2, 0, 200, page(0, 100)), (2, 1, 200, page(0, 100)), (3, 0, 200, page(0, 100)), (3, 1, 200, page(99, 5)),
        (4, 0, 304, None), (5, 0, 200, page(0, 101)), (6, 0, 200, "{}"), (7, 0, 200, page(0, 100)), (7, 2, 200, page(100, 3)), (8, 0, 200, "[]"), (9, 0, 200, page(0, 100)), (9, 1, 500, page(100, 1)), (10, 0, 200, json.dumps([{"id": "a"}, {"id": " a"}])),
    ]
    got = listings.paged(spark.createDataFrame(rows, "fetch_id long, page int, http_status int, body string")).collect()
    assert {(r["fetch_id"], r["page"]) for r in got if r["kept"]} == {(1, 0), (1, 1), (2, 0), (3, 0), (7, 0), (8, 0), (9, 0)}
    assert {(r["fetch_id"], r["page"]) for r in got if r["last"]} == {(1, 1), (8, 0)} and len(got) == len(rows)


def test_board_token(spark):
    from postmill.sources.payloads import board_token

    host = "https://boards.greenhouse.io"
    cases = {
        f"{host}/ab": "ab", f"{host}/ab/": "ab", f"{host}/ab/jobs/1?x=1#y": "ab", f"{host}/ab/jobs/..": None, f"{host}/ab/jobs/%2E.": "ab", f"{host}/ab/jobs/.x": "ab", f"{host}/ab/jobs/1/2": None, f"{host}.evil.org/ab": None,
        f"{host}/embed/job_board?for=c_d&x": "c_d", f"{host}/embed/job_board": None, "https://job-boards.greenhouse.io/z/jobs": "z", "https://boards-api.greenhouse.io/v1/boards/q/jobs/3": "q", f"http{host[5:]}/ab": None, None: None, "": None,
    }
    cases |= {f"{host}/ab/jobs/.%2e": "ab", f"{host}/ab/jobs/%2e%2E": None, f"{host}/ab?a?b": None, f"{host}/ab#a?b": None, f"{host}/-ab": None, f"{host}/{'a' * 129}": None, f"{host}/embed/job_board/?for=x#y": "x", f"{host}/embed/job_board?at=x": None}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", board_token(F.col("u")).alias("t"))
    assert {r["u"]: r["t"] for r in rows.collect()} == cases


def test_board_two_endpoint(spark):
    from postmill.sources.payloads import board_two_endpoint

    jobs, api = "https://jobs.lever.co", "https://api.lever.co/v0/postings"
    cases = {
        f"{jobs}/abc": ("abc", ""), f"{jobs}/abc/": ("abc", ""), f"{jobs}/abc/post-1": ("abc", ""), f"{jobs}/abc/post-1/apply/?q=1#x": ("abc", ""), "https://jobs.eu.lever.co/eu_board/id-2/apply?x=1#y": ("eu_board", "eu"),
        api + "/abc": ("abc", ""), api + "/abc/id-1?q=1#x": ("abc", ""), "https://api.eu.lever.co/v0/postings/b/": ("b", "eu"), "http://jobs.lever.co/abc": None, "https://user@jobs.lever.co/abc": None, "https://jobs.lever.co:443/abc": None,
        "https://jobs.lever.co.example/abc": None, "https://jobslever.co/abc": None, f"{jobs}/": None, f"{jobs}/_bad": None, f"{jobs}/bad.token": None, f"{jobs}/abc/.": None, f"{jobs}/abc/..": None, f"{jobs}/abc/%2e": None,
        f"{jobs}/abc/%2E.": None, f"{jobs}/abc/id/extra": None, f"{jobs}/abc/id/apply/extra": None, api + "/abc/id/apply": None, api + "/": None, api + "/abc/../other": None, f"{jobs}/abc?x y": None, f"{jobs}/abc/a b": None, None: None, "": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", board_two_endpoint(F.col("u")).alias("e"))
    assert {r["u"]: r["e"] and tuple(r["e"]) for r in rows.collect()} == cases


def test_clearance_templates(spark):
    p = rules.Policy(titles=(), clearance=("clearance", "security clearance"), clearance_obliged=("must have", "requires", "obtain"), clearance_absent=("without", "no need for"), clearance_obtain=("able to obtain",))
    cases = {
        "Must have a security clearance": ("reject", "active_clearance_required"), "Security clearance is required": ("reject", "active_clearance_required"), "clearance required": ("reject", "active_clearance_required"),
        "No security clearance is required": ("pass", "active_clearance_not_required"), "This does not require the clearance": ("pass", "active_clearance_not_required"), "Clearance preferred": ("pass", "active_clearance_not_required"),
        "clearance is not required": ("pass", "active_clearance_not_required"), "Without a clearance required": ("pass", "active_clearance_not_required"), "Able to obtain a clearance": ("pass", "active_clearance_not_required"),
        "obtain a clearance": ("reject", "active_clearance_required"), "must have clearance preferred": ("unknown", "clearance_ambiguous"), "Requires clearance. Clearance is not required": ("unknown", "clearance_ambiguous"),
        "without a clearance": ("unknown", "clearance_not_stated"), "clearance": ("unknown", "clearance_not_stated"), "must have no clearance": ("unknown", "clearance_not_stated"), "": ("unknown", "clearance_not_stated"),
        "able to obtain clearance required": ("unknown", "clearance_ambiguous"),
    }
    classes, no_labels = rules.wanted(p), F.lit(None).cast("array<string>")

    search = lambda x: fields.searched(F.lit(""), x, no_labels, classes)
    got = {t: tuple(staged(spark, t, search, lambda v: rules.clearance_rule(v["fields"], rules.Found(v["spans"], classes), p))) for t in cases}
    assert got == cases


def test_run_matrix_codes(spark):
    invalid, incomplete = ("failed", runs.RESULT_INVALID), runs.INCOMPLETE
    cases = [
        ("complete", 200, None, 3, ("succeeded", None)), ("complete", 304, None, 0, invalid), ("complete", None, None, 0, invalid), ("complete", 200, runs.STALE, 0, invalid), ("failed", None, "adapter.tls_error", 0, ("failed", "adapter.tls_error")),
        ("failed", 200, runs.INVALID, 0, ("failed", runs.INVALID)), ("failed", None, None, 0, invalid), ("failed", 200, runs.STALE, 0, invalid), ("incomplete", 304, None, 0, ("succeeded", None)),
        ("incomplete", 200, runs.SUSPICIOUS, 0, ("partial", runs.SUSPICIOUS)), ("incomplete", 200, runs.INVALID, 9, ("failed", runs.INVALID)), ("incomplete", None, "adapter.read_error", 0, invalid),
        ("incomplete", 500, None, 0, ("failed", incomplete)), ("incomplete", 200, None, 2, ("partial", incomplete)), ("other", 200, None, 2, invalid), ("complete", 99, None, 2, invalid), ("complete", 200, "made.up", 2, invalid), (None, 200, None, 1, invalid),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "id int, s string, h int, code string, seen int")
    got = df.select("id", runs.matrix(F.col("s"), F.col("h"), F.col("code"), F.col("seen"), F.col("seen") >= 0).alias("m")).collect()
    assert {r["id"]: tuple(r["m"]) for r in got} == {i: c[4] for i, c in enumerate(cases)}
    codes = {'{"code": "adapter.tls_error"}': "adapter.tls_error", '{"code": "x"}': runs.RESULT_INVALID, "{}": None, None: None}
    assert {e: one(spark, e, runs.reason) for e in codes} == codes


def test_terminal_replay(spark):
    kinds = "run_id long, endpoint_id long, status string, failure string, counts struct<a:int,b:int>"
    stored = [(1, 1, "succeeded", None, (1, 2)), (2, 1, "failed", "x", (1, 2)), (3, 1, "succeeded", None, (1, 3)), (4, 2, "succeeded", None, (1, 2)), (5, 1, "succeeded", None, (1, 2)), (6, 1, "partial", None, (1, None)), (7, 1, "failed", None, (1, None))]
    expected = [(1, 1, "succeeded", None, (1, 2)), (2, 1, "failed", "y", (1, 2)), (3, 1, "succeeded", None, (1, 2)), (4, 1, "succeeded", None, (1, 2)), (6, 1, "partial", None, (1, None)), (7, 1, "partial", None, (1, None))]
    s = spark.createDataFrame(stored, kinds).withColumn("step", F.when(F.col("run_id") < 6, "source_fetch_recorded").when(F.col("run_id") == 7, "source_fetch_recorded"))
    got = {r["run_id"]: r["problem"] for r in runs.terminal_problems(s, spark.createDataFrame(expected, kinds)).collect()}
    assert got == {2: "failure", 3: "counts", 4: "target", 5: "fetch_missing", 6: "step", 7: "status"}


def test_endpoint_health(spark):
    def plain(rows):
        status, before, out = dict.fromkeys({r[0] for r in rows}), {}, {}
        for e, i, _, complete, http, seen, bad, first in sorted(rows, key=lambda r: (r[2], r[1])):
            at, marks = status[e] or first, (False, False)
            if bad and before.get(e) and at != "failing":
                at, marks = "failing", (True, False)
            elif complete and http == 200 and seen > 0 and at == "failing":
                at, marks = "active", (False, True)
            status[e], before[e], out[i] = at, bad, (at, *marks, marks[0])
        return out

    draw = random.Random(5)
    rows = []
    for i in range(300):
        bad, e = draw.random() < 0.5, draw.randrange(12)
        rows.append((e, i, draw.randrange(100), bad or draw.random() < 0.6, 200, 0 if bad else draw.randrange(2), bad, ("active", "paused", "failing")[e % 3]))
    got = history.endpoint_health(spark.createDataFrame(rows, "endpoint_id int, id int, finished_at int, complete boolean, http_status int, seen int, suspicious_zero boolean, initial_status string"))
    assert {r["id"]: (r["endpoint_status"], r["marked_failing"], r["marked_active"], r["alert"]) for r in got.collect()} == plain(rows)


def test_fetch_problems(spark):
    fetches = [(1, 200, True, "e", None), (2, 99, False, "e", "m"), (3, 304, True, None, None), (4, 304, False, None, None), (5, 200, True, None, None), (6, 200, True, None, None), (7, 200, True, None, None), (8, 200, None, None, None), (9, 304, False, None, None), (10, None, False, "x", None)]
    rows = [(1, "a", "t", []), (1, "b", "t", []), (4, "a", "t", []), (5, " a", "t", []), (5, "a ", "t", []), (6, "a", " ", []), (7, "a", "t", None)]
    got = history.fetch_problems(spark.createDataFrame(fetches, "fetch_id int, http_status int, complete boolean, etag string, last_modified string"), spark.createDataFrame(rows, "fetch_id int, external_id string, title string, locations array<string>"))
    found = {r["fetch_id"]: r for r in got.collect()}
    assert {i: r["problem"] for i, r in found.items()} == {1: None, 2: "http_status", 3: "complete_non_200", 4: "rows_of_304", 5: "duplicate_id", 6: "empty_title", 7: "empty_label", 8: "completeness", 9: None, 10: "http_status"}
    assert found[2]["http_status"] is None and found[2]["etag"] == "e" and found[2]["last_modified"] == "m"


def test_evaluations(spark):
    p = rules.Policy(titles=("engineer",))
    rows = spark.createDataFrame([(1, "Engineer", "x"), (2, "Cook", "must have a security clearance"), (3, "Engineer", "x")], "posting_id long, title string, description string").select(
        "*", F.array().cast("array<string>").alias("country_codes"), F.lit(None).cast("string").alias("workplace"), F.when(F.col("posting_id") == 3, ts(25)).otherwise(ts(1)).alias("published_at"), ts(1).alias("first_seen_at"),
        F.when(F.col("posting_id") == 2, "applied").otherwise("none").alias("action"), F.lit(False).alias("company_blocked"),
    )
    results = rules.evaluate(rows, p, ts(20)).cache()
    two = results.where("posting_id = 2").first()
    assert two["rejections"] == ["title", "clearance", "actioned"] and [o["evidence"] for o in two["outcomes"] if o["rule"] == "actioned"] == ["prior_applied"]
    assert [r["problem"] for r in results.where("error is null").select(evaluations.problem(results).alias("problem")).collect()] == [None, None]
    bent = results.where("error is null").withColumn("eligible", ~F.col("eligible"))
    assert {r["problem"] for r in bent.select(evaluations.problem(bent).alias("problem")).collect()} == {"eligible"}
    kept, scores = evaluations.record(results, rows.select("posting_id", F.to_json(F.struct("posting_id", "title", "description")).alias("payload")))
    assert sorted(r["posting_id"] for r in kept.collect()) == [1, 2] and [(r["posting_id"], r["verdict"]) for r in scores.collect()] == [(2, "reject")]
    state = lambda stored, s: {r["state"] for r in evaluations.replay(kept, stored, s).collect()}
    assert state(kept, scores) == {"same"} and state(kept.limit(0), scores.limit(0)) == {"new"} and state(kept, scores.unionByName(scores)) == {"same", "score"} and state(kept, scores.limit(0)) == {"same", "score"}
    assert state(kept.withColumn("output", F.lit("x")), scores) == {"stored_hash"} and state(kept.withColumn("posting_id", F.lit(9)), scores) == {"target"}
    assert {r["violations"] for r in integrity.checks(kept, evaluations.checks(kept)).collect()} == {0}


def test_evaluations_are_not_broadcast(spark, tmp_path):
    """Files of evaluations are far smaller than their rows: a join must not go by the files' size."""
    spark.range(1000).select(
        F.col("id").alias("posting_id"), F.lit(True).alias("eligible"), F.array().cast("array<string>").alias("rejections"), F.array().cast("array<string>").alias("unknowns"),
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit("pass").alias("status"), F.lit("x").alias("evidence")) for r in rules.RULES]).alias("outcomes"), F.lit(None).cast("string").alias("error"), F.lit("p").alias("policy_hash"),
    ).write.parquet(f"{tmp_path}/results")
    results = spark.read.parquet(f"{tmp_path}/results")
    kept, scores = evaluations.record(results, results.select("posting_id", F.col("posting_id").cast("string").alias("payload")))
    for d in (kept, evaluations.replay(kept, kept, scores)):
        assert d.count() == 1000
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_counts_shape(spark):
    base = {"schema_version": 1, "endpoint_id": 5, "adapter_kind": "a", "attempt_recorded": False, "source_fetch_id": None, "http_status": None, "postings_seen": 0, "postings_new": 0, "postings_changed": 0}
    took = base | {"attempt_recorded": True, "source_fetch_id": 3, "http_status": 200, "postings_seen": 7}
    cases = [
        (base, "reserved"), (took, "attempt"), (took | {"http_status": None}, "attempt"), (base | {"postings_seen": 1}, None), (base | {"source_fetch_id": 1}, None), (took | {"source_fetch_id": 0}, None), (took | {"http_status": 600}, None),
        (took | {"postings_new": -1}, None), (took | {"postings_new": "1"}, None), (took | {"postings_new": 1.5}, None), (took | {"postings_new": True}, None), (base | {"attempt_recorded": "no"}, None), (base | {"attempt_recorded": 0}, None),
        (base | {"endpoint_id": 6}, None), (base | {"endpoint_id": "5"}, None), (base | {"adapter_kind": "b"}, None), (base | {"adapter_kind": None}, None), (base | {"schema_version": 2}, None), (base | {"more": 1}, None), ({"schema_version": 1}, None), ([], None), (None, None),
    ]
    df = spark.createDataFrame([(i, None if c is None else json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(98, "{"), (99, None)], "id int, c string")
    got = {r["id"]: r["s"] for r in df.select("id", binding.counts_shape(F.col("c"), F.lit(5), F.lit("a")).alias("s")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)} | {98: None, 99: None}
    made = df.limit(1).select(binding.reserved_counts(F.lit(5), F.lit("a")).alias("c")).first()["c"]
    assert json.loads(made) == base


def test_bind(spark):
    t = lambda x: None if x is None else f"2024-01-0{x} 00:00:00"
    requests = spark.createDataFrame([(1, 5, None), (2, 9, None), (3, 5, 30), (4, 5, 31), (5, 5, 32), (6, 5, 33), (7, 9, 34), (8, 6, 35), (9, 5, 36), (10, 5, 37), (11, 5, 31), (12, None, 31), (13, 7, None)], "request_id int, endpoint_id int, run_id int").withColumn("config_version", F.lit("v"))
    count = lambda e, k: json.dumps({"schema_version": 1, "endpoint_id": e, "adapter_kind": k, "attempt_recorded": False, "source_fetch_id": None, "http_status": None, "postings_seen": 0, "postings_new": 0, "postings_changed": 0})
    rows = [
        (31, "manual", "running", "v", count(5, "a"), None, None, t(1), None), (32, "manual", "failed", "v", count(5, "a"), "s", "{}", t(1), t(2)), (33, "manual", "running", "w", count(5, "a"), None, None, t(1), None),
        (34, "manual", "running", "v", count(9, "a"), None, None, t(1), None), (35, "manual", "running", "v", count(6, "a"), None, None, t(1), None), (36, "manual", "running", "v", count(5, "a"), None, None, t(1), None), (37, "manual", "failed", "v", count(5, "a"), "s", "{}", t(3), t(2)),
    ]
    r = spark.createDataFrame(rows, "run_id int, run_kind string, status string, config_version string, counts string, step string, error string, s string, f string")
    r = r.select("*", F.to_timestamp("s").alias("started_at"), F.to_timestamp("f").alias("finished_at"))
    endpoints = spark.createDataFrame([(5, "a"), (6, "b"), (7, "odd")], "endpoint_id int, kind string")
    attempts = spark.createDataFrame([(36, 5), (36, 5)], "run_id int, endpoint_id int")
    got = {x["request_id"]: (x["state"], x["code"], x["adapter_kind"]) for x in binding.bind(requests, r, endpoints, attempts, ("a", "b")).collect()}
    assert got == {
        1: ("created", None, "a"), 2: ("rejected", binding.ENDPOINT_MISSING, None), 3: ("rejected", binding.RUN_MISSING, None), 4: ("bound", None, "a"), 5: ("replay", None, "a"), 6: ("rejected", binding.INCOMPATIBLE, "a"),
        7: ("failed", binding.DELETED, "a"), 8: ("failed", binding.CHANGED, "a"), 9: ("replay", None, "a"), 10: ("rejected", binding.INCOMPATIBLE, "a"), 11: ("bound", None, "a"), 12: ("rejected", binding.INCOMPATIBLE, "a"), 13: ("created", None, "malformed"),
    }
    assert binding.bind(requests.limit(0), r, endpoints, attempts, ("a",)).count() == 0
    before = spark.createDataFrame([(5, "a", None), (6, "b", "t"), (8, "a", "x")], "endpoint_id int, kind string, token string")
    after = spark.createDataFrame([(5, "a", None), (6, "b", "u")], "endpoint_id int, kind string, token string")
    assert {x["endpoint_id"]: x["code"] for x in binding.recheck(before, after).collect()} == {5: None, 6: binding.CHANGED, 8: binding.DELETED}
    assert [one(spark, c, lambda x: binding.terminal_step(x, F.lit(False))) for c in (binding.CHANGED, "runner.endpoint_paused")] == ["adapter_fetch_completed", "endpoint_snapshotted"]
    assert [tuple(one(spark, c, lambda x: binding.finish_time(x, F.lit("b")))) for c in ("c", "b", "a", None)] == [("c", True), ("b", True), ("b", False), ("b", False)]


def test_snapshots(spark):
    h = "a" * 64
    postings = spark.createDataFrame([(i, 1, 10 + i, None if i != 4 else "2024-01-01", None if i == 5 else "2024-01-01") for i in range(1, 9)] + [(9, 2, 19, None, "2024-01-01"), (10, 1, 0, None, "2024-01-01")], "posting_id int, company_id int, current_version_id int, c string, f string")
    postings = postings.select("posting_id", "company_id", "current_version_id", F.to_timestamp("c").alias("closed_at"), F.to_timestamp("f").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("source_published_at"))
    versions = [(i, 10 + i, "" if i == 6 else "t", h if i != 7 else "xyz", [("x",)] if i != 8 else [(None,)]) for i in (1, 2, 4, 5, 6, 7, 8, 9)]
    versions = spark.createDataFrame(versions, "posting_id int, version_id int, title string, content_hash string, locations array<struct<label:string>>").withColumn("description_md", F.lit(None).cast("string")).withColumn("run_id", F.lit(1))
    companies = spark.createDataFrame([(1, False), (2, None)], "company_id int, blocked boolean")
    actions = spark.createDataFrame([(1, 1, 1, 1, 1, "skipped"), (2, 2, 1, 1, 1, "skipped"), (3, 1, 1, 1, 1, "applied")], "digest_item_id int, posting_id int, score_id int, score_version_id int, version_posting_id int, state string")
    targets = spark.createDataFrame([(i,) for i in range(1, 12)], "posting_id int")
    got = {r["posting_id"]: (r["code"], r["actions"]) for r in snapshots.snapshot(targets, postings, versions, companies, actions).collect()}
    bad = snapshots.UNSOUND
    assert got == {1: (None, 2), 2: (bad, 1), 3: (snapshots.NO_VERSION, 0), 4: (snapshots.CLOSED, 0), 5: (bad, 0), 6: (bad, 0), 7: (bad, 0), 8: (bad, 0), 9: (bad, 0), 10: (snapshots.NO_VERSION, 0), 11: (snapshots.NOT_FOUND, 0)}

    facts = ("posting_id", "digest_item_id", "score_version_id", "state")
    now = actions.select(*facts)
    records = postings.where("posting_id = 1").select("posting_id", F.lit("p").alias("policy_hash"), F.lit(11).alias("version_id"), F.lit(1).alias("run_id"), F.lit(h).alias("content_hash"), "closed_at", F.lit(False).alias("company_blocked"), "first_seen_at", "source_published_at")
    check = lambda rec=records, was=now, policy="p": tuple(snapshots.stale(rec, was, postings, versions, companies, now, policy).first())[1:]
    assert check() == (None, None) and check(policy="q") == (snapshots.UNSUPPORTED, "policy")
    assert check(records.withColumn("version_id", F.lit(3)))[1] == "version" and check(records.withColumn("run_id", F.lit(3)))[1] == "run" and check(records.withColumn("content_hash", F.lit("x")))[1] == "content_hash"
    assert check(records.withColumn("closed_at", ts(3)))[1] == "closed_at" and check(records.withColumn("first_seen_at", ts(3)))[1] == "first_seen_at" and check(records.withColumn("company_blocked", F.lit(None).cast("boolean")))[1] == "company_blocked"
    assert check(was=now.where("digest_item_id <> 3")) == (snapshots.STALE, "actions") and check(was=now.unionByName(now)) == (snapshots.STALE, "actions") and check(was=now.withColumn("state", F.lit(None).cast("string")))[1] == "actions"
    assert check(was=now.where("posting_id = 1")) == (None, None) and check(records.withColumn("posting_id", F.lit(77)))[0] == snapshots.STALE
    assert snapshots.stale(records.limit(0), now, postings, versions, companies, now, "p").count() == 0


def test_pages_of_documents(spark):
    long = "word " * 130
    rows = [(1, 0, long), (1, 1, "more\nwords\n\n"), (2, 0, long), (2, 1, " - \n"), (2, 2, None), (3, 0, "few words"), (4, 0, "x" * 600), (5, 0, None)]
    pages = spark.createDataFrame(rows, "document_id int, page int, text string")
    got = {r["document_id"]: (r["pages"], r["page"], r["gate"]) for r in documents.page_gate(pages).collect()}
    assert got == {1: (2, None, "complete"), 2: (3, 1, "page_no_letters"), 3: (1, None, "too_few_letters"), 4: (1, None, "too_few_tokens"), 5: (1, 0, "page_no_letters")}
    whole = {r["document_id"]: r for r in documents.joined(pages.orderBy(F.col("page").desc())).collect()}
    assert whole[1]["content_md"] == long.strip() + "\n\nmore words\n" and whole[1]["content_hash"] == hashlib.sha256(whole[1]["content_md"].encode()).hexdigest()
    assert documents.page_gate(pages.limit(0)).count() == 0 and documents.joined(pages.limit(0)).count() == 0


def test_http_dates(spark):
    cases = {"Mon, 01 Jan 2024 00:00:05 GMT": 1704067205, "01 Jan 2024 00:00:05": 1704067205, "Mon, 01 Jan 2024 01:00:05 +0100": 1704067205, "not a date": None, "": None, None: None, "Mon, 99 Jan 2024 00:00:05 GMT": None}
    got = {c: one(spark, c, lambda x: F.unix_micros(C.parse_http_date(x))) for c in cases}
    assert got == {c: None if v is None else v * 1_000_000 for c, v in cases.items()}
    assert one(spark, "2024-02-29 23:59:59.9", lambda x: C.http_date(F.to_timestamp(x))) == "Thu, 29 Feb 2024 23:59:59 GMT"
    assert tuple(one(spark, "junk", lambda x: C.validator_flags(x, x))) == (True, False)


def test_conditional_constraints(spark):
    s = spark.createDataFrame([("deep", 1, '{"status":"eligible"}', 1, True), ("deep", None, '{"status":"x"}', 4, True), ("deep", 1, "{}", 1, False), ("deep", 1, None, None, None), ("filter", None, None, 3, True)], "stage string, resume_version_id int, location_eligibility string, rank int, active boolean")
    s = s.withColumn("profile_version_id", F.lit(1)).withColumn("research_id", F.lit(1))
    assert {r["rule"]: r["violations"] for r in integrity.checks(s, integrity.deep_scores()).collect()} == {"deep_inputs": 1, "deep_location": 3, "rank": 1}
    assert [integrity.one_active(s, "r", *k).first()["violations"] for k in ((), ("stage",), ("rank",))] == [1, 1, 0]
    d = spark.createDataFrame([("portfolio_pdf", "base", "u", "h", None), ("portfolio_pdf", "product", "u", "h", None), ("portfolio_pdf", "base", None, "h", None), ("n8n", "base", None, None, None), ("n8n", "base", None, None, 1), ("manual", "base", None, None, None)], "source_kind string, variant string, source_url string, source_sha256 string, parent_id int")
    assert {r["rule"]: r["violations"] for r in integrity.checks(d, integrity.provenance()).collect()} == {"portfolio_pdf": 2, "n8n_parent": 1}
