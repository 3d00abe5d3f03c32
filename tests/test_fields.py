"""Fields with positions: folding, segments, gaps, phrases, labels, against cases and a plain search."""

import random

from pyspark.sql import functions as F

from postmill.functions import fields
from postmill.functions import tokens as T
from postmill.operators import rules


def values(text):
    return [t.value for t in fields.tokens(fields.unified(text))]


def test_folding_keeps_places():
    for text, want in {
        "ＰＲＯＤＵＣＴ ＭＡＮＡＧＥＲ": ["product", "manager"], "Don’t Don‘t Donʼt Don＇t Don't 'Stop": ["dont"] * 5 + ["stop"], "Café Café": ["café", "café"], "éx": ["éx"], "́a": ["a"],
        "Straße ﬁn": ["strasse", "fin"], "x̂y": ["x", "y"], "": [], "...": [], "_a_b": ["a", "b"],
    }.items():
        assert values(text) == want, text
    source = "Straße ﬁn éx, Ａ’s"
    for t in fields.tokens(source):
        assert fields.folded(source[t.start:t.end])[0].replace("'", "").startswith(t.value[:-1]) and t.start < t.end
    assert [(t.start, t.end) for t in fields.tokens("ßß a")] == [(0, 2), (3, 4)]
    assert [(t.start, t.end) for t in fields.tokens("ﬁﬁ éé b")] == [(0, 2), (3, 6), (8, 9)]


def test_folding_is_that_of_every_cluster():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choices("aAé ßＡ’'＇ﬁ̧́İǅ日.ϒ", k=12))
        slow = "".join(fields._fold(c[0]) for c in fields._clusters().finditer(text))
        assert fields.folded(text)[0] == slow and len(fields.folded(text)[1] or text) == len(slow)


def test_segments_and_gaps():
    numbered = lambda text: [(t.value, t.segment) for t in fields.tokens(fields.unified(text))]
    assert numbered("。A!!B") == [("a", 0), ("b", 1)] and numbered("A, B\r\nC. D\r\r \nE") == [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 2)]
    assert numbered("a. --- . b") == [("a", 0), ("b", 2)]
    kinds = {"A, B": "comma", "A; B": "semicolon", "A/ B": "slash", "A\\ B": "slash", "A - B": "other", "A—B": "other", "A B": "whitespace", "A\nB": "whitespace", "A. B": "sentence", "A\n\nB": "paragraph", "A.\n\nB": "paragraph", "A.,B": "sentence"}
    assert {t: fields.gaps(t, fields.tokens(t)) for t in kinds} == {t: [k, None] for t, k in kinds.items()}


def test_one_pass_finds_what_a_plain_search_finds():
    r = random.Random(4)
    phrases = ("a", "a b", "b", "a b a", "c c", "B, A", "")
    wanted = (*[fields.Wanted(p, (p,)) for p in phrases], fields.Wanted("two", ("a b", "c")), fields.Wanted("first", ("a",), once=True), fields.Wanted("titled", ("a",), ("title",)))
    for _ in range(100):
        source = "".join(r.choice(["a", "b", "c", "d"]) + r.choice([" ", ", ", ". ", "\n\n"]) for _ in range(r.randint(0, 25)))
        of = fields.tokens(source)
        words = [t.value for t in of]
        want = set()
        for c, w in enumerate(wanted):
            hits = [(c, i, i + len(values(p))) for p in w.phrases for i in range(len(words)) if values(p) and words[i:i + len(values(p))] == values(p)]
            want |= set(hits[:1] if w.once else hits) if "title" not in w.kinds else set()
        found = fields.spans(of, "description", wanted)
        assert set(found) == want and len(found) == len(want)


def test_fields_of_listings(spark):
    rows = spark.createDataFrame([("Remote", "in the US. Don’t\nstay", ["Remote in", None, "the US"]), (None, None, None)], "title string, text string, labels array<string>")
    classes = (fields.Wanted("in", ("remote in", "in the us")), fields.Wanted("dont", ("DON'T stay",)))
    got = rows.select(fields.searched(F.col("title"), F.col("text"), F.col("labels"), classes).alias("s")).select("s.*").collect()
    assert [(f["kind"], f["ordinal"], f["words"]) for f in got[0]["fields"]] == [("title", 0, " remote "), ("description", 0, " in the us dont stay "), ("location", 0, " remote in "), ("location", 2, " the us ")]
    assert got[0]["fields"][1]["marked"] == "in the us . dont stay"
    # a phrase never reaches from one field into the next
    assert sorted((s["of"], s["field"], s["first"], s["after"], s["segment"], s["start"], s["end"], s["whole"]) for s in got[0]["spans"]) == [(0, 1, 0, 3, 0, 0, 9, True), (0, 2, 0, 2, 0, 0, 9, True), (1, 1, 3, 5, 1, 11, 21, True)]
    assert got[1]["fields"][0]["words"] == "  " and len(got[1]["fields"]) == 1 and got[1]["spans"] == []
    table = fields.token_table(rows, "title", "description", F.col("text")).orderBy("place").collect()
    assert [(t["token"], t["segment"], t["start"], t["end"], t["gap"]) for t in table][2:] == [("us", 0, 7, 9, "sentence"), ("dont", 1, 11, 16, "whitespace"), ("stay", 1, 17, 21, None)]


def test_tokens_fold_in_columns(spark):
    texts = spark.createDataFrame([("Don’t ＳＴＯＰ",), ("plain Text",), (None,)], "t string")
    assert [r["w"] for r in texts.select(T.tokens(F.col("t")).alias("w")).collect()] == [["dont", "stop"], ["plain", "text"], None]


def test_labels_are_searched_by_the_rules(spark):
    p = rules.Policy(titles=("engineer",), included_regions=("united states",), excluded_regions=("canada only",), list_after=("remote in",), named_inside=("us",), named_outside=("canada",))
    at = F.lit("2024-01-01").cast("timestamp")
    rows = spark.createDataFrame([(1, ["Remote"]), (2, ["Remote in Canada"]), (3, ["Remote", "United States"]), (4, ["Canada only", "Remote"]), (5, ["Security clearance is required"]), (6, None)], "posting_id long, labels array<string>").select(
        "*", F.lit("Engineer").alias("title"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("country_codes"), F.lit(None).cast("string").alias("workplace"),
        at.alias("published_at"), at.alias("first_seen_at"), F.lit("none").alias("action"), F.lit(False).alias("company_blocked"),
    )
    got = {r["posting_id"]: {o["rule"]: o["status"] for o in r["outcomes"]} for r in rules.evaluate(rows, p, at).collect()}
    assert {i: (o["remote"], o["geography"], o["clearance"]) for i, o in got.items()} == {
        1: ("pass", "unknown", "unknown"), 2: ("pass", "reject", "unknown"), 3: ("pass", "pass", "unknown"), 4: ("pass", "reject", "unknown"), 5: ("unknown", "unknown", "reject"), 6: ("unknown", "unknown", "unknown")
    }


def test_batches_are_taken_in_slices(spark):
    """A batch of far more text than a slice: rows stay beside their results, and a task's memory follows the slice."""
    import tracemalloc

    import pyarrow as pa

    texts = [None if i % 97 == 0 else "" if i % 89 == 0 else f"t{i} is, here. " * (i % 200) for i in range(3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    found = fields.searched(F.lit("t"), F.col("text"), F.array(F.col("i").cast("string")), (fields.Wanted("is", ("is",)),))
    got = d.select("i", fields.token_rows("text").alias("t"), fields.marked_text("text").alias("m"), found.alias("s")).collect()
    assert len(got) == 3000
    for r in got:
        source = fields.unified(texts[r["i"]] or "")
        of = fields.tokens(source)
        assert [x["token"] for x in r["t"]] == [x.value for x in of] and r["m"] == fields.marked(source, of)
        assert r["s"]["fields"][-1]["words"] == f" {r['i']} " and len(r["s"]["spans"]) == source.count(" is")
    batch = pa.array(["some words, and more. " * 60] * 10_000)
    tracemalloc.start()
    n = sum(len(x) for x in fields.token_rows.func(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 250e6


def test_marked_text_holds_a_slice():
    import tracemalloc

    import pyarrow as pa

    batch = pa.array(["some words, and more. " * 60] * 10_000)
    tracemalloc.start()
    n = sum(len(x) for x in fields.marked_text.func(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 12e6
