"""The corpus pipeline against brute force: rows without an id, rows that share one, copies and empty texts."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from postmill.llm import packing


def text(name, n=80):
    return " ".join(f"{name}{i}" for i in range(n))


LINE = "a line that many of these rows hold"
ROWS = [
    (1, text("a")), (1, text("a")), (1, text("b")), (2, text("a") + " more"), (None, text("c")), (None, text("c") + " more"), (None, text("d")),
    (None, text("e")), (None, text("e")), (3, ""), (None, None), (None, ""), (4, "short"), (5, text("f")), (5, "short"), (None, "short"),
    (6, LINE + "\n" + text("g")), (7, text("h") + "\n" + LINE), (None, LINE + "\n" + text("i")), (None, text("k") + "\n" + LINE),
    (9, text("l")), (10, text("l")), (None, text("l")), (None, text("l")), (8, text("m")), (8, text("m") + " more"),
]


def row(i, t):
    return i, t, "en", "s", None if t is None else len(t)


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())


def good(rows):
    return [r for r in rows if len((r[1] or "").split()) >= 50]  # no word comes twice in a text


def without_lines(rows):
    holders = {}
    for i, t, *_ in rows:
        for line in set(t.split("\n")):
            holders.setdefault(line, []).append(i)
    out = []
    for i, t, *_ in rows:
        kept = [x for x in t.split("\n") if len(x) < 20 or len(holders[x]) < 3 or max(h for h in holders[x] if h is not None) == i]
        out.append(row(i, "\n".join(kept)))
    return out


def apart(rows):
    sets = []
    for _, t, *_ in rows:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    kept = {}
    for k in range(len(rows)):
        if not sets[k]:
            kept[-1 - k] = rows[k]
        elif group[k] not in kept or (rows[k][0] is None, rows[k][0] or 0) < (kept[group[k]][0] is None, kept[group[k]][0] or 0):
            kept[group[k]] = rows[k]
    return list(kept.values())


def test_run_keeps_the_rows_that_brute_force_keeps(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [row(*r) for r in ROWS]
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, got = spark.createDataFrame(rows, shape), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), re.sub(r"\W", "-", name))
        got[name] = rows_of(docs)
    want = good(rows)
    assert got["quality rules"] == Counter(want)
    want = without_lines(want)
    assert got["line dedup"] == Counter(want) and Counter(want)[row(None, "")] == 2
    # of rows that share an id and are near copies either may stay
    eight = lambda c: Counter((r[0], r[1].removesuffix(" more") if r[0] == 8 else r[1]) for r in c.elements())
    want = eight(Counter(apart(want)))
    assert eight(got["n-gram Jaccard join"]) == want
    coder = packing.tokenizer()
    tokens = {(r[0], len(coder.ids(r[1])) + 1) for r in got["n-gram Jaccard join"]}
    # one source has its whole at least once in the mix
    assert {(r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == tokens


def test_run_of_an_empty_table_and_of_long_texts(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], shape).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    long = [row(1, text("a", 60) + " " * 1_500_000 + "x"), row(2, text("b", 60) + "\n" * 300_000 + text("c", 60)), row(3, text("d", 60_000))]
    spark.createDataFrame(long, shape).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2, 3}
