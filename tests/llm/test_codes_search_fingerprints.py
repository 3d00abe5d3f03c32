"""Vector codes, ranked search and Order MinHash against brute force on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import order_minhash, ranked_search, vector_codes

VECTORS = "embedding array<float>, vec_id long, label int, code string, of int, v string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(e, i, label, "c", 1, "v", 1) for i, e, label in rows], VECTORS)


def plain_codes(rows, entries=16, rounds=6):
    """The contract in plain Python integers: {place in rows: (code, error, label_error)} and the codebooks' digest."""
    kept = [(i, vec, label) for i, vec, label in rows if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    ints = [[math.floor(4096 * float(np.float32(x))) for x in vec] for _, vec, _ in kept]
    cut = lambda w, p: w[p * len(w) // 8:(p + 1) * len(w) // 8]
    books = [[cut(w, p) for w in ints[:entries]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            got = {}
            for w in ints:
                got.setdefault(near(cut(w, p), book)[1], []).append(cut(w, p))
            for j, parts in got.items():
                book[j] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    coded = [[near(cut(w, p), books[p]) for p in range(8)] for w in ints]
    errors = [sum(d for d, _ in c) for c in coded]
    of = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        of[label] += e
    found = sorted((-1 if i is None else i, "".join(f"{j:02x}" for _, j in c), e, of[label]) for (i, _, label), c, e in zip(kept, coded, errors, strict=True))
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("heavy", [vector_codes.HEAVY_PARTS, 2])  # labels by broadcast and by shuffle
def test_codes_against_plain_python(spark, monkeypatch, heavy):
    monkeypatch.setattr(vector_codes, "HEAVY_PARTS", heavy)
    r = random.Random(3)
    rows = [(i, [r.choice((-1.0, -0.5, 0.0, 0.25, r.gauss(0, 1))) for _ in range(16)], (i % 5 or None) if i % 3 else 7) for i in range(90)]
    rows += [(90, None, 1), (91, [None] + [0.0] * 15, 1), (92, [math.nan] * 16, 1), (93, [-math.inf] * 16, 1), (94, rows[5][1], None), (95, rows[5][1], None)]
    coded, books = vector_codes.compress(vectors(spark, rows))
    got = sorted((x["vec_id"], x["code"], x["error"], x["label_error"]) for x in coded.collect())
    assert (got, vector_codes.codebooks_digest(books)) == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    coded, books = vector_codes.compress(vectors(spark, []))
    assert coded.collect() == [] and books.size == 0 and coded.columns == ["vec_id", "code", "error", "label_error"]
    # fewer rows than entries, repeated and null ids, short and empty vectors (padded with zeros)
    rows = [(1, [1.0] * 16, 1), (1, [1.0] * 16, 1), (None, [1.0] * 9, None), (2, [], 2)]
    got = vector_codes.compress(vectors(spark, rows))[0].collect()
    padded = [(i, e + [0.0] * (16 - len(e)), label) for i, e, label in rows]
    assert sorted((-1 if x["vec_id"] is None else x["vec_id"], x["code"], x["error"], x["label_error"]) for x in got) == plain_codes(padded)[0]
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(vectors(spark, [(1, [4e4] * 8, 1)]))


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 40), st.integers(1, 3), st.integers(0, 2**31), st.sampled_from([2, 5, 4000, 1 << 25]))
def test_trees_find_the_nearest(entries, width, seed, spread):
    rng = np.random.default_rng(seed)
    book, points = rng.integers(-spread, spread, (entries, width)), rng.integers(-spread, spread, (50, width))
    found, d = vector_codes.nearest(vector_codes.grow(book), book, points)
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def plain_search(texts, items, top=10):
    """{place of the item: [(doc_id, score)]} by the contract."""
    words = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(i, words(t)) for i, t in texts]
    docs = [(i, w) for i, w in docs if w]
    n, length = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for _, text in items:
        found = []
        for i, w in docs:
            tf, m = Counter(w), 25 + 75 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words(text) if t in tf)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out.append([(None if none else i, -s) for s, none, i in sorted(found)[:top]])
    return out


@pytest.mark.parametrize(("run", "chunk"), [(ranked_search.RUN, ranked_search.CHUNK_BYTES), (3, 1)])  # one run and chunk, and many of each
def test_search_against_plain_python(spark, monkeypatch, run, chunk):
    monkeypatch.setattr(ranked_search, "RUN", run)
    monkeypatch.setattr(ranked_search, "CHUNK_BYTES", chunk)
    r = random.Random(5)
    pool = ["the", "Öl", "x1", "Große", "im", "日本", "a", "rare", "é", "I"] + [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(r.choices(pool, k=r.randint(1, 40)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, " .,- "), (63, "THE the-The"), (64, "the " * 20_000), (65, texts[3][1]), (66, texts[3][1]), (None, texts[3][1])]
    items = [(7, "the x1, x1 ÖL"), (8, None), (9, ""), (10, "none of these"), (11, texts[3][1]), (12, "日本 é i")]
    d = spark.createDataFrame([(t, i, "k", 1, 2) for i, t in texts], "text string, doc_id long, item_id string, n int, score int")
    q = spark.createDataFrame([(t, i, 3) for i, t in items], "text string, item_id long, rank int")
    got = {}
    for x in ranked_search.search(d, q).orderBy("item_id", "rank").collect():
        got.setdefault(x["item_id"], []).append((x["doc_id"], x["score"]))
    assert got == {i: f for (i, _), f in zip(items, plain_search(texts, items), strict=True) if f}
    assert ranked_search.search(d.limit(0), q).count() == 0 and ranked_search.search(d, q.limit(0)).count() == 0


def test_search_takes_repeated_items_apart(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b c"), (2, "b c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (1, "c"), (None, "c")], "item_id long, text string")
    got = [(x["item_id"], x["rank"], x["doc_id"]) for x in ranked_search.search(d, q).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1), (1, 1, 2), (1, 2, 2), (None, 1, 2), (None, 2, 2)], key=str)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_radix_order(keys):
    a = np.array(keys, dtype=np.int64)
    assert (ranked_search.radix_order(a, 2**40) == np.argsort(a, kind="stable")).all()


def plain_sketch(text, k=order_minhash.K, m=order_minhash.SKETCHES, size=order_minhash.TUPLE):
    """Order MinHash by its definition: for each order the least numbered k-mers, in text order."""
    grams = [text[i:i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    seen, elements = Counter(), []
    hashes = order_minhash.elements(order_minhash.code_points(text))
    for g, h in zip(grams, hashes.tolist(), strict=True):
        elements.append(((g, seen[g]), h))
        seen[g] += 1
    arc, out = (1 << 64) // m, []
    for j in range(m if elements else 0):
        least = sorted(range(len(elements)), key=lambda i: (elements[i][1] - j * arc) % (1 << 64))[:size]
        out.append(tuple(elements[i][0] for i in sorted(least)))
    return out


@settings(deadline=None, max_examples=60)
@given(st.text("abÖ日", max_size=60), st.text("abÖ日", max_size=60))
def test_signatures_are_order_minhash(a, b):
    x, y = plain_sketch(a), plain_sketch(b)
    want = sum(s == t for s, t in zip(x, y, strict=True)) / len(x) if x and y else float(x == y)
    assert order_minhash.likeness(order_minhash.sketch(a), order_minhash.sketch(b)) == want


def test_signatures_see_order_and_ignore_the_shortcut(monkeypatch):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(4000)]
    text, swapped = " ".join(words), " ".join(words[2000:] + words[:2000])
    assert order_minhash.likeness(order_minhash.sketch(text), order_minhash.sketch(text)) == 1
    assert 0.3 < order_minhash.likeness(order_minhash.sketch(text), order_minhash.sketch(swapped)) < 0.75  # the same k-mers, half of the pairs turned
    short = order_minhash.sketch(text)
    monkeypatch.setattr(order_minhash, "LIKELY", 10**9)
    assert order_minhash.sketch(text) == short
    assert len(order_minhash.elements(order_minhash.code_points("ab" * 40))) == len(set(order_minhash.elements(order_minhash.code_points("ab" * 40)).tolist()))


def test_texts_beyond_the_packed_form(monkeypatch):
    text = "lorem ipsum " * 500
    e = order_minhash.elements(order_minhash.code_points(text))
    assert len(e) == len(text) - order_minhash.K + 1 == len(set(e.tolist()))
    monkeypatch.setattr(order_minhash, "PACKED", 1000)
    assert (order_minhash.elements(order_minhash.code_points(text)) == e).all()


@pytest.mark.parametrize("ranges", [1, 4])
def test_edits_against_plain_python(spark, ranges):
    texts = {i: t for i, t in enumerate([None, "", "x", "two words here", "Ö日" * 40, "copy of a text, long enough", "copy of a text, long enough", "a " * 3000, "short", "y" * 9])}
    rows = spark.createDataFrame([(t, "id", i, b"x", 1.0) for i, t in texts.items()], "text string, id string, doc_id long, sha binary, near_next double")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {x["id"]: x for x in order_minhash.edits(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    ids = sorted(texts, reverse=True)
    assert sorted(got) == sorted(ids)
    for place, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(place + 1) % len(ids)]] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        x = got[i]
        assert x["n_chars"] == len(text) and x["sha"] == hashlib.sha256(new.encode()).digest()
        assert x["own"] == order_minhash.sketch(text) and x["changed"] == order_minhash.sketch(new)
        assert x["near_edited"] == order_minhash.likeness(x["own"], x["changed"]) and x["near_next"] == order_minhash.likeness(x["own"], order_minhash.sketch(after))


def test_edits_of_odd_tables(spark):
    shape = "doc_id long, text string"
    assert order_minhash.edits(spark.createDataFrame([], shape)).collect() == []
    one = order_minhash.edits(spark.createDataFrame([(1, "abcdef")], shape)).first()
    assert one["sha"] == hashlib.sha256(b"abcabc").digest() and one["near_next"] == 1
    rows = [(None, "no id"), (3, "same"), (3, "same"), (3, "other"), (None, None)]
    assert order_minhash.edits(spark.createDataFrame(rows, shape)).count() == 5
    assert sorted(x["n_chars"] for x in order_minhash.fingerprints(spark.createDataFrame(rows, shape)).collect()) == [0, 4, 4, 5, 5]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_ranked_search"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    from postmill.llm import queries

    place = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, place)
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{place}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_fingerprints_tell_edits_from_strangers(spark):
    rows = order_minhash.op13_order_minhash(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
