"""Each operator on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postmill.llm import exact_dedup, jaccard_join, line_dedup, mixing, packing, quality_rules, repeat_removal, shard_shuffle, toxicity, warc
from postmill.llm.common import components
from postmill.llm.cuckoo import CuckooFilter
from postmill.llm.suffix_array import permuted_prefixes, repeated, suffix_array

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string, size long"
LINE = "a line that is long enough to count"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "en", f"s{i % 3}" if i % 4 else None, 1, 5, "k", 7) for i, t in enumerate(texts)], SHAPE)


WORDS = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", " \n ", "x", WORDS, WORDS, WORDS + " more", WORDS.replace("w60 ", "v60 "), f"{LINE}\na", f"  {LINE.upper()}\t\nb", f"{LINE}\n{LINE}\nc", "ñé " * 300, "z" * 3000]


@pytest.fixture(scope="module")
def rows(spark):
    return docs(spark, TEXTS)


def test_exact_dedup(spark, rows, monkeypatch):
    for least in (64, 2):  # with and without salted groups
        monkeypatch.setattr(exact_dedup, "HEAVY_LEAST", least)
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(rows).collect()}
        assert got[0]["keep_id"] == 1 and not got[0]["kept"] and got[1]["group_size"] == 2
        assert got[4]["keep_id"] == 5 and got[5]["kept"] and got[6]["group_size"] == 1
        same = exact_dedup.exact_dedup(docs(spark, ["t"] * 5, [3, 3, None, 2, 3])).collect()
        assert sum(r["kept"] for r in same) == 1 and {r["keep_id"] for r in same} == {3} and {r["group_size"] for r in same} == {5}
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0


def test_shard_shuffle(spark, rows):
    many = docs(spark, [f"t{i}" for i in range(200)] + ["same"] * 100)
    out = shard_shuffle.external_shuffle(many, 7, bucket_bytes=900)
    got = out.select("shard", "slot", "record.doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    sizes = [sum(r["shard"] == s for r in got) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s])) for s in range(7))
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, shard_shuffle.external_shuffle(many, 7, bucket_bytes=900).select("shard", "slot", "record.doc_id").collect()))
    assert shard_shuffle.external_shuffle(rows).count() == len(TEXTS) and shard_shuffle.external_shuffle(rows.limit(0)).count() == 0


def test_line_dedup(spark, rows):
    state = line_dedup.LineState.build(rows)
    got = {r["record"]["doc_id"]: r for r in state.clean(rows).collect()}
    assert (got[8]["text"], got[9]["text"], got[10]["text"]) == ("a", "b", TEXTS[10]) and got[10]["n_dropped"] == 0
    assert got[0]["text"] == "" and got[0]["n_lines"] == 1 and got[2]["text"] == " \n "
    assert line_dedup.LineState.build(rows.limit(0)).clean(rows.limit(0)).count() == 0


def test_line_dedup_counts_documents(spark):
    same = docs(spark, [f"{LINE}\na", f"{LINE}\nb", f"{LINE}\nc"], [1, 1, 2])  # two documents hold the line
    assert {r["n_dropped"] for r in line_dedup.LineState.build(same).clean(same).collect()} == {0}
    three = docs(spark, [f"{LINE}\na", f"{LINE}\nb", f"{LINE}\nc", LINE, LINE], [1, 1, 2, None, None])
    got = line_dedup.LineState.build(three).clean(three).select("record.doc_id", "n_dropped").collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in got) == [(0, 1), (0, 1), (1, 1), (1, 1), (2, 0)]


def test_line_dedup_is_reversible(spark, rows):
    before = line_dedup.LineState.build(rows)
    extra = docs(spark, [f"{LINE}\nq", "another line that is quite long\n"] * 3, list(range(100, 106)))
    grown = before.insert(extra)
    assert {r["record"]["doc_id"]: r["text"] for r in grown.clean(rows).collect()}[10] == "c"  # the holder is a new one
    after = grown.delete(extra, rows)
    assert sorted(map(tuple, after.references.collect())) == sorted(map(tuple, before.references.collect()))
    fewer = after.delete(rows.where("doc_id = 9"), rows.where("doc_id <> 9"))
    assert all(r["n_dropped"] == 0 for r in fewer.clean(rows.where("doc_id <> 9")).collect())


def test_cuckoo_filter():
    keys = [hashlib.blake2b(b"%d" % i, digest_size=16).digest() for i in range(3000)]
    f = CuckooFilter.of(keys)
    assert f.has(keys).all()
    assert all(f.remove(k) for k in keys[:1500])
    assert CuckooFilter.load(f.dump()).has(keys[1500:]).all() and f.has(keys[:1500]).sum() < 15


def test_quality_counts(spark, rows):
    got = {r["doc_id"]: r for r in quality_rules.with_statistics(docs(spark, [*TEXTS, "a b c a b c\nx\nx\n\n", "# $ %"])).collect()}
    for d, t in enumerate([*TEXTS, "a b c a b c\nx\nx\n\n", "# $ %"]):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, d


def test_quality_rules_learn(spark):
    texts = [" ".join(f"w{i * 7 + j}{'###' if i % 3 == 0 else ''}" for j in range(60)) for i in range(120)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    learned = quality_rules.learn_rules(quality_rules.labelled_statistics(d, labels))
    assert learned
    assert {r["doc_id"] for r in quality_rules.judge(d, learned).where("kept").collect()} == {i for i in range(120) if i % 3}
    assert quality_rules.learn_rules(quality_rules.labelled_statistics(d, labels.limit(0))) == []


def held_out(spark, sf="/root/testdata/sf0.01"):
    """Documents and labels of the test tables, and the ids of a third of the labelled ones that nothing is learned from."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    away = F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id")), F.lit(3)) == 0
    return docs, labels.where(~away), labels.where(away)


def test_quality_rules_on_held_out_documents(spark):
    d, known, away = held_out(spark, "/root/testdata/sf0.1")
    learned = quality_rules.learn_rules(quality_rules.labelled_statistics(d, known))
    judged = quality_rules.judge(d.join(away, "doc_id"), learned).join(away, "doc_id").where("not base_failed")
    got = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    junk, good = got.get((0, False), 0) + got.get((0, True), 0), got.get((1, False), 0) + got.get((1, True), 0)
    assert junk and got.get((0, False), 0) >= 0.9 * junk and got.get((1, False), 0) <= 0.02 * good, got


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(150):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 50)), 0).astype(np.uint8)  # 1 is a separator
        sa = suffix_array(t)
        assert list(sa) == sorted(range(len(t)), key=lambda i: list(t[i:]))
        left = [next(k for k in range(len(t)) if t[i + k] <= 1) for i in range(len(t))]
        lcp, before = permuted_prefixes(t, sa, np.array(left))
        for a, b in zip(sa[1:], sa[:-1], strict=True):
            most = min(left[a], left[b])
            assert before[a] == b and lcp[a] == next((k for k in range(most) if t[a + k] != t[b + k]), most)
        strings = [tuple(t[i : i + 3]) if left[i] >= 3 else i for i in range(len(t))]
        assert list(repeated(t, 3, np.array(left))) == [left[i] >= 3 and strings.count(strings[i]) > 1 for i in range(len(t))]


def without_repeats(texts, width):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by counting all strings."""
    raw = {d: (t or "").encode() for d, t in texts.items()}
    counts = Counter(t[i : i + width] for t in raw.values() for i in range(len(t) - width + 1))
    out = {}
    for d, t in raw.items():
        gone, until = [False] * len(t), 0
        for i in range(len(t)):
            if i + width <= len(t) and counts[t[i : i + width]] > 1:
                until = i + width
            gone[i] = i < until
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeat_removal(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    shared = word(40)
    texts = [None, "", "short", shared, word(20) + shared, shared[:150] + word(30), "ab" * 200, word(10) + shared + word(3) + shared, word(50), shared, "é" * 150, word(4000), "\U0010ffff" * 60]
    texts += [t[:300] + "x" + t[300:] for t in (texts[11],)]
    want = without_repeats(dict(enumerate(texts)), 80)
    for most in (1200, 1):  # with and without pieces
        monkeypatch.setattr(repeat_removal, "MOST_CONTEXTS", most)
        got = repeat_removal.remove_repeats(docs(spark, texts), 80).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == want
    # rows without an id and rows that share one are documents like any others
    got = repeat_removal.remove_repeats(docs(spark, [word(30), shared, shared, word(30)], [None, None, 3, 3]), 80).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, len(shared), len(shared)]
    assert repeat_removal.remove_repeats(docs(spark, texts).limit(0), 80).count() == 0
    with pytest.raises(ValueError):
        repeat_removal.remove_repeats(docs(spark, texts), 8)


def test_repeats_go_from_400_bytes_on_whatever_their_words(spark):
    """The query's width counts bytes: a passage of 67 words in two documents stays at 399 bytes and goes whole at 400, with nothing around it."""
    rng = np.random.default_rng(13)
    word = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    passage = word(66) + " abc"
    assert len(passage) == 399 and len(passage.split()) == 67
    # what stands beside it differs on both sides, so that no longer string is shared
    below = [word(30) + "1" + passage + "2" + word(30), word(20) + "3" + passage + "4" + word(40)]
    longer = word(66) + " abcd"
    whole = [word(30) + "1" + longer + "2" + word(30), word(20) + "3" + longer + "4" + word(40)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in repeat_removal.remove_repeats(docs(spark, below + whole)).collect()}
    assert [got[k] for k in (0, 1)] == [(len(t), 0, 0, t.encode()) for t in below]
    assert [got[k] for k in (2, 3)] == [(len(t), 400, 1, t.replace(longer, "").encode()) for t in whole]


def test_repeat_removal_query_against_all_strings(spark):
    sf = "/root/testdata/sf0.001"
    want = without_repeats({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, 400)
    got = repeat_removal.op4_suffix_array_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(r["n_removed"] > 0 for r in got) > 10


def test_repeats_beside_a_passage_that_all_share(spark, monkeypatch):
    """A passage a little shorter than a string, in many texts: its pieces share a key and are counted by digests."""
    random = np.random.default_rng(11)
    word = lambda n: "".join(random.choice(list("abcdef"), n))
    shared, width = word(74), 80
    texts = [word(40) + shared + word(40) for _ in range(40)]
    texts += [texts[0][20:130], word(9) + texts[1][36:118] + word(9), texts[2][:118] + word(30), shared + shared, texts[3] + texts[3]]
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    want = {}
    for k, r in enumerate(raws):
        gone = [False] * len(r)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        want[k] = bytes(b for b, g in zip(r, gone, strict=True) if not g)
    paths = []
    real = repeat_removal._by_digest
    monkeypatch.setattr(repeat_removal, "_by_digest", lambda pieces, w: paths.append(pieces.count()) or real(pieces, w))
    monkeypatch.setattr(repeat_removal, "MOST_CONTEXTS", 3)
    got = repeat_removal.remove_repeats(docs(spark, texts), width).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == want and paths[0] > 30


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (60, 60)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[50] == got[41] == got[40] == 40


def test_jaccard_join(spark, rows):
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(90)]
    texts = list(TEXTS)
    for _ in range(25):
        w = list(base)
        for k in rng.integers(0, 90, rng.integers(0, 6)):
            w[k] = f"n{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs(spark, texts))[0].collect()}
    assert got == {d: (len(s), root[d]) for d, s in enumerate(sets)}
    assert len(set(root[len(TEXTS) :])) < 25
    assert jaccard_join.jaccard_classes(rows.limit(0))[0].count() == 0


def test_jaccard_join_with_repeated_and_missing_ids(spark):
    other = " ".join(f"v{i}" for i in range(120))
    d = docs(spark, [WORDS, other, WORDS + " more", other, WORDS, None, "alone by itself here now"], [5, 5, 7, None, None, 3, None])
    got = jaccard_join.jaccard_classes(d)[0].collect()
    assert sorted((r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 3), (1, 0), (116, 5), (116, 5), (116, 5), (116, 5), (117, 5)]


def test_jaccard_join_keeps_apart_words_that_polynomials_confuse(spark):
    word = "a"
    for _ in range(10):  # the Thue-Morse word and its complement
        word += word.translate({97: 98, 98: 97})
    d = docs(spark, [word, word.translate({97: 98, 98: 97}), word.upper()])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_classes(d)[0].collect()} == {0: 0, 1: 1, 2: 0}


def test_jaccard_join_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [[f"c{c}w{i}" for i in range(60)] for c in range(4)]
    texts = []
    for k in range(80):
        w = [x if rng.random() > 0.06 else f"n{rng.integers(0, 30)}" for x in base[k % 4]]
        texts.append(" ".join(w[: 60 - k % 3]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(80))
    for a in range(80):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "ROUND_LEAST", 0)
    assert [r["component_id"] for r in jaccard_join.jaccard_classes(docs(spark, texts))[0].orderBy("doc_id").collect()] == root


def test_shard_shuffle_against_plain_passes(spark):
    """Buckets by hashes in plain Python: each must take a run of ranks, in an order of its own."""
    ids = list(range(-50, 950))
    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in ids], "doc_id long, text string").repartition(5)
    size = sum(i % 90 + 16 for i in ids)
    buckets = -(-size // 4000)
    by_seed = xxhash.xxh64(struct.pack("<i", shard_shuffle.SEED), seed=42).intdigest()
    placed = {}
    for i in ids:
        h = xxhash.xxh64(struct.pack("<q", i), seed=by_seed).intdigest()
        placed.setdefault((h - (1 << 64) if h >> 63 else h) % buckets, []).append(i)
    got = {r["shard"] + 7 * r["slot"]: r["doc_id"] for r in shard_shuffle.external_shuffle(docs, 7, bucket_bytes=4000).select("shard", "slot", "record.doc_id").collect()}
    assert sorted(got) == list(range(len(ids)))
    start = moved = 0
    for _, members in sorted(placed.items()):
        run = [got[start + k] for k in range(len(members))]
        assert sorted(run) == sorted(members)
        moved += run != sorted(run)
        start += len(members)
    assert moved == len(placed) > 9


def test_mixing(spark):
    d = docs(spark, [" ".join(["w"] * (i % 7)) for i in range(600)] + [None, ""])
    mixed = mixing.mix(d)
    got = mixed.select("record.doc_id", "record.source", "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken")).collect()
    assert len(got) == 602 and all(r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7 and own[0]["source_size"] == sum(r["size"] for r in own)
    assert mixing.mixture(mixed).count() == mixed.select(F.sum("copies")).first()[0]
    assert mixing.mix(d.limit(0)).count() == 0
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    shares = mixing.split_quotas([10, 3, 7], 4)
    assert list(shares.sum(axis=1)) == [10, 3, 7] and set(shares.sum(axis=0)) == {5}


def test_warc_round_trip(spark):
    big = "p" * 1200
    pages = spark.createDataFrame([(1, "http://a/", big), (2, "u\r\nx", big), (3, None, None), (4, "http://b/", "small"), (5, "http://c/", "small"), (6, "x", "\r\n\r\nContent-Length: 3\r\n\r\n" * 60)], "page_id long, url string, html string")
    whole = warc.write_monolithic(warc.classify(pages), archive_bytes=500)
    members = warc.normalise(whole)
    got = {r["page_id"]: r for r in warc.read(members).collect()}
    assert {k: (v["record_type"], v["refers_to"]) for k, v in got.items() if v["record_type"] == "revisit"} == {1: ("revisit", 2)}
    assert all(got[r["page_id"]]["payload_digest"] == hashlib.sha1((r["html"] or "").encode()).hexdigest() for r in pages.collect())
    assert got[6]["payload"] == pages.where("page_id = 6").first()["html"].encode() and got[1]["payload_bytes"] == 1200
    again = warc.normalise(members.select("archive", "content"))  # archives of many members are read too
    assert sorted(again.select("index").collect()) == sorted(members.select("index").collect())
    assert b"".join(warc.inflated(whole.first()["content"])).startswith(b"WARC/1.1\r\n")
    assert warc.read(warc.normalise(warc.write_monolithic(warc.classify(pages.limit(0))))).count() == 0
    long = zlib.compressobj(9, zlib.DEFLATED, 31)
    long = long.compress(b"a" * 5_000_000) + long.flush()
    assert sum(map(len, warc.inflated(long))) == 5_000_000 and sum(map(len, warc.inflated(long + long))) == 10_000_000
    for cut in (4, 9, len(long) - 20):  # within the trailer and before
        with pytest.raises(ValueError):
            list(warc.inflated(long[:-cut]))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab"])))


def test_packing(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [*TEXTS, "two  blanks \n\n and <|endoftext|>", " x  y ", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  c", "<|endoftext| >"]
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in enumerate(texts)}
    got = packing.pack(docs(spark, texts), capacity=64).collect()
    for d, ids in want.items():
        own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == np.array(ids, dtype="<u4").tobytes() and own[0]["doc_tokens"] == len(ids)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    again = packing.pack(docs(spark, ["a b", None, "a b"], [None, 7, 7])).collect()  # rows without an id, rows that share one
    assert sorted(((r["doc_id"] is None, r["doc_tokens"]) for r in again)) == [(False, 1), (False, 3), (True, 3)]
    first = packing.digest(packing.pack(docs(spark, ["a"]))).first()
    assert first["ids_crc32"] == zlib.crc32(np.array([*t.encode("a").ids, 0], dtype="<u4").tobytes())
    assert packing.pack(rows.limit(0)).count() == 0


def test_packing_of_long_runs():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer()
    for run in (" ", "\n", "\t", "\u00a0", "x", "7", "!", " \n", "ab "):
        for n in (1999, 2000, 2001, 150_000):
            for text in (run * n, f"a{run * n}b", f"{run * n}'s {run * n}"):
                assert coder.ids(text) == plain.encode(text, add_special_tokens=False).ids, (run, n)
    for run in " \n\tx7":  # beyond what the split pattern's stack takes
        ids = coder.ids(run * 2_000_000 + "x")
        assert coder.piece.decode(ids) == run * 2_000_000 + "x"


def test_packing_takes_the_cheapest_sequence_with_room():
    lengths = [880] * 50 + [450] * 400 + [130] * 50 + [100] * 255  # 200 sequences of 450 + 450 cost less than those of 880
    pieces = packing.assign(lengths)
    assert all(sum(p[0] == d for p in pieces) == 1 for d in range(450, 500))
    lengths = [int(n) for n in np.random.default_rng(3).integers(1, 700, 1500)]
    count = -(-sum(lengths) // 1024)
    room, spent, whole = [1024] * count, [0.0] * count, {}
    room[-1] -= count * 1024 - sum(lengths)
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        if fits := [s for s in range(count) if room[s] >= lengths[d]]:
            s = whole[d] = min(fits, key=lambda s: (spent[s], s))
            room[s], spent[s] = room[s] - lengths[d], spent[s] + packing.cost(lengths[d])
    pieces = packing.assign(lengths)
    assert {d: s for d, _, n, s in pieces if n == lengths[d]} == whole and sum(p[2] for p in pieces) == sum(lengths)


def test_toxicity(spark):
    texts = [("you are an idiotic fool " if i % 2 else "a quiet day in the garden ") + f"word{i}" for i in range(400)]
    d = docs(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    grammar = toxicity.Grammar.learn(d, labels)
    got = {r["doc_id"]: r["score"] for r in grammar.score(d).collect()}
    assert len(got) == 402 and all((got[i] >= 0.3) == bool(i % 2) for i in range(400)) and got[400] == got[401] < 0.3
    assert grammar.score(d.limit(0)).count() == 0
    again = grammar.score(docs(spark, ["you are an idiotic fool " * 20_000, "fine", "fine"], [7, None, 7])).collect()
    assert len(again) == 3 and max(r["score"] for r in again) >= 0.3 and len({r["score"] for r in again}) == 2


def test_toxicity_patterns():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "fool": 1.0})
    kinds = lambda t: [sorted(toxicity.PATTERNS[k] for k in c) for c in toxicity.clauses(t, lexicon)]
    for text, want in [
        ("an idiot", "plain"), ("you idiot", "aimed"), ("idiot that you are", "aimed"), ("idiot. you are", "plain"), ("an idiot or so it was you", "plain"), ("you a b c d idiot", "plain"),
        ("you a b c idiot", "aimed"), ("not an idiot", "negated"), ("not. an idiot", "plain"), ("he said: idiot", "reported"), ("said so. you idiot", "aimed"), ("idiot", "plain"), ("said not you idiot", "reported"),
    ]:
        assert kinds(text) == [[f"insult_{want}"]], text
    assert kinds("kill him") == [["threat_aimed"]] and kinds("never kill") == [["threat_negated"]]
    assert kinds("you idiot, kill\na fool") == [["insult_aimed", "threat_aimed"], ["insult_plain"]]
    assert kinds("not fine") == kinds("") == kinds(None) == []
    assert toxicity.clauses("idiot and fool", lexicon) == [{0: 2.0}]  # a clause counts its heaviest match
    assert toxicity.emissions("you fool. you idiot", lexicon)[1] == pytest.approx(np.log1p(3.0))


def plain_patterns(symbols):
    """The patterns of one clause by looking back and ahead at each hit."""
    t = toxicity
    out = []
    for i, x in enumerate(symbols):
        if x not in (t.INSULT, t.THREAT):
            continue
        last = next((j for j in range(i + 1, len(symbols)) if symbols[j] in (t.INSULT, t.THREAT) or j == i + t.AFTER), len(symbols))
        after = symbols[i + 1 : last + 1]
        mode = "plain"
        if t.REPORT in symbols[:i]:
            mode = "reported"
        elif t.NEGATION in symbols[max(0, i - t.REACH) : i]:
            mode = "negated"
        elif t.TARGET in symbols[max(0, i - t.REACH) : i] or t.TARGET in after:
            mode = "aimed"
        out.append(f"{'insult' if x == t.INSULT else 'threat'}_{mode}")
    return out


def test_toxicity_machine_against_plain_rules():
    rng = np.random.default_rng(3)
    for _ in range(20_000):
        symbols = [int(x) for x in rng.integers(0, toxicity.END, rng.integers(0, 12))]
        state, out = 0, []
        for x in [*symbols, toxicity.END]:
            out += [toxicity.PATTERNS[k] for k in toxicity.EMITTED[state][x]]
            state = toxicity.NEXT[state][x]
        assert out == plain_patterns(symbols), symbols
        assert state == 0  # the end of a clause forgets it


def test_toxicity_on_held_out_documents(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    away = labels.where(toxicity.part(F.col("doc_id")) == 2)
    scored = toxicity.Grammar.learn(d, labels).score(d.join(away, "doc_id")).join(away, "doc_id")
    got = {(r["toxic"], r["hit"]): r["count"] for r in scored.groupBy("toxic", (F.col("score") >= 0.3).alias("hit")).count().collect()}
    toxic, other = got.get((1, True), 0) + got.get((1, False), 0), got.get((0, True), 0) + got.get((0, False), 0)
    print(got)
    assert got[1, True] >= 0.85 * toxic and got.get((0, True), 0) <= 0.02 * other, got


def test_toxicity_weights_settle():
    """Labels that one weight nearly separates: the fit ends where the loss is least."""
    import numpy as np

    from postmill.llm.toxicity import fitted

    for n in (60, 1_000, 10_000):
        x = np.zeros((n, 2))
        x[: n // 10] = 10.9, 11.0
        x[n // 10 : n // 10 + 3] = 2.4, 3.0
        y = (np.arange(n) < n // 10).astype(float)
        w = fitted(x, y)
        p = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(n)]) @ w)))
        assert (p[y == 1] > 0.9).all() and (p[y == 0] < 0.3).all()
        assert np.abs(np.column_stack([x, np.ones(n)]).T @ (p - y) + 0.5 * w).max() < 1e-3  # the least loss
