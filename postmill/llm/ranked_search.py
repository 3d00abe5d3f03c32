"""Ranked lexical search by sort-based accumulation.

Documents are tokenised once; of each, the terms that the items ask for are stored with their counts, beside the counts of
documents and terms that weights need. Then every task takes its range of documents: for a run of them it concatenates the
(item, document, impact) arrays of all matched terms, sorts the packed keys by radix, adds up equal keys with reduceat, and
keeps each item's best in a heap. The impacts of an item and a document all lie in one task, so sums are whole; only the
heaps' rows (at most TOP for each item and task) are shuffled, twice, so that no task meets an item's rows of all tasks.

Items are taken in chunks whose terms are small enough to be sent to every task; a chunk more is a pass more over the
documents, and no item or term is left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

TOP = 10
#: Bytes of item texts that are sent to every task at once.
CHUNK_BYTES = 16 << 20
#: Impacts that are sorted at once.
RUN = 1 << 21
#: Parts in which an item's rows are ranked before they meet.
BINS = 32

#: Bytes of terms as they are, A-Z as a-z, all others as blanks; bytes from 0x80 on belong to letters beyond ASCII.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Items:
    """Items by term: `start[t]:start[t + 1]` are the places in `item` and `times` of those that hold term t."""

    def __init__(self, texts: list[str | None]) -> None:
        counts = [Counter(terms(t)) for t in texts]
        self.n, self.number = len(texts), {}
        for c in counts:
            for t in c:
                self.number.setdefault(t, len(self.number))
        rows = sorted((self.number[t], i, k) for i, c in enumerate(counts) for t, k in c.items())
        of, item, times = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        self.start = np.searchsorted(of, np.arange(len(self.number) + 1))
        self.item, self.times = np.ascontiguousarray(item), np.ascontiguousarray(times)


def postings(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, times): documents with a term, how many they have, and the numbers and counts of those asked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(number)  # CHUNK_BYTES bounds it

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, n, which, times = [], [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                all_ = terms(text)
                if all_:
                    count = Counter(all_)
                    hits = sorted((known[t], count[t]) for t in count.keys() & known.keys())
                    ids.append(id_)
                    n.append(len(all_))
                    which.append([t for t, _ in hits])
                    times.append([k for _, k in hits])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"]
            )

    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, times array<long>")


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The order of keys from 0 to `most`: stable passes over 16 bits at a time, from the lowest."""
    order, shift = np.arange(len(keys)), 0
    while not shift or most >> shift:
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit integers by radix
        shift += 16
    return order


def accumulate(items: Items, weights: np.ndarray, base: np.ndarray, term: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of all that match, by item then document; base, term and doc describe postings."""
    many = items.start[term + 1] - items.start[term]
    posting = np.repeat(np.arange(len(term)), many)
    place = np.arange(len(posting)) - np.repeat(np.cumsum(many) - many, many) + items.start[term][posting]
    key = items.item[place] * docs + doc[posting]
    impact = (weights[term] * base)[posting] * items.times[place]
    order = radix_order(key, items.n * docs)
    key, impact = key[order], impact[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    score = np.add.reduceat(impact, first) if len(key) else impact
    return key[first] // docs, key[first] % docs, score


class Best:
    """Each item's best documents so far, in heaps; of equal scores the smaller id is better, null ids are last."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.heaps, self.bar = top, [[] for _ in range(items)], np.zeros(items, dtype=np.int64)

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: list) -> None:
        hopeful = (score > 0) & (score >= self.bar[item])
        for i, d, s in zip(item[hopeful].tolist(), doc[hopeful].tolist(), score[hopeful].tolist(), strict=True):
            heap, id_ = self.heaps[i], ids[d]
            entry = s, id_ is not None, -(id_ or 0)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.bar[i] = heap[0][0]

    def rows(self) -> list[tuple]:
        return [(i, -down if there else None, s) for i, heap in enumerate(self.heaps) for s, there, down in heap]


def scored(found: DataFrame, items: Items, holding: dict[int, int], documents: int, length: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best `top` documents of each task for each item."""
    weights = np.array([weight(documents, holding.get(t, 0)) for t in range(len(items.number))], dtype=np.int64)
    sent = found.sparkSession.sparkContext.broadcast((items, weights))  # CHUNK_BYTES bounds it

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        best = Best(items.n, top)
        for batch in batches:
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("terms")
            many = lists.value_lengths().to_numpy()
            term, times = np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column("times").flatten()).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), many)
            m = 25 + 75 * np.asarray(batch.column("n")) * documents // length
            base = 1_000_000_000 * times // (1000 * times + 8 * m[doc])
            some = weights[term] > 0
            term, doc, base = term[some], doc[some], base[some]
            # runs of whole documents with about RUN impacts
            impacts = np.cumsum(np.bincount(doc, weights=items.start[term + 1] - items.start[term], minlength=len(ids)))
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(impacts, (impacts[lo - 1] if lo else 0) + RUN, side="right")))
                a, b = np.searchsorted(doc, (lo, hi))
                best.offer(*accumulate(items, weights, base[a:b], term[a:b], doc[a:b] - lo, hi - lo), ids[lo:hi])
                lo = hi
        rows = best.rows()
        item, id_, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(id_, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return found.mapInArrow(task, "item int, doc_id long, score long")


def chunks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """(id, text) rows in chunks of about CHUNK_BYTES of text; one item at least."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held, size = [], 0
    for r in rows.toLocalIterator():  # a partition of items at a time
        more = len((r["text"] or "").encode("utf-8", "surrogatepass"))
        if held and size + more > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append((r["id"], r["text"]))
        size += more
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0.

    Null and empty texts have no terms: such an item finds nothing, such a document isn't counted. Rows that repeat an id
    are documents, or items, of their own; null ids come last among equal scores. Ids of documents are integers. Other
    columns aren't read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for chunk in chunks(items, item_id, item_text):
        of = Items([t for _, t in chunk])
        found = stored(postings(docs, of.number, id_col, text_col), "postings")
        facts = found.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not facts["documents"] or not of.number:
            continue
        holding = {r["t"]: r["count"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row for each term asked for
        rows = scored(found, of, holding, facts["documents"], facts["length"], top)
        order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
        part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(BINS))).orderBy(*order)
        rows = rows.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top).drop("place")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(chunk)], f"item int, item_id {kind}")
        out = out.unionByName(stored(rows, "ranked").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # CHUNK_BYTES bounds it
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as materialized (select doc_id, {_TERMS.format('text')} as w from documents), l as (select doc_id, len(w) as n from d where len(w) > 0),
s as (select count(*)::bigint as nn, sum(n)::bigint as ll from l),
q as (select item_id, t, count(*)::bigint as times from (select item_id, unnest({_TERMS.format('text')}) as t from benchmark) group by all),
p as materialized (select doc_id, t, count(*)::bigint as tf from (select doc_id, unnest(w) as t from d) where t in (select t from q) group by all),
f as (select t, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by t),
x as (select item_id, doc_id, sum(times * f.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::bigint as score
    from q join p using (t) join f using (t) join l using (doc_id), s group by all),
r as (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from x where score > 0)
select item_id, rank, doc_id, score from r where rank <= {TOP}"""
