"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text's k-mers are numbered by occurrence (the third "abcd" is another element than the first). For each of SKETCHES
orders the TUPLE least elements are selected, put back into the order they have in the text, and hashed as a tuple; the
tuples are the signature. Two texts agree in a tuple only if they share its elements and have them in the same order, so
likeness, the share of equal tuples, falls with moves as well as with other edits.

All orders come from one hash of the elements: order j ranks them by (hash - j * 2^64 / SKETCHES) mod 2^64. Elements are
sorted once, and an order's least are the first ones from its starting point on, around the circle; the rule is the same
for every length. Texts shorter than K are one element; with fewer elements than TUPLE, tuples are shorter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

K, SKETCHES, TUPLE = 8, 96, 2
#: Bits of a k-mer's hash; with the place in the other bits, one sort of plain integers groups and orders a text's k-mers.
HASH_BITS = 40
#: Texts of more k-mers are sorted with places beside their hashes; the result is the same.
PACKED = 1 << (64 - HASH_BITS)
#: Bytes of a tuple's hash in a signature.
WIDTH = 3
#: Elements looked at for each order before all of them are; changes time only.
LIKELY = 24

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each k-mer of code points: windows are doubled in length while they fit, then one more overlap gives k."""
    if not len(points):
        return np.zeros(0, dtype=np.uint64)
    k = min(k, len(points))
    h, w = _mix(points.astype(np.uint64) + _C), 1
    while w < k:
        step = min(w, k - w)
        h = _mix(h[: len(h) - step] * _C + h[step:])
        w += step
    return h


def elements(points: np.ndarray, k: int = K) -> np.ndarray:
    """A hash for each occurrence-numbered k-mer, in text order."""
    h = kmers(points, k) >> np.uint64(64 - HASH_BITS)
    n = len(h)
    places = 64 - HASH_BITS
    if n < PACKED:  # hash and place in one integer
        packed = np.sort((h << np.uint64(places)) | np.arange(n, dtype=np.uint64))
        order, run = (packed & np.uint64((1 << places) - 1)).astype(np.int64), packed >> np.uint64(places)
    else:
        order = np.argsort(h, kind="stable")
        run = h[order]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if n else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.append(first, n))
    number = np.arange(n) - np.repeat(first, lengths)
    out = np.empty(n, dtype=np.uint64)
    out[order] = _mix(run + number.astype(np.uint64) * _C)
    return out


def sketch(text: str, k: int = K, sketches: int = SKETCHES, size: int = TUPLE) -> bytes:
    """The signature: WIDTH bytes for each order; an empty text has none."""
    every = elements(code_points(text), k)
    if not len(every):
        return b""
    size = min(size, len(every))
    arc = np.uint64((1 << 64) // sketches)
    starts = np.arange(sketches, dtype=np.uint64) * arc
    at = None
    if len(every) > 2 * LIKELY * sketches:  # those just after a starting point nearly always hold what is wanted
        at = np.flatnonzero(every % arc < np.uint64(int(arc) * LIKELY * sketches // len(every)))
        if np.bincount((every[at] // arc).astype(np.int64), minlength=sketches)[:sketches].min() < size:
            at = None
    at = np.arange(len(every)) if at is None else at
    at = at[np.argsort(every[at])]
    e = every[at]
    took = (np.searchsorted(e, starts)[:, None] + np.arange(size)[None, :]) % len(e)
    took = np.sort(at[took], axis=1)  # back into text order
    h = np.zeros(sketches, dtype=np.uint64)
    for c in range(size):
        h = _mix(h * _C + every[took[:, c]] + np.uint64(1))
    return h.astype(">u8").view(np.uint8).reshape(sketches, 8)[:, :WIDTH].tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of orders whose tuples agree; two empty texts are alike, an empty and another are not."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(s, dtype=np.uint8).reshape(-1, WIDTH) for s in (a, b))
    return float((x == y).all(axis=1).mean())


def edited(text: str, other: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the other's."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, signature) for each row of docs, without a shuffle; null text counts as empty, other columns aren't read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sketch(t) for t in texts], pa.binary())], ["id", "n_chars", "signature"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, signature binary")


#: What is known of a row: `kind` 0 has it all; a range's first row (1) and last row (2) carry their texts for their neighbours in other ranges.
_FACTS = ("n_chars long", "sha binary", "own binary", "changed binary", "near_edited double", "near_next double")


class _Rows:
    """Finished rows on their way to a batch."""

    def __init__(self, kind: str) -> None:
        self.schema = pa.schema([("kind", pa.int32()), ("place", pa.int32()), ("id", kind), ("text", pa.string()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("own", pa.binary()), ("changed", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        self.rows: list[tuple] = []

    def add(self, kind: int, place: int, id_: object, text: str | None, *facts: object) -> None:
        self.rows.append((kind, place, id_, text, *(facts or (None,) * len(_FACTS))))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def compared(text: str, own: bytes, after: str, after_own: bytes) -> tuple:
    """The facts of a row, in the order of _FACTS: its text, the document after it, and both signatures."""
    new = edited(text, after)
    changed = own if new == text else sketch(new)
    return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), own, changed, likeness(own, changed), likeness(own, after_own)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, sha, own, changed, near_edited, near_next): each row, its signature, that of its edited text, and its likeness to that and to the next document.

    The edited text takes its second half from the next document in descending order of id (nulls last; rows of one id by
    a hash of their text, so that many of them are spread over ranges); after the last comes the first, and a single row is
    its own next. Null text counts as empty, other columns aren't read, an empty table gives an empty result.

    Texts are shuffled once, into sorted ranges. A task passes through its range with one row in hand; the ranges' first
    and last rows, two for each task, are paired afterwards.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"kind int, place int, id {kind}, text string, " + ", ".join(_FACTS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, out = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = out or _Rows(batch.schema.field(0).type)
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sketch(text)
                if held:
                    out.add(0, place, held[0], None, *compared(held[1], held[2], text, own))
                else:
                    out.add(1, place, id_, text)
                held = id_, text, own
            yield out.batch()
        if held:
            out.add(2, place, held[0], held[1])
            yield out.batch()

    found = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task, shape), "edits")
    facts = [f.split()[0] for f in _FACTS]
    done = found.where("kind = 0").select("id", *facts)
    places = sorted(r["place"] for r in found.where("kind = 1").select("place").collect())  # one integer for each task
    if not places:
        return done
    following = found.sparkSession.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "place int, after int")
    heads = found.where("kind = 1").select(F.col("place").alias("after"), F.col("text").alias("next"))
    ends = found.where("kind = 2").select("place", "id", "text").join(following, "place").join(heads, "after").select("id", "text", "next")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(batch.schema.field(0).type)
            for id_, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.add(0, 0, id_, None, *compared(text, sketch(text), after, sketch(after)))
            yield out.batch()

    return done.unionByName(ends.mapInArrow(pair, shape).select("id", *facts))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = lambda c: F.lower(F.hex(c))
    return edits(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", digits("sha").alias("edited_sha256"), digits("own").alias("fingerprint"), digits("changed").alias("edited_fingerprint"), "near_edited", "near_next"
    )
