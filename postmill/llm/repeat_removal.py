"""Removal of long repeated byte strings with suffix arrays sorted by induction.

A string of WIDTH bytes is cut into short grams; the least of their hashes is its anchor, so equal strings have equal
anchors at equal places. Runs of neighbouring strings with one anchor form a context, about half of WIDTH long on average
plus WIDTH. Contexts whose anchor occurs once hold no repeats, and a context that occurs more than once is repeated
throughout. Where an anchor has several distinct contexts, these are dealt by anchor into shards, and each shard's suffix
array and permuted common prefixes tell where strings of WIDTH bytes occur again.

An anchor with more distinct contexts than one task should sort has them cut into pieces by the distance of a string's
begin from the anchor. Strings of a piece share most of their bytes, which become part of its key, and equal pieces are
one; so the pieces spread over many shards, and sorting them finds the same places. Where even a piece's key is shared by
too many (a passage a little shorter than a string, in very many texts), its strings are counted by digests instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table
from .jaccard_join import MIX, mixed
from .suffix_array import repeated

WIDTH, GRAM = 400, 32
#: Bytes of text that are hashed at once, few enough for a processor cache; the bytes of contexts that one suffix array is built over, on average; contexts of one anchor in it.
CHUNK, SHARD_BYTES, MOST_CONTEXTS, PIECES = 1 << 17, 1 << 20, 1200, 8


def _window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(raw) - GRAM + 1
    h = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(0, GRAM, 8) if n > 0 else ():
        h = mixed(h * MIX ^ np.ndarray((n,), dtype="<u8", buffer=raw, offset=k, strides=(1,)))
    return h


def contexts(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Of texts: (text number, anchor, context, lo, hi) arrays. Strings that begin at lo..hi of the text share the anchor.

    context is a digest of the bytes that these strings cover and of the anchor's place in them.
    """
    raw = b"".join(texts)
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    empty = np.empty(0, dtype=np.int64)
    if len(raw) < width:
        return empty, empty, empty, empty, empty
    h = gram_hashes(raw)
    low = np.uint64((1 << 24) - 1)
    anchor_at = (_window_least((h & ~low) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1) & low).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor_at)]
    start = np.flatnonzero(np.arange(width, len(anchor_at) + width) <= ends[text])
    anchor_at, text = anchor_at[start], text[start]
    if not len(start):
        return empty, empty, empty, empty, empty
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor_at) != 0) | (np.diff(text) != 0) | (np.diff(start) != 1)]))
    last = np.append(first[1:], len(start)) - 1
    lo, hi, number, at = start[first], start[last], text[first], anchor_at[first]
    whole = b"".join(
        hashlib.blake2b(raw[a:b], digest_size=8, salt=place.to_bytes(8, "little")).digest() for a, b, place in zip(lo.tolist(), (hi + width).tolist(), (at - lo).tolist(), strict=True)
    )
    begin = (ends - sizes)[number]
    return number, h[at].view(np.int64), np.frombuffer(whole, dtype="<i8"), lo - begin, hi - begin


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK bytes; the anchors' places allow 16 MB at most, so longer texts are cut with overlap by the caller."""
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, texts[lo:k]
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


def anchored(docs: DataFrame, width: int) -> DataFrame:
    """(doc, too, anchor, context, lo, hi) of all texts of (doc, too, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, cut, shift = [], [], []
            for d, raw in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for lo in range(0, max(1, len(raw) - width + 1), CHUNK):
                    of.append(d)
                    cut.append(raw[lo : lo + CHUNK + width - 1])
                    shift.append(lo)
            of, shift = np.array(of, dtype=np.int64), np.array(shift, dtype=np.int64)
            for k, some in _chunks(cut):
                number, anchor, context, lo, hi = contexts(some, width)
                place = number + k
                ids = batch.select([0, 1]).take(pa.array(of[place]))
                yield pa.RecordBatch.from_arrays([*ids.columns, *(pa.array(x) for x in (anchor, context, lo + shift[place], hi + shift[place]))], ["doc", "too", "anchor", "context", "lo", "hi"])

    return docs.select("doc", "too", "text").mapInArrow(emit, "doc long, too int, anchor long, context long, lo long, hi long")


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py().encode()
                rows += [(w["anchor"], w["context"], w["n"], raw[w["lo"] : w["hi"] + width]) for w in wanted.as_py()]
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "context", "n", "bytes"])

    return cut


def _sorted_shard(width: int):
    def sort(rows: pa.Table) -> pa.Table:
        """For each context of a shard the runs of places, two numbers each, where a repeated string begins."""
        texts, n = rows.column("bytes").to_pylist(), rows.column("n").to_numpy()
        sizes = np.array([len(x) for x in texts])
        ends = np.cumsum(sizes + 1)
        # bytes of UTF-8 are 244 at most: they move up by 2, 1 is between contexts, 0 at the very end
        t = np.frombuffer(b"\xff".join([*texts, b"\xfe"]), dtype=np.uint8) + np.uint8(2)
        left = np.append(np.repeat(ends - 1, sizes + 1) - np.arange(ends[-1]), 0)
        again = repeated(t, width, left)
        runs = []
        for k, end in enumerate(ends):
            own = again[end - 1 - sizes[k] : end - width]  # only places from which a whole string lies inside
            if n[k] > 1:
                runs.append([0, len(own) - 1])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            edge[1::2] -= 1
            runs.append(edge.tolist())
        return pa.table({"anchor": rows.column("anchor"), "context": rows.column("context"), "runs": pa.array(runs, pa.list_(pa.int32()))})

    return sort


def _pieces(width: int):
    """Contexts of an oversized anchor cut by the distance of a string's begin from the anchor.

    All strings of a piece cover the same bytes around the anchor; these bytes are part of the new key, so a piece meets
    only pieces that agree in nearly all of a string. `shift` is where the piece begins in its context.
    """
    step = -(-(width - GRAM + 1) // PIECES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, context, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                here = int(np.flatnonzero(gram_hashes(raw).view(np.int64) == anchor)[0])
                for k in range(PIECES):
                    lo, hi = max(0, here - (k + 1) * step + 1), min(here - k * step, len(raw) - width)
                    if lo <= hi:
                        own = raw[lo : hi + width]
                        common = raw[here - k * step : here - (k + 1) * step + 1 + width]
                        sub, whole = (int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in (b"%d %d " % (anchor, k) + common, b"%d %d " % (here - lo, k) + own))
                        rows.append((anchor, context, n, sub, whole, lo, own))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], ["anchor", "context", "n", "sub", "whole", "shift", "bytes"])

    return pieces


def _by_digest(pieces: DataFrame, width: int) -> DataFrame:
    """(anchor, context, runs) of pieces that are too many of one key to be sorted in one task.

    Every string that begins in a piece is known by its key and a 128-bit digest; Spark adds up how often each occurs, in
    parts before the shuffle, so a key's pieces are never together in a task however many there are.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("bytes").to_pylist()
            of = np.repeat(np.arange(len(raws)), [len(r) - width + 1 for r in raws])
            at = [j for r in raws for j in range(len(r) - width + 1)]
            digests = b"".join(hashlib.blake2b(r[j : j + width], digest_size=16).digest() for r in raws for j in range(len(r) - width + 1))
            two = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
            some = batch.select(["anchor", "context", "n"]).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(at, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1])], ["anchor", "context", "n", "at", "d1", "d2"])

    each = stored(pieces.mapInArrow(strings, "anchor long, context long, n long, at int, d1 long, d2 long"), "strings")
    again = each.groupBy("anchor", "d1", "d2").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "d1", "d2")
    places = each.join(again, ["anchor", "d1", "d2"], "left_semi").groupBy("anchor", "context").agg(F.collect_list("at").alias("at"))  # as many as begin in a piece
    return places.select("anchor", "context", F.flatten(F.transform("at", lambda j: F.array(j, j))).alias("runs"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans), one row per row of docs.

    A byte goes if a string of `width` bytes that covers it also begins anywhere else, in the same text too; strings are
    judged on the input. What is left may end within a character, so it is binary. Null text is empty; texts shorter than
    `width` stay; rows that agree in id and text are copies of each other. Ids may be null.
    """
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} bytes at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # two hashes, 96 bits, stand for a row
    rows = rows.withColumn("doc", F.xxhash64("doc_id", "text")).withColumn("too", F.hash("text", "doc_id"))
    found = stored(anchored(rows, width), "anchors")
    groups = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "too", "lo", "hi")).alias("first"))
    often = groups.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("n").alias("total")).where("total > 1").select("anchor", "contexts")
    groups = stored(groups.join(often, "anchor"), "groups")
    wanted = groups.where("contexts > 1").select("first.doc", "first.too", F.struct("anchor", "context", "n", F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi")).alias("w"))
    wanted = wanted.groupBy("doc", "too").agg(F.collect_list("w").alias("wanted"))
    texts = rows.where(F.octet_length("text") >= width).select("doc", "too", "text").join(wanted, ["doc", "too"])
    cut = texts.dropDuplicates(["doc", "too"]).select("text", "wanted").mapInArrow(_cut(width), "anchor long, context long, n long, bytes binary")
    cut = stored(cut, "contexts")
    # the only context of an anchor occurs more than once: all its strings do
    alone = groups.where("contexts = 1").select("anchor", "context", F.array(F.lit(0), (F.col("first.hi") - F.col("first.lo")).cast("int")).alias("runs"))
    sizes = cut.groupBy("anchor").agg(F.count("*").alias("contexts"))
    total = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    huge = stored(sizes.where(F.col("contexts") > MOST_CONTEXTS).select("anchor"), "huge")
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    runs = (
        cut.join(huge, "anchor", "left_anti").select(shard, "anchor", "context", "n", "bytes")
        .groupBy("shard").applyInArrow(_sorted_shard(width), "anchor long, context long, runs array<int>")
    )
    if huge.limit(1).count():
        parts = cut.join(huge, "anchor", "left_semi").select("anchor", "context", "n", "bytes").mapInArrow(_pieces(width), "anchor long, context long, n long, sub long, whole long, shift long, bytes binary")
        parts = stored(parts, "pieces")
        alike = stored(parts.groupBy(F.col("sub").alias("anchor"), F.col("whole").alias("context")).agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes")), "alike")
        crowded = stored(alike.groupBy("anchor").agg(F.count("*").alias("pieces")).where(F.col("pieces") > MOST_CONTEXTS).select("anchor"), "crowded")
        found_in = (
            alike.join(crowded, "anchor", "left_anti").select(shard, "anchor", "context", "n", "bytes").groupBy("shard").applyInArrow(_sorted_shard(width), "anchor long, context long, runs array<int>")
            .unionByName(_by_digest(alike.join(crowded, "anchor", "left_semi"), width))
            .select(F.col("anchor").alias("sub"), F.col("context").alias("whole"), "runs").where(F.size("runs") > 0)
        )
        back = parts.select("anchor", "context", "sub", "whole", F.col("shift").cast("int").alias("shift")).join(found_in, ["sub", "whole"])
        moved = back.select("anchor", "context", F.transform("runs", lambda x: x + F.col("shift")).alias("runs"))
        runs = runs.unionByName(moved.groupBy("anchor", "context").agg(F.flatten(F.collect_set("runs")).alias("runs")))
    runs = stored(runs.where(F.size("runs") > 0).unionByName(alone), "runs")
    spans = stored(found.join(runs, ["anchor", "context"]).groupBy("doc", "too").agg(F.collect_set(F.struct("lo", "runs")).alias("spans")), "spans")
    for old in (found, groups, cut, runs):
        discard(old)
    return rows.join(spans, ["doc", "too"], "left").select("doc_id", "text", "spans").mapInArrow(_apply(width), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def _apply(width: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column(1).cast(pa.binary()).to_pylist()
            size, removed, runs = [len(x) for x in kept], [0] * len(kept), [0] * len(kept)
            for k in np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                spans = batch.column(2)[k].values
                of = spans.field("runs").combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans.field("runs")
                ends = of.flatten().to_numpy().astype(np.int64) + np.repeat(spans.field("lo").to_numpy(), of.value_lengths().to_numpy())
                edge = np.bincount(ends[0::2], minlength=size[k] + 1) - np.bincount(ends[1::2] + width, minlength=size[k] + 1)
                gone = np.cumsum(edge)[:-1] > 0
                kept[k] = np.frombuffer(kept[k], dtype=np.uint8)[~gone].tobytes()
                removed[k] = int(gone.sum())
                runs[k] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, removed, runs))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
            )

    return apply


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

