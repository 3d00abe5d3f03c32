"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference-count tables.

State is two tables. `references` has for each line key (a 16-byte digest) the exact number of documents that hold it and
the largest id among them, the holder. `filters` has for each shard of keys one cuckoo filter of the keys whose count has
reached the threshold. Inserting documents raises counts and adds the keys that cross the threshold upwards to their
shard's filter; deleting documents lowers counts and removes the keys that cross it downwards. To clean documents, their
keys stream past their shard's filter; only keys that the filter admits are looked up in the exact table, which also
settles the filter's false positives.

Counts are combined before they are shuffled, so a line that a third of all documents hold is no hot key; for the
filters, each shard is spread over SALTS parts with the shard's filter copied to each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .cuckoo import CuckooFilter

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of the exact table for each shard, on average; a filter holds those of them that reach the threshold.
SHARD_KEYS, SALTS = 400_000, 8


def keys_of(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line of text, None for lines that are too short: stripped, A-Z in lower case, digested."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        line = line.strip(b" \t\n\r\x0b\x0c").lower()  # bytes.lower() changes A-Z alone
        # code points: at most the bytes, at least a quarter of them
        long = len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars)
        out.append(hashlib.blake2b(line, digest_size=16).digest() if long else None)
    return out


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key): the distinct line keys of each row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(keys_of(text, min_chars)) - {None}
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(emit, "doc_id long, key binary")


def document_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key): the distinct line keys of each document. Rows that share an id are one document, rows without one each their own."""
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("again")).count().where("count > 1").select("again")
    if not again.limit(1).count():
        return line_keys(docs, min_chars)
    again = stored(again, "repeated-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(again, F.col("doc_id") == F.col("again"), "left")
    return line_keys(rows.where("again is null"), min_chars).unionByName(line_keys(rows.where("again is not null"), min_chars).distinct())


def shard_of(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("key"), 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


@dataclass
class LineState:
    """references: key, refs, holder. filters: shard, data. shards: their number, kept until the state is rebuilt."""

    references: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineState:
        """State of all rows of docs. Rows of one id are one document; null text is one empty line; null ids are never holders."""
        refs = document_keys(docs, min_chars).groupBy("key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("holder"))
        refs = stored(refs, "line-refs")
        shards = max(4, -(-refs.count() // SHARD_KEYS))
        made = refs.where(F.col("refs") >= min_docs).select(shard_of(shards), "key").groupBy("shard").applyInArrow(_make, "shard int, data binary")
        return cls(refs, stored(made, "line-filters"), shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineState:
        """State after docs, of ids not seen before, came in, in time that follows docs and the two tables, not the documents seen before."""
        more = document_keys(docs, self.min_chars).groupBy("key").agg(F.count("*").alias("d"), F.max("doc_id").alias("h"))
        return self._changed(more)

    def delete(self, docs: DataFrame, remaining: DataFrame) -> LineState:
        """State after the given documents, inserted before, went; remaining are those still there.

        Of remaining only the lines whose holder went are counted again. Inserting and then deleting the same documents
        gives the state before, filters' free cells included in meaning if not in place.
        """
        gone = document_keys(docs, self.min_chars)
        less = gone.groupBy("key").agg((-F.count("*")).alias("d"), F.max("doc_id").alias("g"))
        lost = self.references.join(less, "key").where(F.col("refs") + F.col("d") > 0).where(F.col("holder") == F.col("g")).select("key")
        fresh = line_keys(remaining, self.min_chars).join(lost, "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("h"))
        return self._changed(less.join(fresh, "key", "left").select("key", "d", "h", (F.lit(True) & F.col("h").isNotNull()).alias("anew")))

    def _changed(self, delta: DataFrame) -> LineState:
        anew = F.coalesce(F.col("anew"), F.lit(False)) if "anew" in delta.columns else F.lit(False)
        was = F.coalesce(F.col("refs"), F.lit(0))
        after = self.references.join(delta, "key", "full").select(
            "key", was.alias("was"), (was + F.coalesce(F.col("d"), F.lit(0))).alias("refs"),
            F.when(anew, F.col("h")).otherwise(F.greatest("holder", "h")).alias("holder"),
        )
        after = stored(after, "line-refs")
        up = (F.col("was") < self.min_docs) & (F.col("refs") >= self.min_docs)
        down = (F.col("was") >= self.min_docs) & (F.col("refs") < self.min_docs)
        crossed = after.where(up | down).select(shard_of(self.shards), "key", up.alias("up"))
        kept = after.where(F.col("refs") >= self.min_docs).select(shard_of(self.shards), "key")
        filters = self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_update, "shard int, data binary, full boolean")
        filters = stored(filters, "line-filters")
        if filters.where("full").limit(1).count():  # a shard overflowed: make the filters again from the exact table
            filters = stored(kept.groupBy("shard").applyInArrow(_make, "shard int, data binary"), "line-filters")
        return LineState(after.where("refs > 0").select("key", "refs", "holder"), filters.select("shard", "data"), self.shards, self.min_docs, self.min_chars)

    def admitted(self, keys: DataFrame) -> DataFrame:
        """Of (doc_id, key) the rows whose key its shard's filter admits: all that reach the threshold and few others."""
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        none = F.lit(None)
        probes = keys.select(shard_of(self.shards), salt.alias("salt"), none.cast("binary").alias("data"), "key", "doc_id")
        copies = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "data", none.cast("binary").alias("key"), none.cast("long").alias("doc_id"))
        parts = probes.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())
        return parts.mapInArrow(_probe, "doc_id long, key binary")

    def dropped(self, docs: DataFrame) -> DataFrame:
        """(id, drops): the keys that each document of docs, which are part of the state, loses."""
        exact = self.references.where(F.col("refs") >= self.min_docs)
        found = self.admitted(line_keys(docs, self.min_chars)).join(exact, "key").where(~F.col("holder").eqNullSafe(F.col("doc_id")) & F.col("holder").isNotNull())
        return found.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("drops"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """(record, text, n_lines, n_dropped): record the struct of all columns of docs, text what is left of its text.

        Lines that are too short or too rare stay. All rows of one id lose the same lines; the rows of the largest id that
        holds a line keep it. Null text is one empty line; it stays.
        """
        whole = F.coalesce(F.col("record.text"), F.lit(""))
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), docs["doc_id"].cast("long").alias("doc_id"))
        joined = rows.join(self.dropped(docs), F.col("doc_id").eqNullSafe(F.col("of")), "left")
        cut = _cutter(self.min_chars)(F.when(F.col("drops").isNotNull(), whole), "drops")
        out = joined.select("record", whole.alias("whole"), cut.alias("cut"))
        return out.select(
            "record", F.coalesce("cut.text", "whole").alias("text"), F.size(F.split("whole", "\n")).cast("long").alias("n_lines"),
            F.coalesce("cut.n", F.lit(0)).cast("long").alias("n_dropped"),
        )


def _cutter(min_chars: int):
    @F.pandas_udf("text string, n long")
    def cut(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for text, gone in zip(texts, drops, strict=True):
            if gone is None or text is None:
                out.append(None)
                n.append(0)
                continue
            gone = set(map(bytes, gone))
            kept = [line for line, key in zip(text.split("\n"), keys_of(text, min_chars), strict=True) if key not in gone]
            out.append("\n".join(kept))
            n.append(text.count("\n") + 1 - len(kept))
        return pd.DataFrame({"text": out, "n": n})

    return cut


def _make(rows: pa.Table) -> pa.Table:
    made = CuckooFilter.of(rows.column("key").to_pylist())
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "data": pa.array([made.dump()], pa.binary())})


def _update(key: tuple, old: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
    now = CuckooFilter.load(old["data"].iloc[0]) if len(old) else CuckooFilter.of([bytes(k) for k in crossed["key"][crossed["up"]]])
    full = False
    for k, up in zip(crossed["key"], crossed["up"], strict=True):
        if not up:
            now.remove(bytes(k))
        elif len(old):
            full |= not now.add(bytes(k))
    return pd.DataFrame({"shard": [key[0]], "data": [now.dump()], "full": [full]})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and salt, each part's filter first; one filter and one batch are in memory."""
    at, now = None, None
    for batch in batches:
        shards, salts, data = (batch.column(i).to_pylist() for i in range(3))
        keys, ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        lo = 0
        while lo < len(shards):
            part = (shards[lo], salts[lo])
            hi = lo
            if part != at:
                at, now = part, None
            while hi < len(shards) and (shards[hi], salts[hi]) == part and data[hi] is None:
                hi += 1
            if hi > lo and now is not None:
                own = keys[lo:hi]
                hit = now.has(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, h in zip(ids[lo:hi], hit, strict=True) if h], pa.int64()), pa.array([k for k, h in zip(own, hit, strict=True) if h], pa.binary())],
                    ["doc_id", "key"],
                )
            if hi < len(shards) and data[hi] is not None:
                at, now = (shards[hi], salts[hi]), CuckooFilter.load(data[hi])
                hi += 1
            lo = hi


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cleaned = LineState.build(docs).clean(docs)
    return cleaned.select(F.col("record.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
    select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as line
    from documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) as r(i)
), keyed as (
    select doc_id, i, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), counts as (
    select key, count(distinct doc_id) as n, max(doc_id) as holder from keyed where length(key) >= 20 group by key
), judged as (
    select k.doc_id, k.i, k.line, coalesce(c.n >= 3 and c.holder <> k.doc_id, false) as gone
    from keyed k left join counts c on k.key = c.key and length(k.key) >= 20
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""
