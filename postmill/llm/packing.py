"""Cost-balanced packing of token sequences.

A document's attention cost is a linear term plus a quadratic one. Documents are taken in descending order of cost and
each goes to the sequence of lowest cost so far that still has room for all of it; what fits nowhere is cut, which is
free, and fills the emptiest sequences. Each task packs its own documents in runs of RUN_TOKENS, so tokens are never
shuffled and a run is all that is in memory; only a run's last sequence can have padding.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY, END = 1024, 0
RUN_TOKENS = 4_000_000
#: Cost of n tokens in one sequence: LINEAR * n + QUADRATIC * n * n, in units of one token's dense layers.
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Runs of white space (the class of the split pattern) that are cut by hand; the split is the same at any length.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
SHAPE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class ByteTokens:
    """Ids of the byte-level tokenizer of a rank file.

    The rank file holds the same vocabulary and merges as the tokenizers file beside it, so ids are equal (tests compare
    them). The split pattern looks ahead only to leave a run of white space its last character; a text without two white
    space characters in a row is split the same way without it, which is much faster. Where a text holds one of the
    tokenizer's added tokens, that is one id, and the parts around it are encoded by themselves. Runs of white space that
    would exhaust the pattern's stack are cut out first, as the pattern cuts them: all but the last character are a piece,
    and all of them at the end of the text.
    """

    def __init__(self, ranks: str, pattern: str, added: dict[str, int]):
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.fast = tiktoken.Encoding("fast", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=known, special_tokens={})
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=known, special_tokens={})
        self.run = re.compile(r"\s\s")
        self.added = added
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")

    def ids(self, text: str) -> list[int]:
        if not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [*self._plain(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if not self.run.search(text):
            return self.fast.encode_ordinary(text)
        out, at = [], 0
        for blanks in LONG_RUN.finditer(text):
            end = blanks.end() if blanks.end() == len(text) else blanks.end() - 1
            out += self.full.encode_ordinary(text[at : blanks.start()]) + self.piece.encode_ordinary(text[blanks.start() : end])
            at = end
        return out + self.full.encode_ordinary(text[at:])


def tokenizer(name: str = "byte_bpe_50k") -> ByteTokens:
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json")) as whole:
        added = {x["content"]: x["id"] for x in json.load(whole)["added_tokens"]}
    return ByteTokens(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, added)


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) of documents of the given lengths, in as few sequences as there can be.

    Whole sequences are cut from the front of longer documents first. The rest go in descending order of cost to the
    cheapest sequence with room; those that fit none are cut across the emptiest ones.
    """
    out, rest, used = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        out += [(d, k * capacity, capacity, used + k) for k in range(whole)]
        used += whole
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    total = sum(r[0] for r in rest)
    count = -(-total // capacity)
    rest.sort(key=lambda r: (-cost(r[0]), r[1]))
    room = [capacity] * count
    if count:
        room[-1] -= count * capacity - total  # the only padding: the last sequence is that much shorter
    # lengths only fall, so a sequence with room for one document has room for all later ones until it takes one:
    # `order` holds exactly the sequences with room, the others wait by their room until the length has come down to it
    waiting: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    for s in range(count):
        waiting[room[s]].append((0.0, s))
    order: list[tuple[float, int]] = []
    bound, left = capacity + 1, []
    for n, d, start in rest:
        while bound > n:
            bound -= 1
            for x in waiting[bound]:
                heapq.heappush(order, x)
            waiting[bound] = []
        if not order:
            left.append((n, d, start))
            continue
        c, s = heapq.heappop(order)
        out.append((d, start, n, used + s))
        room[s] -= n
        if room[s] >= n:
            heapq.heappush(order, (c + cost(n), s))
        elif room[s]:
            waiting[room[s]].append((c + cost(n), s))
    open_ = sorted((s for s in range(count) if room[s]), key=lambda s: (room[s], -s))
    for n, d, start in left:
        while n:
            s = open_[-1]
            take = min(n, room[s])
            out.append((d, start, take, used + s))
            n, start, room[s] = n - take, start + take, room[s] - take
            if not room[s]:
                open_.pop()
    return out


def pack(docs: DataFrame, name: str = "byte_bpe_50k", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32 bits each), doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone. Every row of docs is packed, rows of one id each for themselves; other
    columns are not read. Sequence ids are unique, not gapless. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, first, seen = tokenizer(name), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, seen, ids, tokens
            pieces = sorted(assign([len(t) for t in tokens], capacity), key=lambda p: (p[3], p[0], p[1]))
            for lo in range(0, len(pieces), 20_000):
                rows, at, last = [], 0, None
                if lo:
                    last = pieces[lo - 1][3]
                    at = sum(p[2] for p in pieces[max(0, lo - capacity) : lo] if p[3] == last)
                for d, start, n, s in pieces[lo : lo + 20_000]:
                    at = at if s == last else 0
                    rows.append((ids[d], start, n, tokens[d][start : start + n].tobytes(), len(tokens[d]), (part << 33) + first + s, at))
                    at, last = at + n, s
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SHAPE.split(", ")])
            first += (pieces[-1][3] + 1) if pieces else 0
            ids, tokens, seen = [], [], 0

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                tokens.append(np.array([*coder.ids(text.as_py() or ""), END], dtype="<u4"))
                seen += len(tokens[-1])
                if seen >= RUN_TOKENS:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SHAPE)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def ids_crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
