"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows are distinct shingle sets (equal sets are one row), columns are shingles. Columns are ordered: shingles that many
documents share last, the others by hash. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of
each, so only that part of the matrix is multiplied:

1. every column's members are paired with one of them, the pivot. Pairs that are similar enough are links, and their
   components already hold nearly all copies, however many there are. Columns that still hold several components get
   other pivots, one of the largest component and one apart from it, as long as that finds many links;
2. columns that still hold members of different components are multiplied in blocks of rows. A block's product
   accumulates for each pair of rows how many leading shingles both have; pairs within a component are left out, and so
   are pairs whose sizes, places in the column order or bit signatures bound the overlap below what the threshold
   needs. The counts of a pair are added up over the blocks, and a pair whose count leaves too little to come is
   discarded. The others get their overlap counted in full.

No link between different components is lost, and no pair within one is made. Which shingles come last only affects how
much is multiplied, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, stored, table

WORDS, PERCENT = 5, 75
#: Columns that are put last: at most so many of the most frequent, 8 bytes each, are sent to every task.
MOST_FREQUENT = 1 << 18
#: A shingle counts as frequent where so many documents of one batch hold it.
LOCALLY = 3
#: Bits of a signature; rows of a block's side; parts of a frequent column.
BITS, BLOCK, SALTS = 2048, 1000, 32
#: Another round of pivots pays while it finds a link for each so many rows that columns of several components still hold.
ROUND_LEAST = 10
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at once; words of more bytes than LONG are digested one by one.
CHUNK, LONG = 1 << 21, 64
#: Whether a byte belongs to a word; for each count the mask of so many leading bytes.
INK = ~np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of text, A-Z in lower case, and where the word begins. Eight bytes are mixed in at a time."""
    raw = text.lower() + bytes(8)  # bytes.lower() changes A-Z alone
    t = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(INK[t[:-8]], prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    eight = np.ndarray((len(t) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = mixed(size.astype(np.uint64) * MIX ^ (eight[starts] & MASK[np.minimum(size, 8)]))
    for k in range(8, LONG, 8):
        on = np.flatnonzero(size > k)
        if not len(on):
            break
        h[on] = mixed(h[on] * MIX ^ (eight[starts[on] + k] & MASK[np.minimum(size[on] - k, 8)]))
    for w in np.flatnonzero(size > LONG):
        h[w] = int.from_bytes(hashlib.blake2b(raw[starts[w] : ends[w]], digest_size=8).digest(), "little")
    return h, starts


def _folded(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes: of fewer words the whole sequence, of none nothing."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    out: list[np.ndarray] = []
    lo = size = 0
    for k, t in enumerate(raw):
        size += len(t) + 1
        if size < CHUNK and k + 1 < len(raw):
            continue
        h, starts = word_hashes(b"\n".join(raw[lo : k + 1]))
        ends = np.cumsum([len(x) + 1 for x in raw[lo : k + 1]])
        first = np.concatenate([[0], np.searchsorted(starts, ends)])
        every = _folded(h, words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = np.sort(every[a : b - words + 1]) if b - a >= words else _folded(h[a:b], b - a) if b > a else every[:0]
            new = own[1:] != own[:-1]
            out.append(own if new.all() else own[np.concatenate([[True], new])])
        lo, size = k + 1, 0
    return out


def frequent(docs: DataFrame, words: int, text_col: str) -> np.ndarray:
    """Hashes of the most frequent shingles, MOST_FREQUENT at most, by counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0), words)
            token, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.int64), np.empty(0, np.int64))
            often = n >= LOCALLY
            yield pa.RecordBatch.from_arrays([pa.array(token[often]), pa.array(n[often].astype(np.int64))], ["token", "n"])

    sums = stored(docs.select(text_col).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8"), "frequent")
    power = F.floor(F.log2("n")).cast("int").alias("power")
    room, least = MOST_FREQUENT, 99
    for p, c in sorted(sums.groupBy(power).count().collect(), reverse=True):  # a row for each power of two
        if c > room:
            break
        room, least = room - c, p
    out = np.sort(sums.where(F.col("n") >= 2.0**least).select("token").toArrow().column(0).to_numpy().astype(np.int64))
    discard(sums)
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, cold, bits, leading) for each row: of its set a digest, the size, how much is not frequent, a signature and its first shingles in column order."""
    late = docs.sparkSession.sparkContext.broadcast(frequent(docs, words, text_col))  # MOST_FREQUENT at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = late.value
        for batch in batches:
            keys, sizes, cold, bits = [], [], [], []
            sets = shingle_sets(batch.column(1), words)
            for k, s in enumerate(sets):
                keys.append(digest(s))
                sizes.append(len(s))
                at = np.zeros(BITS, dtype=bool)
                at[(s.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (BITS - 1)] = True
                bits.append(np.packbits(at).tobytes())
                hot = np.zeros(len(s), dtype=bool)
                if len(last) and len(s):
                    hot = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                cold.append(len(s) - int(hot.sum()))
                sets[k] = np.concatenate([s[~hot], s[hot]])[: len(s) + (-len(s) * percent // 100) + 1 if len(s) else 0]
            for lo, hi in _pieces([len(s) for s in sets]):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(keys[lo:hi], pa.binary()), pa.array(sizes[lo:hi], pa.int32()), pa.array(cold[lo:hi], pa.int32()), pa.array(bits[lo:hi], pa.binary()), _lists(sets[lo:hi])],
                    ["doc_id", "key", "n", "cold", "bits", "leading"],
                )

    shape = "doc_id long, key binary, n int, cold int, bits binary, leading array<bigint>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(emit, shape)


def whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, entries) of (doc_id, text): the whole sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            for lo, hi in _pieces([len(s) for s in sets]):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([digest(s) for s in sets[lo:hi]], pa.binary()), _lists(sets[lo:hi])], ["doc_id", "key", "entries"])

    return texts.mapInArrow(emit, "doc_id long, key binary, entries array<bigint>")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))


def _pieces(lengths: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` entries each."""
    lengths = np.array(lengths, dtype=np.int64)
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(most, int(lengths.sum()) + 1, most)) + 1
    edges = np.unique(np.concatenate([[0], cuts, [len(lengths)]]))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def repeated_ids(rows: DataFrame) -> DataFrame | None:
    """(again): the ids that rows of more than one set have; None if there are none."""
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select(F.col("doc_id").alias("again"))
    return stored(again, "repeated-ids") if again.limit(1).count() else None


def with_own(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """`own`: the row's id where no row of another set has it, else null."""
    if again is None:
        return rows.withColumn("own", F.col("doc_id"))
    return rows.join(again, F.col("doc_id") == F.col("again"), "left").withColumn("own", F.when(F.col("again").isNull(), F.col("doc_id"))).drop("again")


def node_of(key, own):
    """A set's node: the least id that stands for it alone, or where none does a negative number from the digest."""
    return F.coalesce(own, -F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)) - 1)


def shared_entries(rows: DataFrame) -> DataFrame:
    """(token, node, n, at, salt, pivot): the leading entries of each distinct set in columns with more than one member, at
    their places in the column order. A frequent column is split into parts, each with its own pivot."""
    sets = rows.where("n > 0").groupBy("key").agg(
        F.min("own").alias("own"), F.first("n").alias("n"), F.first("cold").alias("cold"), F.first("leading").alias("leading")
    )
    entries = sets.select(node_of("key", F.col("own")).alias("node"), "n", "cold", F.posexplode("leading").alias("at", "token"))
    salt = F.when(F.col("at") >= F.col("cold"), F.pmod(F.xxhash64("node"), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int")
    found = Window.partitionBy("token", "salt").orderBy("n", "node", "at")
    whole = found.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entries = entries.select("token", "node", "n", "at", salt.alias("salt"))
    entries = entries.select("*", F.first(F.struct("n", "node", "at")).over(whole).alias("pivot"), F.count(F.lit(1)).over(whole).alias("members"))
    return entries.where("members > 1 or salt > 0").drop("members")


def enough(most, one, two, percent: int):
    """Whether an overlap of `most` suffices for sets of sizes one and two."""
    return (100 + percent) * most >= percent * (one + two)


def _signed(percent: int):
    """Keeps the pairs that their signatures don't rule out: each bit that only one has stands for a shingle that the other lacks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy().astype(np.int64) for c in ("n_src", "n_dst")]
            bits = [_signatures(batch.column(c)) for c in ("one", "two")]
            yield batch.select([0, 1]).filter(pa.array(enough(_most(*bits, *n), *n, percent), pa.bool_()))

    return check


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)


def _most(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    both = one & two
    common = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return np.minimum(n_one - np.bitwise_count(one).sum(axis=1, dtype=np.int64), n_two - np.bitwise_count(two).sum(axis=1, dtype=np.int64)) + common


def signed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    one = nodes.select(F.col("node").alias("src"), F.col("n").alias("n_src"), F.col("bits").alias("one"))
    two = nodes.select(F.col("node").alias("dst"), F.col("n").alias("n_dst"), F.col("bits").alias("two"))
    both = pairs.join(one, "src").join(two, "dst").select("src", "dst", "n_src", "n_dst", "one", "two")
    return both.mapInArrow(_signed(percent), "src long, dst long")


def verified(pairs: DataFrame, sets_of, percent: int) -> DataFrame:
    """Of the pairs (src, dst) of nodes those whose sets are similar enough, by the whole overlap. sets_of: (node, entries) of some nodes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                one, two = a.values.to_numpy(), b.values.to_numpy()
                overlap = len(np.intersect1d(one, two, assume_unique=True))
                good.append(enough(overlap, len(one), len(two), percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    pairs = stored(pairs, "pairs")
    sets = stored(sets_of(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()), "sets")
    one = sets.select(F.col("node").alias("src"), F.col("entries").alias("one"))
    two = sets.select(F.col("node").alias("dst"), F.col("entries").alias("two"))
    both = pairs.join(one, "src").join(two, "dst").select("src", "dst", "one", "two")
    out = stored(both.mapInArrow(check, "src long, dst long").distinct(), "links")
    discard(pairs), discard(sets)
    return out


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: doc_id, n_shingles, component_id for each row of docs. links: verified pairs (src, dst) of nodes.

    Texts with equal sets are linked and share a node; texts without words have no shingles and are linked with nothing, so
    their component is their own id. Null text has no words. Rows without an id take part, but no component is named by
    them: one of such rows alone has none. Rows that share an id are rows like any others, each in the component of its
    own text. An empty table gives an empty result.
    """
    whole = stored(profiles(docs, percent, words, id_col, text_col), "profiles")
    again = repeated_ids(whole)
    rows = with_own(whole, again)
    nameless = again is not None or bool(whole.where("doc_id is null and n > 0").limit(1).count())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        own = whole_sets(texts.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), words).select(F.col("doc_id").alias("node"), "entries")
        if nameless:  # sets that no id stands for
            bare = texts.where("doc_id is null")
            if again is not None:
                bare = bare.unionByName(texts.join(again.withColumnRenamed("again", "doc_id"), "doc_id", "left_semi"))
            bare = whole_sets(bare, words).groupBy("key").agg(F.first("entries").alias("entries"))
            own = own.unionByName(bare.select(node_of("key", F.lit(None).cast("long")).alias("node"), "entries").join(wanted, "node", "left_semi"))
        return own.dropDuplicates(["node"])

    shared = stored(shared_entries(rows), "entries")
    groups = rows.where("n > 0").groupBy("key").agg(F.min("own").alias("own"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = stored(groups.select("key", node_of("key", F.col("own")).alias("node"), "least", "n", "bits"), "nodes")
    entry = F.struct("n", "node", "at")

    def bound(at, n, at2, n2):
        most = F.least(at, at2) + 1 + F.least(n - 1 - at, n2 - 1 - at2)
        return enough(most, n, n2, percent) & (100 * F.least(n, n2) >= percent * F.greatest(n, n2))

    def star(rows: DataFrame) -> DataFrame:
        near = rows.where((F.col("node") != F.col("pivot.node")) & bound(F.col("at"), F.col("n"), F.col("pivot.at"), F.col("pivot.n")))
        return near.select(F.col("node").alias("src"), F.col("pivot.node").alias("dst"))

    heads = shared.where((F.col("salt") > 0) & (F.col("node") == F.col("pivot.node"))).select("token", "node", "n", "at")
    heads = heads.join(heads.groupBy("token").agg(F.min(entry).alias("pivot")), "token")  # a row for each part of a column
    linked = verified(signed(star(shared).unionByName(star(heads)).distinct(), nodes, percent), sets_of, percent)
    named = components(linked)
    live = stored(mixed_columns(shared, named), "columns")
    discard(shared)
    k = 0
    while True:  # each further round has merged components
        k += 1
        pairs = pivot_pairs(live, k)
        pairs = pairs.where(bound(F.col("at"), F.col("n"), F.col("pivot.at"), F.col("pivot.n"))).select(F.greatest("node", "pivot.node").alias("src"), F.least("node", "pivot.node").alias("dst"))
        more = verified(signed(pairs.distinct(), nodes, percent), sets_of, percent)
        linked, found = linked.unionByName(more), more.count()
        if not found:
            break
        named = stored(hooked(named, more), "named")
        before, live = live, stored(mixed_columns(live, named), "columns")
        discard(before)
        if ROUND_LEAST * found < (live.agg(F.approx_count_distinct("node")).first()[0] or 0):
            break
    blocks = stored(incidence(live, nodes), "blocks")
    pairs = crossing(blocks).mapInArrow(_products(percent), "src long, dst long, common long, least int")
    pairs = pairs.groupBy("src", "dst").agg(F.sum("common").alias("common"), F.first("least").alias("least")).where("common >= least").select("src", "dst")
    more = verified(pairs, sets_of, percent)
    discard(blocks), discard(live)
    linked = linked.unionByName(more)
    named = components(linked)
    of = nodes.select("key", "node", "least").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("key", "component_id")
    out = whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "key").join(of, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), linked


def mixed_columns(entries: DataFrame, named: DataFrame) -> DataFrame:
    """(token, node, n, at, component, bulk) of the columns with members of two components or more; bulk: the one with the most."""
    members = entries.select("token", "node", "n", "at").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = members.groupBy("token", "component").agg(F.count("*").alias("c"))
    tops = parts.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return members.join(tops.select("token", F.col("top.component").alias("bulk")), "token")


def hooked(named: DataFrame, links: DataFrame) -> DataFrame:
    """named with the components that links join hung on a lower one, twice over. What is left apart here a later round, or the end, joins."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(named, "node", "left_anti")
    named = named.unionByName(ends.select("node", F.col("node").alias("component")))
    one, two = named.select(F.col("node").alias("src"), F.col("component").alias("c1")), named.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    joined = links.join(one, "src").join(two, "dst").where("c1 <> c2")
    hook = joined.groupBy(F.greatest("c1", "c2").alias("component")).agg(F.min(F.least("c1", "c2")).alias("on"))
    further = hook.join(hook.select(F.col("component").alias("on"), F.col("on").alias("further")), "on", "left").select("component", F.coalesce("further", "on").alias("on"))
    return named.join(further, "component", "left").select("node", F.coalesce("on", "component").alias("component"))


def pivot_pairs(live: DataFrame, k: int) -> DataFrame:
    """Each member of a column with two others, one of the bulk and one apart from it, if they are of another component; the k-th choice."""
    one = F.struct(F.xxhash64(F.lit(k), F.col("node")).alias("by"), "node", "n", "at", "component")
    own = F.col("component") == F.col("bulk")
    pivots = live.groupBy("token").agg(F.array(F.min(F.when(own, one)), F.min(F.when(~own, one))).alias("pivots"))
    met = live.join(pivots, "token").select("node", "n", "at", "component", F.explode("pivots").alias("pivot"))
    return met.where("pivot.component <> component")


def incidence(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the sparse matrix: (bulk, node, component, n, bits, own, entries), entries an array of (token, at).

    A row's columns are kept apart by their bulk; own: whether the row is of that component.
    """
    lines = live.groupBy("bulk", "node").agg(F.first("component").alias("component"), F.collect_list(F.struct("token", F.col("at").cast("int").alias("at"))).alias("entries"))
    return lines.join(nodes.select("node", "n", "bits"), "node").select("bulk", "node", "component", "n", "bits", (F.col("component") == F.col("bulk")).alias("own"), "entries")


def crossing(lines: DataFrame) -> DataFrame:
    """The rows dealt to blocks (bulk, i, j), sorted by block; side tells a block's two sides apart.

    Rows of the bulk's own component lie in bulk blocks, all others in other blocks. Each bulk block meets each other
    block, and the other blocks meet each other; bulk blocks never meet, for that would be one component.
    """
    sizes = lines.groupBy("bulk").agg(F.greatest(F.ceil(F.count_if("own") / BLOCK), F.lit(1)).cast("int").alias("nb"), F.ceil(F.count_if(~F.col("own")) / BLOCK).cast("int").alias("no"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("nb")).otherwise(F.col("no"))).cast("int")
    others = F.sequence(F.lit(0), F.col("no") - 1)
    # a block is (i, j): i >= 0 an other block and -1 - i a bulk block, j an other block
    as_bulk = F.transform(others, lambda j: F.struct((-1 - at).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    with_bulk = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: F.struct((-1 - b).alias("i"), at.alias("j"), F.lit(1).alias("side")))
    among = F.transform(others, lambda o: F.struct(F.least(at, o).alias("i"), F.greatest(at, o).alias("j"), F.when(at <= o, 0).otherwise(1).alias("side")))
    dealt = lines.join(sizes, "bulk").select("bulk", "node", "component", "n", "bits", "entries", F.explode(F.when(F.col("own"), as_bulk).otherwise(F.concat(with_bulk, among))).alias("t"))
    dealt = dealt.select("bulk", "t.i", "t.j", "t.side", "node", "component", "n", "bits", "entries")
    return dealt.repartition("bulk", "i", "j").sortWithinPartitions("bulk", "i", "j")


def _products(percent: int):
    """Blocks come sorted, each with some thousand rows at most; small blocks are multiplied together."""

    def multiply(rows: pa.Table) -> pa.RecordBatch:
        number = lambda c: rows.column(c).to_numpy().astype(np.int64)
        i, j, side, node, n, part = map(number, ("i", "j", "side", "node", "n", "component"))
        block = np.concatenate([[0], np.cumsum((np.diff(number("bulk")) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))])
        entries = rows.column("entries").combine_chunks()
        row = np.repeat(np.arange(len(node)), entries.value_lengths().to_numpy())
        token, at = (entries.flatten().field(c).to_numpy() for c in ("token", "at"))
        order = np.lexsort((row, token, block[row]))
        row, token, at = row[order], token[order], at[order].astype(np.int64)
        new = np.concatenate([[True], (np.diff(token) != 0) | (np.diff(block[row]) != 0)])
        ends = np.append(np.flatnonzero(new)[1:], len(row))[np.cumsum(new) - 1]  # where each entry's column ends in its block
        nothing = np.empty(0, dtype=np.int64)
        codes, counts, held, size = [], [], [nothing], 0

        def add_up() -> None:
            code, times = np.unique(np.concatenate(held), return_counts=True)
            codes.append(code)
            counts.append(times)

        here, step = np.arange(len(row)), 0
        while len(here):
            step += 1
            here = here[ends[here] > here + step]
            for lo in range(0, len(here), 1 << 20):
                x, y = here[lo : lo + (1 << 20)], here[lo : lo + (1 << 20)] + step
                a, b = row[x], row[y]
                ok = (part[a] != part[b]) & ((i[a] == j[a]) | (side[a] != side[b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                x, y, a, b = x[ok], y[ok], a[ok], b[ok]
                most = np.minimum(at[x], at[y]) + 1 + np.minimum(n[a] - 1 - at[x], n[b] - 1 - at[y])
                ok = enough(most, n[a], n[b], percent)
                held.append(a[ok] * len(node) + b[ok])
                size += len(held[-1])
                if size > 4_000_000:
                    add_up()
                    held, size = [nothing], 0
        add_up()
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        common = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        a, b = np.divmod(code, len(node))
        bits = _signatures(rows.column("bits"))
        ok = np.ones(len(a), dtype=bool)
        for lo in range(0, len(a), 1 << 14):
            x, y = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
            ok[lo : lo + (1 << 14)] = enough(_most(bits[x], bits[y], n[x], n[y]), n[x], n[y], percent)
        a, b, common = a[ok], b[ok], common[ok]
        # of one of the two sets only what follows its leading part can be shared besides
        rest = -(-np.maximum(n[a], n[b]) * percent // 100) - 1
        least = -(-percent * (n[a] + n[b]) // (100 + percent)) - rest
        return pa.RecordBatch.from_arrays(
            [pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b])), pa.array(common), pa.array(least.astype(np.int32))], ["src", "dst", "common", "least"]
        )

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            ids = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("bulk", "i", "j")])
            starts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            if len(starts):  # the last block may go on
                yield multiply(rows.slice(0, int(starts[-1])))
                held = rows.slice(int(starts[-1])).to_batches()
        if sum(b.num_rows for b in held):
            yield multiply(pa.Table.from_batches(held))

    return product


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jaccard_classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, counted in full, and the links followed to their least document.
ORACLE = r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w
    from documents
), s as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
    from w
), e as (select doc_id, unnest(s) as g from s), n as (select doc_id, len(s) as n from s),
rare as (select g from e group by g having count(*) > 1),
f as (select doc_id, g from e semi join rare using (g)),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from f a join f b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
d as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as root from documents union select r.doc_id, d.b from r join d on d.a = r.root)
select n.doc_id, n.n as n_shingles, c.component_id
from n join (select doc_id, min(root) as component_id from r group by doc_id) c using (doc_id)
"""
