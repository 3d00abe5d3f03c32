"""Vector code compression: product codes whose nearest entries are found in a vantage-point tree for each part.

A vector's components become integers, its eight parts are coded by the nearest entry of the part's codebook. Codebooks
are fitted by rounds of assignment and integer means over all vectors. Every assignment goes through one vantage-point
tree for each part position, built on the part's entries: a node holds one entry, the entries up to its middle distance
lie inside and the others outside, and a branch is left out only if the triangle inequality rules it out. Square roots are
rounded so that bounds are never too tight, a branch at exactly the best distance is visited (its entry may have the lower
index), and what decides is always the squared distance in integers.

Spark partitions the vectors, tasks return sums for each entry, and only codebooks (PARTS x ENTRIES entries) reach the
driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components must stay below this, scaled, for exact 64-bit sums of squares.
MOST = 1 << 27
#: Labels with this share of all rows get their sums by broadcast (at most so many labels), the others by a shuffle.
HEAVY_PARTS = 10_000

Node = tuple  # (entry, low inside, high inside, low outside, inside, outside); None for no entries


def _down(squares: np.ndarray) -> np.ndarray:
    """A lower bound of the square roots, as integers."""
    return np.maximum(np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64) - 1, 0)


def _up(squares: np.ndarray) -> np.ndarray:
    """An upper bound of the square roots, as integers."""
    return np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64) + 2


def grow(entries: np.ndarray, of: np.ndarray | None = None) -> Node | None:
    """The vantage-point tree of a part's entries (rows); `of` are the indices of those it holds, ascending."""
    of = np.arange(len(entries)) if of is None else of
    if not len(of):
        return None
    rest = of[1:]
    squares = ((entries[rest] - entries[of[0]]) ** 2).sum(axis=1)
    order = np.argsort(squares, kind="stable")
    half = (len(rest) + 1) // 2
    near, far = rest[order[:half]], rest[order[half:]]
    d_near, d_far = squares[order[:half]], squares[order[half:]]
    high_in = int(_up(d_near[-1:])[0]) if half else 0
    low_out = int(_down(d_far[:1])[0]) if len(far) else 0
    return int(of[0]), high_in, low_out, grow(entries, np.sort(near)), grow(entries, np.sort(far))


def nearest(tree: Node | None, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for each point; equal distances go to the lower index."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    found = np.full(len(points), len(entries), dtype=np.int64)

    def visit(node: Node | None, who: np.ndarray) -> None:
        if node is None or not len(who):
            return
        entry, high_in, low_out, inside, outside = node
        d = ((points[who] - entries[entry]) ** 2).sum(axis=1)
        better = (d < best[who]) | ((d == best[who]) & (entry < found[who]))
        best[who[better]], found[who[better]] = d[better], entry
        low, high = _down(d), _up(d)
        first = high <= (high_in + low_out) // 2  # the likelier side goes first and tightens the bound for the other
        into = lambda w, b: visit(inside, w[b - high_in <= _up(best[w])])
        out = lambda w, b: visit(outside, w[low_out - b <= _up(best[w])])
        into(who[first], low[first])
        out(who[first], high[first])
        out(who[~first], high[~first])
        into(who[~first], low[~first])

    visit(tree, np.arange(len(points)))
    return found, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List rows as a matrix of integers; all rows have `width` values."""
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), width)


def assign(books: np.ndarray, rows: np.ndarray, trees: list[Node | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, squared distances), a column for each part; books has the shape (parts, entries, part length)."""
    trees = trees or [grow(b) for b in books]
    pieces = rows.reshape(len(rows), len(books), -1)
    each = [nearest(t, b, np.ascontiguousarray(pieces[:, p])) for p, (t, b) in enumerate(zip(trees, books, strict=True))]
    return np.stack([i for i, _ in each], axis=1), np.stack([d for _, d in each], axis=1)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): kept rows with integer components, padded with zeros to one length that PARTS divides."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(v.isNotNull() & finite)
    wide = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))
    return stored(kept.select("vec_id", "label", wide.alias("v")), "vectors")


def fit(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of the shape (parts, entries, part length) after all rounds; fewer entries where there are fewer rows.

    A round is one pass over the stored rows; each task sums up its parts by entry, and Spark adds the tasks' sums.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # `entries` rows
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        sums = _sums(rows, books, width).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = books.copy()
        for r in sums.collect():  # one row for each component of the codebooks at most
            books[r["part"], r["entry"], r["place"]] = r["s"] // r["n"]
    return books


def _sums(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(part, entry, n, place, s) for each task: how many parts an entry got, and the sum of their components by place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [grow(b) for b in books]
        total, n = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), width)
            found, _ = assign(books, v, trees)
            pieces = v.reshape(len(v), len(books), -1)
            for p in range(len(books)):
                np.add.at(total[p], found[:, p], pieces[:, p])
                n[p] += np.bincount(found[:, p], minlength=books.shape[1])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": n[part, entry], "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    each = rows.select("v").mapInArrow(task, "part int, entry int, n long, sums array<long>")
    return each.select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code, error): indices as two hex digits for each part, squared distances summed over the parts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [grow(b) for b in books]
        for batch in batches:
            found, d = assign(books, _matrix(batch.column("v"), width), trees)
            codes = [bytes(r).hex() for r in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(d.sum(axis=1), pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(task, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, code, error, label_error), codebooks). Rows without a vector, or with a null or non-finite component, go.

    Components must stay below 32,768 in size, else the job ends with an error that says so: 64-bit sums would not hold.
    Vectors shorter than the longest, or of a length that the number of parts doesn't divide, count as padded with zeros.
    Rows that repeat an id are rows like others, null ids come last among those that start the codebooks; fewer rows than
    entries give fewer entries; null labels are one label. Other columns aren't read. An empty table gives an empty result.
    """
    rows = integers(vectors, id_col, vector_col, label_col)
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least"), most.alias("most"), F.count("*").alias("n")).first()
    if (facts["most"] or 0) >= MOST:
        raise ValueError(f"a component is {facts['most'] / SCALE} in size, {MOST // SCALE} is too large")
    width = -(-(facts["width"] or 0) // PARTS) * PARTS
    if (facts["least"] or 0) < width:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    books = fit(rows, width)
    coded = stored(encode(rows, books, width), "vector-codes")
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    heavy = F.col("n") * HEAVY_PARTS >= facts["n"]
    of = sums.select(F.col("label").alias("of"), "label_error", heavy.alias("heavy"))
    same = F.col("label").eqNullSafe(F.col("of"))
    large = coded.join(F.broadcast(of.where("heavy")), same, "left")  # HEAVY_PARTS labels at most
    rest = large.where("heavy is null").drop("of", "label_error", "heavy").join(of.where("not heavy"), same)
    columns = ("vec_id", "code", "error", "label_error")
    return large.where("heavy").select(*columns).unionByName(rest.select(*columns)), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


def _round(i: int) -> str:
    """SQL of one round: every part to its nearest entry, then the entries' floored means (-- of negative sums, too)."""
    return f"""
n{i} as materialized (select v.part, v.id, v.x, min((list_sum(list_transform(range(1, len(v.x) + 1), lambda k: (v.x[k] - b.x[k]) * (v.x[k] - b.x[k])))::bigint, b.entry)) as best from v join b{i} b using (part) group by all),
m{i} as materialized (select part, best[2] as entry, k, (sum(x[k]) - ((sum(x[k]) % count(*)) + count(*)) % count(*)) // count(*) as x from n{i}, unnest(range(1, len(x) + 1)) as u(k) group by all),
b{i + 1} as materialized (select b.part, b.entry, coalesce((select list(m.x::bigint order by m.k) from m{i} m where m.part = b.part and m.entry = b.entry), b.x) as x from b{i} b),"""


ORACLE = f"""
with e as materialized (select vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::double)::bigint) as w from embeddings
    where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
v as materialized (select vec_id as id, part, w[part * len(w) // {PARTS} + 1:(part + 1) * len(w) // {PARTS}] as x from e, range({PARTS}) as r(part)),
f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from e order by vec_id limit {ENTRIES}),
b0 as materialized (select part, entry, x from v join f on id = vec_id),
{"".join(_round(i) for i in range(ROUNDS))}
z as materialized (select v.part, v.id, min((list_sum(list_transform(range(1, len(v.x) + 1), lambda k: (v.x[k] - b.x[k]) * (v.x[k] - b.x[k])))::bigint, b.entry)) as best from v join b{ROUNDS} b using (part) group by all),
c as (select id, string_agg(lower(printf('%02x', best[2])), '' order by part) as code, sum(best[1])::bigint as error from z group by id),
s as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e join c on id = vec_id, s"""
