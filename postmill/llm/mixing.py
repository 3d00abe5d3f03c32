"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by a seeded hash into blocks, which is a random permutation of the source cut into
blocks. A source's target becomes an exact quota: so many whole passes over its blocks, then so many further blocks, then
the leading documents of one last block. A binary tree over the output shards splits the vector of block quotas: the left
half of the shards takes a multivariate-hypergeometric draw from it, the right half the rest, and so on, so shards get
random yet exactly adding shares. Each shard takes disjoint draws of the permuted blocks and orders its records by a
seeded hash.

A document's share depends on its source's few numbers and its own hashes, so documents are never shuffled to decide.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, stored, table

WEIGHTS, SHARE, MOST_PASSES = (5.0, 2.0, 1.0), 1.5, 2
SHARDS, BLOCK_ROWS, SEED = 8, 512, 77
#: Up to this many sources their numbers are broadcast (at most 8 + SHARDS longs each), beyond it they are joined by shuffle.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, BLANK_RUN), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> list[float]:
    """Targets of sources in order: shares by weight of share * sum(sizes); those above most * size stop there, what is over is shared again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        per = left / sum(w[i] for i in open_)
        full = {i for i in open_ if w[i] * per > most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else w[i] * per
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns): rows add up to the quotas, columns differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(quotas)
    room = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(have, sum(room[lo:mid]), method="marginals")
        split(left, lo, mid)
        split(have - left, mid, hi)

    if len(quotas):
        split(np.array(quotas, dtype=np.int64), 0, shards)
    return out


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(record, size, source_size, target, copies, draws): one row per input row, `record` the struct of all its columns.

    draws is an array of (shard, key), one for each time that the mix takes the document; mixture() makes the records of
    the mix from it. Null text has size 0 and is taken as often as its hashes say; a null source is a source, ordered
    last. Rows without an id are placed by their text. An empty table gives an empty result.
    """
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col))).otherwise(F.xxhash64(F.lit(seed), F.col(text_col)))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), key.alias("key"))
    facts = stored(rows.select("source", "size", "key"), "mix-facts")
    # one row per source
    sums = sorted(facts.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([r["size"] for r in sums])
    plan = [(r["source"], r["size"], t, max(1, math.ceil(r["n"] / BLOCK_ROWS)), int(min(MOST_PASSES, t // r["size"])) if r["size"] else 0) for r, t in zip(sums, goal, strict=True)]
    plan = [(*p, p[2] - p[4] * p[1] if p[4] < MOST_PASSES else 0.0) for p in plan]
    spark = docs.sparkSession
    shape = "source string, source_size long, target double, blocks long, passes int, rest double"
    few = len(plan) <= BROADCAST_SOURCES
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    of = spark.createDataFrame(plan, shape)
    block = F.pmod("key", F.col("blocks"))
    placed = facts.join(small(of.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "key", block.alias("block"), "rest")
    blocks = placed.where("rest > 0").groupBy("source", "block", "rest").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    # the block in which a source's rest runs out; all before it are taken whole
    last = blocks.where("before < rest and before + size >= rest").groupBy("source").agg(F.max_by(F.struct("block", (F.col("rest") - F.col("before")).alias("left")), "block").alias("x"))
    last = stored(last.select("source", "x.block", "x.left"), "mix")
    edge = placed.select("source", "size", "key", "block").join(
        small(last.select(F.col("source").alias("of"), F.col("block").alias("b"), "left")), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b"))
    ).withColumn("k2", F.xxhash64("key"))
    upto = Window.partitionBy("source").orderBy("k2").rangeBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("sum", F.sum("size").over(upto)).where(F.col("sum") - F.col("size") / 2 <= F.col("left"))
    cuts = {r["source"]: r["cut"] for r in edge.groupBy("source").agg(F.max("k2").alias("cut")).collect()}  # one row per source
    ends = {r["source"]: r["block"] for r in last.collect()}
    quotas = [b * e + (ends.get(s, -1) + 1) for s, _, _, b, e, _ in plan]
    shares = split_quotas(quotas, shards, seed).cumsum(axis=1)
    lines = []
    for (s, size, t, b, e, _), q, share in zip(plan, quotas, shares, strict=True):
        step = next(x for x in range(max(1, int(q * 0.618)), q + 2) if math.gcd(x, max(q, 1)) == 1)
        lines.append((s, size, t, b, e, ends.get(s, -1), cuts.get(s), max(q, 1), step, [int(x) for x in share]))
    shape = "of string, source_size long, target double, blocks long, passes int, last long, cut long, quota long, step long, ends array<bigint>"
    full = rows.join(small(spark.createDataFrame(lines, shape)), F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block)
    more = (F.col("block") < F.col("last")) | ((F.col("block") == F.col("last")) & F.coalesce(F.xxhash64("key") <= F.col("cut"), F.lit(False)))
    full = full.withColumn("copies", F.col("passes") + F.when(more, 1).otherwise(0))
    # draw number -> its place among the source's permuted draws -> the shard whose range holds that place
    shard = lambda i: F.size(F.filter("ends", lambda x: x <= F.pmod((i.cast("long") * F.col("blocks") + F.col("block")) * F.col("step"), F.col("quota"))))
    draws = F.transform(F.filter(F.sequence(F.lit(0), F.lit(MOST_PASSES)), lambda i: i < F.col("copies")), lambda i: F.struct(shard(i).alias("shard"), F.xxhash64("key", i, F.lit(seed)).alias("key")))
    return full.select("record", "size", "source_size", "target", "copies", draws.alias("draws"))


def mixture(mixed: DataFrame) -> DataFrame:
    """The records of the mix: (shard, key, record), record with all columns of the documents, dealt by ranges of shard and key.

    A shard's draws come from all sources and blocks; ordered by key, which is a hash of the draw, they are shuffled.
    """
    drawn = mixed.select("record", F.explode("draws").alias("draw")).select("draw.shard", "draw.key", "record")
    return drawn.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("record.doc_id").alias("doc_id"), "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"), "draws")
