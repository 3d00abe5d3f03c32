"""Nearest neighbours by cosine: exactly, in blocks of queries, and by an index of cells.

Exact: queries are taken in chunks of bounded size, sent to all tasks, and multiplied as matrices with the batches of
vectors, block by block; a task keeps the k best for each query, and only these are shuffled. Index: centres are fitted on a bounded
sample, every vector is put into the cell of its nearest centre, and a query meets the vectors of its nearest cells.
Null vectors, vectors of another length, and such as have no direction (zero, null or non-finite components) are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept

#: Queries that are sent to all tasks at once.
CHUNK = 4096
#: Similarities that a task holds at once.
BLOCK = 1 << 20
#: The sample that centres are fitted on (vectors of least hash), the number of cells, the rounds, and the cells that a query looks into:
#: enough for vectors that are nearly noise; such as lie in clusters need far fewer.
SAMPLE, CELLS, ROUNDS, PROBES = 20_000, 32, 8, 23


def directions(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of length 1, as doubles; those without a direction are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))  # null, NaN and zero fall out
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def _merged(best: tuple[np.ndarray, np.ndarray], found: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row (similarities, ids) among the best so far and the newly found ones; -inf stands for none."""
    s, i = np.concatenate([best[0], found], axis=1), np.concatenate([best[1], np.broadcast_to(of, found.shape)], axis=1)
    bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, column = np.nonzero((s >= bar[:, None]) & (s > -np.inf))  # equal similarities may be more than k
    s, i = s[row, column], i[row, column]
    order = np.lexsort((i, -s, row))
    row, s, i = row[order], s[order], i[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, s, i, place = (x[place < k] for x in (row, s, i, place))
    out = np.full(best[0].shape, -np.inf), np.zeros(best[1].shape, np.int64)
    out[0][row, place], out[1][row, place] = s, i
    return out


def _best(ids: np.ndarray, queries: np.ndarray, k: int):
    """A task's k best for each query; equal similarities go to the smaller id, and no vector is its own neighbour.

    Batches are taken in blocks, so that similarities held at once are BLOCK, or one for each query if these are more.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        step = max(1, BLOCK // len(ids))
        for batch in batches:
            of, vectors = np.asarray(batch.column(0)), _matrix(batch.column(1), queries.shape[1])
            for at in range(0, len(of), step):
                some = of[at : at + step]
                found = queries @ vectors[at : at + step].T
                found[ids[:, None] == some[None, :]] = -np.inf
                better = (found >= best[0][:, -1:]).any(axis=1)
                if better.any():
                    merged = _merged((best[0][better], best[1][better]), found[better], some, k)
                    best[0][better], best[1][better] = merged
        q, place = np.nonzero(best[0] > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(best[1][q, place], pa.int64()), pa.array(best[0][q, place], pa.float64())], ["q", "id", "similarity"])

    return task


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("similarity").desc(), "id"))  # Spark keeps k of each task before the shuffle
    return rows.withColumn("place", place).where(F.col("place") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(q, id, similarity, place): the k nearest of all vectors for each query; ids are integers. Empty tables give an empty result."""
    rows, asked = directions(vectors, id_col, vector_col), kept(directions(queries, id_col, vector_col), "queries")
    out = rows.sparkSession.createDataFrame([], "q long, id long, similarity double")
    held: list = []

    def passed(chunk: list) -> DataFrame:
        ids, matrix = np.array([r["id"] for r in chunk], dtype=np.int64), np.array([r["v"] for r in chunk])
        same = rows.where(F.size("v") == matrix.shape[1])
        return kept(same.mapInArrow(_best(ids, matrix, k), "q long, id long, similarity double"), "nearest")

    for r in asked.orderBy(F.size("v")).toLocalIterator():  # one length after the other, a partition at a time
        if held and (len(held) == CHUNK or len(held[0]["v"]) != len(r["v"])):
            out, held = out.unionByName(passed(held)), []
        held.append(r)
    return _ranked(out.unionByName(passed(held)) if held else out, k)


def centres(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of cells, by rounds of spherical means over the `sample` vectors of least hash of their id."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # bounded by `sample`
    x = np.array([r["v"] for r in some])
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else np.zeros((0, 0))
    for _ in range(rounds if len(x) else 0):
        cell = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def _cells(c: np.ndarray, probes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(-(_matrix(batch.column(1), c.shape[1]) @ c.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], ["id", "v", "cells"])

    return task


def by_cells(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = PROBES) -> DataFrame:
    """As exact(), among the vectors of the `probes` cells nearest to a query: every vector is in one cell, none is left out.

    Vectors must have one length. A cell with very many vectors is a skewed side of a join, which adaptive execution splits.
    """
    rows, asked = directions(vectors, id_col, vector_col), directions(queries, id_col, vector_col)
    c = centres(rows)
    if not len(c):
        return rows.sparkSession.createDataFrame([], "q long, id long, similarity double, place int")
    shape = "id long, v array<double>, cells array<int>"
    indexed = rows.mapInArrow(_cells(c, 1), shape).select("id", "v", F.get("cells", 0).alias("cell"))
    looked = asked.mapInArrow(_cells(c, probes), shape).select(F.col("id").alias("q"), F.col("v").alias("w"), F.explode("cells").alias("cell"))
    pairs = indexed.join(looked, "cell").where("id <> q")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return _ranked(pairs.select("q", "id", dot.alias("similarity")), k)
