"""Nearest neighbours against brute force; the index's recall."""

import numpy as np
import pytest

from postmill.operators import nearest

SHAPE = "embedding array<float>, vec_id long, id string, v int, q int, cell int"


def table(spark, rows):
    return spark.createDataFrame([(e, i, "x", 1, 2, 3) for i, e in rows], SHAPE)


def plain(rows, queries, k):
    unit = {i: np.array(e, dtype=np.float32).astype(float) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    unit = {i: e / np.linalg.norm(e) for i, e in unit.items()}
    out = set()
    for q in queries:
        near = sorted((-round(float(unit[q] @ e), 9), i) for i, e in unit.items() if i != q and len(e) == len(unit[q])) if q in unit else []
        out |= {(q, i, place + 1) for place, (_, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("chunk", [nearest.CHUNK, 3])
def test_exact_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(nearest, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [float("nan")] * 6), (204, [None] * 6), (205, [1.0, 2.0]), (206, [2.0, 1.0]), (207, rows[3][1]), (208, rows[3][1])]
    asked = [0, 3, 20, 33, 77, 149, 202, 203, 205]
    d = table(spark, rows).repartition(5)
    got = nearest.exact(d, d.where(d.vec_id.isin(asked)), 4).collect()
    assert {(r["q"], r["id"], r["place"]) for r in got} == plain(rows, asked, 4)
    assert nearest.exact(d.limit(0), d, 4).count() == 0 and nearest.exact(d, d.limit(0), 4).count() == 0


def test_memory_of_a_task():
    """Many queries against a batch: neither the first batch nor equal vectors, which all are candidates, become Python objects."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    queries = rng.normal(size=(2000, 8))
    vectors = np.concatenate([rng.normal(size=(2000, 8)), np.ones((2000, 8))])
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(4000) + 4000 * n), pa.array(list(vectors))], ["id", "v"]) for n in range(2)]
    tracemalloc.start()
    out = next(nearest._best(np.arange(2000), queries, 3)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    all_ = queries @ np.concatenate([vectors, vectors]).T
    all_[np.arange(2000), np.arange(2000)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(8000), all_.shape), -np.round(all_, 9)), axis=1)[:, :3]
    assert np.array_equal(np.asarray(out.column(1)).reshape(2000, 3), want)


def test_recall_of_the_cells(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = v.where("vec_id % 100 = 0")
    exact, found = ({(r["q"], r["id"]) for r in f(v, q, 10).collect()} for f in (nearest.exact, nearest.by_cells))
    assert len(exact) == len(found) == 10 * q.count()
    assert len(exact & found) >= 0.9 * len(exact)
    assert nearest.by_cells(v.limit(0), q, 10).count() == 0
