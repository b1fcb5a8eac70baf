"""Neighbour search: recall and exact scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from connrisk.llm import neighbours


def exact(ids, x, query, k):
    scores = (x * x[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_driver_table(llm):
    table = llm.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = by_query(neighbours.search(table, F.col("vec_id") % 20 == 0))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, got in found.items():
        want = exact(ids, x, int(np.flatnonzero(ids == q)[0]), 20)
        hits, total = hits + len({i for i, _ in want} & {i for i, _ in got}), total + len(want)
        scores = {int(i): float(s) for i, s in zip(ids, (x * x[ids == q]).sum(axis=1))}
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in got)
        assert got == sorted(got, key=lambda p: (-p[1], p[0]))
    assert hits / total >= 0.9


def test_recall_on_clusters_and_two_hashes(llm):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 1200)] + 0.25 * rng.normal(size=(1200, 24))).astype(np.float64)
    ids = np.arange(1200)
    df = llm.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    found = by_query(neighbours.search(df, F.col("vec_id") % 20 == 0, hashes=2, probes=40, tables=16))
    hits = sum(len({i for i, _ in exact(ids, x, q, 20)} & {i for i, _ in got}) for q, got in found.items())
    assert hits / (20 * len(found)) >= 0.9


def test_many_equal_vectors_in_small_blocks(llm, monkeypatch):
    """A third of the rows are one vector: its bucket becomes many block pairs, ties go to small ids."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(6)
    same = rng.normal(size=10)
    x = np.array([same if i % 3 == 0 else rng.normal(size=10) for i in range(300)])
    df = llm.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, bucket int").repartition(4)
    found = by_query(neighbours.search(df, F.col("vec_id") % 60 == 0))
    for q, got in found.items():
        assert [i for i, _ in got] == [i for i in range(0, 300, 3) if i != q][:20]
        assert len({s for _, s in got}) == 1


def test_vectors_that_take_no_part_and_few_candidates(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [-1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [0.0, 1e-300])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = by_query(neighbours.search(df, F.lit(True)))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {
        0: [1, 20, 8], 1: [0, 20, 8], 8: [20, 1, 0], 20: [1, 0, 8]}
    assert neighbours.search(df.where("vec_id = 99"), F.lit(True)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = neighbours.hadamard(x)
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and np.allclose(neighbours.hadamard(y), x)
