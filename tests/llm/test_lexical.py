"""Ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from connrisk.llm import lexical as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """``(item_id, rank, doc_id, score)``, items and documents by row."""
    bags = [(i, w, Counter(w)) for i, t in docs if (w := terms(t))]
    n, total = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item_id, text in items:
        asked = terms(text)
        scores = []
        for i, w, c in bags:
            m = 75 + (25 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item_id, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(prose):
    rows = [(i, prose(i, 30)) for i in range(8)] + [(20, None), (21, ""), (22, "nowhere-to-be-found"), (23, "SHORT short Short"), (24, prose(99, 60))]
    return rows + [(0, prose(0, 30)), (25, "one"), (None, "two line"), (26, "a" * 300)]


def tables(llm, docs, items):
    d = llm.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string").repartition(6)
    return d, llm.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int").repartition(3)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("cells", "block"), [(X.SHARD_CELLS, X.BLOCK_BYTES), (2_000, 400), (1, 1 << 20)])
def test_against_brute_force(llm, documents, items, monkeypatch, cells, block):
    monkeypatch.setattr(X, "SHARD_CELLS", cells)  # few cells: many shards, the k-th score carried between them
    docs = documents + [(400 + i, "One two three one") for i in range(40)] + [(None, "One two three one")] * 2 + [(400, "one")]
    assert found(X.search(*tables(llm, docs, items), block_bytes=block)) == brute(docs, items)


def test_empty_tables(llm, documents, items, no_docs, null_docs):
    docs, bench = tables(llm, documents, items)
    assert X.search(docs, bench.where("item_id < -1")).collect() == []
    assert X.search(no_docs, bench).collect() == []
    assert X.search(docs.where("text is null"), bench).collect() == []
    assert len(X.search(null_docs, llm.createDataFrame([(None, "window", None)], "item_id long, text string, x int")).collect()) == 2


def lists(rng, n_terms, n_docs, most):
    impact = rng.integers(0, most, (n_terms, n_docs)) * (rng.random((n_terms, n_docs)) < rng.random((n_terms, 1)))
    t, d = np.nonzero(impact)
    return impact, X.ImpactLists(t, d, impact[t, d], n_terms, n_docs)


def test_best_positions_find_the_same_documents_with_ties():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n_terms, n_docs, k = int(rng.integers(1, 8)), int(rng.integers(1, 300)), int(rng.integers(1, 12))
        impact, shard = lists(rng, n_terms, n_docs, int(rng.integers(2, 60)))
        weights = rng.integers(0, 9, n_terms)
        scores = weights @ impact
        kth = np.sort(scores)[::-1][: k][-1] if n_docs >= k else 0
        for floor in (0, int(kth), int(kth) + 1):
            docs, values, _ = shard.top(np.arange(n_terms), weights, k, floor)
            need = set(np.flatnonzero(scores >= max(kth, floor, 1)).tolist())
            assert need <= set(docs.tolist()) and (values == scores[docs]).all()


def test_reading_stops_early_and_whole_shards_are_left_at_their_heads():
    rng = np.random.default_rng(6)
    docs = np.tile(np.arange(5_000), 3)
    base = rng.pareto(1.0, 5_000) * 1000  # a few documents stand out in all lists
    impact = np.concatenate([np.minimum(base * f, 9e8) for f in (1.0, 0.9, 1.1)]).astype(np.int64) + 1
    shard = X.ImpactLists(np.repeat(np.arange(3), 5_000), docs, impact, 3, 5_000)
    _, values, looked_up = shard.top(np.arange(3), np.array([3, 2, 1]), 10)
    assert looked_up < 100 and len(values) >= 10
    assert shard.top(np.arange(3), np.array([3, 2, 1]), 10, floor=int(1e12))[2] == 0


def test_the_bound_follows_positions_marked_by_direct_access():
    # Documents 0 and 1 lead list 0; direct access marks them at the head of list 1 as well, so its best position is beyond the depth read.
    shard = X.ImpactLists(np.array([0, 0, 0, 1, 1, 1]), np.array([0, 1, 2, 1, 0, 3]), np.array([90, 80, 1, 70, 60, 1]), 2, 4)
    docs, _, looked_up = shard.top(np.array([0, 1]), np.array([1, 1]), 1)
    assert set(docs.tolist()) >= {0} and looked_up == 2
