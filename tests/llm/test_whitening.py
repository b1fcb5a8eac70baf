"""Whitening against numpy's eigenvectors of the covariance and exact whole-number sums."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from connrisk.llm import whitening as W


def brute(rows, k=4):
    """What the contract asks for: rows ``(vec_id, vector)``."""
    dim = max((len(v) for _, v in rows if v is not None), default=0)
    good = [(i, [math.floor(256 * c) for c in v] + [0] * (dim - len(v))) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out += [(i, c + 1, n, deviation, (np.array(x) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(max(values[c], 1e-300)),
                 values[c] / (centred**2).sum() * n) for c in range(len(values))]
    return out


def table(llm, rows):
    wide = [(i, None if v is None else list(v), 1, "x", b"k") for i, v in rows]
    return llm.createDataFrame(wide, "vec_id long, embedding array<double>, n int, key string, slot binary").repartition(4)


def compare(found, expected):
    found, expected = sorted(found, key=lambda r: (r[0], r[1], r[4])), sorted(expected, key=lambda r: (r[0], r[1], r[4]))
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    for c in {r[1] for r in expected}:
        mine = np.array([r[4] for r in found if r[1] == c])
        theirs = np.array([r[4] for r in expected if r[1] == c])
        order = np.argsort(np.abs(mine)), np.argsort(np.abs(theirs))
        sign = np.sign(mine[order[0][-1]] * theirs[order[1][-1]])
        assert np.abs(np.sort(mine * sign) - np.sort(theirs)).max() < 1e-9
    assert np.allclose([r[5] for r in found], [r[5] for r in expected], rtol=1e-10)


def test_against_numpy(llm):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 40)) * np.linspace(2, 0.2, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7].tolist()) for i in range(200)]  # a vector held by a third of all rows
    rows += [(3, x[3].tolist()), (500, None), (501, [float("nan")] + [0.0] * 39), (502, [float("inf")] * 40),
             (503, [None] + [1.0] * 39), (504, [0.5, -0.5]), (505, [])]
    out = W.whiten(table(llm, rows)).collect()
    compare([tuple(r)[:6] for r in out], brute(rows))
    errors = {r.identity_error for r in out}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_a_pass_takes_few_tasks_however_many_the_session_shuffles_to(llm):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 12)) * np.linspace(2, 0.2, 12))]
    context, cores = llm.sparkContext, llm.sparkContext.defaultParallelism
    many, settings = 3 * cores + 7, ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [llm.conf.get(k) for k in settings]
    try:
        for k, v in zip(settings, (str(many), "false"), strict=True):
            llm.conf.set(k, v)
        fit = W.fit_list(table(llm, rows))
        assert fit.rdd.getNumPartitions() == many
        context.setJobGroup("whitening-passes", "")
        found = W.Whitening(fit)
        context.setLocalProperty("spark.jobGroup.id", None)
    finally:
        for k, v in zip(settings, before, strict=True):
            llm.conf.set(k, v)
    status = context.statusTracker()
    stages = {i for j in status.getJobIdsForGroup("whitening-passes") for i in status.getJobInfo(j).stageIds}
    tasks = sorted(s.numCompletedTasks for s in map(status.getStageInfo, stages) if s)  # 0: skipped
    assert found.passes and len(tasks) > found.passes
    assert tasks[-2] <= cores  # all but the job that measures the fit list
    centred = np.floor(256 * np.array([v for _, v in rows]))
    assert np.allclose(found.values, np.linalg.eigvalsh(np.cov(centred.T, bias=True))[::-1][:4], rtol=1e-12)


def test_the_fit_list_is_read_in_partitions_by_its_bytes(llm, monkeypatch):
    fit, cores = llm.range(100).repartition(200), llm.sparkContext.defaultParallelism
    assert W.gathered(fit, 1).rdd.getNumPartitions() == cores
    monkeypatch.setattr(W, "PASS_BYTES", 1000)
    assert W.gathered(fit, 1000 * (cores + 5)).rdd.getNumPartitions() == cores + 5
    assert W.gathered(fit, 10**9).rdd.getNumPartitions() == 200


def test_degenerate_inputs(llm):
    empty = table(llm, [(1, [1.0])]).where("vec_id < 0")
    assert W.whiten(empty).collect() == [] and W.whiten(table(llm, [(1, None), (2, [float("nan")])])).collect() == []
    assert W.whiten(table(llm, [(1, []), (2, [])])).collect() == []
    alike = W.whiten(table(llm, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alike) == [
        (i, c, 1, 0, None, None, None) for i in ("1", "None") for c in (1, 2)]
    line = W.whiten(table(llm, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()  # one direction
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert [r.explained for r in line if r.component == 1] == pytest.approx([1.0] * 9)


def test_huge_numbers_stay_exact(llm):
    rows = [(1, [1e14, -3e13]), (2, [5e13, 1e300]), (3, [-1e300, 7.0])]
    out = W.whiten(table(llm, rows)).collect()
    x = {1: (256 * 10**14, -256 * 3 * 10**13), 2: (256 * 5 * 10**13, 2**63 - 1), 3: (-(2**63), 1792)}
    sums = [sum(v[j] for v in x.values()) for j in (0, 1)]
    exact = {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}
    assert {r.vec_id: r.deviation for r in out} == {i: v if v < 10**38 else None for i, v in exact.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-200, 200), min_size=3, max_size=3), max_size=8))
def test_keys_are_equal_when_vectors_are(rows):
    x = np.array(rows, np.int64).reshape(len(rows), 3)
    keys = W.packed(x)
    assert (W.unpacked(keys, 5)[:, :3] == x).all()
    assert len(set(keys)) == len({tuple(r) for r in rows})
    assert keys == W.packed(np.pad(x, ((0, 0), (0, 2))))


@pytest.mark.parametrize("spectrum", [np.ones(50) + np.linspace(0.1, 0, 50), np.arange(1, 51.0) ** -2, np.exp(-np.arange(50.0)),
                                      np.r_[3.0, 3.0, 3.0, 3.0, 3.0, np.ones(45)], np.r_[1.0, np.zeros(49)]])
def test_certified_for_flat_steep_tied_and_rank_deficient_spectra(spectrum):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((50, 50)))[0]
    v = (turn * spectrum) @ turn.T
    calls = []
    values, vectors, residual = W.leading_eigenpairs(lambda q: calls.append(1) or v @ q, 50, 4, block=12)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-12, atol=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13 and residual < 1e-12
    assert np.linalg.norm(v @ vectors - vectors * values) < 1e-12
    assert len(calls) < 200
