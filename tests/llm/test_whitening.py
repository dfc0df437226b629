from __future__ import annotations

import math

import numpy as np
import pytest

from loomwork.llm import queries
from loomwork.llm.whitening import BLOCK_ROWS, Model, State, whiten
from tests.conftest import DATA


def fit_of(vectors):
    good = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return np.unique(np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in good if v], np.int64), axis=0)


def compare(rows, fit, top):
    """Rows (vec_id, component, ...) against the covariance's own eigenvectors."""
    n, d = fit.shape
    sums = fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    for c in range(1, top + 1):
        mine = sorted((r for r in rows if r.component == c), key=lambda r: r.vec_id)
        assert all(abs(r.explained / (values[c - 1] / np.trace(cov)) - 1) < 1e-9 and r.n == n and 0 <= r.identity_error < 1e-8 for r in mine)
        yield c, mine, vectors[:, c - 1] / math.sqrt(values[c - 1]), sums, n


def test_merging_loses_nothing():
    rng = np.random.default_rng(3)
    for n, d in [(1, 4), (3, 5), (200, 6), (BLOCK_ROWS + 5, 3)]:
        rows = (rng.normal(size=(n, d)) * rng.integers(1, 900, d) + rng.integers(-5000, 5000, d)).astype(np.int64)
        cuts = sorted({0, n, *rng.integers(0, n + 1, 4).tolist()})
        states = [State.of(rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        state = states[0]
        for s in states[1:]:
            state = state.merged(s)
        centred = rows - rows.mean(axis=0)
        back = state.vectors.T @ np.diag(state.sizes**2) @ state.vectors
        assert state.n == n and state.sums == rows.sum(axis=0).tolist()
        assert np.allclose(back, centred.T @ centred, rtol=1e-10, atol=1e-7 * max(1, np.abs(back).max()) * 1e-3)


def test_exact_deviation_beyond_64_bits():
    rows = np.array([[2**40, 0], [0, 5], [1, 1]], np.int64)
    model = Model.of(State.of(rows), 4)
    want = [sum((3 * int(x) - int(s)) ** 2 for x, s in zip(r, rows.sum(axis=0), strict=True)) for r in rows]
    assert model.deviations(rows) == [w if w < 2**63 else None for w in want] and None in model.deviations(rows)
    assert model.deviations(np.array([[1, 2]])) == [None]


def test_query_against_numpy(spark):
    sf = f"{DATA}/sf0.01"
    rows = queries.queries()["op12_whitened_embeddings"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    by_id = {r.vec_id: list(r.embedding) for r in table}
    fit = fit_of(by_id.values())
    assert len(rows) == 4 * len(by_id)
    for _, mine, axis, sums, n in compare(rows, fit, 4):
        x = np.array([[math.floor(256 * c) for c in by_id[r.vec_id]] for r in mine], np.int64)
        want = (x - sums / n) @ axis
        got = np.array([r.whitened for r in mine])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert [r.deviation for r in mine] == ((n * x - sums) ** 2).sum(axis=1).tolist()


def test_nulls_copies_and_columns_of_the_same_names(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(c) for c in rng.normal(size=3)], "a") for k in range(60)]
    copies = [(1000 + k, good[0][1], "a") for k in range(200)]
    bad = [(500, None, "a"), (501, [1.0, None, 2.0], "a"), (502, [1.0, float("nan"), 0.0], "a"), (503, [float("inf"), 0.0, 0.0], "a"), (504, [], "a")]
    more = [(None, good[1][1], "a"), (7, good[7][1], "b")]
    df = spark.createDataFrame(good + copies + bad + more, "vec_id bigint, embedding array<float>, n string").repartition(5)
    rows = whiten(df).collect()
    assert whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(rows) == 3 * (60 + 200 + 2) and {r.component for r in rows} == {1, 2, 3} and {r.n for r in rows} == {60}
    for _, mine, axis, sums, n in compare([r for r in rows if r.vec_id is not None and r.vec_id < 60], fit_of([g[1] for g in good]), 3):
        x = {k: np.array([math.floor(256 * float(np.float32(c))) for c in v]) for k, v, _ in good}
        want = np.array([(x[r.vec_id] - sums / n) @ axis for r in mine])
        got = np.array([r.whitened for r in mine])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9


def test_little_or_nothing_to_fit(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []  # no spread
    rows = whiten(spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [0.0, 0.0, 3.0]), (3, [0.0, 0.0, 3.0])], kind)).collect()
    assert sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9), r.explained) for r in rows) == [(k, 1, 512**2, 1.0, 1.0) for k in (1, 2, 3)]
    with pytest.raises(Exception, match="different lengths"):
        whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], kind).coalesce(1)).collect()
