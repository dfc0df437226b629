"""What the vector index moves and compares, and that a pair is found once, held against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from loomwork.operators import blocks, vector_index

N, D = 400, 12


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, D))
    x[:120] = x[rng.integers(0, 4, 120)] + 0.4 * x[:120]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "item_id long, embedding array<float>").repartition(3).cache()
    return df, x.astype(float)


def found_by(index, x, threshold, probes, asked=None):
    """The pairs of which one vector (that is asked for) asks the list of the other."""
    order = np.argsort(-(x @ index.at.T), axis=1)
    own, sims = order[:, 0], x @ x.T
    asks = np.zeros((len(x), len(index.at)), bool)
    np.put_along_axis(asks, order[:, :probes], True, axis=1)
    if asked is not None:
        asks[~asked] = False
    hit = asks[:, own] | asks[:, own].T
    return {(a, b): sims[a, b] for a, b in zip(*np.nonzero(np.triu(hit & (sims >= threshold), 1)), strict=True)}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("probes", [1, 3, 9])
def test_each_pair_is_found_once(monkeypatch, table, probes, small):
    if small:
        for where, name, n in ((blocks, "HELD_ROWS", 7), (blocks, "PASSING_ROWS", 50), (vector_index, "TASK_ROWS", 30), (vector_index, "OUT_PAIRS", 5)):
            monkeypatch.setattr(where, name, n)
    df, x = table
    index = vector_index.VectorIndex(df, lists=9)
    some = np.arange(N) % 5 == 0
    for asked in (None, some):
        got = [(r.name_a, r.name_b, r.sim) for r in index.pairs(0.4, probes=probes, asked=None if asked is None else df.where("item_id % 5 = 0").select("item_id")).collect()]
        want = found_by(index, x, 0.4, probes, asked)
        assert len(got) == len(want) and {(a, b) for a, b, _ in got} == set(want)
        assert all(abs(s - want[a, b]) < 1e-12 for a, b, s in got)


def test_a_vector_is_not_written_once_a_probe(monkeypatch, table):
    df, _ = table
    steps, durable = [], vector_index.durable
    monkeypatch.setattr(vector_index, "durable", lambda rows, what: steps.append(durable(rows, what)) or steps[-1])
    vector_index.VectorIndex(df, lists=9).pairs(0.4, probes=4).collect()
    assert max(step.count() for step in steps) == N


def test_no_more_comparisons_than_pairs(table):
    """Where nearly all lists would be asked, all pairs are compared, once each but for those inside of lists."""
    df, x = table
    index = vector_index.VectorIndex(df, lists=20)
    got = [(r.name_a, r.name_b) for r in index.pairs(0.1, probes=20).collect()]
    a, b = np.nonzero(np.triu(x @ x.T >= 0.1, 1))
    assert sorted(got) == sorted(zip(a.tolist(), b.tolist(), strict=True)) and index.compared < 0.62 * N**2
