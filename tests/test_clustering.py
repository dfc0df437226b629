"""Connected components of near vectors, held against plain numpy."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from loomwork import registry
from loomwork.operators import clustering, similarity
from tests.conftest import DATA


def expected(ids, x, near, least):
    apart = np.array(ids)[:, None] != np.array(ids)[None, :]
    links = ((x[:, None, :] * x[None, :, :]).sum(2) >= near) & apart
    comp = np.arange(len(ids))
    while True:
        new = np.where(links.any(1), np.minimum(comp, np.where(links, comp[None, :], len(ids)).min(1)), comp)
        if (new == comp).all():
            break
        comp = new
    name = {c: min(np.array(ids)[comp == c]) for c in set(comp)}
    return {i: name[c] for i, c, k in zip(ids, comp, links.any(1), strict=True) if k and (comp == c).sum() >= least}


def some(kind):
    rng = np.random.default_rng(7)
    if kind == "one large":
        x = rng.normal(size=(240, 8)) * 0.4
        x[:150] += 1.0
    elif kind == "many small":
        x = np.eye(12)[rng.integers(0, 12, 240)] + rng.normal(size=(240, 12)) * 0.08
    elif kind == "copies":
        x = rng.normal(size=(240, 6))
        x[60:] = x[rng.integers(0, 9, 180)]
    else:
        x = np.cos(np.arange(240)[:, None] * 0.026 - np.array([0, np.pi / 2])[None, :])  # each is near its neighbours alone
        return x[rng.permutation(240)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::9] *= 0.3  # not near themselves
    return x


@pytest.mark.parametrize("block", [20_000, 25])
@pytest.mark.parametrize("kind, near", [("one large", 0.6), ("many small", 0.8), ("copies", 0.85), ("chain", 0.9995)])
def test_components_of_any_shape(spark, monkeypatch, kind, near, block):
    monkeypatch.setattr(similarity, "HUB_BLOCK", block)
    x = some(kind)
    ids = [f"i{k * 7919 % 1000:03d}" for k in range(len(x))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "item_id string, embedding array<double>").repartition(3)
    for least in (1, 4):
        got = [(r.item_id, r.cluster_id) for r in clustering.near_components(df, near, least).collect()]
        want = expected(ids, x, near, least)
        assert len(got) == len(dict(got)) and dict(got) == want and want


def test_no_pair_leaves_a_task(spark, monkeypatch):
    """300 items that are all near each other are 44,850 pairs, and a forest a task."""
    sent, components = [], clustering.components
    monkeypatch.setattr(clustering, "components", lambda edges: sent.append(edges.count()) or components(edges))
    df = spark.range(300).selectExpr("id AS item_id", "array(1.0D, id / 3000) AS embedding")
    assert {r.cluster_id for r in clustering.near_components(df, 0.5, 3).collect()} == {0}
    assert 299 <= sum(sent) <= 4 * 300


def test_nothing_is_near(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id long, embedding array<float>")
    assert clustering.near_components(df, 0.5, 1).collect() == [] and clustering.near_components(df.where("false"), 0.5, 1).collect() == []


@pytest.mark.parametrize("block", [20_000, 60])
def test_near_components_against_sql(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "HUB_BLOCK", block)
    con = duckdb.connect()
    for t in ("embeddings", "part", "lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES["r1_near_components"](spark, f"{DATA}/sf0.01").select("item_id", "cluster_id").collect())
    assert got == sorted(con.execute(registry.ORACLE_SQL["r1_near_components"]).fetchall()) and got
