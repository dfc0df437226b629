from __future__ import annotations

import numpy as np
import pytest

from loomwork.operators import density
from loomwork.operators.density import CLOSEST, density_clusters
from tests.conftest import DATA


def plain(x, least=3, samples=2):
    """Labels (-1: noise) from the whole matrix, from the heaviest edge down."""
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    m = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    inside, best, link, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (m[at] < best)
        best[closer], link[closer] = m[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], int(link[at]), at))
    clusters = []  # parent, stability, points

    def split(members, tree):
        """Members of a component and its tree, by the heaviest weight's removal."""
        w = max(e[0] for e in tree)
        rest = [e for e in tree if e[0] < w]
        up = {v: v for v in members}

        def root(v):
            while up[v] != v:
                v = up[v]
            return v

        for _, a, b in rest:
            up[root(a)] = root(b)
        groups = {}
        for v in members:
            groups.setdefault(root(v), []).append(v)
        return w, [(g, [e for e in rest if root(e[1]) == k]) for k, g in groups.items()]

    todo = [(list(range(n)), edges, -1, 0.0)]
    while todo:
        members, tree, parent, birth = todo.pop()
        me = len(clusters)
        clusters.append({"parent": parent, "stable": 0.0, "points": [], "kids": []})
        if parent >= 0:
            clusters[parent]["kids"].append(me)
        while True:
            if not tree:
                break
            w, parts = split(members, tree)
            level = 1 / max(w, CLOSEST)
            large = [p for p in parts if len(p[0]) >= least]
            for p in parts:
                if len(p[0]) < least:
                    clusters[me]["points"] += p[0]
                if len(p[0]) < least or len(large) > 1:
                    clusters[me]["stable"] += (level - birth) * len(p[0])
            if len(large) != 1:
                todo += [(*p, me, level) for p in large]
                break
            members, tree = large[0]
    taken, best = {}, {}
    for c in reversed(range(len(clusters))):
        under = sum(best[k] for k in clusters[c]["kids"])
        taken[c], best[c] = clusters[c]["stable"] >= under, max(clusters[c]["stable"], under)
    labels = np.full(n, -1)
    for c in range(1, len(clusters)):
        top, k = None, c
        while k > 0:
            top = k if taken[k] else top
            k = clusters[k]["parent"]
        if top is not None:
            labels[clusters[c]["points"]] = top
    return labels


def same(got, ids, labels):
    """The clusters found are those of the labels, and named by their least item."""
    want = {}
    for i, c in zip(ids, labels, strict=True):
        if c >= 0:
            want.setdefault(c, set()).add(i)
    assert got == {i: min(g) for g in want.values() for i in g}
    return len(want)


def found(df, **kw):
    return {r.item_id: r.cluster_id for r in density_clusters(df, **kw).collect()}


def frame(spark, x, name="v{:04d}"):
    ids = [name.format(k) for k in range(len(x))]
    return ids, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "item_id string, embedding array<double>").repartition(3)


@pytest.mark.parametrize(("listed", "range_edges"), [(12, 200_000), (3, 15)])
def test_labels_equal_plain_numpy(spark, listed, range_edges, monkeypatch):
    if listed == 3:
        monkeypatch.setattr("loomwork.operators.blocks.HELD_ROWS", 30)
        monkeypatch.setattr("loomwork.operators.blocks.PASSING_ROWS", 17)
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, s, (m, 3)) for c, s, m in [(0, 0.3, 30), (4, 0.2, 25), (4.9, 0.2, 12), (-5, 1.0, 20), (9, 0.05, 4)]] + [rng.uniform(-9, 12, (12, 3))])
    ids, df = frame(spark, x)
    assert same(found(df, listed=listed, range_edges=range_edges), ids, plain(x)) >= 4
    if listed == 12:
        assert same(found(df, least=6, samples=4), ids, plain(x, 6, 4)) >= 2


def test_every_item_of_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").where("vec_id % 25 <> 0").select("vec_id", "embedding").collect()
    from loomwork import registry

    got = {r.item_id: r.cluster_id for r in registry.QUERIES["r1_density_clusters"](spark, f"{DATA}/sf0.01").collect()}
    same(got, [f"V{r.vec_id}" for r in rows], plain(np.array([r.embedding for r in rows], float)))


def test_copies_nulls_and_noise(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile([[1.0, 0.0]], (40, 1)), np.tile([[0.0, 1.0]], (2, 1)), rng.normal([0, -1], 0.05, (10, 2)), rng.uniform(5, 50, (5, 2))])
    ids, df = frame(spark, x)
    bad = spark.createDataFrame([("n1", None), ("n2", []), ("n3", [float("nan"), 0.0]), ("n4", [None, 1.0]), ("v0000", [1.0, 0.0])], "item_id string, embedding array<double>")
    got = found(df.unionByName(bad).withColumn("vid", F_one()).withColumn("cluster_id", F_one()))
    assert same(got, [*ids, "v0000"], plain(np.vstack([x, [[1.0, 0.0]]]))) == 3
    assert got["v0003"] == "v0000" and density_clusters(df).columns == ["item_id", "cluster_id"]


def F_one():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_too_few(spark):
    kind = "item_id long, embedding array<float>"
    for rows in ([], [(1, [0.0, 1.0])], [(k, [float(k), 0.0]) for k in range(2)], [(k, [0.0, 1.0]) for k in range(9)]):
        assert density_clusters(spark.createDataFrame(rows, kind)).collect() == []
    # Chains of even gaps hold together at one level alone: nothing is denser than all of it.
    assert density_clusters(spark.createDataFrame([(k, [float(k)]) for k in range(20)], kind)).collect() == []


def test_cuts_keep_equal_weights_together(spark):
    tree = spark.createDataFrame([(k, k + 1, float(k // 10)) for k in range(200)], "a long, b long, weight double")
    bounds = density._ranges(tree, 25)
    assert len(bounds) > 3 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))
