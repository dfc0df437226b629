"""Selection, intervals, batches and the vector index against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from loomwork.operators import blocks, intervals, sampling, selection, vector_index
from tests.conftest import DATA

# --- selection ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1024, 4])
def test_order_statistics(spark, monkeypatch, parts):
    monkeypatch.setattr(selection, "PARTS", parts)
    rng = random.Random(3)
    for values in (
        [5.0], [1.0, 1.0, 1.0], [rng.gauss(0, 1) for _ in range(500)], [rng.choice([0.0, -0.0, 1e-300, 5e300, -1e308, 1e308, 0.1]) for _ in range(200)],
        [float(k // 50) for k in range(400)], [math.nextafter(1, 2), 1.0, math.nextafter(1, 0)] * 5,
    ):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
        assert selection.order_statistics(df, "v", ranks) == [sorted(values)[r] for r in ranks]
    with pytest.raises(ValueError):
        selection.order_statistics(df, "v", [99])


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.exponential(size=301)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]
    assert np.allclose(selection.quantiles(df, "v", shares), np.quantile(values, shares), rtol=1e-12)
    assert selection.quantiles(df.where("false"), "v", [0.5]) == [None]


# --- intervals ------------------------------------------------------------------------------------------


def test_intervals_equal_depth_first_order(spark):
    rng = random.Random(8)
    ids = [f"n{k:03d}" for k in range(300)]
    rng.shuffle(ids)
    up = {c: rng.choice(ids[max(0, k - 9) : k]) for k, c in enumerate(ids) if k > 3}
    cycle = [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c4", "c1")]
    nodes = spark.createDataFrame([(i,) for i in [*ids, "c1", "c2", "c3", "c4"]], "id string")
    edges = spark.createDataFrame([*up.items(), *cycle], "id string, parent_id string")
    kids: dict = {}
    for c, p in up.items():
        kids.setdefault(p, []).append(c)
    want, at = {}, 0

    def walk(i, depth, root):
        nonlocal at
        at += 1
        enter = at
        for c in sorted(kids.get(i, [])):
            walk(c, depth + 1, root)
        want[i] = (depth, root, at - enter + 1, enter, at)

    for r in sorted(i for i in ids if i not in up):
        walk(r, 0, r)
    tree = intervals.intervals(nodes, edges)
    got = {r.id: (r.depth, r.root_id, r["size"], r.enter, r.leave) for r in tree.collect()}
    assert got == want
    values = spark.createDataFrame([(i, k) for i in ids for k in range(3) if i > "n100"], "id string, n long")
    below = {r.id: r.n for r in intervals.subtree_sums(tree, values, "n").collect()}
    weight = {i: 3 if i > "n100" else 0 for i in ids}
    assert below == {i: sum(weight[j] for j in ids if want[i][3] <= want[j][3] <= want[i][4]) for i in ids}
    a = tree.where("id = 'n005'").alias("a")
    under = {r.id for r in tree.alias("b").join(a, intervals.is_below("a", "b")).select("b.id").collect()}
    assert under == {j for j in ids if want["n005"][3] <= want[j][3] <= want["n005"][4]}


def test_rounds_grow_with_the_logarithm_of_the_depth(spark):
    n = 1000
    nodes = spark.range(n).selectExpr("cast(id as string) AS id")
    up = spark.range(1, n).selectExpr("cast(id as string) AS id", "cast(id - 1 as string) AS parent_id")
    tree, cyclic, rounds = intervals.ancestors_by_doubling(nodes, up)
    assert rounds == 10 and cyclic.isEmpty()
    assert {(int(r.id), r.depth, r["size"]) for r in tree.collect()} == {(k, k, n - k) for k in range(n)}
    none = spark.createDataFrame([], "id string")
    assert intervals.intervals(none, spark.createDataFrame([], "id string, parent_id string")).collect() == []


# --- batches --------------------------------------------------------------------------------------------


def deal(spark, rows, **kw):
    df = spark.createDataFrame(rows, "pair_id long, hub_id string, text_key string, is_ai boolean, batch_size string").repartition(3)
    out = sampling.conflict_free_batches(df, key="pair_id", **kw).collect()
    batches: dict = {}
    for r in out:
        batches.setdefault(r.batch, []).append(r)
    for group in batches.values():
        assert sorted(r.place for r in group) == list(range(len(group)))
        for name in ("hub_id", "text_key"):
            seen = [r[name] for r in group if r[name] is not None]
            assert len(seen) == len(set(seen)), (name, group)
    assert sorted(batches) == list(range(len(batches)))
    return out, [batches[k] for k in range(len(batches))]


def test_batches_hold_every_row_once_and_no_collision(spark):
    rng = random.Random(5)
    rows = [(k, f"h{rng.randrange(80)}", f"t{rng.randrange(300)}", k % 5 == 0, "x") for k in range(900)]
    rows += [(2000 + k, None, None, None, "x") for k in range(20)]
    out, batches = deal(spark, rows, batch_size=16, segment_batches=8, seed=3)
    assert Counter(r.pair_id for r in out) == Counter(r[0] for r in rows)
    sizes = [len(b) for b in batches]
    full = next((k for k, s in enumerate(sizes) if s < 16), len(sizes))
    assert sum(sizes[:full]) > 0.9 * len(rows) and all(s == 16 for s in sizes[:full])
    again, _ = deal(spark, rows, batch_size=16, segment_batches=8, seed=3)
    assert sorted((r.pair_id, r.batch, r.place) for r in out) == sorted((r.pair_id, r.batch, r.place) for r in again)
    other, _ = deal(spark, rows, batch_size=16, segment_batches=8, seed=3, epoch=1)
    assert sorted((r.pair_id, r.batch) for r in out) != sorted((r.pair_id, r.batch) for r in other)
    whole, _ = deal(spark, rows, batch_size=16, segment_batches=8, seed=3, drop_last=True)
    assert len(whole) == sum(s for s in sizes if s == 16) or len(whole) == sum(sizes[:full])


def test_a_hub_with_a_third_of_all_rows(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"h{k % 50}", f"t{k}", False, "x") for k in range(600)] + [(1000 + k, f"g{k}", "hot text", True, "x") for k in range(60)]
    out, batches = deal(spark, rows, batch_size=16, segment_batches=8)
    assert Counter(r.pair_id for r in out) == Counter(r[0] for r in rows) and len(batches) >= 200


def test_few_rows_and_none(spark):
    assert deal(spark, [], batch_size=4) == ([], [])
    out, batches = deal(spark, [(1, "a", "t", True, "x"), (1, "a", "t", True, "x"), (2, "b", "t", False, "x")], batch_size=4)
    assert len(out) == 3 and len(batches) == 3
    out, batches = deal(spark, [(1, "a", "t", True, "x"), (2, "b", "u", False, "x")], batch_size=4)
    assert len(batches) == 1


def test_weights_of_the_order(spark):
    n_ai, n_other = 2000, 8000
    df = spark.range(n_ai + n_other).selectExpr("id", f"id < {n_ai} AS is_ai")
    for temperature in (2.0, 1.0):
        rate = sampling.kind_rates(n_ai, n_other, temperature)[0]
        rows = [r.is_ai for r in sampling.weighted_order(df, "id", "is_ai", temperature=temperature, seed="s").orderBy("_time").collect()]
        assert len(rows) == n_ai + n_other and sum(rows) == n_ai
        # AI rows among the first thousands, within four standard deviations of a binomial draw
        for first in (1000, 4000):
            assert abs(sum(rows[:first]) - rate * first) < 4 * math.sqrt(first * rate * (1 - rate))
    assert sampling.kind_rates(20, 80, 2.0)[0] == pytest.approx(math.sqrt(0.2) / (math.sqrt(0.2) + math.sqrt(0.8)))
    assert sampling.kind_rates(0, 5, 2.0) == (0.0, 1.0) and sampling.kind_rates(0, 0, 2.0) == (0.0, 0.0)


# --- the vector index -----------------------------------------------------------------------------------


def pairs_of(x, ids, threshold):
    sims = x @ x.T
    return {tuple(sorted((ids[i], ids[j]))): sims[i, j] for i, j in zip(*np.nonzero(np.triu(sims >= threshold, 1)), strict=True)}


def test_recall_of_the_index(spark):
    """Ids divisible by 100 against all rows, and all pairs, of vectors without any clusters in them."""
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").selectExpr("vec_id AS item_id", "embedding").cache()
    got = rows.collect()
    x, ids = np.array([r.embedding for r in got], float), [r.item_id for r in got]
    index = vector_index.VectorIndex(rows)
    found = {(r.name_a, r.name_b): r.sim for r in index.pairs(0.35).collect()}
    want = pairs_of(x, ids, 0.35)
    assert all(abs(want[k] - s) < 1e-9 for k, s in found.items())
    assert len(found) / len(want) >= 0.9 and index.compared < 0.8 * len(ids) ** 2 / 2, (len(found), len(want), index.compared)
    asked = rows.where("item_id % 100 = 0").select("item_id")
    some = {k: s for k, s in pairs_of(x, ids, 0.3).items() if k[0] % 100 == 0 or k[1] % 100 == 0}
    hit = {(r.name_a, r.name_b) for r in index.pairs(0.3, asked=asked).collect()}
    assert hit <= set(some) and len(hit) / len(some) >= 0.9, (len(hit), len(some))
    rows.unpersist()


@pytest.mark.parametrize("small", [False, True])
def test_index_is_exact_with_all_lists(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(blocks, "HELD_ROWS", 7)
        monkeypatch.setattr(blocks, "PASSING_ROWS", 5)
        monkeypatch.setattr(vector_index, "ASKING_ROWS", 20)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5))
    x[:60] = x[0] + 0.2 * x[:60]  # half of all rows are near each other
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:] = x[3]
    ids = [f"i{k:03d}" for k in range(120)]
    rows = [(i, [float(c) for c in v], "x") for i, v in zip(ids, x, strict=True)] + [("bad", None, "x"), ("nan", [float("nan")] * 5, "x"), ("void", [], "x"), ("hole", [None] * 5, "x")]
    df = spark.createDataFrame(rows, "item_id string, embedding array<double>, vid string").repartition(4)
    index = vector_index.VectorIndex(df, lists=6)
    kept = [k for k in range(120) if k < 100]
    want = {k: s for k, s in pairs_of(x[kept], [ids[k] for k in kept], 0.8).items() if s < 1 - 1e-12}
    got = {(r.name_a, r.name_b): r.sim for r in index.pairs(0.8, probes=6).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.item_id: r.name for r in index.members.collect()} == {i: ("i003" if k >= 100 else i) for k, i in enumerate(ids)}
    tiers = {(r.name_a, r.name_b): r.tier for r in vector_index.near_duplicates(df, similar=0.8, duplicate=0.97, probes=6, lists=6).collect()}
    assert tiers == {k: "duplicate" if s >= 0.97 else "similar" for k, s in want.items()}


def test_index_of_nothing(spark):
    kind = "item_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]):
        assert vector_index.near_duplicates(spark.createDataFrame(rows, kind), similar=0.5).collect() == []


# --- calibration without pairs --------------------------------------------------------------------------


@pytest.mark.parametrize("block", [20_000, 4])
def test_sums_over_blocks_equal_those_over_pairs(spark, monkeypatch, block):
    from loomwork.operators import calibration as cal
    from loomwork.operators import similarity

    monkeypatch.setattr(similarity, "HUB_BLOCK", block)
    rng = np.random.default_rng(3)
    hubs_x, items_x = rng.normal(size=(11, 4)), rng.normal(size=(30, 4))
    hubs = spark.createDataFrame([(f"h{k}", [float(c) for c in v]) for k, v in enumerate(hubs_x)], "hub_id string, embedding array<double>")
    items = spark.createDataFrame([(k, [float(c) for c in v], "x") for k, v in enumerate(items_x)], "item_id long, embedding array<double>, right string").drop("right")
    right = {(k, f"h{rng.integers(11)}") for k in range(25) for _ in range(3)} | {(1, "unknown"), (99, "h1")}
    valid = spark.createDataFrame(sorted(right), "item_id long, hub_id string")
    grid = [0.05, 0.5, 3.0]
    got = {(r.item_id, r.i): (r.m, r.a, r.v) for r in cal.grid_sums(items, hubs, valid, grid).collect()}
    assert len(got) == 90
    for k, x in enumerate(items_x):
        s = hubs_x @ x
        for i, t in enumerate(grid):
            e = np.exp((s - s.max()) / t)
            ok = [j for j in range(11) if (k, f"h{j}") in right]
            m, a, v = got[k, i]
            assert np.isclose(m, s.max()) and np.isclose(a, e.sum(), rtol=1e-9) and (v is None if not ok else np.isclose(v, e[ok].sum(), rtol=1e-9))
    sims = similarity.similarities(items, hubs)
    assert cal.fit_temperature_of(items, hubs, valid, grid).first() == cal.fit_temperature(sims, valid, grid).first()
    steps = cal.linear_grid(0.01, 0.99, 30)
    assert cal.global_threshold_of(items, hubs, valid, 0.5, steps).first() == cal.global_threshold(similarity.softmax(sims, 0.5), valid, steps).first()
