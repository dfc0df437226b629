"""What all pairs of items and hubs tell, held against the queries' SQL, from one block of hubs and from several."""

from __future__ import annotations

import tracemalloc

import duckdb
import numpy as np
import pytest

from loomwork import registry
from loomwork.operators import pairs, similarity
from tests.conftest import DATA

QUERIES = [
    "e16_ingest_summary", "e19_similarity_stats", "f4_negatives", "j2_cosine", "j3_softmax", "j3_totals", "k1_nll", "k5_conformal_quantile", "k6_prediction_sets", "k7_set_coverage", "k8_ood_gate", "k8_ood_threshold",
    "k9_calibration_error", "k14_ranking_metrics", "k15_lofo_aggregate", "k16_covered_split", "k19_fold_results", "k20_gates", "d17_compare_predictions", "k19b_fold_errors", "f1_top_hubs",
]
SIZES = {"one": ("sf0.01", 20_000), "several": ("sf0.01", 6), "many_hubs": ("sf0.1", 20_000)}


@pytest.fixture(scope="module")
def oracle():
    def run(name, sf):
        con = duckdb.connect()
        for t in ("embeddings", "part", "lineitem", "supplier", "nation", "region", "orders", "customer", "documents", "events"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
        out = con.execute(registry.ORACLE_SQL[name])
        return [d[0] for d in out.description], out.fetchall()

    return run


def same(got, want, columns):
    key = lambda r: tuple(str(x) if not isinstance(x, float) else "" for x in r)
    got, want = (sorted(([r[c] for c in columns] for r in x), key=key) for x in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and y is not None and abs(x - float(y)) <= 1.01e-6), (a, b)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, oracle, monkeypatch, name, size):
    sf, block = SIZES[size]
    if size == "many_hubs" and name in ("j2_cosine", "j3_softmax"):
        pytest.skip("as many rows as pairs")
    monkeypatch.setattr(similarity, "HUB_BLOCK", block)
    df = registry.QUERIES[name](spark, f"{DATA}/{sf}")
    plan = df._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "CartesianProduct" not in plan  # no pair of vectors is a row before its number is known
    columns, rows = oracle(name, sf)
    assert set(columns) == set(df.columns)
    same([r.asDict() for r in df.collect()], [dict(zip(columns, r, strict=True)) for r in rows], columns)


def test_stats_of_values_that_repeat(spark, monkeypatch):
    """Percentiles between values that many pairs share, and lengths other than one."""
    items = spark.createDataFrame([(f"V{k}", [float(k % 3), 1.0]) for k in range(50)], "item_id string, embedding array<float>")
    hubs = spark.createDataFrame([(f"H{k}", [2.0, float(k % 2)]) for k in range(7)], "hub_id string, embedding array<float>")
    s = np.array([[2.0 * (k % 3) + j % 2 for j in range(7)] for k in range(50)]).ravel()
    for block in (20_000, 2):
        monkeypatch.setattr(similarity, "HUB_BLOCK", block)
        got = pairs.similarity_stats(items, hubs).first().asDict()
        want = {"n": 350, "mean": s.mean(), "std": s.std(), "min": s.min(), "max": s.max()} | {f"p{int(q * 100)}": np.quantile(s, q) for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}
        assert all(abs(got[c] - want[c]) < 6e-4 for c in want), (got, want)
    assert pairs.similarity_stats(items.where("false"), hubs).first().n == 0


def test_best_of_with_equals():
    rng = np.random.default_rng(1)
    for k in (1, 3, 10):
        sims = rng.integers(0, 6, (40, 60)).astype(float)
        row, col = similarity.best_of(sims, k)
        want = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        assert row.tolist() == np.repeat(np.arange(40), k).tolist() and col.tolist() == want.ravel().tolist()


@pytest.mark.parametrize("block", [20_000, 6])
def test_pairs_leave_tasks_without_ids(spark, monkeypatch, block):
    """A row that a task sends holds a batch of pairs; numbers are rounded as SQL does, without a negative zero."""
    monkeypatch.setattr(similarity, "HUB_BLOCK", block)
    sent, folded = [], pairs.folded
    monkeypatch.setattr(pairs, "folded", lambda *a, **k: sent.append(folded(*a, **k)) or sent[-1])
    x, h = np.random.default_rng(2).normal(size=(300, 3)), np.random.default_rng(3).normal(size=(20, 3))
    items = spark.createDataFrame([(f"V{k}", [float(c) for c in row]) for k, row in enumerate(x)] + [("zero", [0.0, 0.0, 0.0])], "item_id string, embedding array<double>")
    hubs = spark.createDataFrame([(f"H{k}", [float(c) for c in row]) for k, row in enumerate(h)], "hub_id string, embedding array<double>")
    got = {(r.item_id, r.hub_id): r.cosine for r in pairs.cosine_pairs(items, hubs, digits=2).collect()}
    cosine = x @ h.T / np.outer(np.linalg.norm(x, axis=1) + 1e-10, np.linalg.norm(h, axis=1) + 1e-10)
    assert len(got) == 301 * 20 and all(got["zero", f"H{k}"] == 0 for k in range(20))
    assert all(abs(got[f"V{i}", f"H{j}"] - cosine[i, j]) <= 0.005 + 1e-12 and round(got[f"V{i}", f"H{j}"], 2) == got[f"V{i}", f"H{j}"] for i in range(300) for j in range(20))
    assert all(np.copysign(1, v) > 0 for v in got.values() if v == 0)
    assert sent[-1].count() <= 100  # 6,020 pairs


def test_block_tasks_are_even(spark, monkeypatch):
    """Where blocks are held by tasks, every core has some, and none has many more rows than another."""
    monkeypatch.setattr(similarity, "HUB_BLOCK", 10)

    class Passed(similarity.Fold):
        n = 0

        def add(self, passing):
            self.n += len(passing)

        def end(self):
            return {"held": np.array([len(self.held)]), "n": np.array([self.n])}

    items = spark.range(4000).selectExpr("concat('V', id) AS item_id", "array(double(id), 1.0D) AS embedding")
    hubs = spark.range(18).selectExpr("concat('H', id) AS hub_id", "array(double(id), 1.0D) AS embedding")
    got = similarity.folded(hubs, "hub_id", items, Passed, "held long, n long").selectExpr("held", "n", "spark_partition_id() AS task").collect()
    assert sum(r.n * r.held for r in got) == 4000 * 18
    assert len({r.task for r in got}) == len(got) >= 8 and max(r.n for r in got) <= 1.3 * min(r.n for r in got)


@pytest.mark.parametrize("tile", [1, 3, 1024])
def test_tiles_of_a_block(monkeypatch, tile):
    """Sums of exponentials put together tile by tile, over numbers too far apart for one exponential."""
    monkeypatch.setattr(similarity, "TILE", tile)
    x, h = np.random.default_rng(5).normal(size=(9, 4)) * 30, np.random.default_rng(6).normal(size=(11, 4))
    got, marked = similarity.ExpSums(9, 0.1), np.random.default_rng(7).random((9, 11)) < 0.4
    for at, sims in similarity.tiles(x, h):
        got.add(sims, marked[:, at])
    s = x @ h.T
    e = np.exp((s - s.max(1)[:, None]) / 0.1)
    assert np.allclose(got.m, s.max(1)) and np.allclose(got.a, e.sum(1)) and np.allclose(got.v, (e * marked).sum(1))
    assert sum(at.stop - at.start for at, _ in similarity.tiles(x, h)) == 11 and all(p.shape[1] <= tile for _, p in similarity.tiles(x, h))


@pytest.mark.parametrize("block", [20_000, 400])
def test_ranks_of_equal_vectors(spark, monkeypatch, block):
    """Hubs of one vector rank by id, wherever they stand in a matrix; labels may be missing, vectors may be no numbers."""
    monkeypatch.setattr(similarity, "HUB_BLOCK", block)
    x, h = (np.random.default_rng(k).normal(size=(n, 64)).astype(np.float32).astype(float) for k, n in ((11, 26), (12, 1001)))
    same = [0, 5, 333, 700, 999, 1000]
    h[same] = h[0]
    h[17] = np.nan
    items = spark.createDataFrame([(f"V{k}", [float(c) for c in row], None if k == 25 else same[k % 6] if k < 24 else 9999) for k, row in enumerate(x)], "item_id string, embedding array<double>, label int")
    hubs = spark.createDataFrame([(f"H{k:04d}", [float(c) for c in row], None if k in (17, 18) else k) for k, row in enumerate(h)], "hub_id string, embedding array<double>, label int")
    got = {r.item_id: r.best for r in pairs.label_ranks(items, hubs).collect()}
    sims = np.array([(row * h).sum(1) for row in x])
    want = {f"V{k}": 1 + int((sims[k] > sims[k, 0]).sum()) + k % 6 for k in range(24)}
    assert got == want | {"V24": None, "V25": None}


def test_own_hubs_alone_are_multiplied(monkeypatch):
    """For its own hub, an item is multiplied with hubs of its label only, and the result is that of all."""
    rng = np.random.default_rng(13)
    h, x = rng.normal(size=(60, 4)), rng.normal(size=(90, 4))
    held = pairs.Rows({"hub_id": np.array([f"H{k:02d}" for k in range(60)], object), "embedding": h, "label": rng.integers(0, 6, 60)})
    label = rng.integers(0, 7, 90)
    work, cells = pairs._Own(held), []
    monkeypatch.setattr(pairs, "ROWS", 5)
    monkeypatch.setattr(pairs, "TILE", 4)
    work.matrix = type("Seen", (np.ndarray,), {"T": property(lambda m: cells.append(len(m)) or np.asarray(m).T)})((60, 4), buffer=np.ascontiguousarray(work.matrix))
    got = work.add(pairs.Rows({"item_id": np.arange(90), "embedding": x, "label": label}))
    sims = np.where(label[:, None] == held.label[None, :], x @ h.T, -np.inf)
    some = np.flatnonzero(np.isfinite(sims.max(1)))
    assert got["item_id"].tolist() == some.tolist() and got["hub_id"].tolist() == held.hub_id[sims[some].argmax(1)].tolist()
    assert np.allclose(got["sim"].astype(float), sims[some].max(1)) and max(cells) == np.bincount(held.label).max()


def _folds(spark, monkeypatch, query):
    """The folds that ``query`` of 200 items and 3,000 hubs of 10 labels sets going, and its rows."""
    rng, made = np.random.default_rng(17), []
    for module in (pairs, similarity):
        monkeypatch.setattr(module, "folded", lambda *a, _f=module.folded, **k: made.append(a[3]) or _f(*a, **k))
    rows = lambda n, name: spark.createDataFrame([(f"{name[0]}{k:04d}", [float(c) for c in v], k % 10) for k, v in enumerate(rng.normal(size=(n, 16)))], f"{name} string, embedding array<double>, label int")
    items, hubs = rows(200, "item_id"), rows(3000, "hub_id")
    out = query(items, hubs)
    held, passing = (pairs.Rows({c: np.stack(v) if c == "embedding" else v.to_numpy() for c, v in df.toPandas().items()}) for df in (hubs, items))
    return made, held, passing, out


def test_likely_hubs_are_found_in_tiles(spark, monkeypatch):
    """What a task holds for some rows does not grow with the hubs of a block."""
    monkeypatch.setattr(similarity, "TILE", 100)
    (fold,), held, passing, out = _folds(spark, monkeypatch, lambda items, hubs: pairs.likely(items, hubs, 0.08, 1.0))
    work = fold(held)
    tracemalloc.start()
    work.add(passing)
    assert tracemalloc.get_traced_memory()[1] < 128 * 3000 * 8 / 2
    tracemalloc.stop()
    s = passing.embedding @ held.embedding.T
    p = np.exp(s - s.max(1)[:, None])
    p /= p.sum(1)[:, None]
    got = {(r.item_id, r.hub_id): r.p for r in out.collect()}
    want = {(passing.item_id[i], held.hub_id[j]): p[i, j] for i, j in zip(*np.nonzero(p >= 0.08), strict=True)}
    assert len(want) > 50 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sums_look_at_rows_of_a_tiles_labels(spark, monkeypatch):
    """Marks of valid hubs are made for items of a tile's labels, not for all; items and hubs may be without a label."""
    monkeypatch.setattr(similarity, "TILE", 100)
    (fold,), held, passing, _ = _folds(spark, monkeypatch, lambda items, hubs: pairs.softmax_sums(items, hubs, 0.5))
    cells, add = [], similarity.ExpSums.add
    monkeypatch.setattr(similarity.ExpSums, "add", lambda self, sims, marked, *a: cells.append(marked.size) or add(self, sims, marked, *a))
    held.columns["label"] = np.where(np.arange(3000) % 7 == 0, np.nan, held.label)
    passing.columns["label"] = np.array([np.nan, 77.0, *passing.label[2:]])
    got = fold(held).add(passing)
    assert sum(cells) < 200 * 3000 / 4
    s = (passing.embedding @ held.embedding.T) / 0.5
    e, right = np.exp(s - s.max(1)[:, None]), passing.label[:, None] == held.label[None, :]
    assert np.allclose(got["m"], s.max(1) * 0.5) and np.allclose(got["a"], e.sum(1)) and np.isnan(got["v"][:2]).all() and np.allclose(got["v"][2:], (e * right).sum(1)[2:])
    held.columns["label"] = np.full(3000, np.nan)
    assert np.isnan(fold(held).add(passing)["v"]).all()


def test_totals_multiply_once(spark, monkeypatch):
    made, held, passing, out = _folds(spark, monkeypatch, lambda items, hubs: pairs.softmax_totals(items, hubs, 0.01))
    assert len(made) == 1
    monkeypatch.setattr(similarity, "HUB_BLOCK", 700)
    for df in (out, _folds(spark, monkeypatch, lambda items, hubs: pairs.softmax_totals(items, hubs, 0.01))[3]):
        rows = df.collect()
        assert len(rows) == 200 and all(abs(r.total - 1) < 1e-9 for r in rows)


@pytest.mark.parametrize("block", [20_000, 400])
def test_least_of_equal_vectors(spark, monkeypatch, block):
    """Of hubs that are one vector the first id is the least, wherever they stand in a matrix."""
    monkeypatch.setattr(similarity, "HUB_BLOCK", block)
    rng = np.random.default_rng(19)
    x, h = (rng.normal(size=(n, 64)).astype(np.float32).astype(float) for n in (27, 1001))
    x[:, 0], h[:, 0], h[[3, 333, 700, 999, 1000]] = 40.0, 0.0, np.array([-30.3, *rng.normal(size=63)])
    items = spark.createDataFrame([(f"V{k}", [float(c) for c in row]) for k, row in enumerate(x)], "item_id string, embedding array<double>")
    hubs = spark.createDataFrame([(f"H{k:04d}", [float(c) for c in row]) for k, row in enumerate(h)], "hub_id string, embedding array<double>")
    got = {r.item_id: (r.hub_id, r.sim) for r in pairs.bottom_hub(items, hubs).collect()}
    assert got == {f"V{k}": ("H0003", (row * h[3]).sum()) for k, row in enumerate(x)}


def test_copies_are_compared_once():
    """A block of one vector alone: what is compared exactly does not grow with its copies."""
    h = np.tile(np.random.default_rng(23).normal(size=(1, 64)), (2000, 1))
    held = pairs.Rows({"hub_id": np.array([f"H{k:04d}" for k in range(2000)], object), "embedding": h, "label": np.arange(2000) // 1000})
    x = np.random.default_rng(24).normal(size=(500, 64))
    passing = pairs.Rows({"item_id": np.arange(500), "embedding": x, "label": np.ones(500, int), "own": np.full(500, "H1000", object), "top": (x * h[:1]).sum(1)})
    works = [pairs._Own(held), pairs._Before(held), pairs._Least(held)]
    tracemalloc.start()
    own, before, least = (w.add(passing) for w in works)
    assert tracemalloc.get_traced_memory()[1] < 128 * 1024 * 64 * 8
    tracemalloc.stop()
    assert set(own["hub_id"]) == {"H1000"} and set(before["n"]) == {1000} and set(least["hub_id"]) == {"H0000"}


# --- temperatures ---------------------------------------------------------------------------------------


@pytest.fixture
def written(tmp_path, spark):
    """A data folder with the given vectors (of rows vec_id, embedding, label), and what SQL makes of it."""

    def write(rows):
        folder = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")

        def oracle(name):
            con = duckdb.connect()
            for t in ("part", "lineitem", "supplier", "nation", "region"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
            con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
            return con.execute(registry.ORACLE_SQL[name]).fetchall()

        return folder, oracle

    return write


def vectors(n, seed, scale=1.0, labels=(0, 1, 2, None)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x *= scale / np.linalg.norm(x, axis=1, keepdims=True)
    return [(k, [float(c) for c in v], labels[k % 7 % len(labels)]) for k, v in enumerate(x)]


@pytest.mark.parametrize("rows", [vectors(700, 1), vectors(700, 2, 4.0), vectors(200, 3, labels=(None,)), vectors(200, 4, 0.0), []], ids=["unit", "long", "unlabelled", "zero", "none"])
@pytest.mark.parametrize("name", ["k2_temperature", "k3_pooled_temperature"])
def test_temperatures_of_odd_vectors(spark, written, name, rows):
    """Items without a label are a fold that weighs, but has no valid hub; lengths are any."""
    folder, oracle = written(rows)
    got, want = registry.QUERIES[name](spark, folder).collect(), oracle(name)
    assert len(got) == len(want) == 1
    if want[0][1] is None:
        assert tuple(got[0]) == (None, None)
    else:
        assert abs(got[0].nll - want[0][1]) <= 1.01e-6 and (abs(got[0].t - want[0][0]) < 1e-9 or max(map(max, (r[1] for r in rows))) == 0)  # without lengths every temperature is as good


@pytest.mark.parametrize("name", ["k2_temperature", "k3_pooled_temperature"])
def test_temperatures_leave_tasks_as_sums(spark, oracle, monkeypatch, name):
    """No valid pair is listed, and no row an item and temperature leaves a task."""
    left, met = [], pairs.met
    monkeypatch.setattr(pairs, "met", lambda *a: left.append(met(*a)) or left[-1])
    df = registry.QUERIES[name](spark, f"{DATA}/sf0.1")
    columns, rows = oracle(name, "sf0.1")
    same([r.asDict() for r in df.collect()], [dict(zip(columns, r, strict=True)) for r in rows], columns)
    assert left[-1].count() <= 200 * 3 * 4  # of 1,920 items at 200 temperatures


@pytest.mark.parametrize("least", [0.01, 0.2])
def test_binned_sums_are_right(least):
    """Sums of exponentials from bins are those of each exponential, at every temperature and of any label's hubs."""
    rng = np.random.default_rng(5)
    x, h = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(150, 6)), rng.normal(size=(900, 6))))
    label, theirs, grid = rng.integers(0, 9, 150).astype(float), rng.integers(0, 7, 900), np.geomspace(least, 5, 20)
    label[:9] = np.nan
    held = pairs.Rows({"embedding": x, "label": label, "weight": rng.random(150)})
    found = []
    for fold in (pairs._BinnedGrid(held, grid, 1 + 1e-9), pairs._DirectGrid(held, grid)):
        for k in range(0, 900, 400):
            fold.add(pairs.Rows({"embedding": h[k : k + 400], "label": theirs[k : k + 400]}))
        found.append((fold.end(), fold.v / fold.a))
    sims = x @ h.T
    e = np.exp((sims[None] - sims.max(1)[None, :, None]) / grid[:, None, None])
    right = label[:, None] == theirs[None, :]
    share, some = (e * right).sum(2) / e.sum(2), right.any(1)
    want = -np.log(share + 1e-10)[:, some] @ held.weight[some]
    for got, _ in found:
        assert np.allclose(got["loss"], want, rtol=1e-10) and np.allclose(got["right"], held.weight[some].sum()) and np.allclose(got["every"], held.weight.sum())
    assert np.allclose(found[0][1], found[1][1], rtol=2e-11, atol=0)
