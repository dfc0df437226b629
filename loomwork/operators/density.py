"""Hierarchical density clustering (HDBSCAN) over tables of vectors.

1. Equal vectors become one point with a weight, so copies make no pairs.
2. Each point's nearest neighbours, by blocks; its core distance is that to its ``samples``-th neighbour.
3. A spanning tree over mutual reachability (the largest of two core distances and the distance), by
   Boruvka rounds: every component takes its lightest outgoing edge.  The neighbour lists decide wherever
   an unlisted edge cannot be lighter; only the points for which it could be are held against all again.
4. The condensed tree from the lightest edge up, in ranges of a bounded number of edges: a component of
   ``least`` items or more carries a cluster; a smaller one that joins it leaves its items to the cluster at that
   level; where two clusters meet, both end and a new one begins.
5. A cluster is taken if it is at least as stable as the best choice below it; the topmost taken ones
   win, and the one that holds everything is never taken.

Edges of equal weight merge at once, so the result does not depend on their order.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .blocks import Fold, Rows, against_all
from .clustering import components

#: Neighbours that are kept for each point: more of them, fewer points are held against all again.
LISTED = 12
#: Edges of the tree that one task condenses (more only where so many weigh the same).
RANGE_EDGES = 200_000
#: Density is one over the distance; nearer than this counts as this near.
CLOSEST = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows to the rows beside them, from the differences: the same from both ends."""
    return np.sqrt(((a - b) ** 2).sum(-1))


class Nearest(Fold):
    """The ``k`` nearest others of each held point: id, their ids, weights and distances."""

    def __init__(self, held: Rows, k: int):
        super().__init__(held)
        self.k = k
        n = len(held)
        self.ids, self.copies, self.far = np.full((n, 0), -1, np.int64), np.zeros((n, 0), np.int64), np.zeros((n, 0))

    def add(self, passing: Rows) -> None:
        held = self.held
        far = _distances(held.x, passing.x)
        far[held.vid[:, None] == passing.vid[None, :]] = np.inf
        some = np.argpartition(far, min(self.k, far.shape[1]) - 1, axis=1)[:, : self.k]
        near = np.stack([_exact(held.x, passing.x[c]) for c in some.T], axis=1)
        near[held.vid[:, None] == passing.vid[some]] = np.inf
        ids, copies, dist = (np.hstack(p) for p in ((self.ids, passing.vid[some]), (self.copies, passing.copies[some]), (self.far, near)))
        order = np.lexsort((ids, dist), axis=1)[:, : self.k]
        self.ids, self.copies, self.far = (np.take_along_axis(p, order, 1) for p in (ids, copies, dist))

    def end(self) -> dict[str, np.ndarray] | None:
        real = np.isfinite(self.far)
        row, _ = np.nonzero(real)
        return {"vid": self.held.vid[row], "other": self.ids[real], "other_copies": self.copies[real], "dist": self.far[real]}


class Lightest(Fold):
    """The lightest edge of each held point that leaves its component."""

    def __init__(self, held: Rows):
        super().__init__(held)
        self.weight, self.other = np.full(len(held), np.inf), np.full(len(held), -1, np.int64)

    def add(self, passing: Rows) -> None:
        held = self.held
        w = np.maximum(np.maximum(held.core[:, None], passing.core[None, :]), _distances(held.x, passing.x))
        w[held.comp[:, None] == passing.comp[None, :]] = np.inf
        best = w.argmin(axis=1)
        exact = np.maximum(np.maximum(held.core, passing.core[best]), _exact(held.x, passing.x[best]))
        exact[~np.isfinite(w[np.arange(len(held)), best])] = np.inf
        better = (exact < self.weight) | ((exact == self.weight) & (passing.vid[best] < self.other))
        self.weight, self.other = np.where(better, exact, self.weight), np.where(better, passing.vid[best], self.other)

    def end(self) -> dict[str, np.ndarray] | None:
        real = np.isfinite(self.weight)
        return {"vid": self.held.vid[real], "other": self.other[real], "weight": self.weight[real]}


def points(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (vid, x, copies), and the item_id of each with its vid; items without a
    vector or with a null or non-finite entry are left out."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = items.select("item_id", F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0)).alias("x")).where((F.size("x") > 0) & F.forall("x", fine))
    distinct = usable.groupBy("x").agg(F.count("*").alias("copies"))
    found = durable(distinct.withColumn("vid", F.monotonically_increasing_id()), "points")
    members = durable(usable.join(found.select("x", "vid"), "x").select("item_id", "vid"), "members")
    return found, members


def core_distances(near: DataFrame, found: DataFrame, samples: int) -> DataFrame:
    """vid, core, far of each point: the distance to the ``samples``-th other item (to the farthest if
    there are fewer), copies counted, and that of the last listed neighbour."""
    rows = near.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("dist", "other", "other_copies"))).alias("list"))  # at most `LISTED` each
    start = F.struct((F.col("copies") - 1).alias("col1"), F.lit(0.0).alias("col2"))
    within = F.aggregate("list", start, lambda a, e: F.when(a["col1"] >= samples, a).otherwise(F.struct((a["col1"] + e["other_copies"]).alias("col1"), e["dist"].alias("col2"))))
    listed = found.select("vid", "copies").join(rows, "vid", "left").withColumn("list", F.coalesce("list", F.array().cast("array<struct<dist:double,other:bigint,other_copies:bigint>>")))
    return listed.select("vid", within["col2"].alias("core"), F.when(F.size("list") > 0, F.element_at("list", -1)["dist"]).otherwise(F.lit(float("inf"))).alias("far"))


def _roots(links: pa.Table) -> pa.Table:
    """v, comp: the least vertex that each vertex of the links (a, b) is connected with."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in _tuples(links, "a", "b"):
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return pa.table({"v": pa.array(list(up), pa.int64()), "comp": pa.array([root(v) for v in list(up)], pa.int64())})


def _connected(links: DataFrame, most: int) -> DataFrame:
    """v, comp of the links (a, b): in one task up to ``most`` of them, in rounds beyond."""
    if links.count() > most:
        return components(links)
    return links.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(lambda t: _roots(t), "v long, comp long")


def spanning_tree(found: DataFrame, samples: int, listed: int = LISTED, range_edges: int = RANGE_EDGES) -> DataFrame:
    """a, b, weight: a minimum spanning tree of ``found`` (vid, x, copies) over mutual reachability."""
    n = found.count()
    k = max(samples, listed)
    near = durable(against_all(found, found, "vid", lambda held: Nearest(held, k), "vid long, other long, other_copies long, dist double", count=n), "near")
    core = core_distances(near, found, samples)
    # A list of all others leaves none out.
    core = core.withColumn("far", F.lit(float("inf")) if n - 1 <= k else F.col("far"))
    core = durable(core.withColumn("bound", F.greatest("core", "far")).select("vid", "core", "bound"), "core")
    other = core.select(F.col("vid").alias("other"), F.col("core").alias("other_core"))
    weighed = near.join(core, "vid").join(other, "other").select("vid", "other", F.greatest("core", "other_core", "dist").alias("weight"))
    pool = durable(_ends(weighed), "edges")
    labels = core.select("vid", F.col("vid").alias("comp"))
    tree: list[DataFrame] = []
    left = n
    while left > 1:
        at = lambda c: labels.select(F.col("vid").alias(c), F.col("comp").alias(f"comp_{c}"))
        # Edges inside a component never leave it again.
        pool = durable(pool.join(at("a"), "a").join(at("b"), "b").where("comp_a <> comp_b"), "edges")
        ours = core.join(labels, "vid")
        asked = ours.join(_lightest(pool), "comp", "left").where(F.col("weight").isNull() | (F.col("bound") < F.col("weight"))).select("vid")
        asked = durable(asked, "asked")
        n_asked = asked.count()
        if n_asked:
            full = found.select("vid", "x").join(ours.select("vid", "core", "comp"), "vid")
            more = _ends(against_all(full.join(asked, "vid", "left_semi"), full, "vid", Lightest, "vid long, other long, weight double", count=n_asked))
            pool = durable(pool.unionByName(more.join(at("a"), "a").join(at("b"), "b")), "edges")
        best = _lightest(pool)
        chosen = durable(best.select("a", "b", "weight", "comp_a", "comp_b").distinct(), "chosen")
        tree.append(chosen.select("a", "b", "weight"))
        moved = _connected(chosen.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), range_edges).select(F.col("v").alias("comp"), F.col("comp").alias("new"))
        labels = durable(labels.join(moved, "comp", "left").select("vid", F.coalesce("new", "comp").alias("comp")), "labels")
        left = labels.select("comp").distinct().count()
        pool = pool.select("a", "b", "weight")
    out = found.sparkSession.createDataFrame([], "a long, b long, weight double")
    for part in tree:
        out = out.unionByName(part)
    return durable(out, "tree")


def _ends(edges: DataFrame) -> DataFrame:
    ab = edges.select(F.least("vid", "other").alias("a"), F.greatest("vid", "other").alias("b"), "weight")
    return ab.groupBy("a", "b").agg(F.min("weight").alias("weight"))


def _lightest(edges: DataFrame) -> DataFrame:
    """comp, weight, a, b, comp_a, comp_b: the first edge of each component by weight and ends."""
    both = edges.select("*", F.col("comp_a").alias("comp")).unionByName(edges.select("*", F.col("comp_b").alias("comp")))
    best = both.groupBy("comp").agg(F.min(F.struct("weight", "a", "b", "comp_a", "comp_b")).alias("e"))
    return best.select("comp", "e.*")


#: A component: its size, and if it carries a cluster, sums of levels and sizes and the best choice below it.
STATE = ("comp", "size", "cluster", "level_sum", "level_n", "below")
CLUSTER = "cluster long, parent long, taken boolean"


def _condensed(edges: list[tuple[float, int, int]], state: list[tuple], least: int, number: int) -> dict[str, list]:
    """One range of edges (weight, comp_a, comp_b) over components (``STATE``): their states after it,
    the clusters that ended, and the clusters that small components left their items to.

    ``number`` is the first number for new clusters.
    """
    up = {r[0]: r[0] for r in state}
    size, cluster, level_sum, level_n, below = ({r[0]: r[i] for r in state} for i in range(1, 6))
    small = {c: [c] for c in up if cluster[c] is None}  # components of the range's start inside a small one
    ended: list[tuple] = []
    left: list[tuple] = []

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    for weight, same in groupby(sorted(edges), key=lambda e: e[0]):
        level = 1.0 / max(weight, CLOSEST)
        met: dict[int, set[int]] = {}
        local = {}

        def top(c: int, local=local) -> int:
            while local.setdefault(c, c) != c:
                local[c] = local[local[c]]
                c = local[c]
            return c

        for _, a, b in same:
            x, y = top(root(a)), top(root(b))
            if x != y:
                local[max(x, y)] = min(x, y)
        for c in list(local):
            met.setdefault(top(c), set()).add(c)
        for key, group in met.items():
            if len(group) < 2:
                continue
            large = sorted(c for c in group if cluster[c] is not None)
            little = [c for c in group if cluster[c] is None]
            total = sum(size[c] for c in group)
            own, s, n, under = None, 0.0, 0, 0.0
            if len(large) == 1:
                own, s, n, under = cluster[large[0]], level_sum[large[0]], level_n[large[0]], below[large[0]]
            elif len(large) > 1 or total >= least:
                own, number = number, number + 1
                for c in large:
                    stable = level_sum[c] - level * level_n[c]
                    taken = stable >= below[c]
                    ended.append((cluster[c], own, bool(taken)))
                    s, n, under = s + level * size[c], n + size[c], under + max(stable, below[c])
            if own is not None:
                for c in little:
                    s, n = s + level * size[c], n + size[c]
                    left += [(old, own) for old in small.pop(c)]
            else:
                small[key] = [old for c in little for old in small.pop(c)]
            for c in group:
                up[c] = key
            size[key], cluster[key], level_sum[key], level_n[key], below[key] = total, own, s, n, under
    return {"up": [(c, root(c)) for c in up], "state": [(c, size[c], cluster[c], level_sum[c], level_n[c], below[c]) for c in up if up[c] == c], "ended": ended, "left": left}


def condense(tree: DataFrame, found: DataFrame, least: int, range_edges: int = RANGE_EDGES) -> tuple[DataFrame, DataFrame]:
    """vid, cluster of each point, and cluster, parent, taken of each cluster (those that are nobody's
    child have no row)."""
    spark = tree.sparkSession
    level = 1.0 / CLOSEST
    # Copies alone may be a cluster.
    is_large = F.col("copies") >= least
    state = found.select(
        F.col("vid").alias("comp"), F.col("copies").alias("size"), F.when(is_large, F.col("vid")).alias("cluster"), F.when(is_large, F.col("copies") * level).otherwise(0.0).alias("level_sum"),
        F.when(is_large, F.col("copies")).otherwise(0).cast("long").alias("level_n"), F.lit(0.0).alias("below"),
    )
    state = durable(state, "state")
    labels = found.select("vid", F.col("vid").alias("comp"))
    settled = [found.where(is_large).select("vid", F.col("vid").alias("cluster"))]
    clusters = [spark.createDataFrame([], CLUSTER)]
    number = (found.agg(F.max("vid")).first()[0] or 0) + 1
    for low, high in _ranges(tree, range_edges):
        some = tree.where((F.col("weight") >= low) & (F.col("weight") <= high))
        at = lambda c: labels.select(F.col("vid").alias(c), F.col("comp").alias(f"comp_{c}"))
        placed = some.join(at("a"), "a").join(at("b"), "b").select("comp_a", "comp_b", "weight")
        placed = durable(placed, "range")
        touched = placed.select(F.col("comp_a").alias("comp")).union(placed.select("comp_b")).distinct()
        n_edges = placed.count()

        # A bounded number of edges and of the components they join: one task.
        def work(edges: pa.Table, comps: pa.Table, number=number) -> pa.Table:
            out = _condensed(_tuples(edges, "weight", "comp_a", "comp_b"), _tuples(comps, *STATE), least, number)
            none = (None,) * 4
            got = [(0, *x, *none) for x in out["up"]] + [(1, *x) for x in out["state"]] + [(2, k, p, int(t), *none[1:]) for k, p, t in out["ended"]] + [(3, *x, *none) for x in out["left"]]
            kinds = {"kind": pa.int32(), "p": pa.int64(), "q": pa.int64(), "r": pa.int64(), "s": pa.float64(), "n": pa.int64(), "u": pa.float64()}
            return pa.table({name: pa.array([g[i] for g in got], kind) for i, (name, kind) in enumerate(kinds.items())})

        one = lambda df: df.withColumn("_g", F.lit(0)).groupBy("_g")
        got = one(placed).cogroup(one(state.join(touched, "comp", "left_semi"))).applyInArrow(lambda e, c: work(e, c), "kind int, p long, q long, r long, s double, n long, u double")
        got = durable(got, "condensed")
        number += 2 * n_edges + 1
        moved = got.where("kind = 0").select(F.col("p").alias("comp"), F.col("q").alias("new"))
        left = got.where("kind = 3").select(F.col("p").alias("comp"), F.col("q").alias("cluster"))
        settled.append(durable(labels.join(left, "comp").select("vid", "cluster"), "settled"))
        clusters.append(got.where("kind = 2").select(F.col("p").alias("cluster"), F.col("q").alias("parent"), (F.col("r") == 1).alias("taken")))
        labels = durable(labels.join(moved, "comp", "left").select("vid", F.coalesce("new", "comp").alias("comp")), "labels")
        fresh = got.where("kind = 1").select(F.col("p").alias("comp"), F.col("q").alias("size"), F.col("r").alias("cluster"), F.col("s").alias("level_sum"), F.col("n").alias("level_n"), F.col("u").alias("below"))
        state = durable(state.join(moved, "comp", "left_anti").unionByName(fresh), "state")
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return union(settled), union(clusters)


def _tuples(table: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(table[n].to_pylist() for n in names), strict=True))


def _ranges(tree: DataFrame, range_edges: int) -> list[tuple[float, float]]:
    """Bounds of ranges of about ``range_edges`` edges in order of weight; equal weights share one."""
    n = tree.count()
    if not n:
        return []
    cuts = max(1, -(-n // range_edges))
    if cuts == 1:
        return [(0.0, float("inf"))]
    at = tree.select("weight").repartitionByRange(cuts, "weight").groupBy(F.spark_partition_id().alias("k")).agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    return sorted((r["low"], r["high"]) for r in at.collect())


def _winners(clusters: DataFrame) -> DataFrame:
    """cluster, winner: the topmost taken cluster at or above each, by pointer doubling."""
    at = durable(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("taken"), F.col("cluster")).alias("winner")), "winners")
    while True:
        above = at.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("winner").alias("higher"))
        new = at.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "winner").alias("winner"))
        at = durable(new, "winners")
        if at.where("up IS NOT NULL").isEmpty():
            return at.select("cluster", "winner")


def density_clusters(items: DataFrame, *, least: int = 3, samples: int = 2, listed: int = LISTED, range_edges: int = RANGE_EDGES) -> DataFrame:
    """item_id, cluster_id (the least item of the cluster) of each item (item_id, embedding) in a cluster.

    Noise is left out, as are items without a usable vector. Repeated rows count each for themselves. Fewer than
    ``least`` items, or none that are denser together than all are, give no rows. ``cluster_id`` has the type of ``item_id``.
    """
    found, members = points(items)
    empty = items.select("item_id", F.col("item_id").alias("cluster_id")).limit(0)
    if members.count() < max(least, 2) or found.count() < 2:
        return empty
    tree = spanning_tree(found, samples, listed, range_edges)
    settled, clusters = condense(tree, found, least, range_edges)
    won = settled.join(_winners(clusters), "cluster").where("winner IS NOT NULL").select("vid", "winner")
    labelled = durable(members.join(won, "vid").select("item_id", "winner"), "labelled")
    names = labelled.groupBy("winner").agg(F.min("item_id").alias("cluster_id"))
    return labelled.join(names, "winner").select("item_id", "cluster_id")
