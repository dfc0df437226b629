"""Clusters of near vectors: the connected components of the relation "similarity at least near".

The plain form of clustering, at one threshold for all; ``density`` finds clusters of any density.
Pairs meet inside tasks, and a task sends a forest of what it has found connected, never a row a pair.
Labels move to the least among neighbours and jump to their label's label until none
changes, and rounds are written, so nothing is gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import similarity
from .blocks import Fold, Rows, block_of
from .similarity import ROWS, folded, tiles


def components(edges: DataFrame) -> DataFrame:
    """v, comp: the least vertex that each vertex of ``edges`` (a, b) is connected with."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jumps = labels.select(F.col("v").alias("comp"), F.col("comp").alias("next"))
        new = durable(moved.join(jumps, "comp", "left").select("v", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "labels")
        labels = new.select("v", "comp")
        if new.where("comp <> old").isEmpty():
            return labels


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least of what each number is connected with, after ``a`` and ``b`` are connected, too."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


class _Forest(Fold):
    """A forest of the components (comp) that near pairs of a held block and passing rows connect; a row a component at most.

    Of two blocks that are both held, only the later one passes (turn; those under 0 always pass)."""

    def __init__(self, held: Rows, near: float):
        super().__init__(held)
        self.near, self.long = near, np.sqrt((held.embedding**2).sum(1)).max(initial=0.0)
        self.names: list = []
        self.known: dict = {}
        self.root = np.zeros(0, np.int64)
        self.code = self.codes(held.comp)

    def codes(self, comps: np.ndarray) -> np.ndarray:
        out = np.empty(len(comps), np.int64)
        for k, c in enumerate(comps):
            if (n := self.known.get(c)) is None:
                n = self.known[c] = len(self.names)
                self.names.append(c)
            out[k] = n
        self.root = np.append(self.root, np.arange(len(self.root), len(self.names)))
        return out

    def add(self, passing: Rows) -> None:
        some = np.flatnonzero((passing.turn < 0) | (passing.turn >= self.held.turn[0]))
        for k in range(0, len(some), ROWS):
            rows = some[k : k + ROWS]
            x, found = passing.embedding[rows], [np.zeros((2, 0), np.int64)]
            margin = 4 * np.finfo(float).eps * x.shape[1] * self.long * np.sqrt((x * x).sum(1))
            for at, sims in tiles(x, self.held.embedding):
                row, col = np.divmod(np.flatnonzero(sims >= (self.near - margin)[:, None]), sims.shape[1])
                # A product's last bits depend on where in a matrix a vector stands: as near as that, the sum over the two vectors tells.
                close = np.flatnonzero(sims[row, col] <= self.near + margin[row])
                far = close[(x[row[close]] * self.held.embedding[at.start + col[close]]).sum(1) < self.near]
                found.append(np.delete([row, at.start + col], far, axis=1))
            row, col = np.concatenate(found, axis=1)
            if len(row):
                touched, place = np.unique(row, return_inverse=True)
                mine = self.codes(passing.comp[rows[touched]])[place]
                self.root = joined(self.root, mine, self.code[col])

    def end(self) -> dict:
        apart = np.flatnonzero(self.root != np.arange(len(self.root)))
        return {"a": [self.names[k] for k in apart], "b": [self.names[k] for k in self.root[apart]]}


def near_components(items: DataFrame, near: float, least: int) -> DataFrame:
    """item_id, cluster_id (the least item of the cluster) for clusters of ``least`` items or more;
    items in smaller ones, and those near no other, are noise and left out.

    All items are held against some of them first.  What that connects with the largest component needs no more comparisons
    among itself: the items outside of it are then held against all."""
    points = items.select("item_id", "embedding")
    n = points.count()
    share = 1 << 20 if n <= similarity.HUB_BLOCK else int(0.9 * similarity.HUB_BLOCK / n * (1 << 20))  # about nine tenths of a block
    kind = items.schema["item_id"].dataType.simpleString()

    def found(held: DataFrame, rows: DataFrame) -> DataFrame:
        edges = folded(held, "item_id", rows, lambda block: _Forest(block, near), f"a {kind}, b {kind}", ("comp", "turn"))
        return components(durable(edges, "forest"))  # it reads them twice

    alone = points.withColumns({"comp": F.col("item_id"), "turn": F.lit(-1)})
    few = alone.where(F.pmod(F.xxhash64("item_id"), F.lit(1 << 20)) < F.lit(share))
    first = points.join(found(few, alone).withColumnRenamed("v", "item_id"), "item_id", "left").withColumn("comp", F.coalesce("comp", "item_id"))
    if n > similarity.HUB_BLOCK:  # else the few were all
        first = durable(first, "points")
        largest = first.groupBy("comp").agg(F.count("*").alias("n")).agg(F.max_by("comp", F.struct("n", "comp")).alias("comp"), F.max("n").alias("n")).first()
        blocks = max(1, -(-(n - largest["n"]) // similarity.HUB_BLOCK))
        rows = first.withColumn("turn", F.when(F.col("comp") == F.lit(largest["comp"]), -1).otherwise(block_of("item_id", blocks)))
        if n > largest["n"]:
            merged = found(rows.where("turn >= 0"), rows).select(F.col("v").alias("comp"), F.col("comp").alias("_least"))
            first = first.join(merged, "comp", "left").withColumn("comp", F.coalesce("_least", "comp"))
    big = first.groupBy("comp").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= max(least, 2))
    return first.join(big, "comp").select("item_id", F.col("comp").alias("cluster_id")).distinct()
