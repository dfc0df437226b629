"""Near pairs of vectors through inverted lists, instead of a comparison of all pairs.

Unit vectors are dealt into lists by their nearest centroid (spherical k-means on a bounded sample);
every vector is in one list.  A vector asks the lists of its ``probes`` nearest centroids, and is compared
there with all they hold: pairs are found by the index and kept by their exact similarity.  ``probes`` is measured where it is not given: the least
number with which the index finds ``RECALL`` of the pairs in a sample that all-pairs comparison finds. ``compared`` counts
the comparisons made.

Equal vectors are one entry: pairs are between different vectors, named by their least item, and ``members`` tells who
else has each.  Lists of any size are held in parts of a bounded number of rows, several parts by one task; a vector
passes a task once, with marks of the lists that it asks, and so many tasks hold a part as there are shares of those that pass.
A pair is found once: where both vectors ask each other's list, by the lesser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import blocks
from .blocks import Fold, Rows, met
from .similarity import task_count

#: Numbers in the sample that centroids are fitted on, at most about.
SAMPLE_VALUES = 8_000_000
MOST_LISTS = 4096
#: Rows that pass one task, and that it holds, at most about.
ASKING_ROWS = 200_000
TASK_ROWS = 100_000
#: Pairs that leave a task in one batch, about.
OUT_PAIRS = 200_000
ROUNDS = 8
#: Rows of the sample that are compared with each other to choose ``probes``, and the share of their pairs wanted.
TRIED_ROWS = 4_000
RECALL = 0.95


def centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors; a list that loses all its vectors starts again at the worst served one."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    at = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        sims = sample @ at.T
        own = sims.argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=lists)
        worst = iter(np.argsort(sims.max(axis=1), kind="stable"))
        for k in np.flatnonzero(n == 0):
            sums[k] = sample[next(worst)]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.divide(sums, size, out=at.copy(), where=size > 0)
    return at


class VectorIndex:
    """Distinct vectors of ``items`` (item_id, embedding: unit length) in lists.

    ``entries``: vid, name (the least item of a vector), x, list. ``members``: item_id, name of all usable
    items. Items without a vector or with a null or non-finite entry are in neither.
    """

    def __init__(self, items: DataFrame, *, lists: int | None = None, seed: int = 0):
        fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        usable = items.select("item_id", F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0)).alias("x")).where((F.size("x") > 0) & F.forall("x", fine))
        distinct = durable(usable.groupBy("x").agg(F.min("item_id").alias("name")).withColumn("vid", F.monotonically_increasing_id()), "vectors")
        self.members = durable(usable.join(distinct.select("x", "name"), "x").select("item_id", "name"), "members")
        self.n = distinct.count()
        self.lists = max(1, min(MOST_LISTS, lists or round(self.n**0.5)))
        self.tried = np.zeros((0, 0))
        self.at = self._fit(distinct, seed) if self.n else np.zeros((0, 0))
        kind = "array<float>" if items.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"  # as they came: half as much to move
        entries = distinct.select("vid", "name", F.col("x").cast(kind).alias("x"))
        self.entries = durable(self._listed(entries), "lists") if self.n else entries.withColumn("list", F.lit(0))
        self.compared = 0

    def _fit(self, distinct: DataFrame, seed: int) -> np.ndarray:
        d = distinct.select(F.size("x").alias("d")).first()["d"]
        most = max(self.lists, SAMPLE_VALUES // d)
        # A hash threshold takes about ``most`` rows of the whole table, whatever its order.
        share = min(1.0, most / self.n)
        some = distinct.where(F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("x").limit(2 * most)
        sample = np.array([r["x"] for r in some.collect()], float)
        if not len(sample):
            sample = np.array([distinct.first()["x"]], float)
        self.tried = sample[:TRIED_ROWS]
        return centroids(sample, self.lists, seed)

    def probes_for(self, threshold: float, recall: float, both_ask: bool) -> int:
        """The least number of probes that finds ``recall`` of the sample's pairs; a quarter of the lists, at
        least 8, if the sample has hardly any."""
        x, k = self.tried, len(self.at)
        order = np.argsort(np.argsort(-(x @ self.at.T), axis=1), axis=1)  # a vector's rank of each list
        home = order.argmin(axis=1)
        needed = []
        for i in range(0, len(x), 500):
            a, b = np.nonzero(x[i : i + 500] @ x.T >= threshold)
            a = a + i
            a, b = a[a < b], b[a < b]
            ab, ba = order[a, home[b]], order[b, home[a]]
            needed.append(np.minimum(ab, ba) if both_ask else np.concatenate([ab, ba]))
        ranks = np.sort(np.concatenate(needed)) if needed else np.zeros(0, int)
        if len(ranks) < 20:
            return min(k, max(8, k // 4))
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1

    def _listed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their nearest ``list``."""
        at = self.at

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.stack(pdf["x"]).astype(np.float64) if len(pdf) else np.zeros((0, at.shape[1]))
                pdf["list"] = np.concatenate([np.zeros(0, np.int32), *[(x[i : i + 1024] @ at.T).argmax(1).astype(np.int32) for i in range(0, len(x), 1024)]])
                yield pdf

        return rows.mapInPandas(best, f"{_kinds(rows)}, list int")

    def _asking(self, rows: DataFrame, probes: int | None) -> DataFrame:
        """``rows`` with marks (``asks``, bits) of the lists that they ask, if they do: their ``probes`` nearest; for None each asks the half of
        all lists that comes after its own, so that each list asks the other or is asked by it."""
        at = self.at
        lists = len(at)

        def marks(x: np.ndarray, own: np.ndarray) -> np.ndarray:
            if probes is None:
                return (np.arange(lists)[None, :] - own[:, None]) % lists <= lists // 2
            out = np.zeros((len(x), lists), bool)
            np.put_along_axis(out, np.argpartition(-(x @ at.T), min(probes, lists) - 1, axis=1)[:, :probes], True, axis=1)
            return out

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                bits = []
                for i in range(0, len(pdf), 1024):
                    part = pdf.iloc[i : i + 1024]
                    got = marks(np.stack(part["x"]).astype(np.float64), part["list"].to_numpy()) & part["asked"].to_numpy(bool)[:, None]
                    bits += [row.tobytes() for row in np.packbits(got, axis=1)]
                pdf["asks"] = pd.Series(bits, dtype=object, index=pdf.index)
                yield pdf

        return rows.mapInPandas(best, f"{_kinds(rows)}, asks binary")

    def _asked(self, asking: DataFrame) -> np.ndarray:
        """How many rows ask each list."""
        lists = len(self.at)

        def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(lists, np.int64)
            for pdf in batches:
                for i in range(0, len(pdf), 1024):
                    n += _bits(pdf["asks"].iloc[i : i + 1024], lists).sum(0)
            yield pd.DataFrame({"list": np.arange(lists), "n": n})

        got = asking.select("asks").mapInPandas(counts, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()  # a row a list
        out = np.zeros(lists, np.int64)
        for r in got:
            out[r["list"]] = r["n"]
        return out

    def pairs(self, threshold: float, *, probes: int | None = None, recall: float = RECALL, asked: DataFrame | None = None) -> DataFrame:
        """name_a, name_b (a before b), sim: pairs of different vectors at or over ``threshold`` that the index
        finds; with ``asked`` (item_id) those with a vector of an asked item.

        With as many probes as lists every pair is found.  Where the probes would take more comparisons than all pairs are,
        all pairs are compared.
        """
        if not self.n:
            return self.entries.select(F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(0.0).alias("sim"))
        rows = self.entries.withColumn("asked", F.lit(True))
        if asked is not None:
            names = self.members.join(asked.select("item_id"), "item_id", "left_semi").select("name").distinct().withColumn("asked", F.lit(True))
            rows = self.entries.join(names, "name", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        probes = min(probes or self.probes_for(threshold, recall, asked is None), len(self.at))
        held_n = {r["list"]: r["n"] for r in self.entries.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
        sizes = np.array([held_n.get(k, 0) for k in range(len(self.at))])
        asking = durable(self._asking(rows, probes), "asking")
        self.compared = int(self._asked(asking) @ sizes)
        if asked is None and 2 * self.compared > 1.1 * self.n**2:
            asking = durable(self._asking(rows, None), "asking")
            self.compared = int(self._asked(asking) @ sizes)
        asks = asking.where("asked")
        # Tasks hold parts of lists, several to one; each share of the rows that ask passes all of these once.
        tasks = task_count(rows.sparkSession)
        room = max(1, min(TASK_ROWS, round(self.n / tasks**0.5)))
        cuts = [(k, max(1, -(-int(n) // min(room, blocks.HELD_ROWS)))) for k, n in enumerate(sizes)]
        each = np.array([sizes[k] / p for k, p in cuts for _ in range(p)])
        block = ((each.cumsum() - each / 2) // room).astype(int)
        ends = np.cumsum([p for _, p in cuts])
        parts = F.broadcast(rows.sparkSession.createDataFrame([(k, p, block[end - p : end].tolist()) for (k, p), end in zip(cuts, ends, strict=True)], "list int, _parts int, _blocks array<int>"))
        n_blocks = int(block.max()) + 1
        shares = max(-(-tasks // n_blocks), -(-(self.n if asked is None else asks.count()) // ASKING_ROWS))
        salt = lambda n, k: F.pmod(F.xxhash64("vid", F.lit(k)), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        held = asking.join(parts, "list").withColumn("_block", F.element_at("_blocks", salt(F.col("_parts"), 1) + 1)).withColumn("_share", every(shares))
        passing = asks.withColumn("_share", salt(F.lit(shares), 2)).withColumn("_block", every(n_blocks))
        keys, columns = ["_block", "_share"], ["vid", "name", "x", "list", "asks"]
        name = self.entries.schema["name"].dataType.simpleString()
        found = met(held.select(*columns, *keys), passing.select(*columns, *keys), keys, lambda x: _Near(x, threshold), f"a {name}, b {name}, sim double", (n_blocks * shares, F.col("_block") * shares + F.col("_share")))
        return found.select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"), "sim")


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def _bits(asks, lists: int) -> np.ndarray:
    """Rows by lists: whether a row asks a list."""
    return np.unpackbits(np.frombuffer(b"".join(asks), np.uint8).reshape(len(asks), -1), axis=1, count=lists).astype(bool)


class _Near(Fold):
    """The near pairs of passing rows and the held rows of the lists that they ask; held rows stand by list."""

    def __init__(self, held: Rows, threshold: float):
        order = np.argsort(held.list, kind="stable")
        super().__init__(Rows({c: v[order] for c, v in held.columns.items()}))
        self.threshold, self.names = threshold, pa.array(self.held.name)
        self.lists, first = np.unique(self.held.list, return_index=True)
        self.ends = [*first, len(order)]
        self.marks = np.frombuffer(b"".join(self.held.asks), np.uint8).reshape(len(order), -1)

    def add(self, passing: Rows) -> Iterator[dict]:
        asks, names = _bits(passing.asks, self.marks.shape[1] * 8)[:, self.lists], pa.array(passing.name)
        parts, n = [], 0
        for k, (a, b) in enumerate(zip(self.ends[:-1], self.ends[1:], strict=True)):
            rows = np.flatnonzero(asks[:, k])
            for c in range(a, b if len(rows) else a, blocks.HELD_ROWS):
                held = self.held.x[c : min(c + blocks.HELD_ROWS, b)]
                # A sum in another order may differ in its last digits: near the threshold it is taken again.
                row, col = np.divmod(np.flatnonzero(passing.x[rows] @ held.T >= self.threshold - 1e-9), len(held))
                row, col = rows[row], c + col
                mine, other, own = passing.vid[row], self.held.vid[col], passing.list[row]
                back = (self.marks[col, own >> 3] >> (7 - (own & 7))) & 1  # whether the held row asks the passing row's list
                once = (mine < other) | ((back == 0) & (mine != other))
                row, col = row[once], col[once]
                sim = np.einsum("ij,ij->i", self.held.x[col], passing.x[row])
                near = sim >= self.threshold
                parts.append((row[near], col[near], sim[near]))
                n += int(near.sum())
                if n >= OUT_PAIRS:
                    yield self._out(parts, names)
                    parts, n = [], 0
        if n:
            yield self._out(parts, names)

    def _out(self, parts: list[tuple[np.ndarray, ...]], names: pa.Array) -> dict:
        row, col, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"a": names.take(pa.array(row)), "b": self.names.take(pa.array(col)), "sim": sim}


def near_duplicates(items: DataFrame, *, similar: float = 0.85, duplicate: float = 0.95, probes: int | None = None, lists: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """name_a, name_b, sim, tier: near pairs in two tiers; equal vectors are one name (``VectorIndex.members``)."""
    found = VectorIndex(items, lists=lists).pairs(similar, probes=probes, asked=asked)
    return found.withColumn("tier", F.when(F.col("sim") >= duplicate, "duplicate").otherwise("similar"))
