"""Similarity between items and hubs: top-k, negatives, thresholds, neighbours.

``similarities`` is the long table of all pairs of items and a small set of hubs.  The others
never make it: one side is a block of bounded size, sent to every task as a matrix, and Arrow
batches of the other side are multiplied with it.  With several blocks, each is held by tasks of its own
(``blocks``), so neither side goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from .blocks import Fold, Rows, arrow_schema, block_of, met, result

#: Rows of the side that is sent, in one block.
HUB_BLOCK = 20_000
#: Rows of the other side that are multiplied with a block at once.
ROWS = 128
#: Vectors of a block that are multiplied with these rows at once: what follows a product then finds it in a core's cache.
TILE = 1024
#: Tasks for each shuffle partition, about, where blocks are held by tasks: the last ones to end are then short.
TASKS_PER_PART = 3

#: Cores for which tasks are made at least, as a session may not know all of its cores yet.
CORES = 16

Block = tuple[np.ndarray, ...]


def sent(hubs: DataFrame) -> DataFrame:
    """``hubs`` marked to be sent to every task, if they are few enough for one block."""
    return F.broadcast(hubs) if hubs.count() <= HUB_BLOCK else hubs


def similarities(items: DataFrame, hubs: DataFrame) -> DataFrame:
    """item_id, hub_id, sim (and both sides' other columns) for every pair of items and a taxonomy."""
    a = items.withColumnRenamed("embedding", "item_embedding")
    b = hubs.withColumnRenamed("embedding", "hub_embedding")
    return a.crossJoin(sent(b)).withColumn("sim", dot(F.col("item_embedding"), F.col("hub_embedding"))).drop("item_embedding", "hub_embedding")


def top_k(sims: DataFrame, k: int, *, by: str = "sim", item: str = "item_id", other: str = "hub_id") -> DataFrame:
    """The k best of each item; ties by ``other``."""
    w = Window.partitionBy(item).orderBy(F.desc(by), F.col(other))
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bottom_1(sims: DataFrame, *, item: str = "item_id", other: str = "hub_id") -> DataFrame:
    return sims.groupBy(item).agg(F.min_by(other, F.struct("sim", other)).alias(other), F.min("sim").alias("sim"))


class _Found(Fold):
    """A held block of named vectors, and what ``found`` makes of it and of passing rows."""

    def __init__(self, held: Rows, name: str, found: Callable[[pd.DataFrame, Block], pd.DataFrame], more: tuple[str, ...] = ()):
        order = np.argsort(held.columns[name], kind="stable")
        super().__init__(held)
        self.block, self.found = tuple(held.columns[c][order] for c in (name, "embedding", *more)), found

    def add(self, passing: Rows) -> dict[str, np.ndarray] | None:
        parts = []
        for k in range(0, len(passing), ROWS):
            pdf = pd.DataFrame({c: list(v[k : k + ROWS]) if v.ndim > 1 else v[k : k + ROWS] for c, v in passing.columns.items()})
            parts.append(self.found(pdf, self.block))
        got = pd.concat(parts, ignore_index=True)
        return {c: got[c].to_numpy() for c in got.columns}


def task_count(spark: SparkSession) -> int:
    """Tasks for what is sent to each of them: as many as cores need, however many shuffle partitions there are."""
    return TASKS_PER_PART * min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(CORES, spark.sparkContext.defaultParallelism))


def folded(sent: DataFrame, name: str, rows: DataFrame, fold: Callable[[Rows], Fold], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``fold`` over each block of ``sent`` (name, embedding and ``more``) and all ``rows``.

    One block is sent to every task; more are held in tasks of their own, which the rows pass: a task holds one block
    and is passed by one share of the rows, so tasks are even.  Rows are dealt to tasks anew, as a small table of
    vectors may be one file that one task would read."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-sent.count() // HUB_BLOCK)
    if blocks > 1:
        chunks = -(-TASKS_PER_PART * parts // blocks)
        held = sent.select(name, "embedding", *more).withColumn("_block", block_of(name, blocks)).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        passing = rows.withColumn("_chunk", F.pmod(F.xxhash64(*rows.columns), F.lit(chunks)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return met(held, passing, ["_block", "_chunk"], fold, schema, (blocks * chunks, F.col("_block") * chunks + F.col("_chunk")))
    part = sent.select(name, "embedding", *more).limit(HUB_BLOCK).toPandas()
    columns = {c: np.stack(part[c]).astype(np.float64) if c == "embedding" and len(part) else part[c].to_numpy() for c in part.columns}
    shared, names, kinds = spark.sparkContext.broadcast(columns), rows.columns, arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(shared.value[name]):
            return
        work = fold(Rows(shared.value))
        for batch in batches:
            for k in range(0, batch.num_rows, work.rows):
                yield from result(work.add(Rows.of(batch.slice(k, work.rows), names)), kinds)
        yield from result(work.end(), kinds)

    return rows.repartition(parts).mapInArrow(run, schema)


def by_blocks(sent: DataFrame, name: str, rows: DataFrame, found: Callable[[pd.DataFrame, Block], pd.DataFrame], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """What ``found`` makes of each batch of ``rows`` and each block of ``sent`` (name, embedding, ``more``), the block by name."""
    return folded(sent, name, rows, lambda held: _Found(held, name, found, more), schema, more)


def tiles(x: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The products of ``x`` with even parts of a block, and which vectors a part has."""
    n = len(matrix)
    parts = -(-n // TILE)
    for k in range(parts):
        at = slice(k * n // parts, (k + 1) * n // parts)
        yield at, x @ matrix[at].T


class ExpSums:
    """For each row m, its greatest number so far, and a, the sum of exponentials under it; with marks also v, the sum
    over those that are marked."""

    def __init__(self, rows: int, temperature: float):
        self.m, self.a, self.v, self.temperature = np.full(rows, -np.inf), np.zeros(rows), np.zeros(rows), temperature

    def add(self, sims: np.ndarray, marked: np.ndarray | None = None, rows: np.ndarray | slice = slice(None)) -> None:
        """``sims`` is overwritten by its exponentials under the new m; marks are those of ``rows``, others have none."""
        m = np.maximum(self.m, sims.max(1))
        under = np.exp((self.m - m) / self.temperature)
        sims -= m[:, None]
        sims /= self.temperature
        np.exp(sims, out=sims)
        self.m, self.a = m, self.a * under + sims.sum(1)
        if marked is not None:
            self.v *= under
            self.v[rows] += (sims[rows] * marked).sum(1)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def best_of(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest of each row, from the greatest; of equals the first columns."""
    if k == 1:
        return np.arange(len(sims)), sims.argmax(1)
    if k < sims.shape[1] // 4:  # those at or over the k-th greatest, equals too, and only they are sorted
        row, col = np.nonzero(sims >= np.partition(sims, -k, axis=1)[:, -k][:, None])
        order = np.lexsort((col, -sims[row, col], row))
        row, col = row[order], col[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        return row[keep], col[keep]
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(sims)), order.shape[1]), order.ravel()


def top_hubs(items: DataFrame, hubs: DataFrame, k: int) -> DataFrame:
    """item_id, hub_id, sim, rank: the k most similar hubs of each item."""

    def best(pdf: pd.DataFrame, block: Block) -> pd.DataFrame:
        names, matrix = block
        sims = np.stack(pdf["embedding"]).astype(np.float64) @ matrix.T
        rows, at = best_of(sims, k)
        return pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[rows], "hub_id": names[at], "sim": sims[rows, at]})

    schema = f"item_id {_kind(items, 'item_id')}, hub_id {_kind(hubs, 'hub_id')}, sim double"
    return top_k(by_blocks(hubs, "hub_id", items.select("item_id", "embedding"), best, schema), k)


def nearest(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """item_id, neighbour_id, sim, rank: the k nearest of all ``rows`` to each asked row, itself left
    out; asked rows go out in blocks, and a batch sends on its k best for each."""

    def best(pdf: pd.DataFrame, block: Block) -> pd.DataFrame:
        names, matrix = block
        others = pdf["item_id"].to_numpy()
        sims = matrix @ np.stack(pdf["embedding"]).astype(np.float64).T
        sims[names[:, None] == others[None, :]] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(sims, order, 1).ravel()
        out = pd.DataFrame({"item_id": np.repeat(names, order.shape[1]), "neighbour_id": others[order.ravel()], "sim": top})
        return out[np.isfinite(top)]

    kind = _kind(rows, "item_id")
    found = by_blocks(asked, "item_id", rows.select("item_id", "embedding"), best, f"item_id {kind}, neighbour_id {kind}, sim double")
    return top_k(found, k, other="neighbour_id")


def similar_to(items: DataFrame, threshold: float, duplicate: float) -> DataFrame:
    """Unordered pairs at or over ``threshold``, in two tiers, of the rows that are ``asked`` with
    all rows (item_id, embedding, asked)."""

    def near(pdf: pd.DataFrame, block: Block) -> pd.DataFrame:
        names, matrix = block
        sims = np.stack(pdf["embedding"]).astype(np.float64) @ matrix.T
        row, col = np.nonzero(sims >= threshold)
        mine, other = pdf["item_id"].to_numpy()[row], names[col]
        # Two asked rows meet twice: the pair counts once.
        keep = np.where(pdf["asked"].to_numpy()[row].astype(bool), other < mine, True)
        return pd.DataFrame({"x": other[keep], "y": mine[keep], "sim": sims[row, col][keep]})

    kind = _kind(items, "item_id")
    found = by_blocks(items.where("asked"), "item_id", items.select("item_id", "embedding", "asked"), near, f"x {kind}, y {kind}, sim double")
    tier = F.when(F.col("sim") >= duplicate, "duplicate").otherwise("similar").alias("tier")
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.round("sim", 6).alias("sim"), tier)


def scored_top(items: DataFrame, hubs: DataFrame, k: int, temperature: float) -> DataFrame:
    """item_id, hub_id, sim, p, max_sim, rank: the k best hubs of each item with their softmax
    probability over all hubs.

    Each block gives its best k with the maximum and the sum of exponentials of all its hubs;
    those of all blocks make the whole sum, so no row a pair is ever written."""

    def best(pdf: pd.DataFrame, block: Block) -> pd.DataFrame:
        names, matrix = block
        sims = np.stack(pdf["embedding"]).astype(np.float64) @ matrix.T
        rows, at = best_of(sims, k)
        top = sims.max(1)
        total = sum(np.exp((sims[:, c : c + TILE] - top[:, None]) / temperature).sum(1) for c in range(0, sims.shape[1], TILE))
        first = np.diff(rows, prepend=-1) > 0
        return pd.DataFrame({
            "item_id": pdf["item_id"].to_numpy()[rows], "hub_id": names[at], "sim": sims[rows, at],
            "m": np.where(first, top[rows], np.nan), "z": np.where(first, total[rows], np.nan),
        })

    schema = f"item_id {_kind(items, 'item_id')}, hub_id {_kind(hubs, 'hub_id')}, sim double, m double, z double"
    found = by_blocks(hubs, "hub_id", items.select("item_id", "embedding"), best, schema)
    w = Window.partitionBy("item_id")
    found = found.withColumns({"m": F.nanvl("m", F.lit(None)), "z": F.nanvl("z", F.lit(None))})
    found = found.withColumn("max_sim", F.max("m").over(w))
    found = found.withColumn("_z", F.sum(F.col("z") * F.exp((F.col("m") - F.col("max_sim")) / temperature)).over(w))
    found = found.withColumn("p", F.exp((F.col("sim") - F.col("max_sim")) / temperature) / F.col("_z"))
    return top_k(found, k).select("item_id", "hub_id", "sim", "p", "max_sim", "rank")


def knn_vote(sims: DataFrame, neighbours: int, keep: int) -> DataFrame:
    """Votes of an item's nearest labelled neighbours: sums of positive similarity by hub."""
    near = top_k(sims, neighbours, other="neighbour_id")
    votes = near.groupBy("item_id", "hub_id").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("vote"))
    return top_k(votes, keep, by="vote")


def softmax(sims: DataFrame, temperature: float) -> DataFrame:
    """Adds ``p``: a stable softmax over each item's hubs."""
    w = Window.partitionBy("item_id")
    e = sims.withColumn("_e", F.exp((F.col("sim") - F.max("sim").over(w)) / temperature))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def knn_over(labelled: DataFrame, ks: list[int]) -> DataFrame:
    """k, item_id, hub_id: the hub that each item's nearest k neighbours vote for, for several k;
    neighbours (item_id, hub_id, sim, rank) are ranked once."""
    spread = labelled.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(F.col("rank") <= F.col("k"))
    votes = spread.groupBy("k", "item_id", "hub_id").agg(F.sum(F.greatest("sim", F.lit(0.0))).alias("vote"))
    w = Window.partitionBy("k", "item_id").orderBy(F.desc("vote"), "hub_id")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("k", "item_id", "hub_id")


def health(vectors: DataFrame, size: int) -> DataFrame:
    """Whether all vectors have the size and length one that similarities assume."""
    return vectors.agg(F.count("*").alias("n"), ((F.min(F.size("embedding")) == size) & (F.max(F.size("embedding")) == size)).alias("right_size"), F.bool_and(F.abs(norm(F.col("embedding")) - 1) < 0.001).alias("unit"))
