"""Whitening of embeddings by merging singular value decompositions.

The fit list (each distinct vector once) is decomposed block by block.  A block leaves its number
of rows, mean, singular values and right vectors, all of them: d by d numbers, whatever its rows.
Two such states merge by one more decomposition of their scaled vectors under each other and a row
for the distance of their means, which is the decomposition of all their rows together.  States
merge within a partition and then in groups, round by round, until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

STEPS = 256
BLOCK_ROWS = 4096
#: States that one merge task holds.
FAN = 8
_LONG = 1 << 63

STATE = "id long, n long, sums array<decimal(38,0)>, mean array<double>, sizes array<double>, vectors array<double>"


@dataclass
class State:
    """``n`` rows of exact integer ``sums``: their mean, singular values and right vectors (rows)."""

    n: int
    sums: list[int]
    mean: np.ndarray
    sizes: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> State:
        """The state of a block of integer vectors."""
        # Halves of the bits sum up in 64 bits without overflow.
        high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
        sums = [(int(a) << 32) + int(b) for a, b in zip(high, low, strict=True)]
        exact = rows.astype(np.float64)
        mean = np.array([s / len(rows) for s in sums])
        _, sizes, vectors = np.linalg.svd(exact - mean, full_matrices=False)
        return cls(len(rows), sums, mean, sizes, vectors)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        gap = np.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        stacked = np.vstack([self.sizes[:, None] * self.vectors, other.sizes[:, None] * other.vectors, gap[None, :]])
        _, sizes, vectors = np.linalg.svd(stacked, full_matrices=False)
        return State(n, sums, np.array([s / n for s in sums]), sizes, vectors)

    def row(self, key: int) -> dict:
        return {"id": key, "n": self.n, "sums": self.sums, "mean": self.mean.tolist(), "sizes": self.sizes.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def from_row(cls, row) -> State:
        d = len(row.mean)
        return cls(int(row.n), [int(s) for s in row.sums], np.asarray(row.mean, float), np.asarray(row.sizes, float), np.asarray(row.vectors, float).reshape(-1, d))


def quantised(vector: Column) -> Column:
    """floor(256*c) of each entry as long; entries beyond the range of a long stop at its ends."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(STEPS))).cast("long"))


def finite(vector: Column) -> Column:
    """True where the vector and all its entries are there and finite."""

    def fine(c: Column) -> Column:
        v = c.cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows; those without entries are left out."""
    xs = batch.column(batch.schema.get_field_index("x"))
    widths = set(np.unique(np.diff(xs.offsets.to_numpy()))) - {0}
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(int(w) for w in widths)}")
    flat = xs.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, widths.pop()) if widths else np.zeros((0, 0), np.int64)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    state = None
    for batch in batches:
        rows = _matrix(batch)
        for k in range(0, len(rows), BLOCK_ROWS):
            block = State.of(rows[k : k + BLOCK_ROWS])
            state = block if state is None else state.merged(block)
    if state is not None:
        yield _arrow_states(pd.DataFrame([state.row(TaskContext.get().partitionId())]))


def _arrow_states(rows: pd.DataFrame) -> pa.RecordBatch:
    doubles = pa.list_(pa.float64())
    kinds = {"id": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.decimal128(38, 0)), "mean": doubles, "sizes": doubles, "vectors": doubles}
    return pa.RecordBatch.from_arrays([pa.array(rows[c].tolist(), kinds[c]) for c in kinds], names=list(kinds))


def _merge(group: pa.Table) -> pa.Table:
    states = [State.from_row(r) for r in group.to_pandas().sort_values("id").itertuples()]
    total = states[0]
    for s in states[1:]:
        total = total.merged(s)
    return pa.Table.from_batches([_arrow_states(pd.DataFrame([total.row(min(group["id"].to_pylist()))]))])


def fit_state(fit: DataFrame) -> State | None:
    """The merged state of all rows of ``fit`` (x: array of long); None if it has no entries.

    Only one state, of d by d numbers, comes to the driver.
    """
    states, drop = kept(fit.select("x").mapInArrow(_states, STATE), "states")
    left = states.agg(F.count("*").alias("n"), F.max("id").alias("id")).first()
    top = (left["id"] or 0) + 1
    while top > 1:
        states = states.groupBy(F.floor(F.col("id") / FAN).alias("g")).applyInArrow(_merge, STATE).withColumn("id", F.floor(F.col("id") / FAN))
        top = -(-top // FAN)
    found = [State.from_row(r) for r in states.collect()] if left["n"] else []
    drop()
    return found[0] if found else None


@dataclass
class Model:
    """Components (rows of ``axes``, by falling ``values``) of the covariance of ``n`` vectors with exact ``sums``."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, state: State, components: int | None) -> Model:
        values = state.sizes**2 / state.n
        d = len(state.sums)
        # A direction without spread, up to rounding, cannot be scaled to unit spread.
        real = state.sizes > (state.sizes[0] if len(state.sizes) else 0) * np.finfo(float).eps * max(d, min(state.n, 1 << 20))
        top = int(real.sum()) if components is None else min(int(real.sum()), components)
        return cls(state.n, state.sums, state.vectors[:top], values[:top], values[:top] / values.sum() if top else values[:0])

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """Projections of ``rows`` less the mean, scaled to unit variance."""
        mean = np.array([s / self.n for s in self.sums])
        return (rows.astype(np.float64) - mean) @ self.axes.T / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2; None where one is beyond a long."""
        sums = self.sums
        reach = max(int(np.abs(rows.astype(np.float64)).max(initial=0)) + 1, 1) * self.n + max(map(abs, sums), default=0)
        if reach * reach * max(1, rows.shape[1]) < _LONG:
            gap = rows * np.int64(self.n) - np.array(sums, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        exact = [sum((self.n * int(x) - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in rows]
        return [v if v < _LONG else None for v in exact]


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's measured covariance less the identity."""
    k = len(model.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whitened rows are already centred by the mean of the fit list.
        total = np.zeros((k, k))
        for batch in batches:
            rows = _matrix(batch)
            if len(rows):
                w = model.whitened(rows)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["place", "total"])

    sums = fit.select("x").mapInArrow(products, "place long, total double").groupBy("place").agg(F.sum("total").alias("total"))
    cov = np.zeros(k * k)
    for r in sums.collect():  # k by k numbers
        cov[r["place"]] = r["total"]
    return float(np.abs(cov.reshape(k, k) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, *, vector: str = "embedding", id_col: str = "vec_id", components: int | None = 4) -> DataFrame:
    """Whitened coordinates: a row (``id_col``, component from 1, n, deviation, whitened, explained,
    identity_error) for each usable row of ``vectors`` and component up to ``components`` (None: all).

    Rows whose vector is null or holds a null or non-finite entry are left out; one without entries
    has no components and so no rows.  Repeated rows and null ids give rows each time, while the fit takes each
    distinct vector once.  Components without spread (fewer different vectors than components, or one
    vector only) are left out; equal eigenvalues share their plane by any axes.  ``deviation`` is
    null where it is beyond a long.  Vectors of different lengths raise an error.  Other columns are not
    read.  An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    usable = vectors.select(vectors[id_col].alias("vec"), vectors[vector].alias("v")).where(finite(F.col("v"))).select("vec", quantised(F.col("v")).alias("x"))
    # Copies combine before the shuffle.
    fit, drop = kept(usable.select("x").where(F.size("x") > 0).distinct(), "fit")
    schema = f"vec {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    state = fit_state(fit)
    model = Model.of(state, components) if state else None
    k = len(model.values) if model else 0
    error = identity_error(fit, model) if k else 0.0
    drop()
    if not k:
        return spark.createDataFrame([], schema).withColumnRenamed("vec", id_col)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column(1)
            some = pa.array(np.diff(xs.offsets.to_numpy()) > 0)
            batch = batch.filter(some)
            rows = _matrix(batch)
            if not len(rows):
                continue
            m = len(rows)
            again = pa.array(np.repeat(np.arange(m), k))
            dev = pa.array(model.deviations(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), dev.take(again),
                    pa.array(model.whitened(rows).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(coordinates, schema).withColumnRenamed("vec", id_col)
