"""Running sums and ranks over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` cut into ranges of ``order`` and written; ``_part`` numbers the ranges in order."""
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return durable(dealt, "ranges")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], *, rank: str | None = None) -> DataFrame:
    """Adds the running total of each of ``sums`` (and the 1-based ``rank``) in ``order``.

    Each range is summed up; one row a range is summed up again; both meet in a small join.
    """
    values = {**{f"_v{i}": c for i, c in enumerate(sums.values())}, **({"_one": F.lit(1)} if rank else {})}
    names = {**{f"_v{i}": n for i, n in enumerate(sums)}, **({"_one": rank} if rank else {})}
    cut = ranged(rows.withColumns(values), order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])  # one row a range
    starts = totals.select("_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_s") for v in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(starts), "_part")
    return out.select(*rows.columns, *[(F.sum(v).over(inside) + F.col(f"{v}_s")).alias(names[v]) for v in values])


def least_from_here(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the least ``value`` of a row and all after it in ``order``."""
    cut = ranged(rows.withColumn("_v", value), order)
    after = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_part").agg(F.min("_v").alias("_m"))
    later = totals.select("_part", F.min("_m").over(after).alias("_later"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return cut.join(F.broadcast(later), "_part").select(*rows.columns, F.least(F.min("_v").over(inside), "_later").alias(name))
