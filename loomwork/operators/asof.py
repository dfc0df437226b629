"""As-of join: each row meets the last row of another table at or before its place.

Both tables are put into one order and cut into ranges; within a range the last row of the other
table is carried forward, and one row a range says what the next ranges begin with.  A key of any size may
lie in many ranges, and nothing but the ends of ranges meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged


def as_of(left: DataFrame, right: DataFrame, *, by: list[str], at: str, values: list[str], strict: bool = False, ties: str | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same ``by`` whose ``at`` is not after its own
    (``strict``: before it); null where there is none.

    Of rows of ``right`` at one place the last by ``ties`` (else by its values) is taken. A null key or place meets
    nothing. Rows of ``left`` are kept as often as they come, whatever their other columns are called.
    """
    own = left.columns
    kind = left.schema[at].dataType
    known = right.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, at])).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(at).cast(kind).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.struct(*([ties] if ties else []), *values).alias("_v"), F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("_row"),
    )
    asked = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(known.schema["_v"].dataType).alias("_v"), F.struct(*own).alias("_row"))
    keys = [f"_k{i}" for i in range(len(by))]
    order = [*map(F.col, keys), F.col("_at"), F.col("_side"), F.col("_v")]
    cut = ranged(known.unionByName(asked), order)
    held = F.when(F.col("_v").isNotNull(), F.struct(*keys, "_v"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.withColumn("_held", held)
    ends = marked.where("_held IS NOT NULL").groupBy("_part").agg(F.max_by("_held", F.struct(*keys, "_at", "_side", "_v")).alias("_end"))  # one row a range
    parts = marked.select("_part").distinct().join(ends, "_part", "left")
    carried = parts.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    last = marked.join(F.broadcast(carried), "_part").withColumn("_last", F.coalesce(F.last("_held", ignorenulls=True).over(inside), F.col("_carried")))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_last.{k}"))
    found = last.where("_row IS NOT NULL").withColumn("_hit", F.when(same & F.col("_at").isNotNull(), F.col("_last._v")))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in own], *[F.col("_hit").getField(v).alias(v) for v in values])
