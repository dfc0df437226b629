"""Exact order statistics without bringing the values together.

The interval of values around a wanted rank is cut into equal parts, rows are counted in each, and the
part that holds the rank is cut again, from its least to its greatest value, until both are equal.  All ranks are
followed at once; a pass brings at most ``PARTS`` counts for each of them to the driver, whatever the rows.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

PARTS = 1024


def places(n: int, shares: list[float]) -> list[tuple[int, int, float]]:
    """For each share of ``n`` values the ranks on both sides of its place, and how far it lies between them."""
    return [(floor((n - 1) * s), ceil((n - 1) * s), (n - 1) * s - floor((n - 1) * s)) for s in shares]


def order_statistics(values: DataFrame, name: str, ranks: list[int], weight: str | None = None) -> list[float]:
    """The values of the given ranks (from 0, in ascending order); nulls and NaN must be left out.
    With ``weight``, a row stands for so many.

    ``values`` is read once a pass: give a written table.
    """
    many = F.sum(weight) if weight else F.count(name)
    ends = values.agg(F.min(name).alias("lo"), F.max(name).alias("hi"), many.alias("n")).first()
    if not ranks:
        return []
    if ends["n"] is None or max(ranks) >= ends["n"] or min(ranks) < 0:
        raise ValueError(f"ranks {sorted(set(ranks))} of {ends['n']} values")
    # For each rank: the bracket that holds it and how many values lie before the bracket.
    at = {r: (ends["lo"], ends["hi"], 0) for r in set(ranks)}
    x = F.col(name)
    while open_ := sorted({(lo, hi) for lo, hi, _ in at.values() if lo < hi}):
        bracket, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (lo, hi) in enumerate(open_):
            inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
            bracket, part = F.when(inside, k).otherwise(bracket), F.when(inside, _part(x, lo, hi)).otherwise(part)
        counts = values.select(x.alias("x"), (F.col(weight) if weight else F.lit(1)).alias("w"), bracket.alias("b"), part.alias("p")).where("b IS NOT NULL").groupBy("b", "p").agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        found: dict[int, list] = {}
        for r in counts.collect():  # at most PARTS + 1 a bracket
            found.setdefault(r["b"], []).append((r["p"], r["n"], r["lo"], r["hi"]))
        for rank, (lo, hi, before) in at.items():
            if lo == hi:
                continue
            for _, n, low, high in sorted(found[open_.index((lo, hi))]):
                if rank < before + n:
                    at[rank] = (low, high, before)
                    break
                before += n
    return [at[r][0] for r in ranks]


def _part(x: Column, lo: float, hi: float) -> Column:
    """The part of [lo, hi] that a value lies in: never falls as values rise, and differs at the ends."""
    if hi - lo == float("inf"):  # halves first, where the width itself has no double
        return F.when(x == F.lit(hi), PARTS).otherwise(F.floor(((x / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)) * (PARTS - 1))).cast("int")
    return F.when(x == F.lit(hi), PARTS).otherwise(F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * PARTS), F.lit(PARTS - 1))).cast("int")


def quantiles(rows: DataFrame, value: str | Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours; None for each if there is no value.

    Nulls and NaN are left out.  Only the one column is written and read again.
    """
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    kept = durable(rows.select(column.alias("v")).where("v IS NOT NULL AND NOT isnan(v)"), "values")
    n = kept.count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * s for s in shares]
    ranks = sorted({r for p in places for r in (floor(p), ceil(p))})
    at = dict(zip(ranks, order_statistics(kept, "v", ranks), strict=True))
    return [at[floor(p)] if floor(p) == ceil(p) else (ceil(p) - p) * at[floor(p)] + (p - floor(p)) * at[ceil(p)] for p in places]
