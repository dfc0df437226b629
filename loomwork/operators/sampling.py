"""Training batches in which no two rows share a hub or a text.

Order: rows of the two kinds (AI or not) are shuffled and then drawn one by one, AI with
probability w / (w + w'), each kind's weight being its share of the rows to the power 1 / temperature,
until one kind is used up.  That is the order of arrival of two Poisson streams, so it is made without a
loop: a row's time is the running sum of exponential gaps of its kind, over the kind's rate.

Batches: the order is cut into segments of a bounded number of rows, and in each full batches are
dealt greedily, row after row, taking the first rows that do not collide.  What is left over is put together in its
order and cut again.  When a round places little (one hub may hold a third of all rows),
the rest is dealt by rank within its hub: the k-th rows of all hubs make a batch without any collision.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordering import running

#: Batches that a segment makes, if no rows collide.
SEGMENT_BATCHES = 64
#: A round that places a smaller share of its rows is the last.
LEAST_PLACED = 0.25


def _uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) for a key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(1 << 48))


def kind_rates(n_ai: int, n_other: int, temperature: float) -> tuple[float, float]:
    """Probabilities that the next row is of the AI kind and of the other."""
    n = n_ai + n_other
    if not n:
        return 0.0, 0.0
    if n_ai and n_other and temperature > 0:
        a, b = (n_ai / n) ** (1 / temperature), (n_other / n) ** (1 / temperature)
        return a / (a + b), b / (a + b)
    return n_ai / n, n_other / n


def weighted_order(rows: DataFrame, key: str, is_ai: str, *, temperature: float, seed: str) -> DataFrame:
    """Adds ``_time``, the place of each row in the drawn order."""
    flag = F.coalesce(F.col(is_ai), F.lit(False))
    n = rows.agg(F.count_if(flag).alias("ai"), F.count("*").alias("n")).first()
    rates = kind_rates(n["ai"], n["n"] - n["ai"], temperature)
    parts = []
    for want, rate in ((True, rates[0]), (False, rates[1])):
        some = rows.where(flag == F.lit(want)).withColumns({"_u": _uniform(f"{seed}:order", F.col(key)), "_gap": -F.log(_uniform(f"{seed}:gap", F.col(key))) / F.lit(rate or 1.0)})
        parts.append(running(some, [F.col("_u"), F.col(key)], {"_time": F.col("_gap")}).drop("_u", "_gap"))
    return parts[0].unionByName(parts[1])


def dealt(rows: list[tuple], batch_size: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Full batches of (hub, text) pairs, greedily in order: (row, batch) of those placed, and the rows left.

    A null hub or text collides with nothing.
    """
    placed: list[tuple[int, int]] = []
    queue = list(range(len(rows)))
    batch = 0
    while len(queue) >= batch_size:
        hubs: set = set()
        texts: set = set()
        chosen: list[int] = []
        left: list[int] = []
        for at, k in enumerate(queue):
            hub, text = rows[k]
            if (hub is not None and hub in hubs) or (text is not None and text in texts):
                left.append(k)
                continue
            chosen.append(k)
            hubs.add(hub)
            texts.add(text)
            if len(chosen) == batch_size:
                left += queue[at + 1 :]
                break
        if len(chosen) < batch_size:
            break
        placed += [(k, batch) for k in chosen]
        queue, batch = left, batch + 1
    return placed, queue


def _greedy_round(rows: DataFrame, columns: list[str], batch_size: int, segment: int) -> DataFrame:
    """``rows`` (with hub ``_h``, text ``_x`` and ``_time``) with ``_segment`` and ``_batch``, null where left over."""
    numbered = running(rows, [F.col("_time"), F.col("_row")], {}, rank="_place").withColumn("_segment", F.floor((F.col("_place") - 1) / segment).cast("long"))

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("_place")
        placed, _ = dealt(list(zip(group["_h"].to_pylist(), group["_x"].to_pylist(), strict=True)), batch_size)
        batch: list[int | None] = [None] * group.num_rows
        for k, b in placed:
            batch[k] = b
        return pa.table({"_row": group["_row"], "_segment": group["_segment"], "_batch": pa.array(batch, pa.int64())})

    found = numbered.select("_row", "_h", "_x", "_place", "_segment").groupBy("_segment").applyInArrow(work, "_row long, _segment long, _batch long")
    return numbered.drop("_place", "_segment").join(found, "_row").select(*columns, "_segment", "_batch")


def _rank_in(rows: DataFrame, keys: list[str], then: list[str], name: str) -> DataFrame:
    """Adds the rank from 0 of each row among those of equal ``keys``: its place in the whole order less
    the first place of its keys, so a key of any size is in no window of its own."""
    placed = durable(running(rows, [F.col(c) for c in [*keys, *then]], {}, rank="_r"), "ranks")
    first = placed.groupBy(*keys).agg(F.min("_r").alias("_first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = placed.alias("a").join(first.alias("b"), same)
    return both.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("a._r") - F.col("b._first")).alias(name))


def conflict_free_batches(
    rows: DataFrame, *, key: str, hub: str = "hub_id", text: str | None = "text_key", is_ai: str = "is_ai", batch_size: int = 64, temperature: float = 2.0, seed: int = 0, epoch: int = 0,
    drop_last: bool = False, segment_batches: int = SEGMENT_BATCHES,
) -> DataFrame:
    """``rows`` with ``batch`` (from 0, in the order of training) and ``place`` in it.

    Every row is in one batch, and no batch holds a hub or a text twice. Batches are full but for those at the
    end, which hold what collides too often; ``drop_last`` leaves these out. A null hub or text collides with nothing.
    ``seed`` and ``epoch`` alone decide about the order; rows that share a key follow each other in any order.
    An empty table gives an empty one.
    """
    mark = f"{seed + epoch}"
    columns = rows.columns
    wanted = [*columns, "_h", "_x", "_row", "_time"]
    numbered = durable(rows.withColumns({"_h": F.col(hub).cast("string"), "_x": (F.col(text) if text else F.lit(None)).cast("string"), "_row": F.monotonically_increasing_id()}), "rows")
    left = durable(weighted_order(numbered, key, is_ai, temperature=temperature, seed=mark).select(*wanted), "order")
    done: list[DataFrame] = []
    start, n, turn = 0, left.count(), 0
    while n >= batch_size:
        turned = durable(_greedy_round(left, wanted, batch_size, batch_size * segment_batches), "round")
        placed = turned.where("_batch IS NOT NULL")
        # Batches in order of segment, then as dealt; the last segment is only as long as its rows.
        number = F.col("_segment") * segment_batches + F.col("_batch")
        done.append(placed.select(*wanted, number.alias("_b"), F.lit(turn).alias("_turn")))
        rest = n - placed.count()
        left, turn = turned.where("_batch IS NULL").select(*wanted), turn + 1
        few = n - rest < LEAST_PLACED * n
        n = rest
        if few:
            break
    if n and not drop_last:
        # A null hub or text is a hub or text of its own row.
        own = left.withColumns({"_hk": F.coalesce(F.concat(F.lit("h"), "_h"), F.concat(F.lit("r"), F.col("_row").cast("string"))), "_xk": F.coalesce(F.concat(F.lit("x"), "_x"), F.concat(F.lit("r"), F.col("_row").cast("string")))})
        by_hub = _rank_in(own, ["_hk"], ["_time", "_row"], "_i")
        by_text = _rank_in(by_hub, ["_i", "_xk"], ["_time", "_row"], "_j")
        inside = _rank_in(by_text, ["_i", "_j"], ["_time", "_row"], "_k")
        cut = inside.withColumn("_c", F.floor(F.col("_k") / batch_size))
        groups = running(cut.select("_i", "_j", "_c").distinct(), [F.col("_i"), F.col("_j"), F.col("_c")], {}, rank="_b")
        done.append(cut.join(groups, ["_i", "_j", "_c"]).select(*wanted, F.col("_b").cast("long"), F.lit(turn).alias("_turn")))
    if not done:
        return rows.select(*columns, F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("place")).limit(0)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = durable(out, "batches")
    numbers = running(out.groupBy("_turn", "_b").agg(F.min("_time").alias("_t")), [F.col("_turn"), F.col("_b")], {}, rank="batch")
    placed = _rank_in(out.join(numbers.select("_turn", "_b", (F.col("batch") - 1).alias("batch")), ["_turn", "_b"]).select(*wanted, "batch"), ["batch"], ["_time", "_row"], "place")
    return placed.select(*columns, "batch", "place")
