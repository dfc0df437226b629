"""Ranking measures, fold splits and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import similarity
from .ordering import running


def item_ranks(ranked: DataFrame, valid: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, best: the first rank of a valid hub; null if none is ranked."""
    best = ranked.join(valid, ["item_id", "hub_id"], "left_semi").groupBy("item_id").agg(F.min("rank").alias("best"))
    return items.join(best, "item_id", "left")


def ranking_metrics(ranks: DataFrame, by: str | None = None) -> DataFrame:
    """hit@1, hit@5, MRR and NDCG@10 (first valid hub alone); items without a hit count as 0."""
    r = F.col("best")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    aggs = [
        share((r <= 1).cast("double")).alias("hit1"), share((r <= 5).cast("double")).alias("hit5"), share(1.0 / r).alias("mrr"), share(F.when(r <= 10, 1.0 / F.log2(r + 1.0))).alias("ndcg10"), F.count("*").alias("n"),
    ]
    return ranks.groupBy(by).agg(*aggs) if by else ranks.agg(*aggs)


def covered_split(ranks: DataFrame, valid: DataFrame, trained_hubs: DataFrame) -> DataFrame:
    """The measures for items with a hub seen in training, and for the others."""
    seen = valid.join(trained_hubs, "hub_id", "left_semi").select("item_id").distinct().withColumn("covered", F.lit(True))
    return ranking_metrics(ranks.join(seen, "item_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False))), "covered")


def compare_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of both sides by who was right."""
    both = a.select("item_id", F.col("correct").alias("ca")).join(b.select("item_id", F.col("correct").alias("cb")), "item_id")
    kind = F.when(F.col("ca") & F.col("cb"), "both_correct").when(F.col("ca"), "a_only").when(F.col("cb"), "b_only").otherwise("both_wrong")
    return both.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def hashed_split(rows: DataFrame, key: str, sizes: dict[str, int], rest: str, seed: int) -> DataFrame:
    """Adds ``part``: exact numbers of rows for each named part, by hash order, the others ``rest``.

    Fewer rows than the parts need are an error."""
    need = sum(sizes.values())
    if (n := rows.count()) < need:
        raise ValueError(f"{need} rows are needed, {n} are there")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    # The first rows of the order are found by a distributed top-k, not by ranking them all.
    first = rows.select(key, h.alias("_h")).orderBy("_h", key).limit(need)
    numbered = first.withColumn("_r", F.row_number().over(Window.orderBy("_h", key)))
    at, part = 0, F.lit(None).cast("string")
    for name, n in sizes.items():
        part = F.when((F.col("_r") > at) & (F.col("_r") <= at + n), name).otherwise(part)
        at += n
    return rows.join(numbered.select(key, part.alias("part")), key, "left").withColumn("part", F.coalesce("part", F.lit(rest)))


def folds(links: DataFrame, names: list[str]) -> DataFrame:
    """Leave-one-framework-out: each row once a fold, as evaluation or training row of it."""
    spread = links.withColumn("fold", F.explode(F.array(*[F.lit(n) for n in names])))
    return spread.withColumn("role", F.when(F.col("framework_id") == F.col("fold"), "eval").otherwise("train"))


#: Replicates that are drawn at once from one random stream.
BLOCK = 2_500


def bootstrap(values: DataFrame, replicates: int, seed: int, tasks: int = 8) -> DataFrame:
    """mean, lo, hi, p_positive: a percentile interval of the mean, resampled within folds (fold, value),
    and the share of replicates at or under zero.

    Values are counted by Spark first.  A replicate draws how often each different value of a fold
    comes, which is the same as drawing rows, so its cost is the number of different values
    (checked, at most a million) however many rows there are.  Blocks of replicates have random
    streams of their own and are drawn at once: the result depends on the seed alone.
    """
    counted = values.groupBy("fold", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n")).orderBy("fold", "value").limit(1_000_001).collect()
    if len(counted) > 1_000_000:
        raise ValueError("bootstrap is for at most a million different values")
    groups: dict = {}
    for r in counted:
        groups.setdefault(r.fold, []).append((r.value, r.n))
    spark = values.sparkSession
    if not counted:
        return spark.createDataFrame([], "mean double, lo double, hi double, n long, p_positive double")
    shared = spark.sparkContext.broadcast([(np.array([v for v, _ in g]), np.array([n for _, n in g], np.int64)) for g in groups.values()])
    total = int(sum(r.n for r in counted))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Blocks of replicates are numbered alike, however they are dealt to tasks.
            for block in pdf["id"]:
                rng = np.random.default_rng([seed, int(block)])
                many = min(BLOCK, replicates - int(block) * BLOCK)
                m = np.zeros(many)
                for v, n in shared.value:
                    step = max(1, 4_000_000 // len(v))
                    m += np.concatenate([rng.multinomial(n.sum(), n / n.sum(), size=min(step, many - k)) @ v for k in range(0, many, step)])
                yield pd.DataFrame({"m": m / total})

    blocks = -(-replicates // BLOCK)
    drawn = spark.range(0, blocks, 1, min(tasks, blocks)).mapInPandas(draw, "m double")
    mean = sum(r.value * r.n for r in counted) / total
    return drawn.agg(
        F.round(F.lit(float(mean)), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"),
        F.lit(total).cast("long").alias("n"), F.round(F.avg((F.col("m") <= 0).cast("int")), 6).alias("p_positive"),
    )


def paired_delta(a: DataFrame, b: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The interval of the mean of b - a over common items, resampled within folds; ``p_positive``
    is the one-sided p-value of a gain."""
    both = a.select("fold", "item_id", F.col("value").alias("va")).join(b.select("item_id", F.col("value").alias("vb")), "item_id")
    return bootstrap(both.select("fold", (F.col("vb") - F.col("va")).alias("value")), replicates, seed)


def lofo_aggregate(ranks: DataFrame, replicates: int = 0, seed: int = 42) -> DataFrame:
    """fold, n and the measures of each fold, and of all items (fold ``all``); with ``replicates``,
    the interval of hit@1 over all."""
    per = ranking_metrics(ranks, "fold").select(F.col("fold").cast("string").alias("fold"), "hit1", "hit5", "mrr", "ndcg10", "n")
    whole = ranking_metrics(ranks).select(F.lit("all").alias("fold"), "hit1", "hit5", "mrr", "ndcg10", "n")
    out = per.unionByName(whole)
    if not replicates:
        return out
    hits = ranks.select("fold", F.coalesce((F.col("best") <= 1).cast("double"), F.lit(0.0)).alias("value"))
    ci = bootstrap(hits, replicates, seed).select(F.lit("all").alias("fold"), "lo", "hi")
    return out.join(ci, "fold", "left")


def rescored(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """item_id, best: stored predictions (item_id, text, hub_id, rank, own_hub) against all hubs
    that ``truth`` (text, hub_id) knows for the text; an unknown text has its own hub alone."""
    known = truth.select("text", "hub_id").distinct().withColumn("ok", F.lit(True))
    some = truth.select("text").distinct().withColumn("known", F.lit(True))
    rows = predictions.join(known, ["text", "hub_id"], "left").join(some, "text", "left")
    right = F.when(F.col("known"), F.coalesce("ok", F.lit(False))).otherwise(F.col("hub_id") == F.col("own_hub"))
    return rows.groupBy("item_id").agg(F.min(F.when(right, F.col("rank"))).alias("best"))


def fold_results(ours: DataFrame, baseline: DataFrame) -> DataFrame:
    """fold, hit1, base_hit1, delta, n: folds with the baseline's, null where it has none."""
    return ours.join(baseline.select("fold", F.col("hit1").alias("base_hit1")), "fold", "left").select("fold", "hit1", "base_hit1", F.round(F.col("hit1") - F.col("base_hit1"), 6).alias("delta"), "n")


def soft_floors(folds: DataFrame, floors: dict[str, float]) -> DataFrame:
    """fold, lo, floor of the folds whose interval begins under their floor; others have none."""
    m = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
    return folds.withColumn("floor", m[F.col("fold")]).where(F.col("lo") < F.col("floor")).select("fold", "lo", "floor")


def stopping(rate: float, canary: float, hubs: int) -> bool:
    """Whether a review may end: enough accepted, canaries right, hubs reached."""
    return rate > 0.80 and canary >= 0.50 and hubs >= 50


def phase_gates(metrics: DataFrame) -> DataFrame:
    """gate, value, passed of a model (hit5) against a baseline (base_hit5): 0.50, and a gap of 0.10."""
    gap = F.round(F.col("hit5") - F.col("base_hit5"), 6)
    rows = metrics.select(F.explode(F.array(F.struct(F.lit("hit5").alias("gate"), F.col("hit5").alias("value"), (F.col("hit5") > 0.5).alias("passed")),
                                            F.struct(F.lit("gap").alias("gate"), gap.alias("value"), (gap > 0.1).alias("passed")))).alias("g"))
    return rows.select("g.*")


def evenly_spaced(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows at places 0, n // k, 2n // k, ... of the order of ``key``: examples over its range."""
    n = rows.count()
    ranked = running(rows, [F.col(key)], {}, rank="_r")
    places = sorted({i * n // k for i in range(k)}) if n else []
    return ranked.where((F.col("_r") - 1).isin(places)).drop("_r")


def evaluation_text(section_name: Column, section_id: Column) -> Column:
    """The section's name, else its id; the id goes before a name that does not hold it."""
    name = F.coalesce(F.nullif(F.trim(section_name), F.lit("")), section_id)
    return F.when(F.contains(name, section_id), name).otherwise(F.concat(section_id, F.lit(": "), name))


def evaluate_fold(items: DataFrame, hubs: DataFrame, valid: DataFrame, fold, k: int = 10) -> DataFrame:
    """The measures of one fold's items (item_id, fold, embedding), ranked over all hubs."""
    own = items.where(F.col("fold") == fold)
    ranked = similarity.top_hubs(own, hubs, k)
    return ranking_metrics(item_ranks(ranked, valid, own.select("item_id", "fold")), "fold")
