"""Grouped counts, rates and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import GROUND_TRUTH
from .filters import floor_of
from .ordering import running
from .selection import quantiles


def framework_metadata(frameworks: DataFrame, controls: DataFrame, assignments: DataFrame) -> DataFrame:
    """Counts for every framework, those without assignments too."""
    owner = controls.select(F.col("id").alias("control_id"), "framework_id")
    truth = F.col("provenance").isin(*GROUND_TRUTH)
    used = assignments.join(owner, "control_id").groupBy("framework_id").agg(
        F.countDistinct("control_id").alias("assigned_controls"), F.count("*").alias("n_assignments"), F.bool_or(truth).alias("any_truth"), F.bool_or(~truth).alias("any_model")
    )
    total = owner.groupBy("framework_id").agg(F.count("*").alias("total_controls"))
    out = frameworks.select(F.col("id").alias("framework_id")).join(total, "framework_id", "left").join(used, "framework_id", "left")
    kind = F.when(F.col("any_truth") & F.col("any_model"), "mixed").when(F.col("any_truth"), "ground_truth").otherwise("model_prediction")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("framework_id", zero("total_controls"), zero("assigned_controls"), zero("n_assignments"), kind.alias("coverage_type"))


def filter_stats(assignments: DataFrame, controls: DataFrame, *, floor: float = 0.30, overrides: dict[str, float] | None = None) -> DataFrame:
    """What the export filter did with each framework's assignments, in its order of tests."""
    rows = assignments.join(controls.select(F.col("id").alias("control_id"), "framework_id"), "control_id")
    low = F.col("confidence") < floor_of(F.col("framework_id"), floor, overrides or {})
    why = (
        F.when(F.col("provenance") == "ground_truth_ai", "ground_truth").when(F.col("review_status") != "accepted", "not_accepted").when(F.col("confidence").isNull(), "null_confidence")
        .when(F.col("is_ood"), "ood").when(low, "below_floor").when(~F.col("is_ood"), "exported").otherwise("uncounted")
    )
    names = ("ground_truth", "not_accepted", "null_confidence", "ood", "below_floor", "exported")
    return rows.groupBy("framework_id").agg(*[F.count_if(why == n).alias(f"n_{n}") for n in names])


def coverage(exported: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls, exported controls and their share for each framework."""
    done = exported.select("control_id").distinct().withColumn("done", F.lit(1))
    rows = controls.select(F.col("id").alias("control_id"), "framework_id").join(done, "control_id", "left")
    out = rows.groupBy("framework_id").agg(F.count("*").alias("total"), F.count("done").alias("exported"))
    return out.withColumn("pct", F.round(100.0 * F.col("exported") / F.col("total"), 1))


def missing_controls(exported: DataFrame, controls: DataFrame) -> DataFrame:
    """framework_id, control_id of every control that no exported row has."""
    rows = controls.select("framework_id", F.col("id").alias("control_id"))
    return rows.join(exported.select("control_id"), "control_id", "left_anti").select("framework_id", "control_id")


def review_metrics(assignments: DataFrame) -> DataFrame:
    """Totals and rates of a review; calibration rows (negative ids) are not part of it."""
    real = assignments.where("id >= 0")
    status = lambda s: F.count_if(F.col("review_status") == s)
    out = real.agg(F.count("*").alias("total"), status("pending").alias("pending"), status("accepted").alias("accepted"), status("rejected").alias("rejected"), status("reassigned").alias("reassigned"))
    done = F.col("total") - F.col("pending")
    rate = lambda c: F.round(100.0 * F.col(c) / F.nullif(done, F.lit(0)), 1).alias(f"{c}_rate")
    return out.select("*", done.alias("reviewed"), F.round(100.0 * done / F.nullif(F.col("total"), F.lit(0)), 1).alias("pct_reviewed"), rate("accepted"), rate("rejected"), rate("reassigned"))


def status_pivot(rows: DataFrame, statuses: tuple[str, ...] = ("accepted", "rejected", "reassigned")) -> DataFrame:
    """Reviewed rows of each framework by status."""
    seen = rows.where(F.col("review_status") != "pending").groupBy("framework_id")
    return seen.agg(*[F.count_if(F.col("review_status") == s).alias(s) for s in statuses])


def calibration_quality(rows: DataFrame) -> DataFrame:
    """Agreement of a reviewer with known answers (negative ids): agreed, reviewed and score."""
    own = rows.where("id < 0 AND review_status <> 'pending'")
    out = own.agg(F.count_if(F.col("reviewer_hub_id") == F.col("hub_id")).alias("agreed"), F.count("*").alias("reviewed"))
    return out.withColumn("score", F.round(F.col("agreed") / F.nullif(F.col("reviewed"), F.lit(0)), 3))


def confidence_strata(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Acceptance in high, low and out-of-distribution rows; the strata overlap."""
    conf = F.coalesce("confidence", F.lit(0.0))
    strata = F.array_compact(F.array(F.when(conf > threshold, "high"), F.when(conf <= threshold, "low"), F.when(F.coalesce("is_ood", F.lit(False)), "ood")))
    per = rows.where("review_status <> 'pending'").select(F.explode(strata).alias("stratum"), "review_status").groupBy("stratum")
    out = per.agg(F.count("*").alias("reviewed"), F.count_if(F.col("review_status") == "accepted").alias("accepted"))
    return out.withColumn("rate", F.round(100.0 * F.col("accepted") / F.col("reviewed"), 1))


def micro_average(folds: DataFrame, value: str, weight: str) -> DataFrame:
    return folds.agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias("micro"), F.round(F.avg(value), 6).alias("macro"), F.sum(weight).alias("n"))


def length_histogram(rows: DataFrame, length: Column, edges: tuple[int, ...] = (0, 5, 10, 20, 30, 50, 100, 200, 500)) -> DataFrame:
    """Rows in [edge, next edge) for fixed edges; the last bucket is open."""
    label = F.lit(None).cast("int")
    for e in edges:
        label = F.when(length >= e, e).otherwise(label)
    return rows.groupBy(label.alias("from_length")).agg(F.count("*").alias("n"))


def similarity_stats(sims: DataFrame, col: str = "sim") -> DataFrame:
    """Mean, population deviation, extremes and exact percentiles, rounded to three places.

    Percentiles are selected by ranges of values: no task holds all different values."""
    q = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    out = sims.agg(F.count("*").alias("n"), F.round(F.avg(col), 3).alias("mean"), F.round(F.stddev_pop(col), 3).alias("std"), F.round(F.min(col), 3).alias("min"), F.round(F.max(col), 3).alias("max"))
    found = quantiles(sims, col, list(q))
    return out.select("*", *[F.round(F.lit(v).cast("double"), 3).alias(f"p{int(x * 100)}") for x, v in zip(q, found, strict=True)])


def long_tail(rows: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """Counts of each key from the largest, their running share, and whether ``share`` is reached.

    Keys are counted first; ranges of the order are summed up each on its own.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    out = running(counts, [F.desc("n"), F.col(key)], {"running": F.col("n")}, rank="rank").crossJoin(F.broadcast(total))
    return out.select(key, "n", F.col("rank").cast("long").alias("rank"), F.round(F.col("running") / F.col("total"), 6).alias("share"), (F.col("running") >= share * F.col("total")).alias("reached"))


def top_links(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def hub_sections(links: DataFrame, exclude: str | None = None) -> DataFrame:
    """Distinct section names of each hub, sorted and joined; one framework may be left out."""
    used = links if exclude is None else links.where(F.col("framework_id") != exclude)
    return used.groupBy("hub_id").agg(F.array_join(F.array_sort(F.collect_set("section_name")), ", ").alias("sections"))


def affected_hubs(before: DataFrame, after: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Hubs whose sections changed and whose share of AI sections, of distinct ones, is over ``threshold``."""
    key = ["hub_id", "framework_id", "section_name"]
    pair = F.concat_ws("|", "framework_id", "section_name")
    a = before.groupBy("hub_id").agg(F.array_sort(F.collect_set(pair)).alias("old"))
    once = after.groupBy(*key).agg(F.max(F.col("is_ai").cast("int")).alias("ai"))
    b = once.groupBy("hub_id").agg(F.array_sort(F.collect_set(pair)).alias("new"), F.avg("ai").alias("ai_share"))
    both = b.join(a, "hub_id", "full_outer")
    return both.where((~F.col("old").eqNullSafe(F.col("new"))) & (F.col("ai_share") > threshold)).select("hub_id", F.round("ai_share", 6).alias("ai_share"))


def links_per_hub(links: DataFrame) -> DataFrame:
    """Least, largest, mean and median number of links of a hub."""
    n = links.groupBy("hub_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("hubs"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 3).alias("mean"), F.round(F.percentile("n", F.lit(0.5)), 3).alias("median"))


def hub_usability(links: DataFrame) -> DataFrame:
    """Hubs by whether all, some or none of their links are usable."""
    per = links.groupBy("hub_id").agg(F.bool_and("usable").alias("every"), F.bool_or("usable").alias("some"))
    return per.groupBy(F.when(F.col("every"), "all_good").when(F.col("some"), "mixed").otherwise("all_bad").alias("kind")).agg(F.count("*").alias("n"))


def multi_hub_texts(links: DataFrame) -> DataFrame:
    """Texts, those that map to several hubs, and the largest and mean number of hubs of a text."""
    per = links.groupBy(F.lower(F.trim("text")).alias("key")).agg(F.countDistinct("hub_id").alias("n"))
    return per.agg(F.count("*").alias("texts"), F.count_if(F.col("n") > 1).alias("several"), F.max("n").alias("most"), F.round(F.avg("n"), 3).alias("mean"))


def root_pivot(flows: DataFrame, roots: list[str]) -> DataFrame:
    """framework_id and a column of counts for each of the named roots (root_id, framework_id, n)."""
    return flows.groupBy("framework_id").agg(*[F.coalesce(F.sum(F.when(F.col("root_id") == r, F.col("n"))), F.lit(0)).alias(r) for r in roots])


def confusions(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent wrong answers (true_id, predicted_id, n)."""
    wrong = pairs.where("true_id <> predicted_id").groupBy("true_id", "predicted_id").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "true_id", "predicted_id").limit(k)


def dominance(rows: DataFrame, key: str, limit: float = 0.5) -> DataFrame:
    """The largest share that one key has of all rows, and whether it is over ``limit``."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    out = n.agg(F.max_by(key, F.struct("n", key)).alias(key), F.max("n").alias("n"), F.sum("n").alias("total"))
    return out.select(key, F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") > limit * F.col("total")).alias("warn"))


def round_status(reviews: DataFrame) -> DataFrame:
    """Counts of a review round, its acceptance rate (accepted or corrected of reviewed) and hubs."""
    good = F.col("status").isin("accepted", "corrected")
    seen = F.col("status") != "pending"
    out = reviews.agg(F.count("*").alias("total"), F.count_if(seen).alias("reviewed"), F.count_if(good).alias("good"), F.countDistinct(F.when(good, F.col("hub_id"))).alias("hubs"))
    return out.select("total", "reviewed", "good", F.round(F.col("good") / F.nullif("reviewed", F.lit(0)), 6).alias("rate"), "hubs")


def ingest_summary(predictions: DataFrame, duplicates: DataFrame, *, high: float = 0.5) -> DataFrame:
    """Counts and means of an ingest: predictions (item_id, confidence, max_sim, is_ood), one row
    an item, and duplicates (item_id, tier)."""
    tier = duplicates.groupBy("item_id").agg(F.bool_or(F.col("tier") == "duplicate").alias("dup"), F.bool_or(F.col("tier") == "similar").alias("near"))
    rows = predictions.join(tier, "item_id", "left")
    return rows.agg(
        F.count("*").alias("controls"), F.count_if("is_ood").alias("ood"), F.count_if("dup").alias("duplicates"), F.count_if("near").alias("similar"),
        F.count_if(F.col("confidence") >= high).alias("high"), F.count_if(F.col("confidence") < high).alias("low"),
        F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.round(F.avg("max_sim"), 3).alias("mean_max_sim"),
    )


def import_round(rounds: DataFrame) -> DataFrame:
    """The number of the next import."""
    return rounds.agg((F.coalesce(F.max("round"), F.lit(0)) + 1).alias("next_round"))


def review_document(assignments: DataFrame) -> DataFrame:
    """section, name, value: the numbers of a review in one long table."""
    real = assignments.where("id >= 0")
    m = review_metrics(assignments)
    parts = [m.select(F.lit("coverage").alias("section"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in m.columns]), F.array(*[F.col(c).cast("double") for c in m.columns]))).alias("name", "value"))]
    s = confidence_strata(real)
    parts.append(s.select(F.lit("confidence").alias("section"), F.col("stratum").alias("name"), F.col("rate").cast("double").alias("value")))
    q = assignments.where("id < 0").agg(F.count("*").cast("double").alias("value"))
    parts.append(q.select(F.lit("calibration").alias("section"), F.lit("items").alias("name"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
