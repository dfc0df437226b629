"""Cross-framework questions: equivalences, siblings, overlaps and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import IN_SCOPE_STATUSES


def in_scope(assignments: DataFrame, controls: DataFrame, frameworks: list[str] | None = None, statuses: tuple[str, ...] = IN_SCOPE_STATUSES) -> DataFrame:
    """Assignments that count, with their framework; the status filter reaches the scan."""
    scope = controls.select(F.col("id").alias("control_id"), "framework_id", "title")
    if frameworks is not None:
        scope = scope.where(F.col("framework_id").isin(frameworks))
    return assignments.where(F.col("review_status").isin(*statuses)).join(scope, "control_id")


def equivalences(scope: DataFrame, hubs: DataFrame, least: int = 2) -> DataFrame:
    """Hubs that controls of ``least`` frameworks or more meet in.

    Only counts are gathered, which combine before the shuffle; ``members`` lists the controls
    of one hub where they are wanted.
    """
    per = scope.groupBy("hub_id").agg(
        F.array_sort(F.collect_set("framework_id")).alias("fws"), F.count("*").alias("n_rows"), F.countDistinct("control_id").alias("n_controls"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )
    per = per.where(F.size("fws") >= least)
    named = per.join(hubs.select(F.col("id").alias("hub_id"), F.col("name").alias("hub_name")), "hub_id", "left")
    return named.select("hub_id", F.coalesce("hub_name", "hub_id").alias("hub_name"), F.array_join("fws", ",").alias("frameworks"), F.size("fws").cast("long").alias("n_frameworks"), "n_rows", "n_controls", "avg_confidence")


def members(scope: DataFrame) -> DataFrame:
    """hub_id, framework_id, control_id of the controls in scope, once each."""
    return scope.select("hub_id", "framework_id", "control_id").distinct()


def pair_overlap(scope: DataFrame) -> DataFrame:
    """For each unordered pair of frameworks, the hubs that both reach."""
    one = scope.select("hub_id", "framework_id").distinct()
    pairs = one.alias("a").join(one.alias("b"), (F.col("a.hub_id") == F.col("b.hub_id")) & (F.col("a.framework_id") < F.col("b.framework_id")))
    return pairs.groupBy(F.col("a.framework_id").alias("fw_a"), F.col("b.framework_id").alias("fw_b")).agg(F.count("*").alias("n_hubs"))


def related_siblings(scope: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs of hubs with one parent whose frameworks differ or that share two or more."""
    per = scope.groupBy("hub_id").agg(F.array_sort(F.collect_set("framework_id")).alias("fws"))
    placed = per.join(hubs.where("parent_id IS NOT NULL").select(F.col("id").alias("hub_id"), "parent_id"), "hub_id")
    a, b = placed.alias("a"), placed.alias("b")
    pairs = a.join(b, (F.col("a.parent_id") == F.col("b.parent_id")) & (F.col("a.hub_id") < F.col("b.hub_id")))
    pairs = pairs.where((F.col("a.fws") != F.col("b.fws")) | (F.size("a.fws") >= 2))
    return pairs.select(F.col("a.parent_id").alias("parent_id"), F.col("a.hub_id").alias("hub_a"), F.col("b.hub_id").alias("hub_b"), F.array_join("a.fws", ",").alias("fws_a"), F.array_join("b.fws", ",").alias("fws_b"))


def related_hubs(scope: DataFrame, hubs: DataFrame) -> DataFrame:
    """hub_id, parent_id, frameworks, n_related: each hub with the number of its siblings that ``related_siblings`` pairs it with.

    The pairs themselves are all siblings but those of the same one framework, so a row a hub says as much."""
    per = scope.groupBy("hub_id").agg(F.array_sort(F.collect_set("framework_id")).alias("fws"))
    placed = per.join(hubs.where("parent_id IS NOT NULL").select(F.col("id").alias("hub_id"), "parent_id"), "hub_id")
    sets = placed.groupBy("parent_id", "fws").agg(F.count("*").alias("_same"))
    whole = sets.groupBy("parent_id").agg(F.sum("_same").alias("_all"))
    n = F.col("_all") - F.when(F.size("fws") == 1, F.col("_same")).otherwise(1)
    return placed.join(sets, ["parent_id", "fws"]).join(whole, "parent_id").select("hub_id", "parent_id", F.array_join("fws", ",").alias("frameworks"), n.cast("long").alias("n_related"))


def related_counts(scope: DataFrame, hubs: DataFrame) -> DataFrame:
    """parent_id, n_hubs, n_pairs: how many of ``related_siblings``'s pairs each parent has.

    Of all pairs under a parent, those of two hubs with the same one framework are no pairs, so
    counts by framework set are enough."""
    per = scope.groupBy("hub_id").agg(F.array_sort(F.collect_set("framework_id")).alias("fws"))
    placed = per.join(hubs.where("parent_id IS NOT NULL").select(F.col("id").alias("hub_id"), "parent_id"), "hub_id")
    sets = placed.groupBy("parent_id", "fws").agg(F.count("*").alias("m"))
    pairs = lambda n: n * (n - 1) / 2
    same = F.sum(F.when(F.size("fws") == 1, pairs(F.col("m"))).otherwise(0))
    out = sets.groupBy("parent_id").agg(F.sum("m").alias("n_hubs"), same.alias("_same"))
    return out.select("parent_id", "n_hubs", (pairs(F.col("n_hubs")) - F.col("_same")).cast("long").alias("n_pairs"))


def gap_controls(scope: DataFrame, hubs: DataFrame) -> DataFrame:
    """Controls in scope that share no hub, nor a sibling pair, with another framework.

    A hub of one framework is in a sibling pair if its parent has hubs of different framework
    sets; a hub of several is shared anyway.  So sets are counted and no pair is made.
    """
    per = scope.groupBy("hub_id").agg(F.array_sort(F.collect_set("framework_id")).alias("fws"))
    placed = per.join(hubs.where("parent_id IS NOT NULL").select(F.col("id").alias("hub_id"), "parent_id"), "hub_id")
    varied = placed.groupBy("parent_id").agg((F.min("fws") != F.max("fws")).alias("v")).where("v").select("parent_id")
    reached = per.where(F.size("fws") >= 2).select("hub_id").union(placed.join(varied, "parent_id", "left_semi").select("hub_id")).distinct()
    matched = scope.join(reached, "hub_id", "left_semi").select("control_id").distinct()
    return scope.select("framework_id", "control_id").distinct().join(matched, "control_id", "left_anti").select("framework_id", "control_id")
