"""Entity resolution and deduplication with declared precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_key

STRATEGIES = ("direct", "prefixed", "title_exact", "title_lower", "normalized")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a declared order (ranked in each task before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_provenance(assignments: DataFrame, priority: list[str]) -> DataFrame:
    """One row for each control and hub: the provenance named first in ``priority``."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("provenance")), F.lit(0))
    rank = F.when(rank == 0, 99).otherwise(rank)
    return first_per(assignments, ["control_id", "hub_id"], [rank, F.col("id"), F.col("confidence").desc_nulls_last()])


def longest_description(rows: DataFrame) -> DataFrame:
    """One row an id: the longest description, the earliest of equals (``pos``)."""
    return first_per(rows, ["control_id"], [F.length("description").desc_nulls_last(), F.col("pos")])


def resolve_sections(links: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls for (framework_id, section_id, title) links by five strategies, the first that hits.

    All lookups are one keyed table with a rank, so a link is joined once for each of its keys
    and not once for each strategy.  Of controls with one key the largest id wins.
    Both sides are shuffled: Spark's estimate leaves out that a row is spread over its keys, so it would
    gather millions of them in the driver to send them out.
    """
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"))
    keyed = controls.select(
        "framework_id", F.col("id").alias("control_id"),
        F.explode(F.array(
            key(1, F.col("section_id")), key(3, F.col("title")), key(4, F.lower("title")), key(5, bare_key(F.coalesce("section_id", "title")))
        )).alias("e"),
    ).where("e.k IS NOT NULL AND e.k <> ''")
    lookup = keyed.groupBy("framework_id", F.col("e.kind").alias("kind"), F.col("e.k").alias("k")).agg(F.max("control_id").alias("control_id"))
    s = F.col("section_id")
    asked = links.select(
        "link_id", "framework_id",
        F.explode(F.array(
            F.struct(F.lit(1).alias("rank"), F.lit(1).alias("kind"), s.alias("k")),
            F.struct(F.lit(2).alias("rank"), F.lit(1).alias("kind"), F.concat_ws(":", "framework_id", s).alias("k")),
            F.struct(F.lit(3).alias("rank"), F.lit(3).alias("kind"), s.alias("k")),
            F.struct(F.lit(4).alias("rank"), F.lit(4).alias("kind"), F.lower(s).alias("k")),
            F.struct(F.lit(5).alias("rank"), F.lit(5).alias("kind"), bare_key(s).alias("k")),
        )).alias("e"),
    ).select("link_id", "framework_id", "e.*")
    hits = asked.hint("merge").join(lookup, ["framework_id", "kind", "k"]).groupBy("link_id").agg(F.min(F.struct("rank", "control_id")).alias("h"))
    strategy = F.lit("unresolved")
    for rank, name in enumerate(STRATEGIES, 1):
        strategy = F.when(F.col("h.rank") == rank, name).otherwise(strategy)
    out = links.select("link_id", "framework_id", "section_id").join(hits.hint("merge"), "link_id", "left")
    return out.select("link_id", "framework_id", "section_id", F.col("h.control_id").alias("control_id"), strategy.alias("strategy"))


def training_pairs(links: DataFrame, tiers: list[str]) -> DataFrame:
    """One pair for each text (trimmed, case apart) and hub: the best tier, then the first id."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier")), F.lit(0)), F.lit(99))
    usable = links.withColumn("text_key", F.lower(F.trim("text"))).where(F.length("text_key") >= 3)
    return first_per(usable, ["text_key", "hub_id"], [rank, F.col("id")])


def evaluation_items(links: DataFrame) -> DataFrame:
    """One item for each framework and text: its first hub, and all its hubs, sorted."""
    keyed = links.withColumn("text_key", F.lower(F.trim("text")))
    return keyed.groupBy("framework_id", "text_key").agg(F.min_by("hub_id", "id").alias("hub_id"), F.array_sort(F.collect_set("hub_id")).alias("valid_hubs"))


def apply_corrections(links: DataFrame, corrections: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Excluded links go; then corrected hubs replace old ones, which stay as ``original_hub_id``."""
    key = ["framework_id", "section_name", "hub_id"]
    left = links.join(exclusions.select(*key), key, "left_anti")
    new = left.join(corrections.select(*key, "new_hub_id"), key, "left")
    return new.select(
        *[c for c in links.columns if c != "hub_id"], F.coalesce("new_hub_id", "hub_id").alias("hub_id"), F.when(F.col("new_hub_id").isNotNull(), F.col("hub_id")).alias("original_hub_id")
    )


def training_rows(pairs: DataFrame, negatives: DataFrame, n: int, temperature: float) -> DataFrame:
    """Pairs with their hub's first ``n`` negatives (empty where there are fewer) and a sampling
    weight: the rarer AI rows weigh more, by the ratio of both kinds to the power 1 / temperature."""
    wide = negatives.groupBy(F.col("id").alias("hub_id")).agg(*[F.max(F.when(F.col("rank") == k, F.col("negative_id"))).alias(f"negative_{k}") for k in range(1, n + 1)])
    ai = F.col("tier") == "T1-AI"
    total = pairs.agg(F.count_if(ai).alias("_ai"), F.count_if(~ai).alias("_other"))  # one row
    rows = pairs.join(wide, "hub_id", "left").crossJoin(F.broadcast(total))
    weight = F.when(ai, F.pow(F.col("_other") / F.col("_ai"), F.lit(1 / temperature))).otherwise(1.0)
    return rows.select(*pairs.columns, *[F.coalesce(f"negative_{k}", F.lit("")).alias(f"negative_{k}") for k in range(1, n + 1)], weight.alias("weight"))
