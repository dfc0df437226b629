"""The review cycle: scope, decisions, imports and calibration items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GROUND_TRUTH


def review_scope(assignments: DataFrame) -> DataFrame:
    """Model assignments whose control and hub no ground-truth row already joins."""
    truth = assignments.where(F.col("provenance").isin(*GROUND_TRUTH)).select("control_id", "hub_id").distinct()
    return assignments.where(~F.col("provenance").isin(*GROUND_TRUTH)).join(truth, ["control_id", "hub_id"], "left_anti")


def apply_decisions(assignments: DataFrame, decisions: DataFrame) -> DataFrame:
    """A new version of the table after a review (id, status, reviewer_hub_id, notes).

    A reassignment keeps the old hub, takes the reviewer's and loses its confidence; pending
    decisions and calibration rows (negative ids) change nothing.
    """
    d = decisions.where("status <> 'pending' AND id >= 0").select("id", F.col("status").alias("_s"), F.col("reviewer_hub_id").alias("_h"), F.col("notes").alias("_n"))
    moved = (F.col("_s") == "reassigned") & F.col("_h").isNotNull()
    note = F.when(moved, F.concat_ws(" ", F.concat(F.lit("[Reassigned from hub "), F.col("hub_id"), F.lit("]")), F.nullif("_n", F.lit("")))).otherwise(F.nullif("_n", F.lit("")))
    new = {
        "review_status": F.when(moved, "accepted").otherwise(F.coalesce("_s", "review_status")), "reviewer_notes": F.coalesce(note, "reviewer_notes"),
        "original_hub_id": F.when(moved, F.col("hub_id")).otherwise(F.col("original_hub_id")), "confidence": F.when(moved, F.lit(None)).otherwise(F.col("confidence")),
        "hub_id": F.when(moved, F.col("_h")).otherwise(F.col("hub_id")),
    }
    joined = assignments.join(d, "id", "left")
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in assignments.columns])


def update_status(assignments: DataFrame, updates: DataFrame) -> DataFrame:
    """New statuses by id; a correction also adds a row for its hub, without confidence."""
    u = updates.select("id", F.col("status").alias("_s"), F.col("corrected_hub_id").alias("_h"))
    joined = assignments.join(u, "id", "left")
    kept = joined.select(*[F.coalesce("_s", "review_status").alias(c) if c == "review_status" else F.col(c) for c in assignments.columns])
    fresh = {"hub_id": F.col("_h"), "confidence": F.lit(None).cast("double"), "provenance": F.concat(F.col("provenance"), F.lit("_corrected")), "review_status": F.lit("accepted")}
    extra = joined.where(F.col("_h").isNotNull()).select(*[fresh.get(c, F.col(c)).alias(c) for c in assignments.columns])
    return kept.unionByName(extra)


def import_truth(assignments: DataFrame, links: DataFrame) -> DataFrame:
    """Ground-truth links (control_id, hub_id, link_type) that the table does not have yet, once each."""
    new = links.groupBy("control_id", "hub_id").agg(F.min("link_type").alias("source_link_id"))
    new = new.join(assignments.select("control_id", "hub_id"), ["control_id", "hub_id"], "left_anti")
    return new.select("control_id", "hub_id", F.lit(1.0).alias("confidence"), F.lit("ground_truth").alias("provenance"), F.lit("ground_truth").alias("review_status"), "source_link_id")


def accept_ingest(assignments: DataFrame, framework_controls: DataFrame, reviews: DataFrame) -> DataFrame:
    """Replaces one framework's assignments by its accepted or corrected review items."""
    kept = assignments.join(framework_controls.select("control_id"), "control_id", "left_anti").select("control_id", "hub_id", "confidence", "review_status")
    ok = reviews.where(F.col("status").isin("accepted", "corrected"))
    corrected = F.col("status") == "corrected"
    new = ok.select("control_id", F.when(corrected, F.col("corrected_hub_id")).otherwise(F.col("top_hub_id")).alias("hub_id"), F.when(~corrected, F.col("top_confidence")).alias("confidence"), F.col("status").alias("review_status"))
    return kept.unionByName(new.where("hub_id IS NOT NULL"))


def calibration_items(rows: DataFrame, easy: int, hard: int, middle: int, seed: int) -> DataFrame:
    """The surest and least sure rows and a hashed pick between, with ids -1 to -n in that order."""
    key = [F.col("control_id"), F.col("hub_id")]
    top = rows.orderBy(F.desc("confidence"), *key).limit(easy).withColumn("kind", F.lit(1))
    low = rows.orderBy("confidence", *key).limit(hard).withColumn("kind", F.lit(2))
    ends = top.select("control_id", "hub_id").union(low.select("control_id", "hub_id"))
    rest = rows.join(ends, ["control_id", "hub_id"], "left_anti").withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *key)))
    mid = rest.orderBy("_h", *key).limit(middle).drop("_h").withColumn("kind", F.lit(3))
    every = top.unionByName(low).unionByName(mid)
    w = Window.orderBy("kind", F.desc("confidence"), *key)
    return every.withColumn("id", -F.row_number().over(w))


def canary_accuracy(reviews: DataFrame, valid: DataFrame) -> DataFrame:
    """Share of reviewed, not rejected items whose hub is one of the known ones."""
    seen = reviews.where(~F.col("status").isin("pending", "rejected"))
    ok = valid.select("item_id", "hub_id").distinct().withColumn("ok", F.lit(1))
    return seen.join(ok, ["item_id", "hub_id"], "left").agg(F.round(F.avg(F.coalesce("ok", F.lit(0))), 6).alias("accuracy"), F.count("*").alias("n"))


def uncovered_inserts(assignments: DataFrame, predictions: DataFrame, controls: DataFrame, frameworks: list[str]) -> DataFrame:
    """The best prediction of each control of the named frameworks, pending, for pairs of control
    and hub that the table does not have."""
    own = controls.where(F.col("framework_id").isin(frameworks)).select(F.col("id").alias("control_id"))
    top = predictions.where("rank = 1").join(own, "control_id", "left_semi")
    new = top.join(assignments.select("control_id", "hub_id"), ["control_id", "hub_id"], "left_anti")
    return new.select("control_id", "hub_id", "confidence", "is_ood", F.lit("model_prediction").alias("provenance"), F.lit("pending").alias("review_status"))


def round_assignments(items: DataFrame) -> DataFrame:
    """Assignments of a reviewed round (control_id, status, hub_id, predictions: array of hub_id and
    confidence): a chosen hub has its predicted confidence, if it was predicted."""
    ok = items.where(F.col("status").isin("accepted", "corrected") & F.col("hub_id").isNotNull())
    mine = F.get(F.filter("predictions", lambda p: p["hub_id"] == F.col("hub_id")), 0)["confidence"]
    return ok.select("control_id", "hub_id", mine.alias("confidence"), F.lit("active_round").alias("provenance"), F.lit("accepted").alias("review_status"), F.substring_index("control_id", ":", -1).alias("section_id"))


def appended(assignments: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that a table does not have yet, by control and hub, once each, added to it; other
    columns of theirs are null."""
    once = new.dropDuplicates(["control_id", "hub_id"]).join(assignments.select("control_id", "hub_id"), ["control_id", "hub_id"], "left_anti")
    return assignments.unionByName(once, allowMissingColumns=True).select(assignments.columns)
