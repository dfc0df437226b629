"""Row filters and derived classes over assignments, links and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXPORTABLE_STATUS, GROUND_TRUTH


def floor_of(framework: Column, floor: float, overrides: dict[str, float]) -> Column:
    if not overrides:
        return F.lit(floor)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])[framework], F.lit(floor))


def exportable(assignments: DataFrame, controls: DataFrame, *, floor: float = 0.30, overrides: dict[str, float] | None = None, frameworks: list[str] | None = None) -> DataFrame:
    """Accepted, calibrated, in-distribution assignments at or over their framework's floor.

    A null ``is_ood`` is not "false": such rows are left out, as are null confidences.
    """
    rows = assignments.where((F.col("review_status") == EXPORTABLE_STATUS) & (F.col("provenance") != "ground_truth_ai") & F.col("confidence").isNotNull() & (~F.col("is_ood")))
    scope = controls.select(F.col("id").alias("control_id"), "framework_id", "section_id", "title")
    if frameworks is not None:
        scope = scope.where(F.col("framework_id").isin(frameworks))
    return rows.join(scope, "control_id").where(F.col("confidence") >= floor_of(F.col("framework_id"), floor, overrides or {}))


def assignment_type(provenance: Column, link: Column, status: Column, original_hub: Column) -> Column:
    """How an assignment came to be: linked, automatic, rejected, reassigned or accepted."""
    truth = provenance.isin(*GROUND_TRUTH)
    return (
        F.when(truth & (link == "AutomaticallyLinkedTo"), "ground_truth_auto").when(truth, "ground_truth_linked").when(status == "rejected", "model_rejected")
        .when((status == "accepted") & original_hub.isNotNull(), "expert_reassigned").otherwise("model_accepted")
    )


def text_quality(text: Column, high: int = 500, medium: int = 100) -> Column:
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n >= high, "high").when(n >= medium, "medium").otherwise("low")


def review_priority(confidence: Column, quality: Column, is_ood: Column, threshold: float = 0.5) -> Column:
    weak = F.coalesce(confidence, F.lit(0.0)) <= threshold
    return F.when(weak & (quality == "low"), "critical").when(weak | F.coalesce(is_ood, F.lit(False)), "careful").otherwise("routine")


def gap_reasons(assignments: DataFrame, controls: DataFrame, *, floor: float = 0.30) -> DataFrame:
    """Why each control has nothing exported: its least bad assignment decides.

    Below the floor, then not accepted, then without confidence, then out of distribution,
    then ground truth alone; a control without assignments is unassigned.
    """
    bucket = (
        F.when(F.col("provenance") == "ground_truth_ai", "ground_truth").when(F.col("review_status") != EXPORTABLE_STATUS, "not_accepted")
        .when(F.col("confidence").isNull(), "null_confidence").when(F.coalesce("is_ood", F.lit(True)), "ood").when(F.col("confidence") < floor, "below_floor").otherwise("exported")
    )
    rows = assignments.select("control_id", "confidence", "review_status", bucket.alias("bucket"))
    has = lambda b: F.bool_or(F.col("bucket") == b).alias(b)
    per = rows.groupBy("control_id").agg(
        *[has(b) for b in ("exported", "below_floor", "not_accepted", "null_confidence", "ood", "ground_truth")],
        F.max(F.when(F.col("bucket") == "below_floor", F.col("confidence"))).alias("best"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("bucket") == "not_accepted", F.col("review_status")))), ",").alias("statuses"),
    )
    out = controls.select(F.col("id").alias("control_id"), "framework_id").join(per, "control_id", "left").where(~F.coalesce("exported", F.lit(False)))
    reason = F.lit("unassigned")
    for b in ("ground_truth", "ood", "null_confidence", "not_accepted", "below_floor"):
        reason = F.when(F.coalesce(b, F.lit(False)), b).otherwise(reason)
    detail = F.when(reason == "below_floor", F.format_string("%.2f", "best")).when(reason == "not_accepted", F.col("statuses"))
    return out.select("control_id", "framework_id", reason.alias("reason"), detail.alias("detail"))


def quality_tier(framework_dropped: Column, section: Column, is_ai: Column, link: Column) -> Column:
    return (
        F.when(framework_dropped | (F.length(F.coalesce(section, F.lit(""))) < 10), "DROPPED").when(is_ai, "T1-AI").when(link == "AutomaticallyLinkedTo", "T3").otherwise("T1")
    )


# Shapes of section names that are identifiers alone.
BARE_IDS = (r"^[A-Z]{1,5}-?\d+(\.\d+)*$", r"^\d+(\.\d+)*$", r"^V\d+(\.\d+)+$", r"^CWE-\d+$", r"^[A-Z]{2}-\d+\(\d+\)$")


def section_class(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    bare = F.length(n) <= 3
    for p in BARE_IDS:
        bare = bare | n.rlike(p)
    return F.when(n == "", "empty").when(bare, "bare_id").when(F.length(n) <= 10, "short").when(n.rlike(r"^[A-Za-z]*[-.]?\d+[.\d]*[:\s]+\S"), "id_plus_description").otherwise("descriptive")


def trust_tier(rate: Column) -> Column:
    return F.when(rate >= 85, "High").when(rate >= 50, "Medium").otherwise("Lower")


def change_scope(n: Column, deletes_control: Column, deletes_mapping: Column) -> Column:
    return F.when((n > 50) | deletes_control, "major").when((n >= 10) | deletes_mapping, "moderate").otherwise("minor")
