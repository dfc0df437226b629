"""The engine's verbs: what a user asks for, composed of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_present, sanitize
from ..operators import calibration, compare, filters, hierarchy, linking, proposals, quality, review, similarity, snapshots, summaries
from ..schemas import GROUND_TRUTH
from ..session import durable
from ..sources import writers
from ..sources.versions import VersionLog
from . import documents


@dataclass
class Crosswalk:
    """The tables of a crosswalk; every verb returns new DataFrames and changes none."""

    controls: DataFrame
    hubs: DataFrame
    assignments: DataFrame
    frameworks: DataFrame | None = None

    def compare(self, frameworks: list[str]) -> dict[str, DataFrame]:
        if len(frameworks) < 2:
            raise ValueError("two frameworks or more are compared")
        scope = compare.in_scope(self.assignments, self.controls, frameworks)
        return {
            "equivalences": compare.equivalences(scope, self.hubs), "related": compare.related_hubs(scope, self.hubs),
            "gaps": compare.gap_controls(scope, self.hubs), "overlap": compare.pair_overlap(scope),
        }

    def export(self, *, floor: float = 0.30, overrides: dict[str, float] | None = None, frameworks: list[str] | None = None, hubs: list[str] | None = None, least: float | None = None) -> DataFrame:
        rows = filters.exportable(self.assignments, self.controls, floor=floor, overrides=overrides, frameworks=frameworks)
        if hubs is not None:
            rows = rows.where(F.col("hub_id").isin(hubs))
        return rows if least is None else rows.where(F.col("confidence") >= least)

    def export_stats(self, **options) -> DataFrame:
        return summaries.filter_stats(self.assignments, self.controls, **options)

    def gaps(self, floor: float = 0.30) -> DataFrame:
        return filters.gap_reasons(self.assignments, self.controls, floor=floor)

    def snapshot(self, **options) -> DataFrame:
        return snapshots.build_snapshot(self.controls, self.export(**options))

    def review_export(self, threshold: float = 0.5) -> DataFrame:
        rows = review.review_scope(self.assignments).join(self.controls.select(F.col("id").alias("control_id"), "framework_id", "title", "description"), "control_id")
        level = filters.text_quality(F.col("description"))
        return rows.withColumn("text_quality", level).withColumn("priority", filters.review_priority(F.col("confidence"), level, F.col("is_ood"), threshold))

    def write_review(self, path: str, threshold: float = 0.5) -> None:
        """A folder for reviewers: the rows, the hub reference and a guide."""
        documents.write_review_bundle(self.review_export(threshold), self.hubs, path)

    def review_import(self, decisions: DataFrame) -> Crosswalk:
        """A new crosswalk; refuses decisions that break a rule."""
        bad = quality.review_issues(decisions, self.assignments, self.hubs).where("rule <> 'pending'")
        if not bad.isEmpty():
            raise ValueError(f"review has issues: {[r.asDict() for r in bad.limit(5).collect()]}")
        return Crosswalk(self.controls, self.hubs, review.apply_decisions(self.assignments, decisions), self.frameworks)

    def canonical(self, before: Crosswalk | None = None, **options) -> dict[str, DataFrame]:
        """A canonical export: the snapshot, and against a crosswalk of before the changes, their counts
        and the hubs they touch; without one all rows are additions."""
        rows = lambda cw: (cw.controls.select("framework_id", F.col("id").alias("control_id"), "title"), cw.export(**options).select("framework_id", "control_id", "hub_id", "confidence"))
        c, m = rows(self)
        c0, m0 = rows(before) if before else (c.where("false"), m.where("false"))
        controls = snapshots.diff(c0, c, ["framework_id", "control_id"], ["title"])
        mappings = snapshots.diff(m0, m, ["framework_id", "control_id", "hub_id"], ["confidence"])
        return {
            "snapshot": self.snapshot(**options), "changes": snapshots.changeset(c0, c, m0, m), "summary": snapshots.change_summary(controls, mappings),
            "impact": snapshots.impact(mappings, self.assignments, self.controls),
        }

    def import_truth(self, links: DataFrame) -> tuple[Crosswalk, DataFrame]:
        """Ground-truth links (link_id, framework_id, section_id, hub_id, link_type) resolved to controls
        and added where the table does not have them; and how many each strategy resolved."""
        found = linking.resolve_sections(links, self.controls).join(links.select("link_id", "hub_id", "link_type"), "link_id")
        known = found.where("control_id IS NOT NULL").join(self.hubs.select(F.col("id").alias("hub_id")), "hub_id", "left_semi")
        new = review.import_truth(self.assignments, known.select("control_id", "hub_id", "link_type"))
        table = self.assignments.unionByName(new, allowMissingColumns=True).select(self.assignments.columns)
        return Crosswalk(self.controls, self.hubs, table, self.frameworks), found.groupBy("strategy").agg(F.count("*").alias("n"))

    def accept(self, framework_id: str, reviews: DataFrame) -> Crosswalk:
        """A framework's assignments replaced by its reviewed ones (control_id, status,
        corrected_hub_id, top_hub_id, top_confidence)."""
        own = self.controls.where(F.col("framework_id") == framework_id).select(F.col("id").alias("control_id"))
        others = self.assignments.join(own, "control_id", "left_anti")
        new = review.accept_ingest(self.assignments.where("false"), own, reviews).join(own, "control_id", "left_semi")
        return Crosswalk(self.controls, self.hubs, others.unionByName(new, allowMissingColumns=True).select(self.assignments.columns), self.frameworks)

    def review_metrics(self) -> DataFrame:
        return summaries.review_document(self.assignments)

    def dataset(self) -> dict[str, DataFrame]:
        """The published rows (the best provenance of each control and hub, with its type) and each framework's numbers."""
        best = linking.best_provenance(self.assignments, [*GROUND_TRUTH, "active_round_2"])
        kind = filters.assignment_type(F.col("provenance"), F.col("source_link_id") if "source_link_id" in best.columns else F.lit(None).cast("string"), F.col("review_status"), F.col("original_hub_id"))
        rows = best.join(self.controls.select(F.col("id").alias("control_id"), "framework_id", "title"), "control_id").withColumn("assignment_type", kind)
        frameworks = self.frameworks if self.frameworks is not None else self.controls.select(F.col("framework_id").alias("id")).distinct()
        return {"crosswalk": rows, "frameworks": summaries.framework_metadata(frameworks, self.controls, self.assignments)}

    def publish_dataset(self, log: VersionLog, title: str, key: str, *, licence: str) -> int:
        """The data set, its frameworks and its card as one version of ``log``."""
        found = self.dataset()
        return documents.publish_dataset(log, found, documents.dataset_card(title, found, licence=licence), key)

    def inspect(self, hub_id: str) -> dict[str, DataFrame]:
        h = self.hubs
        return {
            "hub": h.where(F.col("id") == hub_id), "children": h.where(F.col("parent_id") == hub_id),
            "siblings": hierarchy.siblings_of(h, h.where(F.col("id") == hub_id)), "controls": self.assignments.where(F.col("hub_id") == hub_id),
        }


def prepare(rows: DataFrame, framework_id: str, *, description_chars: int = 2000) -> dict[str, DataFrame]:
    """Read rows (control_id, title, description, full_text, pos) cleaned and validated."""
    clean = rows.select(
        F.lit(framework_id).alias("framework_id"), "control_id", "pos", sanitize(F.col("title"), 500).alias("title"), sanitize(F.col("description")).alias("_d"), sanitize(F.col("full_text"), 50_000).alias("_f")
    )
    long = F.length("_d") > description_chars
    clean = clean.select("framework_id", "control_id", "pos", "title", F.when(long, F.substring("_d", 1, description_chars)).otherwise(F.col("_d")).alias("description"), F.coalesce("_f", F.when(long, F.col("_d"))).alias("full_text"))
    return {"controls": clean, "issues": quality.validate_controls(clean)}


def assign(items: DataFrame, hubs: DataFrame, *, temperature: float, quantile: float, ood_threshold: float, k: int = 5) -> DataFrame:
    """item_id, hub_id, rank, sim, confidence, in_conformal_set, is_ood: the k best hubs of each item.

    The softmax runs over all hubs, and only the k best of an item become rows.
    """
    top = similarity.scored_top(items, hubs, k, temperature)
    return top.select("item_id", "hub_id", "rank", "sim", F.col("p").alias("confidence"), (F.col("p") >= 1 - quantile).alias("in_conformal_set"), (F.col("max_sim") < ood_threshold).alias("is_ood"))


def ingest(rows: DataFrame, framework_id: str, known: DataFrame, hubs: DataFrame, embed: Callable[[DataFrame], DataFrame], *, temperature: float, quantile: float, ood_threshold: float,
           similar: float = 0.85, duplicate: float = 0.95, k: int = 5) -> dict[str, DataFrame]:
    """A new framework's read rows, cleaned, checked, assigned and compared with ``known`` vectors
    (item_id, embedding).  ``embed`` makes vectors (item_id, embedding) of texts (item_id, text).

    Rows that break a rule of severity "error" stop the ingest.
    """
    ready = prepare(rows, framework_id)
    bad = ready["issues"].where("severity = 'error'")
    if not bad.isEmpty():
        raise ValueError(f"{framework_id} has errors: {[(r.control_id, r.rule) for r in bad.limit(5).collect()]}")
    item = F.concat_ws(":", "framework_id", "control_id")
    texts = ready["controls"].select(item.alias("item_id"), join_present(F.col("title"), F.col("description"), F.col("full_text")).alias("text"))
    vectors = embed(texts)
    top = assign(vectors, hubs, temperature=temperature, quantile=quantile, ood_threshold=ood_threshold, k=k)
    both = vectors.select("item_id", "embedding", F.lit(True).alias("asked")).unionByName(known.select("item_id", "embedding", F.lit(False).alias("asked")))
    own = vectors.select("item_id")
    near = similarity.similar_to(both, similar, duplicate)
    near = near.select(F.explode(F.array(F.struct(F.col("id_a").alias("item_id"), F.col("id_b").alias("other_id")), F.struct(F.col("id_b").alias("item_id"), F.col("id_a").alias("other_id")))).alias("x"), "sim", "tier")
    near = near.select("x.item_id", "x.other_id", "sim", "tier").join(own, "item_id", "left_semi").join(own.select(F.col("item_id").alias("other_id")), "other_id", "left_anti")
    best = top.where("rank = 1").select("item_id", "confidence", F.col("sim").alias("max_sim"), "is_ood")
    return {**ready, "assignments": top, "duplicates": near, "summary": summaries.ingest_summary(best, near)}


def calibrate(items: DataFrame, hubs: DataFrame, valid: DataFrame, *, alpha: float = 0.1, grid: list[float] | None = None) -> dict[str, float]:
    """Temperature, conformal quantile and out-of-distribution threshold of labelled items (item_id, embedding) and
    hubs (hub_id, embedding), with valid pairs (item_id, hub_id); no row a pair is made."""
    t = calibration.fit_temperature_of(items, hubs, valid, grid or calibration.log_grid(0.01, 5.0, 200)).first().t
    sums = durable(calibration.grid_sums(items, hubs, valid, [t]), "sums")
    q = calibration.conformal_of(sums, alpha).first().quantile
    o = calibration.ood_threshold(sums.select("item_id", F.col("m").alias("max_sim"))).first().threshold
    return {"temperature": t, "quantile": q, "ood_threshold": o}


def bridges(links: DataFrame, hubs: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """Candidates and negatives between hubs of AI frameworks and of others, with names and links."""
    return proposals.bridge_rows(links, hubs, vectors, k)


def propose(items: DataFrame, hub_vectors: DataFrame, hubs: DataFrame, *, ood_threshold: float, round_number: int = 1, **options) -> DataFrame:
    """A round of named proposals of new hubs, those that passed every rule."""
    checked = proposals.propose_hubs(items, hub_vectors, ood_threshold=ood_threshold, **options)
    return proposals.named(writers.proposal_rows(checked, round_number), hubs)
