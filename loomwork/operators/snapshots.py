"""Versioned exports: snapshots, differences, impact and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import change_scope


def ranked_mappings(exported: DataFrame) -> DataFrame:
    """Each control's hubs by confidence, ties by hub."""
    w = Window.partitionBy("framework_id", "control_id").orderBy(F.desc("confidence"), "hub_id")
    return exported.withColumn("rank", F.row_number().over(w))


def row_hash(*cols: str) -> Column:
    """A hash of values that tells null from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)


def content_hash(rows: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """A hash of each group's set of rows, whatever their order.

    Row hashes are added as numbers (two halves), so nothing is gathered or sorted.
    """
    h = rows.select(by, row_hash(*cols).alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", k, 8), 16, 10).cast("decimal(38,0)"))
    return h.groupBy(by).agg(F.sha2(F.concat_ws(",", *[part(k).cast("string") for k in (1, 9, 17, 25)], F.count("*").cast("string")), 256).alias("content_hash"), F.count("*").alias("n_rows"))


def build_snapshot(controls: DataFrame, exported: DataFrame) -> DataFrame:
    """A row a control of each framework with its title and ranked mappings; one that has no
    mapping keeps an empty array.  Rows, not one document, so a framework of any size fits."""
    m = F.array_sort(F.collect_list(F.struct("rank", "hub_id", "confidence")))
    per = ranked_mappings(exported).groupBy("framework_id", "control_id").agg(m.alias("mappings"))
    rows = controls.select("framework_id", F.col("id").alias("control_id"), "title").join(per, ["framework_id", "control_id"], "left")
    return rows.withColumn("mappings", F.coalesce("mappings", F.array().cast("array<struct<rank:int,hub_id:string,confidence:double>>")))


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """operation (add, delete, update), keys, and old and new values; equal rows give none.

    Values are compared with nulls as values.
    """
    old, new = F.struct(*values).alias("before"), F.struct(*values).alias("after")
    both = before.select(*keys, old).join(after.select(*keys, new), keys, "full_outer")
    op = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return both.select(op.alias("operation"), *keys, "before", "after").where("operation IS NOT NULL")


def change_summary(control_ops: DataFrame, mapping_ops: DataFrame) -> DataFrame:
    """Six counts and the scope of a change."""
    ops = control_ops.select(F.lit("control").alias("kind"), "operation").union(mapping_ops.select(F.lit("mapping").alias("kind"), "operation"))
    n = lambda k, o: F.count_if((F.col("kind") == k) & (F.col("operation") == o)).alias(f"{k}_{o}")
    out = ops.agg(*[n(k, o) for k in ("control", "mapping") for o in ("add", "delete", "update")], F.count("*").alias("n"))
    return out.withColumn("scope", change_scope(F.col("n"), F.col("control_delete") > 0, F.col("mapping_delete") > 0))


def impact(mapping_ops: DataFrame, assignments: DataFrame, controls: DataFrame) -> DataFrame:
    """For each changed hub, the controls and frameworks that map to it."""
    hubs = mapping_ops.select("hub_id").distinct()
    hit = assignments.join(hubs, "hub_id", "left_semi").join(controls.select(F.col("id").alias("control_id"), "framework_id"), "control_id")
    return hit.groupBy("hub_id").agg(F.countDistinct("control_id").alias("n_controls"), F.countDistinct("framework_id").alias("n_frameworks"))


def latest(history: DataFrame) -> DataFrame:
    """The last export of each framework."""
    cols = [c for c in history.columns if c != "framework_id"]
    return history.groupBy("framework_id").agg(F.max_by(F.struct(*cols), F.struct("export_date", "content_hash")).alias("r")).select("framework_id", "r.*")


def staleness(ours: DataFrame, upstream: DataFrame) -> DataFrame:
    """Ids that only one side has."""
    a = ours.join(upstream, "id", "left_anti").select(F.lit("only_ours").alias("side"), "id")
    return a.union(upstream.join(ours, "id", "left_anti").select(F.lit("only_upstream"), "id"))


def changeset(controls_before: DataFrame, controls_after: DataFrame, mappings_before: DataFrame, mappings_after: DataFrame) -> DataFrame:
    """operation, entity_kind, key and values (as JSON) of every change, controls (framework_id,
    control_id, title) and mappings (framework_id, control_id, hub_id, confidence)."""

    def ops(kind: str, a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        d = diff(a, b, keys, values)
        return d.select("framework_id", "operation", F.lit(kind).alias("entity_kind"), F.concat_ws("|", *keys[1:]).alias("key"), F.to_json("before").alias("before"), F.to_json("after").alias("after"))

    return ops("control", controls_before, controls_after, ["framework_id", "control_id"], ["title"]).unionByName(
        ops("mapping", mappings_before, mappings_after, ["framework_id", "control_id", "hub_id"], ["confidence"])
    )


def table_hash(rows: DataFrame, cols: list[str]) -> DataFrame:
    """One hash of a whole table's rows, whatever their order."""
    return content_hash(rows.withColumn("_all", F.lit("all")), "_all", cols).drop("_all")
