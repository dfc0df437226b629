"""Exports: nested JSON, CSV, per-framework files, data sets and manifests."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import content_hash


def atomic_json(value, path: str) -> None:
    """A small document on the driver's own disk: sorted keys, and whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")
    os.replace(f.name, path)


def grouped(rows: DataFrame) -> DataFrame:
    """framework_id, control_id and the control's hubs (hub_id, confidence, provenance), sorted.

    A row a control: a framework's controls never meet in one row, whatever their number."""
    hubs = F.array_sort(F.collect_list(F.struct("hub_id", "confidence", "provenance")))
    return rows.groupBy("framework_id", "control_id").agg(hubs.alias("hubs"))


def write_json(rows: DataFrame, path: str) -> None:
    """Accepted assignments, a folder a framework, a JSON line a control with its hubs as objects."""
    out = grouped(rows.where("review_status = 'accepted'"))
    out.repartition("framework_id", "control_id").sortWithinPartitions("framework_id", "control_id").write.mode("overwrite").partitionBy("framework_id").json(path)


CSV_COLUMNS = ("framework_id", "control_id", "title", "hub_id", "hub_name", "confidence", "provenance", "review_status")


def csv_rows(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Assignments of every status with their hub's name, the columns of the CSV export."""
    named = rows.join(hubs.select(F.col("id").alias("hub_id"), F.col("name").alias("hub_name")), "hub_id", "left")
    return named.select(*CSV_COLUMNS)


def write_csv(rows: DataFrame, hubs: DataFrame, path: str) -> None:
    """The CSV export in the order of framework, control and hub."""
    csv_rows(rows, hubs).orderBy("framework_id", "control_id", "hub_id").write.mode("overwrite").option("header", True).csv(path)


def standard_csv(exported: DataFrame, hubs: DataFrame, standard: str, link: str | None = None) -> DataFrame:
    """The interchange table of one standard: a hub column and four columns named after it; ``link``
    is the standard's hyperlink with ``{section_id}``."""
    named = exported.join(hubs.select(F.col("id").alias("hub_id"), F.col("name").alias("hub_name")), "hub_id", "left")
    url = F.replace(F.lit(link), F.lit("{section_id}"), F.col("section_id")) if link else F.lit("")
    return named.select(
        F.concat_ws("|", "hub_id", F.coalesce("hub_name", "hub_id")).alias("CRE 0"), F.lit(standard).alias(f"{standard}|name"), F.col("section_id").alias(f"{standard}|id"),
        F.col("title").alias(f"{standard}|description"), url.alias(f"{standard}|hyperlink"),
    ).orderBy("CRE 0", f"{standard}|id")


def write_by_framework(rows: DataFrame, path: str) -> None:
    """In-scope assignments as JSON lines, a folder a framework."""
    rows.where(F.col("review_status").isin("accepted", "ground_truth")).repartition("framework_id").write.mode("overwrite").partitionBy("framework_id").json(path)


def write_dataset(rows: DataFrame, metadata: DataFrame, path: str) -> None:
    """The published data set: assignments and framework metadata as JSON lines."""
    rows.write.mode("overwrite").json(f"{path}/crosswalk")
    metadata.write.mode("overwrite").json(f"{path}/frameworks")


def manifest(stats: DataFrame, version: str, now: str) -> dict:
    """Totals of the filter's counters over frameworks."""
    names = [c for c in stats.columns if c.startswith("n_")]
    total = stats.agg(*[F.sum(c).alias(c) for c in names]).first()
    counts = {c: int(total[c] or 0) for c in names}
    return {"version": version, "created": now, "exported": counts.get("n_exported", 0), "excluded": sum(v for k, v in counts.items() if k != "n_exported"), "counts": counts}


def versioned(df: DataFrame, root: str, version: str) -> str:
    """A new version of a table in a folder of its own; readers switch by name."""
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def load_version(spark: SparkSession, path: str, by: str, cols: list[str], hashes: DataFrame) -> DataFrame:
    """A saved version of a table whose groups still have the recorded hashes; else an error."""
    rows = spark.read.parquet(path)
    now = content_hash(rows, by, cols).select(by, "content_hash")
    bad = now.join(hashes.select(by, F.col("content_hash").alias("_was")), by, "full_outer").where(~F.col("content_hash").eqNullSafe(F.col("_was")))
    if not bad.isEmpty():
        raise ValueError(f"{path}: contents are not those recorded for {[r[by] for r in bad.limit(5).collect()]}")
    return rows


def count_shortfalls(found: DataFrame, stats: DataFrame) -> DataFrame:
    """framework_id, expected, found where an export has fewer links than its manifest says."""
    n = found.groupBy("framework_id").agg(F.count("*").alias("found"))
    both = stats.select("framework_id", F.col("n_exported").alias("expected")).join(n, "framework_id", "left")
    return both.select("framework_id", "expected", F.coalesce("found", F.lit(0)).cast("long").alias("found")).where("found < expected")


def assign_lines(predictions: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, text (100 characters), hubs and top1_sim of each item, the least sure items first in
    the order of ``top1_sim`` (predictions: item_id, hub_id, rank, sim, p)."""
    hubs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "hub_id", "p"))), lambda x: x["hub_id"])
    per = predictions.groupBy("item_id").agg(F.max("sim").alias("top1_sim"), hubs.alias("hubs"))
    return per.join(texts.select("item_id", F.substring("text", 1, 100).alias("text")), "item_id", "left").select("item_id", "text", "hubs", "top1_sim").orderBy("top1_sim", "item_id")


def review_lines(predictions: DataFrame, threshold: float, quantile: float, k: int = 10) -> DataFrame:
    """A review item for each item: its ``k`` best hubs with confidence (four places) and membership of
    the conformal set, whether it is out of distribution, and whether it may be accepted unseen."""
    p = F.round("p", 4)
    member = F.col("p") >= 1 - quantile
    hubs = F.array_sort(F.collect_list(F.struct("rank", "hub_id", p.alias("confidence"), member.alias("in_conformal_set"))))
    per = predictions.where(F.col("rank") <= k).groupBy("item_id").agg(hubs.alias("predictions"), F.bool_or("is_ood").alias("is_ood"))
    first = F.get("predictions", 0)
    return per.withColumn("auto_accept", ~F.col("is_ood") & (first["confidence"] >= threshold) & first["in_conformal_set"])


def proposal_rows(checked: DataFrame, round_number: int) -> DataFrame:
    """The proposals of a round that passed every rule."""
    return checked.where("failed IS NULL").withColumn("round", F.lit(round_number)).drop("failed")


def write_vectors(vectors: DataFrame, params: dict[str, float], path: str) -> None:
    """Deployment artifacts: vectors in the order of their ids, and one row of calibration numbers."""
    vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).orderBy("id").write.mode("errorifexists").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([tuple(float(v) for v in params.values())], ", ".join(f"{k} double" for k in params)).write.mode("errorifexists").parquet(f"{path}/calibration")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/calibration").first().asDict()


def card(title: str, metrics: DataFrame, order: str) -> str:
    """A Markdown card: a table of all rows of a small metrics table (a row a framework or fold), in order."""
    names = metrics.columns
    head = f"# {title}\n\n| " + " | ".join(names) + " |\n|" + "---|" * len(names) + "\n"
    return head + "".join("| " + " | ".join("" if r[c] is None else str(r[c]) for c in names) + " |\n" for r in metrics.orderBy(order).toLocalIterator())


def weighted_average(metrics: DataFrame, names: list[str], weight: str = "n") -> DataFrame:
    """One row: averages of ``names`` weighted by ``weight``, each over the rows that have it, and the sum of weights."""
    mean = lambda c: F.round(F.sum(F.col(c) * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight))), 6).alias(c)
    return metrics.agg(*[mean(c) for c in names], F.sum(weight).cast("long").alias(weight))


def metrics_card(title: str, metrics: DataFrame, by: str, names: list[str], *, weight: str = "n", intro: str = "", sources: list[tuple[str, str]] = ()) -> str:
    """A card of measures: an introduction, a row of each ``by`` in order, their weighted average, and the sources' names and licences."""
    rows = metrics.select(F.col(by).cast("string").alias(by), *names, weight)
    text = card(title, rows, by).replace("\n\n|", f"\n\n{intro}\n\n|" if intro else "\n\n|", 1)
    total = weighted_average(metrics, names, weight).first()
    text += "| **all** | " + " | ".join("" if total[c] is None else str(total[c]) for c in [*names, weight]) + " |\n"
    return text + ("\n## Sources\n\n" + "".join(f"* {name}: {licence}\n" for name, licence in sources) if sources else "")
