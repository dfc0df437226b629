"""Canonical exports of frameworks as versions of a log: snapshot, change set, vectors and history at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, json_string, ordered_digest, row_json
from ..operators import snapshots
from ..operators.filters import change_scope
from ..session import durable
from ..sources.versions import VersionLog

CONTROL = ["control_id", "framework_id", "section_id", "title", "description", "hyperlink"]
MAPPING = ["control_id", "hub_id", "hub_name", "confidence", "rank", "link_type", "provenance", "model_version"]


def ranked(mappings: DataFrame) -> DataFrame:
    """Each control's mappings numbered by confidence, ties by hub."""
    return snapshots.ranked_mappings(mappings)


def snapshot_digests(controls: DataFrame, mappings: DataFrame, header: DataFrame, *, control_columns: list[str] = CONTROL, mapping_columns: list[str] = MAPPING) -> DataFrame:
    """framework_id, content_hash, n_controls, n_mappings: the SHA-256 of each framework's snapshot as canonical JSON.

    The object has a key for each column of ``header`` (a row a framework; volatile values are simply not among them), and the
    lists ``controls`` (by control_id) and ``mappings`` (by control_id and rank), in the order of key names. A mapping's row names its
    framework in ``framework_id``, which is no key of it unless ``mapping_columns`` says so.
    """
    names = sorted([*header.columns, "controls", "mappings"])
    at = {n: i for i, n in enumerate(names)}
    key = lambda n: F.concat(F.lit("," if at[n] else ""), json_string(F.lit(n)), F.lit(":"))
    none = F.lit(None)
    piece = lambda n, a, b, text: [F.col("framework_id").alias("g"), F.lit(at[n]).alias("s"), a.cast("string").alias("a"), b.cast("long").alias("b"), text.alias("text")]
    parts = [header.select(*piece(n, none, none, F.concat(key(n), canonical_json(F.col(n), header.schema[n].dataType)))) for n in header.columns]
    counted = {}
    for n, rows, cols, order in (("controls", controls, control_columns, F.lit(0)), ("mappings", mappings, mapping_columns, F.col("rank"))):
        rows = rows.join(header.select("framework_id"), "framework_id", "left_semi")
        # The list opens in a row that sorts first; every element but the first has its comma from the running place.
        parts.append(header.select(*piece(n, none, none, F.concat(key(n), F.lit("[")))))
        parts.append(rows.select(*piece(n, F.col("control_id"), order, row_json(rows, cols))))
        counted[n] = rows.groupBy("framework_id").agg(F.count("*").alias(f"n_{n}"))
        parts.append(header.select(F.col("framework_id").alias("g"), F.lit(at[n]).alias("s"), F.lit("\U0010ffff").alias("a"), F.lit(1 << 60).alias("b"), F.lit("]").alias("text")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    # An element is led by a comma unless its list has just opened.
    first = every.where(F.col("a").isNotNull() & (F.col("text") != "]")).groupBy("g", "s").agg(F.min(F.struct("a", "b")).alias("_first"))
    led = every.join(first, ["g", "s"], "left")
    comma = F.col("a").isNotNull() & (F.col("text") != "]") & ~((F.col("a") == F.col("_first.a")) & F.col("b").eqNullSafe(F.col("_first.b")))
    led = led.select("g", "s", "a", "b", F.concat(F.when(comma, ",").otherwise(""), "text").alias("text"))
    found = ordered_digest(led, "g", ["s", "a", "b"], "text", before="{", after="}").select(F.col("g").alias("framework_id"), F.col("digest").alias("content_hash"))
    out = found
    for n in ("controls", "mappings"):
        out = out.join(counted[n], "framework_id", "left").withColumn(f"n_{n}", F.coalesce(f"n_{n}", F.lit(0)).cast("long"))
    return out


def publish(
    log: VersionLog, controls: DataFrame, mappings: DataFrame, header: DataFrame, now: str, *, vectors: DataFrame | None = None, dry_run: bool = False, control_columns: list[str] = CONTROL, mapping_columns: list[str] = MAPPING,
) -> DataFrame:
    """Exports the frameworks of ``header``: framework_id, content_hash, n_controls, n_mappings, changed, scope of each.

    A framework without controls and mappings is skipped. What differs from the last version's snapshot makes the change set;
    snapshot, change set, history and, if given, vectors (id, embedding) of exported controls become one version, or none of them.
    Nothing is written by a dry run, nor when no framework changed. Frameworks of earlier versions that are not exported now stay.
    """
    spark = controls.sparkSession
    digests = durable(snapshot_digests(controls, mappings, header, control_columns=control_columns, mapping_columns=mapping_columns).where("n_controls > 0 OR n_mappings > 0"), "digests")
    own = digests.select("framework_id")
    controls, mappings = controls.select("framework_id", *[c for c in control_columns if c != "framework_id"]).join(own, "framework_id", "left_semi"), mappings.select("framework_id", *[c for c in mapping_columns if c != "framework_id"]).join(own, "framework_id", "left_semi")
    before = {n: log.read(n) for n in ("controls", "mappings", "history")}
    was_controls = before["controls"].join(own, "framework_id", "left_semi") if before["controls"] is not None else controls.limit(0)
    was_mappings = before["mappings"].join(own, "framework_id", "left_semi") if before["mappings"] is not None else mappings.limit(0)
    values = lambda cols, keys: [c for c in cols if c not in keys]
    c_ops = snapshots.diff(was_controls, controls, ["framework_id", "control_id"], values(control_columns, ["framework_id", "control_id"]))
    m_ops = snapshots.diff(was_mappings, mappings, ["framework_id", "control_id", "hub_id"], values(mapping_columns, ["framework_id", "control_id", "hub_id"]))
    line = lambda kind, ops, keys: ops.select("framework_id", "operation", F.lit(kind).alias("entity_kind"), F.concat_ws("|", *keys).alias("key"), F.to_json("before", {"ignoreNullFields": "false"}).alias("before"), F.to_json("after", {"ignoreNullFields": "false"}).alias("after"))
    changes = durable(line("control", c_ops, ["control_id"]).unionByName(line("mapping", m_ops, ["control_id", "hub_id"])), "changes")
    n = lambda k, o: F.count_if((F.col("entity_kind") == k) & (F.col("operation") == o))
    summary = changes.groupBy("framework_id").agg(F.count("*").alias("n_changes"), n("control", "delete").alias("_c"), n("mapping", "delete").alias("_m"))
    out = digests.join(summary, "framework_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_changes", "_c", "_m")})
    out = out.withColumn("scope", change_scope(F.col("n_changes"), F.col("_c") > 0, F.col("_m") > 0)).drop("_c", "_m")
    last = snapshots.latest(before["history"]).select("framework_id", F.col("content_hash").alias("_was")) if before["history"] is not None else spark.createDataFrame([], "framework_id string, _was string")
    out = durable(out.join(last, "framework_id", "left").withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("_was"))).drop("_was"), "published")
    fresh = out.where("changed")
    if dry_run or fresh.isEmpty():
        return out
    entries = fresh.select("framework_id", "content_hash", F.lit(now).alias("export_date"), "n_controls", "n_mappings", "scope")
    others = lambda old, new: new if old is None else old.join(own, "framework_id", "left_anti").unionByName(new)
    tables = {
        "controls": others(before["controls"], controls), "mappings": others(before["mappings"], mappings), "changes": changes,
        "history": entries if before["history"] is None else before["history"].unionByName(entries),
    }
    if vectors is not None:
        tables["vectors"] = vectors.join(controls.select(F.col("control_id").alias("id")).distinct(), "id", "left_semi")
    # The same change has the same key: one that is repeated after a lost answer adds nothing.
    token = ordered_digest(entries.select(F.lit("all").alias("g"), "framework_id", "content_hash"), "g", ["framework_id"], "content_hash", before=f"{now}:").first()["digest"]
    log.commit(tables, key=token, note={"exported": now, "frameworks": entries.count()})
    return out


def rebuild(log: VersionLog, tables: dict[str, DataFrame], key: str) -> int:
    """All tables anew in one version, and no others: readers see the old ones until it is complete."""
    return log.commit(tables, key=key, note={"rebuilt": True}, replace=True)


def file_digests(spark, path: str) -> DataFrame:
    """path, length and SHA-256 of each file under ``path`` that is not empty (files of up to 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
