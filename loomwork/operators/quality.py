"""Validation rules for framework documents, secrets in texts, leakage of evaluation text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SECRET_PATTERNS, ascii_letter_ratio, nfc
from ..session import durable


def control_rules(limits: dict[str, int] | None = None) -> list[tuple[str, str, Column]]:
    """(severity, rule, condition) over control_id, title, description, full_text and ``n_same``,
    the place of a control among those with its id."""
    lim = {"empty": 10, "short": 50, "long": 2000} | (limits or {})
    d, title = F.coalesce("description", F.lit("")), F.coalesce("title", F.lit(""))
    n = F.length(F.trim(d))
    return [
        ("error", "duplicate_control_id", F.col("n_same") > 1),
        ("error", "null_bytes", F.contains(F.concat_ws("", title, d, "full_text"), F.lit("\x00"))),
        ("error", "empty_description", n < lim["empty"]),
        ("warning", "short_description", (n >= lim["empty"]) & (n < lim["short"])),
        ("warning", "long_description_no_full_text", (F.length(d) > lim["long"]) & F.col("full_text").isNull()),
        ("warning", "problematic_control_id_chars", F.col("control_id").rlike(r"[:\s]")),
        ("warning", "reference_only_description", (F.length(d) < 100) & d.rlike(r"(?i)^\s*(see|refer to|cf\.?)\s+\S+")),
        ("warning", "title_description_redundancy", (title != "") & (F.lower(F.trim(title)) == F.lower(F.trim(d)))),
        ("warning", "non_english_text", F.coalesce(ascii_letter_ratio(d) < 0.7, F.lit(False))),
    ]


def validate_controls(controls: DataFrame, *, unicode_rule: bool = True, limits: dict[str, int] | None = None) -> DataFrame:
    """framework_id, control_id, pos, severity, rule: a row for each broken rule of a control.

    All rules are one array of conditions, so each document is read once.
    """
    w = Window.partitionBy("framework_id", "control_id").orderBy("pos")
    rows = controls.withColumn("n_same", F.row_number().over(w))
    rules = control_rules(limits)
    if unicode_rule:
        text = F.concat_ws(" ", "title", "description", "full_text")
        rules.append(("warning", "non_nfc_unicode", nfc(text) != text))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in rules]))
    return rows.select("framework_id", "control_id", "pos", F.explode(found).alias("i")).select("framework_id", "control_id", "pos", "i.severity", "i.rule")


def validate_frameworks(frameworks: DataFrame, controls: DataFrame, expected: DataFrame | None = None, low: int = 10, high: int = 2000) -> DataFrame:
    """framework_id, severity, rule for whole frameworks; ``expected``: framework_id, n."""
    n = controls.groupBy("framework_id").agg(F.count("*").alias("n"))
    rows = frameworks.join(n, "framework_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.join(expected.withColumnRenamed("n", "want"), "framework_id", "left") if expected is not None else rows.withColumn("want", F.lit(None).cast("long"))
    some = F.col("n") > 0
    rules = [
        ("error", "zero_controls", ~some), ("error", "invalid_framework_id", some & ~F.col("framework_id").rlike("^[a-z][a-z0-9_]{1,49}$")),
        ("warning", "low_control_count", some & (F.col("n") < low)), ("warning", "high_control_count", F.col("n") > high),
        ("warning", "expected_count_mismatch", some & (F.abs(F.col("n") - F.col("want")) > 0.5 * F.col("want"))),
        ("warning", "missing_version", some & (F.coalesce("version", F.lit("")) == "")), ("warning", "missing_source_url", some & (F.coalesce("source_url", F.lit("")) == "")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in rules]))
    return rows.select("framework_id", F.explode(found).alias("i")).select("framework_id", "i.severity", "i.rule")


def scan_secrets(texts: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """id, line_no, kind, match: the first match of each pattern in each line, at most 50 characters.

    Whole texts are searched once for any of the patterns; only texts that hold one are cut into
    lines, and only lines that hold one are searched for each."""
    patterns = patterns or SECRET_PATTERNS
    # Line by line a pattern sees the same as in a whole text where ^ and $ stand for line ends.
    some = "(?m)" + "|".join(f"(?:{p})" for p in patterns.values())
    held = texts.where(F.col("text").rlike(some))
    lines = held.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(some))
    checks = [F.struct(F.lit(k).alias("kind"), F.substring(F.regexp_extract("line", f"({p})", 1), 1, 50).alias("match")) for k, p in patterns.items()]
    found = lines.select("id", (F.col("pos") + 1).alias("line_no"), F.explode(F.filter(F.array(*checks), lambda c: c["match"] != "")).alias("c"))
    return found.select("id", "line_no", "c.kind", "c.match")


#: Slots of the tables that count grams and mark anchors: a fixed size, whatever the texts.
SLOTS = 1 << 20
#: Bytes of a gram, and of text whose grams are looked at together.
GRAM = 5
PART_BYTES = 1 << 20
#: Bytes that a longer item and a text must share from the anchor on, before both are brought together.
WIDE = 24


def _grams(data: bytes) -> np.ndarray:
    """Every run of five bytes as a number, in order: equal runs, equal numbers."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(raw) < GRAM:
        return np.zeros(0, np.int64)
    out = raw[: len(raw) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out |= raw[k : len(raw) - GRAM + 1 + k] << (8 * k)
    return out


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The grams of a text by parts that share their edges."""
    data = text.encode("utf-8", "surrogatepass")
    for k in range(0, max(len(data) - GRAM + 1, 0), PART_BYTES):
        yield _grams(data[k : k + PART_BYTES + GRAM - 1])


def _wide(data: bytes, at: np.ndarray) -> np.ndarray:
    """A hash of the ``WIDE`` bytes from each place on."""
    rows = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(WIDE)[None, :]]
    out = np.full(len(at), 1, np.uint64)
    for part in np.ascontiguousarray(rows).view(np.uint64).T:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _counted(texts: Iterator[str]) -> np.ndarray:
    """How often each slot's grams occur.  Texts are counted together: a table a text would cost more than the text."""
    total, held, n = np.zeros(SLOTS, np.int64), [], 0
    for text in texts:
        for grams in _pieces(text):
            held.append(_slots(grams))
            n += len(grams)
        if n >= SLOTS:
            total += np.bincount(np.concatenate(held), minlength=SLOTS)
            held, n = [], 0
    return total + np.bincount(np.concatenate(held), minlength=SLOTS) if held else total


def _anchor(needle: str, often: np.ndarray) -> tuple[int, int]:
    """The rarest gram of an item, and the hash of the bytes from it on (0 for an item shorter than ``WIDE``)."""
    data = needle.encode("utf-8", "surrogatepass")
    grams = np.concatenate(list(_pieces(needle)))
    if len(data) < WIDE:
        return int(grams[often[_slots(grams)].argmin()]), 0
    at = int(often[_slots(grams[: len(data) - WIDE + 1])].argmin())
    return int(grams[at]), int(_wide(data, np.array([at]))[0])


def _found(text: str, short: np.ndarray, long: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different anchors (gram, hash) that a text may hold, by marks of the slots of grams and hashes."""
    data, out = text.encode("utf-8", "surrogatepass"), []
    for k, grams in enumerate(_pieces(text)):
        slots = _slots(grams)
        lone = grams[short[slots]]
        at = np.flatnonzero(long[slots])
        at = at[at + k * PART_BYTES + WIDE <= len(data)]
        h = _wide(data, at + k * PART_BYTES)
        keep = wide[_slots(h)]
        out.append(np.stack([np.concatenate([lone, grams[at[keep]]]), np.concatenate([np.zeros(len(lone), np.int64), h[keep]])]))
    found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    gram, h = np.unique(found, axis=1) if found.shape[1] > 1 else found
    return gram, h


def leaked_items(items: DataFrame, texts: DataFrame, least: int = GRAM) -> DataFrame:
    """(item_id, id): evaluation texts of ``least`` characters or more contained in other texts,
    case apart.

    A text that contains an item has all its runs of five bytes, so one of them finds it: the one
    that is rarest in the texts, by counts in a table of fixed size. Texts are scanned for these anchors (tables
    of marks of the same size go to every task), joined with the items by the anchors they hold, and
    compared whole.  Of longer items ``WIDE`` bytes from the anchor on have to be the same too: a run alone stands in
    many texts, and so candidates would outnumber what is found. Neither side is gathered; an item shorter than a run is refused.
    """
    if least < GRAM:
        raise ValueError(f"items need {GRAM} characters or more")
    spark = items.sparkSession
    needles = items.where(F.length(F.trim("text")) >= least).select("item_id", F.lower(F.trim("text")).alias("needle"))
    hay = texts.select("id", F.lower("text").alias("hay")).where("hay IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = _counted(text for pdf in batches for text in pdf["hay"])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"slot": some, "n": total[some]})

    counts = hay.select("hay").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(often)

    def anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.array([_anchor(needle, shared.value) for needle in pdf["needle"]], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"needle": pdf["needle"], "nid": pdf["nid"], "gram": found[:, 0], "wide": found[:, 1]})

    one = needles.select("needle").distinct().withColumn("nid", F.xxhash64("needle"))
    anchors = durable(one.mapInPandas(anchor, "needle string, nid long, gram long, wide long"), "anchors")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gram, wide = _slots(pdf["gram"].to_numpy(np.int64)), pdf["wide"].to_numpy(np.int64)
            lone = wide == 0
            of = [gram[lone], gram[~lone], _slots(wide[~lone])]
            yield pd.DataFrame({"kind": np.repeat(range(3), [len(x) for x in of]), "slot": np.concatenate(of)}).drop_duplicates()

    marks = np.zeros((3, SLOTS), bool)
    used = anchors.select("gram", "wide").mapInPandas(slots, "kind long, slot long").distinct().toPandas()  # at most three times SLOTS rows
    marks[used["kind"].to_numpy(np.int64), used["slot"].to_numpy(np.int64)] = True
    marked = spark.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_found(text, *marked.value) for text in pdf["hay"]]
            ids = pdf["id"].repeat([len(g) for g, _ in found])
            join = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
            yield pd.DataFrame({"id": ids.to_numpy(), "gram": join(0), "wide": join(1)})

    # A text's key is its id and a hash: rows alike in both are alike, and each gives its own row at the end.
    keyed = hay.select(F.struct("id", F.xxhash64("hay")).alias("key"), "id", "hay")
    id_kind = hay.schema["id"].dataType.simpleString()
    hits = keyed.select(F.col("key").alias("id"), "hay").select(F.to_json("id").alias("id"), "hay").mapInPandas(scan, "id string, gram long, wide long")
    # Items go by a hash here, as their texts would be repeated; equal hashes only add candidates.
    pairs = durable(hits.join(anchors, ["gram", "wide"]).select("id", "nid").distinct(), "candidates")
    checked = keyed.select(F.to_json("key").alias("_key"), "id", "hay").join(pairs.withColumnRenamed("id", "_key"), "_key").join(anchors.select("nid", "needle"), "nid").where(F.contains("hay", F.col("needle")))
    return checked.select(F.col("id").cast(id_kind).alias("id"), "needle").join(needles, "needle").select("item_id", "id")


def review_issues(reviews: DataFrame, assignments: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, rule) for unknown ids or hubs, unknown statuses and missing or needless hubs."""
    known = assignments.select("id").distinct().withColumn("_a", F.lit(True))
    hub = hubs.select(F.col("id").alias("reviewer_hub_id")).withColumn("_h", F.lit(True))
    rows = reviews.join(known, "id", "left").join(hub, "reviewer_hub_id", "left")
    re, has = F.col("status") == "reassigned", F.col("reviewer_hub_id").isNotNull()
    rules = {
        "unknown_id": (F.col("id") >= 0) & F.col("_a").isNull(), "unknown_status": ~F.col("status").isin("pending", "accepted", "rejected", "reassigned"), "missing_hub": re & ~has,
        "unknown_hub": has & F.col("_h").isNull(), "needless_hub": ~re & has, "pending": F.col("status") == "pending",
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return rows.select("id", F.explode(found).alias("rule"))


def description_gaps(leaves: DataFrame, described: DataFrame) -> DataFrame:
    """side, id: leaves without a description, and descriptions of no leaf."""
    a = leaves.select("id").join(described.select("id"), "id", "left_anti").select(F.lit("missing").alias("side"), "id")
    return a.union(described.select("id").join(leaves.select("id"), "id", "left_anti").select(F.lit("extra"), "id"))


def description_report(leaves: DataFrame, described: DataFrame, low: int = 50) -> DataFrame:
    """Counts of a set of descriptions (id, text): leaves, described, missing, extra, empty, short."""
    both = leaves.select("id", F.lit(1).alias("l")).join(described.select("id", "text", F.lit(1).alias("d")), "id", "full_outer")
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return both.agg(
        F.count("l").alias("leaves"), F.count("d").alias("described"), F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"),
        F.count_if(F.col("d").isNotNull() & (n == 0)).alias("empty"), F.count_if(F.col("d").isNotNull() & (n > 0) & (n < low)).alias("short"),
    )


def batch_issues(controls: DataFrame, expected: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """framework_id, rule, n of whole documents: count beyond ``tolerance`` of what is expected
    (framework_id, n), empty descriptions and repeated ids."""
    per = controls.groupBy("framework_id").agg(F.count("*").alias("c"), F.count_if(F.trim(F.coalesce("description", F.lit(""))) == "").alias("empty"), (F.count("*") - F.countDistinct("control_id")).alias("again"))
    rows = per.join(expected.withColumnRenamed("n", "want"), "framework_id", "full_outer")
    off = F.coalesce("c", F.lit(0)).cast("double").between(F.floor(F.col("want") * (1 - tolerance)), F.ceil(F.col("want") * (1 + tolerance)))
    rules = [("count", F.col("want").isNotNull() & ~off, F.coalesce("c", F.lit(0))), ("empty_description", F.col("empty") > 0, F.col("empty")), ("repeated_id", F.col("again") > 0, F.col("again"))]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), n.cast("long").alias("n"))) for r, c, n in rules]))
    return rows.select("framework_id", F.explode(found).alias("i")).select("framework_id", "i.rule", "i.n")


def publication_issues(reviews: DataFrame, bridges: DataFrame, related: DataFrame) -> DataFrame:
    """rule, id of what stands against publishing: pending rows, and accepted bridges (hub_a, hub_b)
    that the hierarchy's relation does not have; no row means go."""
    pending = reviews.where("status = 'pending'").select(F.lit("pending").alias("rule"), F.col("id").cast("string").alias("id"))
    lost = bridges.join(related, ["hub_a", "hub_b"], "left_anti").select(F.lit("missing_bridge"), F.concat_ws("|", "hub_a", "hub_b"))
    return pending.union(lost)
