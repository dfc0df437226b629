"""Requirement documents and taxonomies as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bare_key, link_type, slug
from ..schemas import FRAMEWORK_DOCUMENT, HUB_LINKS, TAXONOMY_DUMP, conform, struct

# Header names that stand for each column; in a file, the first such column counts.
ALIASES = {
    "control_id": ("control_id", "id", "control id", "section_id", "section id"),
    "title": ("title", "name", "control_name", "control name", "section_name"),
    "description": ("description", "desc", "text", "body", "specification"),
    "full_text": ("full_text", "fulltext", "full text"),
}
ROW_SCHEMA = "file string, pos long, control_id string, title string, description string, full_text string"


def _first_of(columns: list[str], wanted: tuple[str, ...], override: str | None = None) -> str | None:
    names = [(c.strip().lstrip("\ufeff").lower(), c) for c in columns]
    wanted = (override.lower(),) if override else wanted
    return next((c for name, c in names if name in wanted), None)


def present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_delimited(spark: SparkSession, path: str, *, sep: str | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Controls of CSV or TSV files with a header; names are matched by alias.

    Blank rows are skipped.  A missing id becomes ``ROW-n`` with the row's number in its file
    (the header is row 1); an empty description takes the title.  Needs a column for the id or
    the title, and one for the description.
    """
    sep = sep or ("\t" if path.endswith(".tsv") else ",")
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    names = {k: _first_of(raw.columns, v, (overrides or {}).get(k)) for k, v in ALIASES.items()}
    if not names["description"] or not (names["control_id"] or names["title"]):
        raise ValueError(f"{path}: no column for the description, or none for the id and title")
    col = lambda k: present(F.col(f"`{names[k]}`")) if names[k] else F.lit(None).cast("string")
    # A file that spans lines is read by one task, so its rows are numbered as they come.
    rows = raw.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), *[col(k).alias(k) for k in ALIASES])
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("at")) + 1).where(F.coalesce("control_id", "title", "description").isNotNull())
    out = rows.select("file", F.col("pos").cast("long").alias("pos"), F.coalesce("control_id", F.concat(F.lit("ROW-"), F.col("pos").cast("string"))).alias("control_id"), "title", F.coalesce("description", "title").alias("description"), "full_text")
    return out


def read_json_controls(spark: SparkSession, path: str) -> DataFrame:
    """Controls of JSON files: an array, or an object with ``controls``, ``items`` or ``data``.

    Keys are matched by alias, case apart; a missing id is ``ITEM-nnn``; entries that are no
    objects, or have neither title nor description, are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    text = F.trim("value")
    # A framework document is such an object already: its controls have the names that are sought.
    body = F.when(text.startswith("["), text).otherwise(F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in ("controls", "items", "data")]))
    rows = files.select("file", F.posexplode(F.from_json(body, "array<string>")).alias("pos", "item"))
    entry = F.from_json("item", "map<string,string>")
    keyed = rows.select("file", F.col("pos").cast("long").alias("pos"), F.transform_keys(entry, lambda k, _: F.lower(k)).alias("m")).where("m IS NOT NULL")
    pick = lambda k: F.coalesce(*[present(F.col("m")[a]) for a in ALIASES[k]])
    out = keyed.select("file", "pos", pick("control_id").alias("control_id"), pick("title").alias("title"), pick("description").alias("description"), pick("full_text").alias("full_text"))
    out = out.where(F.coalesce("title", "description").isNotNull())
    return out.select("file", "pos", F.coalesce("control_id", F.format_string("ITEM-%03d", F.col("pos") + 1)).alias("control_id"), "title", F.coalesce("description", "title").alias("description"), "full_text")


# Ids at the start of a heading, tried in order.
HEADING_IDS = (
    r"^([A-Za-z]{2,10}\d+(?:\.\d+)*)\s*[:\-–—]\s*(.+)$",
    r"^([A-Za-z]+-\d+(?:\.\d+)*)\s*[:\-–—]\s*(.+)$",
    r"^(\d+(?:\.\d+)+)\s+(.+)$",
    r"^(\d+\.\d+)\s+(.+)$",
)


def sections(text: str, level: int | None = None) -> Iterator[tuple[str | None, str, str]]:
    """(id, title, body) of the Markdown sections at one heading level.

    The level is the one with most headings that have a body near (the first of equals; 2 if
    there is none).  A higher heading ends a section, lower ones belong to its body.
    """
    lines = text.split("\n")
    heads = [(k, len(m.group(1)), m.group(2).strip()) for k, line in enumerate(lines) if (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line))]
    if level is None:
        score: dict[int, int] = {}
        for k, n, _ in heads:
            near = next((x for x in lines[k + 1 : k + 10] if x.strip()), "")
            score.setdefault(n, 0)
            score[n] += bool(near) and not near.startswith("#")
        level = max(score, key=lambda n: score[n]) if score and max(score.values()) else 2
    for i, (k, n, title) in enumerate(heads):
        if n != level:
            continue
        end = next((j for j, m, _ in heads[i + 1 :] if m <= level), len(lines))
        body = "\n".join(lines[k + 1 : end]).strip()
        if body:
            m = next((m for p in HEADING_IDS if (m := re.match(p, title))), None)
            yield (m.group(1), m.group(2).strip() or title, body) if m else (None, title, body)


def read_markdown(spark: SparkSession, path: str, *, level: int | None = None, description_chars: int = 2000) -> DataFrame:
    """Controls of Markdown files, a row a section; ids by heading, else ``CTRL-nn`` by place."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                rows = [(file, k, i or f"CTRL-{k + 1:02d}", t, b[:description_chars], b if len(b) > description_chars else None) for k, (i, t, b) in enumerate(sections(text, level))]
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "pos", "control_id", "title", "description", "full_text"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(parse, ROW_SCHEMA)


def read_patterned(spark: SparkSession, path: str, *, start: str, stop: str | None = None, parent: str | None = None, description_chars: int = 2000) -> DataFrame:
    """Controls of plain texts by patterns with groups ``id`` and ``title``.

    Each match of ``start`` (multi-line) opens a control, whose body ends at the next match of
    ``start``, ``stop`` or ``parent``; the last ``parent`` before it is its parent.  The first of
    repeated ids is kept.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opens, ends, ups = re.compile(start, re.M), re.compile(stop, re.M) if stop else None, re.compile(parent, re.M) if parent else None
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                above = list(ups.finditer(text)) if ups else []
                cuts = sorted({m.start() for p in (opens, ends, ups) if p for m in p.finditer(text)} | {len(text)})
                rows, seen = [], set()
                for m in opens.finditer(text):
                    body = text[m.end() : next(c for c in cuts if c > m.start())].strip()
                    g = m.groupdict()
                    up = next((a for a in reversed(above) if a.start() < m.start()), None)
                    if g["id"] in seen:
                        continue
                    seen.add(g["id"])
                    rows.append((file, len(rows), g["id"], (g.get("title") or g["id"]).strip(), body[:description_chars], body if len(body) > description_chars else None, up.group("id") if up else None))
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "pos", "control_id", "title", "description", "full_text", "parent_id"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(parse, ROW_SCHEMA + ", parent_id string")


def read_controls(spark: SparkSession, path: str, **options) -> DataFrame:
    """Controls of files of any known kind, by the path's ending."""
    kinds = {"csv": read_delimited, "tsv": read_delimited, "json": read_json_controls, "md": read_markdown, "markdown": read_markdown}
    end = path.rsplit(".", 1)[-1].lower()
    if end not in kinds:
        raise ValueError(f"{path}: unknown kind of file")
    return kinds[end](spark, path, **options)


def read_frameworks(spark: SparkSession, path: str) -> DataFrame:
    """Framework documents (one JSON object a file) as declared rows."""
    return spark.read.schema(FRAMEWORK_DOCUMENT).option("multiLine", True).json(path)


def controls_of(frameworks: DataFrame) -> DataFrame:
    """CONTROLS rows: ids are ``framework:control``, the first of repeated ones is kept."""
    rows = frameworks.select("framework_id", F.posexplode("controls").alias("pos", "c"))
    w = Window.partitionBy("framework_id", "c.control_id").orderBy("pos")
    first = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.select(F.concat_ws(":", "framework_id", "c.control_id").alias("id"), "framework_id", F.col("c.control_id").alias("section_id"), "c.title", "c.description", "c.full_text")


def merge_frameworks(parsed: DataFrame, extracted: DataFrame) -> DataFrame:
    """Parsed documents, and extracted ones of other frameworks."""
    return parsed.unionByName(extracted.join(parsed.select("framework_id"), "framework_id", "left_anti"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAXONOMY_DUMP).option("multiLine", True).json(path).select(F.explode("cres").alias("c")).select("c.*")


def taxonomy_nodes(cres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name) of the hubs and (parent_id, child_id) of their Contains links."""
    hubs = cres.where("doctype = 'CRE'")
    links = hubs.select("id", F.explode("links").alias("l")).where("l.ltype = 'Contains' AND l.document.doctype = 'CRE'")
    return hubs.select("id", "name"), links.select(F.col("id").alias("parent_id"), F.col("l.document.id").alias("child_id"))


def hub_links(cres: DataFrame, framework_ids: dict[str, str] | None = None) -> DataFrame:
    """HUB_LINKS rows: standards that hubs link to; a missing section id or name takes the other."""
    rows = cres.select(F.col("id").alias("cre_id"), F.col("name").alias("cre_name"), F.explode("links").alias("l")).where("l.document.doctype = 'Standard'")
    rows = rows.withColumn("link_type", link_type(F.col("l.ltype"))).where("link_type IS NOT NULL")
    sid, name = present(F.col("l.document.sectionID")), present(F.col("l.document.section"))
    std = F.col("l.document.name")
    known = F.create_map(*[F.lit(x) for kv in framework_ids.items() for x in kv])[std] if framework_ids else F.lit(None)
    out = rows.select("cre_id", "cre_name", std.alias("standard_name"), F.coalesce(sid, name, F.lit("")).alias("section_id"), F.coalesce(name, sid, F.lit("")).alias("section_name"), "link_type", F.coalesce(known, F.translate(slug(std), "-", "_")).alias("framework_id"))
    return conform(out, HUB_LINKS)


def standard_controls(links: DataFrame) -> DataFrame:
    """Controls that a taxonomy's links name: one a section, ids made distinct by their name."""
    w = Window.partitionBy("framework_id", "section_id", "section_name").orderBy("cre_id")
    one = links.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    own = F.coalesce(present(F.col("section_id")), slug(F.col("section_name")))
    again = Window.partitionBy("framework_id", "own").orderBy("section_name")
    ids = one.withColumn("own", own).withColumn("_k", F.row_number().over(again))
    name = F.when(F.col("_k") == 1, F.col("own")).otherwise(F.concat_ws("-", "own", slug(F.col("section_name"))))
    return ids.select(F.concat_ws(":", "framework_id", name).alias("id"), "framework_id", name.alias("section_id"), F.col("section_name").alias("title"), F.col("section_name").alias("description"))


def control_texts(controls: DataFrame) -> DataFrame:
    """``id: title. body`` of each control; the body is the full text unless blank."""
    body = F.coalesce(present(F.col("full_text")), F.col("description"), F.lit(""))
    title = present(F.col("title"))
    return controls.select("id", "framework_id", F.when(title.isNotNull(), F.concat(F.col("id"), F.lit(": "), title, F.lit(". "), body)).otherwise(F.concat(F.col("id"), F.lit(": "), body)).alias("text"))


def audit_verdicts(audit: DataFrame, old_id: str = "hub_id", pattern: str = r"\d{3}-\d{3}") -> DataFrame:
    """Audit rows (verdict, notes, hub_id) as corrections, exclusions or kept rows.

    A correction is the first id in the notes that is not the old one.
    """
    ids = F.regexp_extract_all("notes", F.lit(f"({pattern})"), 1)
    new = F.get(F.filter(ids, lambda x: x != F.col(old_id)), 0)
    none = F.lower("notes").rlike(r"no (suitable |good |matching )?hub|none fits")
    wrong = F.lower("verdict") == "wrong"
    return audit.withColumn("new_hub_id", F.when(wrong, new)).withColumn("action", F.when(wrong & new.isNotNull(), "correct").when(wrong | none, "exclude").otherwise("keep"))


def read_nested(spark: SparkSession, path: str, schema: str, levels: list[str], fields: dict[str, str]) -> DataFrame:
    """Controls of JSON documents that nest them: ``levels`` are the arrays to open, one inside the
    other (``"domains"``, ``"domains.controls"``, ...), and ``fields`` SQL over their names."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), "*")
    for at, level in enumerate(levels):
        rows = rows.select("*", F.posexplode(level).alias(f"pos{at}", f"l{at}"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(*[f"pos{k}" for k in range(len(levels))])) - 1
    return rows.select("file", place.cast("long").alias("pos"), *[F.expr(v).alias(k) for k, v in fields.items()])


_ACTIVITY = "struct<id:string,description:string,category:string,evidence_types:array<string>>"


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """Activities of a standard of domains, controls and activities; a control's title is theirs."""
    schema = f"domains array<struct<name:string,controls:array<struct<id:string,title:string,activities:array<{_ACTIVITY}>>>>>"
    fields = {
        "control_id": "l2.id", "title": "l1.title", "description": "l2.description", "full_text": "CAST(NULL AS STRING)", "hierarchy_level": "'activity'", "parent_id": "l1.id",
        "parent_name": "l1.title", "metadata": "map('category', coalesce(l2.category, ''), 'domain', l0.name, 'evidence_types', to_json(coalesce(l2.evidence_types, array())))",
    }
    return read_nested(spark, path, schema, ["domains", "l0.controls", "l1.activities"], fields)


def read_techniques(spark: SparkSession, path: str) -> DataFrame:
    """Techniques, their sub-techniques (with their parent) and mitigations of the first matrix."""
    item = "id:string,name:string,description:string"
    schema = f"matrices array<struct<techniques:array<struct<{item},subtechniques:array<struct<{item}>>>>,mitigations:array<struct<{item}>>>>"
    m = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.get("matrices", 0).alias("m"))
    row = lambda c, level, up=None: F.struct(
        c["id"].alias("control_id"), c["name"].alias("title"), c["description"].alias("description"), F.lit(level).alias("hierarchy_level"),
        (up["id"] if up is not None else F.lit(None).cast("string")).alias("parent_id"), (up["name"] if up is not None else F.lit(None).cast("string")).alias("parent_name"),
    )
    none = F.array().cast("array<struct<control_id:string,title:string,description:string,hierarchy_level:string,parent_id:string,parent_name:string>>")
    with_subs = F.transform("m.techniques", lambda t: F.concat(F.array(row(t, "technique")), F.coalesce(F.transform(t["subtechniques"], lambda s: row(s, "sub-technique", t)), none)))
    every = F.concat(F.coalesce(F.flatten(with_subs), none), F.coalesce(F.transform("m.mitigations", lambda x: row(x, "mitigation")), none))
    return m.select("file", F.posexplode(every).alias("pos", "c")).select("file", F.col("pos").cast("long").alias("pos"), "c.*")


class _Sections(HTMLParser):
    """Elements with an id that a pattern matches: their id, first heading and text."""

    def __init__(self, pattern: str):
        super().__init__(convert_charrefs=True)
        self.pattern, self.found, self.stack = re.compile(pattern), [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        name = dict(attrs).get("id") or ""
        here = {"tag": tag, "id": name, "text": [], "title": [], "own": bool(self.pattern.fullmatch(name))}
        if here["own"]:
            self.found.append(here)
        self.stack.append(here)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.stack):
            while self.stack.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        owner = next((e for e in reversed(self.stack) if e["own"]), None)
        if owner is not None:
            heading = any(re.fullmatch("h[1-6]", e["tag"]) for e in self.stack) or any(e["tag"] == "title" for e in self.stack)
            owner["title" if heading else "text"].append(data)


def read_html_sections(spark: SparkSession, path: str, *, pattern: str, description_chars: int = 2000, least: int = 0) -> DataFrame:
    """Controls of HTML files: elements whose id matches ``pattern``, the first of each id; fewer than
    ``least`` in a file are an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                p = _Sections(pattern)
                p.feed(text)
                rows, seen = [], set()
                for e in p.found:
                    body, title = (" ".join(" ".join(e[k]).split()) for k in ("text", "title"))
                    if e["id"] not in seen and (body or title):
                        seen.add(e["id"])
                        rows.append((file, len(rows), e["id"], title or e["id"], (body or title)[:description_chars], body if len(body) > description_chars else None))
                if len(rows) < least:
                    raise ValueError(f"{file}: {len(rows)} sections, {least} are expected")
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "pos", "control_id", "title", "description", "full_text"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(parse, ROW_SCHEMA)


def read_links(spark: SparkSession, path: str, schema: str = HUB_LINKS) -> DataFrame:
    """Links of JSON lines; blank lines give no row.  ``snapshots.content_hash`` of them is their
    version, whatever the order of lines and keys."""
    return spark.read.schema(schema).json(path).where(F.coalesce(*[F.col(f.name).cast("string") for f in struct(schema)]).isNotNull())


def united(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Rows of several tables with one key, and the ``source`` each comes from: for each key the row of the first table
    that has it (links and later rounds, parsed and extracted documents, controls and risks).

    Columns that a table does not have are null. Rows that repeat a key within their table stay once; rows with a null in their
    key are all kept.
    """
    every, names = None, list(parts)
    for place, (name, df) in enumerate(parts.items()):
        part = df.withColumns({"source": F.lit(name), "_place": F.lit(place)})
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    if every is None:
        raise ValueError(f"nothing to unite: {names}")
    whole = " AND ".join(f"{k} IS NOT NULL" for k in key)
    others = [c for c in every.columns if c not in key]
    first = every.where(whole).groupBy(*key).agg(F.min_by(F.struct(*others), F.struct("_place", F.xxhash64(*others))).alias("_r"))
    return first.select(*key, "_r.*").unionByName(every.where(f"NOT ({whole})")).drop("_place")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """file, name, value of every number in JSON documents, by its dotted path (measures, calibration, metadata);
    list places count from 0. A document that is no JSON stops the reading."""
    import json

    def walk(value: object, name: str) -> Iterator[tuple[str, float]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{name}.{k}" if name else str(k))
        elif isinstance(value, list):
            for k, v in enumerate(value):
                yield from walk(v, f"{name}.{k}" if name else str(k))
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            yield name, float(value)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(file, name, value) for file, text in zip(pdf["file"], pdf["value"], strict=True) for name, value in walk(json.loads(text), "")]
            yield pd.DataFrame(rows, columns=["file", "name", "value"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(parse, "file string, name string, value double")


def framework_totals(frameworks: DataFrame) -> DataFrame:
    """Frameworks and controls of merged documents."""
    return frameworks.agg(F.count("*").alias("frameworks"), F.coalesce(F.sum(F.size("controls")), F.lit(0)).cast("long").alias("controls"))


def parsed_texts(controls: DataFrame) -> DataFrame:
    """framework_id, section_id, text: the full text unless blank, else the description."""
    return controls.select("framework_id", "section_id", F.coalesce(present(F.col("full_text")), F.col("description")).alias("text"))


def framework_names(links: DataFrame) -> DataFrame:
    """framework_id, label, names: the shortest of a framework's standard names (the first of equals), and all."""
    return links.groupBy("framework_id").agg(
        F.min_by("standard_name", F.struct(F.length("standard_name"), F.col("standard_name"))).alias("label"), F.array_join(F.array_sort(F.collect_set("standard_name")), ", ").alias("names"))


def aligned_texts(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """id, text for each asked id: the text that comes first (pos), the id where there is none."""
    one = texts.groupBy("id").agg(F.min_by("text", "pos").alias("text"))
    return ids.join(one, "id", "left").select("id", F.coalesce("text", "id").alias("text"))


def truth_of(items: DataFrame, hubs: DataFrame) -> DataFrame:
    """(item_id, hub_id) of ground truth written as a JSON array; unknown hubs are left out, and
    an item that knows none keeps a null hub for the caller to report."""
    rows = items.select("item_id", F.explode_outer(F.from_json("truth", "array<string>")).alias("hub_id"))
    known = rows.join(hubs.select(F.col("id").alias("hub_id")), "hub_id", "left_semi").distinct()
    return items.select("item_id").distinct().join(known, "item_id", "left")


def enriched_corpus(items: DataFrame, parsed: DataFrame) -> DataFrame:
    """item_id, text, source: the parsed text of an item's section, by its id, by its normalised id,
    else the section's own text (``items``: item_id, framework_id, section_id, section_text)."""
    exact = parsed.groupBy("framework_id", "section_id").agg(F.min("text").alias("exact"))
    loose = parsed.groupBy("framework_id", bare_key(F.col("section_id")).alias("key")).agg(F.min_by("text", "section_id").alias("loose"))
    rows = items.withColumn("key", bare_key(F.col("section_id"))).join(exact, ["framework_id", "section_id"], "left").join(loose, ["framework_id", "key"], "left")
    source = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "normalised").otherwise("section")
    return rows.select("item_id", F.coalesce("exact", "loose", "section_text").alias("text"), source.alias("source"))


def embedding_slice(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors (id, embedding) whose id, with double colons as one, is among ``ids`` (id)."""
    key = lambda c: F.replace(c, F.lit("::"), F.lit(":"))
    return vectors.withColumn("_k", key(F.col("id"))).join(ids.select(key(F.col("id")).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def flat_text(value) -> str:
    """All text of a nested value, one part a line."""
    if isinstance(value, dict):
        return "\n".join(filter(None, (flat_text(v) for v in value.values())))
    if isinstance(value, (list, tuple)):
        return "\n".join(filter(None, map(flat_text, value)))
    return "" if value is None else str(value).strip()


def read_yaml_controls(spark: SparkSession, path: str, *, lists: tuple[str, ...] = ("controls", "risks"), description_chars: int = 2000) -> DataFrame:
    """Controls of YAML files: the entries of the named lists, one list after the other; a
    description may be nested text.  Needs a YAML library in the workers."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                doc = yaml.safe_load(text) or {}
                rows = []
                for entry in (e for name in lists for e in doc.get(name) or [] if isinstance(e, dict) and e.get("id")):
                    title = flat_text(entry.get("title") or entry.get("name"))
                    body = flat_text(entry.get("description") or entry.get("shortDescription") or entry.get("longDescription")) or title
                    rows.append((file, len(rows), str(entry["id"]), title, body[:description_chars], body if len(body) > description_chars else None))
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "pos", "control_id", "title", "description", "full_text"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(parse, ROW_SCHEMA)
