"""The readers of control documents as a data source: ``spark.read.format("controls")``.

    register(spark)
    spark.read.format("controls").load("/data/frameworks")
    spark.sql("CREATE TEMPORARY VIEW c USING controls OPTIONS (path '/data/frameworks', kind 'markdown')")

Each file is a partition of its own, listed and opened through pyarrow's file systems, so folders
may be local or in a store.  A file that cannot be read gives one row with its ``error``, unless ``mode`` is ``failfast``.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import ALIASES, ROW_SCHEMA, sections

SCHEMA = ROW_SCHEMA + ", error string"
KINDS = {"csv": "delimited", "tsv": "delimited", "json": "json", "md": "markdown", "markdown": "markdown"}


@dataclass
class FilePartition(InputPartition):
    path: str
    size: int


def present(value: object) -> str | None:
    """A value as text without white space around it; None if nothing is left."""
    text = value if isinstance(value, str) else None if value is None else json.dumps(value)
    return (text or "").strip(" ") or None


def rows_of(text: str, kind: str | None, *, separator: str = ",", level: int | None = None, description_chars: int = 2000) -> Iterator[tuple]:
    """(pos, control_id, title, description, full_text) of a document of a kind, as the readers of ``readers`` give them."""
    if kind == "markdown":
        for k, (i, t, b) in enumerate(sections(text, level)):
            yield k, i or f"CTRL-{k + 1:02d}", t, b[:description_chars], b if len(b) > description_chars else None
    elif kind == "json":
        found = json.loads(text)
        if isinstance(found, dict):
            found = next((found[k] for k in ("controls", "items", "data") if found.get(k) is not None), None)
        if not isinstance(found, list):
            raise ValueError("no list of controls")
        for k, row in enumerate(found):
            if not isinstance(row, dict):
                continue
            low = {str(key).lower(): v for key, v in row.items()}
            r = {name: next((v for a in known if (v := present(low.get(a)))), None) for name, known in ALIASES.items()}
            if r["title"] or r["description"]:
                yield k, r["control_id"] or f"ITEM-{k + 1:03d}", r["title"], r["description"] or r["title"], r["full_text"]
    elif kind == "delimited":
        rows = csv.DictReader(io.StringIO(text), delimiter=separator)
        heads = [(h.strip().lstrip("\ufeff").lower(), h) for h in rows.fieldnames or []]
        names = {name: next((h for low, h in heads if low in known), None) for name, known in ALIASES.items()}
        if not names["description"] or not (names["control_id"] or names["title"]):
            raise ValueError("no column for the description, or none for the id and title")
        for k, row in enumerate(rows, 2):
            r = {name: present(row[h]) if h else None for name, h in names.items()}
            if r["control_id"] or r["title"] or r["description"]:
                yield k, r["control_id"] or f"ROW-{k}", r["title"], r["description"] or r["title"], r["full_text"]
    else:
        raise ValueError(f"unknown kind {kind!r}")


class ControlsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        if not self.options.get("path"):
            raise ValueError("controls: give a path")

    def _store(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://|file:", path) else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        store, path = self._store()
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"controls: {self.options['path']} is not there")
        files = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
        wanted = [x for x in files if self._kind(x.path) and not x.base_name.startswith(("_", "."))]
        return [FilePartition(x.path, x.size) for x in sorted(wanted, key=lambda x: x.path)]

    def _kind(self, path: str) -> str | None:
        return self.options.get("kind") or KINDS.get(path.rsplit(".", 1)[-1].lower())

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        name = partition.path.rsplit("/", 1)[-1]
        try:
            store, _ = self._store()
            with store.open_input_stream(partition.path) as f:
                text = f.read().decode("utf-8-sig")
            separator = self.options.get("separator") or ("\t" if name.lower().endswith(".tsv") else ",")
            level = self.options.get("level")
            rows = list(rows_of(text, self._kind(name), separator=separator, level=int(level) if level else None, description_chars=int(self.options.get("description_chars", 2000))))
        except (ValueError, OSError, csv.Error) as e:
            if self.options.get("mode", "permissive").lower() == "failfast":
                raise
            yield name, None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for row in rows:
            yield name, *row, None


class ControlsSource(DataSource):
    """Options: path; kind (delimited, json, markdown; else by the file's ending); separator; level (Markdown headings);
    description_chars; mode (permissive, failfast)."""

    @classmethod
    def name(cls) -> str:
        return "controls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ControlsReader:
        return ControlsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ControlsSource)
