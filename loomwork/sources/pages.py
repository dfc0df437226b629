"""Controls of page texts: texts of printed documents, cut into pages by form feeds.

Pages repeat running headers and footers, titles wrap, and a table of contents names every control
before it begins.  A reader walks over the lines as a small state machine and gives a row a control.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .readers import ROW_SCHEMA

FEED = "\f"


@dataclass
class PageRules:
    """``header`` has the groups id and title and is tried on the first line of a page that is not a footer's; ``footers`` are
    whole lines that every page may repeat; a line that begins like one of ``headings`` is no rest of a title."""

    header: str
    footers: list[str] = field(default_factory=list)
    headings: list[str] = field(default_factory=list)
    title_chars: int = 80

    def __post_init__(self):
        self._header = re.compile(self.header)
        self._footers = [re.compile(p) for p in self.footers]

    def is_footer(self, line: str) -> bool:
        return any(p.fullmatch(line.strip()) for p in self._footers)

    def goes_on(self, title: str, line: str) -> bool:
        """Whether a line is the rest of a title that did not fit: short, no heading, and begun like a title or
        after a hyphen."""
        line = line.strip()
        if not line or len(line) >= self.title_chars or any(line.startswith(h) for h in self.headings) or self._header.match(line):
            return False
        return line[0].isupper() or title.endswith("-")


def page_controls(text: str | None, rules: PageRules) -> Iterator[tuple[str, str, str]]:
    """(id, title, body) of each control in order of its page; the first of repeated ids is kept, and a control
    reaches to the next first one, over as many pages as it has.

    Blank lines at a body's ends go, and several in a row become one.
    """
    found: list[tuple[str, str, list[str]]] = []
    seen: set[str] = set()
    state = "outside"  # outside, title (its second line may follow), body
    for part in (text or "").split(FEED):
        top = True
        for line in part.splitlines():
            if rules.is_footer(line) or (top and not line.strip()):
                continue
            m = rules._header.match(line.strip()) if top else None
            top = False
            if m and m["id"] not in seen:
                seen.add(m["id"])
                found.append((m["id"], (m["title"] or "").strip(), []))
                state = "title"
                continue
            if state == "title":
                key, title, body = found[-1]
                if rules.goes_on(title, line):
                    found[-1] = (key, title + ("" if title.endswith("-") else " ") + line.strip(), body)
                    state = "body"
                    continue
                state = "body"
            if state == "body":
                found[-1][2].append(line.rstrip())
    for key, title, lines in found:
        body = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
        yield key, title or key, body


def read_pages(spark: SparkSession, path: str, rules: PageRules, *, expected: int | None = None, description_chars: int = 2000) -> DataFrame:
    """Controls of page texts, a row a control; a control without a body has its title as description.

    With ``expected`` a file with another number of controls stops the reading.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                rows = [(file, k, i, t, (b or t)[:description_chars], b if len(b) > description_chars else None) for k, (i, t, b) in enumerate(page_controls(text, rules))]
                if expected is not None and len(rows) != expected:
                    raise ValueError(f"{file}: {len(rows)} controls, not {expected}")
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "pos", "control_id", "title", "description", "full_text"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.mapInPandas(parse, ROW_SCHEMA)


def register_table_function(spark: SparkSession, name: str, rules: PageRules) -> None:
    """Makes ``SELECT ... FROM name(text)`` give the controls of a page text."""

    @udtf(returnType="pos int, control_id string, title string, body string")
    class Controls:
        def eval(self, text: str):
            for k, (i, t, b) in enumerate(page_controls(text, rules)):
                yield k, i, t, b

    spark.udtf.register(name, Controls)
