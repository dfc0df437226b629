"""Functions under names that SQL text can use."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.readers import sections
from .text import nfc, unescape_html


@udtf(returnType="pos int, control_id string, title string, body string")
class MarkdownSections:
    """The sections of a Markdown text, a row each."""

    def eval(self, text: str) -> Iterator[tuple[int, str | None, str, str]]:
        for k, (control_id, title, body) in enumerate(sections(text or "")):
            yield k, control_id, title, body


def register(spark: SparkSession) -> None:
    """``nfc(text)``, ``html_unescape(text)`` and the table function ``markdown_sections(text)``."""
    spark.udf.register("nfc", nfc)
    spark.udf.register("html_unescape", unescape_html)
    spark.udtf.register("markdown_sections", MarkdownSections)
