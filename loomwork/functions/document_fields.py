"""Fields that documents of requirements have in common, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_token(text: Column, mark: str = " - ") -> Column:
    """What stands after the last ``mark`` of a text; all of it without one."""
    return F.trim(F.element_at(F.split(text, F.lit(_quoted(mark))), -1))


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def with_guidelines(specification: Column, guidelines: Column) -> Column:
    """A specification and its guidelines (map of name to text) as ``name: text`` lines, a blank line between them;
    null if both are blank."""
    lines = F.array_join(F.transform(F.map_entries(guidelines), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    return F.nullif(F.concat_ws("\n\n", F.nullif(F.trim(specification), F.lit("")), F.nullif(lines, F.lit(""))), F.lit(""))


def distinct_captures(text: Column, pattern: str, group: int = 1) -> Column:
    """The different captures of a pattern in a text, sorted; an empty array for none or null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def level_by_file(file: Column, levels: dict[str, str], rest: str) -> Column:
    """The level of a file's controls by a part of its name; the first that fits."""
    out = F.lit(rest)
    for part, level in reversed(levels.items()):
        out = F.when(F.contains(F.lower(file), F.lit(part.lower())), level).otherwise(out)
    return out


def count_check(controls: DataFrame, expected: DataFrame, *, tolerance: float = 0.1) -> DataFrame:
    """framework_id, found, expected, level: ``error`` where nothing was found or, if ``exact``, the count differs; ``warning``
    beyond ``tolerance``; else ``ok``. ``expected`` has framework_id, n and exact."""
    n = controls.groupBy("framework_id").agg(F.count("*").alias("found"))
    both = expected.join(n, "framework_id", "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))
    off = F.abs(F.col("found") - F.col("n"))
    level = F.when((F.col("found") == 0) | (F.col("exact") & (off > 0)), "error").when(off > tolerance * F.col("n"), "warning").otherwise("ok")
    return both.select("framework_id", "found", F.col("n").cast("long").alias("expected"), level.alias("level"))


def positional(left: DataFrame, right: DataFrame, *, by: str = "file", at: str = "pos") -> DataFrame:
    """The k-th row of each file with the k-th of another table's, whatever their places are numbered from;
    rows without a partner stay, with nulls."""
    from pyspark.sql import Window

    rank = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(at)))
    a, b = rank(left), rank(right).drop(at)
    return a.join(b, [by, "_k"], "full_outer").withColumn(at, F.coalesce(at, F.col("_k").cast("long"))).drop("_k")
