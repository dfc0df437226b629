"""op7: document quality rules as a short-circuit cascade, in Spark's own functions only.

Each rule is a condition that rejects a document.  Which documents pass does not depend on the
order of the rules, but the work does: on a sample, each rule's time a row and the rows it
rejects are measured, and the rule with the most rejections per second goes first, then the one
with the most among what that leaves, and so on.  Filters (or a ``CASE``) in that order leave a
document at its first rejection, so costly rules see few documents.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words(text: Column) -> Column:
    """Runs of characters other than 20 and 09 to 0D; none for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE_CLASS + "+"), ""), F.array().cast("array<string>"))


def letters_in_words(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, SPACES, "")), F.lit(0)).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    parts = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return F.coalesce(parts, F.array().cast("array<string>"))


def with_repeated_words(df: DataFrame, words_col: str, name: str) -> DataFrame:
    """Adds the number of words that stand in an 8-word window found twice or more.

    Window hashes come by doubling (pairs of words, of pairs, of those); only documents with a
    repeated hash go on to sort their windows and measure what the repeated ones cover.
    """
    df = df.withColumn("_g", F.transform(words_col, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        n = F.greatest(F.size("_g") - step, F.lit(0))
        df = df.withColumn("_g", F.zip_with(F.slice("_g", 1, n), F.slice("_g", 1 + step, n), lambda a, b: F.xxhash64(a, b)))
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, other: other.isNotNull() & (e["x"] == other["x"])
    at = F.filter("_s", lambda e, k: same(e, F.get(F.col("_s"), k - 1)) | same(e, F.get(F.col("_s"), k + 1)))
    df = df.withColumn("_p", F.sort_array(F.transform(at, lambda e: e["i"])))
    steps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn(name, F.coalesce(F.when(F.size("_p") > 0, total), F.lit(0).cast("long"))).drop("_g", "_s", "_p")


@dataclass(frozen=True)
class Rule:
    """``needs``: the signals that it reads; ``rejects``: SQL over them, never null."""

    name: str
    needs: tuple[str, ...]
    rejects: str


#: The base rules fail a document in every use; the others are this operator's verdict.
BASE = (
    Rule("too_short", ("n_words",), "n_words < 20"),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 30 * n_words"),
)
OWN = (
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("shouting", ("n_words", "n_shouts"), "5 * n_shouts > n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
)
RULES = (*BASE, *OWN)
#: Signals that no report shows, as SQL over ``text``: computed where a rule asks, not before.
LAZY = {"n_shouts": "coalesce(length(text) - length(translate(text, '!', '')), 0)"}


def rejects(rule: Rule) -> Column:
    """The rule's condition over the other signals and ``text``."""
    sql = rule.rejects
    for name, value in LAZY.items():
        sql = sql.replace(name, f"({value})")
    return F.expr(sql)


def sealed(df: DataFrame) -> DataFrame:
    """``df`` as it is, but filters on it stay above it.

    A filter pushed through the steps that a signal comes from would compute all of them again
    at each mention; Spark does not push filters below a random column.
    """
    return df.withColumn("_r", F.rand(0)).where("_r >= 0").drop("_r")


def with_signals(df: DataFrame, text_col: str, needed: set[str]) -> DataFrame:
    """Adds the signals asked for, as long columns (lazy ones are left to the rules)."""
    text = F.col(text_col)
    if needed & {"n_words", "n_repeat_words"}:
        df = df.withColumn("_words", words(text)).withColumn("n_words", F.size("_words").cast("long"))
    if "n_repeat_words" in needed:
        df = with_repeated_words(df, "_words", "n_repeat_words")
    if needed & {"n_lines", "n_dup_lines"}:
        df = df.withColumn("_lines", lines(text)).withColumn("n_lines", F.size("_lines").cast("long"))
        df = df.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    simple = {"word_chars": letters_in_words(text), "n_symbols": symbols(text)}
    df = df.withColumns({k: v for k, v in simple.items() if k in needed})
    return sealed(df.drop("_words", "_lines"))


def measure(docs: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, repeats: int = 2) -> dict:
    """``seconds`` a row of each rule, and ``verdicts``: how many rows each set of rules rejects.

    The sample, about ``sample_rows`` rows, is drawn over the whole table.  A rule is timed after
    a run that compiles it, less the time of a job that computes nothing; times are rounded to
    powers of two, so that chance seldom changes the order (and never a verdict).
    """
    total = docs.count()
    some = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / max(total, 1)), seed=7)
    some, drop = kept(some, "sample")

    def seconds(job: DataFrame) -> float:
        took = []
        for _ in range(1 + repeats):
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    n = some.count()
    idle = seconds(some.agg(F.count("text")))
    cost = {}
    for rule in rules:
        spent = seconds(with_signals(some, "text", set(rule.needs)).agg(F.count_if(rejects(rule)))) - idle
        cost[rule.name] = 2.0 ** round(log2(max(spent, 1e-3) / max(n, 1)))
    every = with_signals(some, "text", {x for r in rules for x in r.needs})
    bad = every.select(F.array_compact(F.array(*[F.when(rejects(r), r.name) for r in rules])).alias("bad")).groupBy("bad").count().collect()
    drop()
    return {"seconds": cost, "verdicts": {frozenset(r["bad"]): r["count"] for r in bad}}


def cascade(measured: dict, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per second among the rows that those before them leave; ties, and
    rules that reject nothing more, by time."""
    cost, left = measured["seconds"], dict(measured["verdicts"])
    waiting, out = list(rules), []
    while waiting:
        rejected = {r.name: sum(c for bad, c in left.items() if r.name in bad) for r in waiting}
        best = min(waiting, key=lambda r: (-rejected[r.name] / cost[r.name], cost[r.name], r.name))
        out.append(best)
        waiting.remove(best)
        left = {bad: c for bad, c in left.items() if best.name not in bad}
    return out


def first_failure(ordered: list[Rule]) -> Column:
    """The first rule of the cascade that rejects, or null."""
    out = None
    for rule in ordered:
        out = F.when(rejects(rule), rule.name) if out is None else out.when(rejects(rule), rule.name)
    return out if out is not None else F.lit(None).cast("string")


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, measured: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns.

    One filter after another in the cascade's order, each computing only its own signals on
    what is left.  A null or empty text has no words and is rejected as too short.  Repeated rows
    are judged each on its own, texts of any length whole, and ids are not looked at.  Names that
    the signals use are kept apart from the table's own columns.  An empty table stays empty.
    """
    ordered = cascade(measured or measure(docs, text_col, rules), rules)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    for rule in ordered:
        rows = with_signals(rows, "text", set(rule.needs)).where(~rejects(rule)).select("row", "text")
    return rows.select("row.*")


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", measured: dict | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    These signals are reported for every document; others are computed only for documents that
    reach their rule in the cascade, which decides ``kept``.  A null or empty text has no words
    and fails; repeated rows are judged each on its own; a null id stays null; texts of any length
    are read whole; other columns are ignored; an empty table gives no rows.
    """
    ordered = cascade(measured or measure(docs, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_signals(rows, "text", {x for r in RULES for x in r.needs} | {"n_dup_lines"})
    base = F.lit(False)
    for rule in BASE:
        base = base | rejects(rule)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        first_failure(ordered).isNull().alias("kept"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
pos AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, g FROM pos GROUP BY doc_id, g HAVING count(*) > 1),
steps AS (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS s FROM pos JOIN twice USING (doc_id, g)),
covered AS (SELECT doc_id, sum(least(coalesce(s, 8), 8)) AS c FROM steps GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(replace(t, '!', '')) AS n_shouts, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 5 * n_shouts > n_words OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM b
"""
