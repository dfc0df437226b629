"""Text cleaning, keys and templates as column functions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
# Typographic ligatures, longest first.
LIGATURES = (("ﬄ", "ffl"), ("ﬃ", "ffi"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))
TAG = r"</?[a-zA-Z][^>]*>"
SPACE = r"(?U)\s+"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C (no built-in has it)."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else None)


@F.pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Character references decoded (no built-in has the full table)."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, TAG, "")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACE, " "))


def fix_ligatures(x: Column) -> Column:
    for old, new in LIGATURES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def rejoin_hyphens(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")


def cut_at_space(x: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space unless that halves the text."""
    head = F.substring(x, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    whole = F.when((F.instr(head, " ") > 0) & (at >= limit / 2), F.rtrim(F.substring(head, F.lit(1), at))).otherwise(head)
    return F.when(F.length(x) > limit, whole).otherwise(x)


def sanitize(x: Column, limit: int | None = None) -> Column:
    """The whole cleaning chain; text that ends empty is null (the caller reports it)."""
    x = nfc(F.translate(x, "\x00", " "))
    x = strip_tags(unescape_html(F.translate(x, ZERO_WIDTH, "")))
    x = collapse(rejoin_hyphens(fix_ligatures(x)))
    x = F.when(x != "", x)
    return cut_at_space(x, limit) if limit else x


def sanitize_full(x: Column, limit: int) -> Column:
    """struct(text, full): ``full`` only where ``text`` had to be cut."""
    whole = sanitize(x)
    return F.struct(cut_at_space(whole, limit).alias("text"), F.when(F.length(whole) > limit, whole).alias("full"))


def sanitize_light(x: Column, limit: int = 10_000) -> Column:
    """NUL removed, normal form C, cut hard."""
    return F.substring(nfc(F.translate(x, "\x00", "")), 1, limit)


def catalog_line(hub_id: Column, path: Column, name: Column, description: Column | None = None, limit: int = 200) -> Column:
    """``[id] path | name: description``; long descriptions are cut and marked."""
    head = F.concat(F.lit("["), hub_id, F.lit("] "), path, F.lit(" | "), name)
    if description is None:
        return head
    short = F.when(F.length(description) > limit, F.concat(F.substring(description, 1, limit), F.lit("..."))).otherwise(description)
    return F.concat(head, F.coalesce(F.concat(F.lit(": "), F.nullif(short, F.lit(""))), F.lit("")))


def instructed(text: Column, instruction: str | None) -> Column:
    """The text after an encoder's instruction, if it has one."""
    return F.concat(F.lit(instruction), text) if instruction else text


def linked_text(text: Column) -> Column:
    """What follows the first colon, trimmed; ``(none)`` without one."""
    return F.when(F.contains(text, F.lit(":")), F.trim(F.substring(text, F.instr(text, ":") + 1, F.length(text)))).otherwise("(none)")


def day(x: Column) -> Column:
    """The day of an ISO date or time as text; ``unknown`` for what is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(x), "yyyy-MM-dd"), F.lit("unknown"))


def slug(x: Column, limit: int = 80) -> Column:
    """a-z, 0-9 and single hyphens; null if nothing is left."""
    out = F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(out != "", out)


def bare_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def text_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def link_type(x: Column) -> Column:
    """Canonical names of link kinds, whatever their case and spaces; null for others."""
    key = F.lower(F.replace(x, F.lit(" "), F.lit("")))
    return F.when(key == "linkedto", "LinkedTo").when(key == "automaticallylinkedto", "AutomaticallyLinkedTo")


def join_present(*parts: Column) -> Column:
    """Non-empty parts, one space between them."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def hub_text(path: Column, name: Column, description: Column | None = None, standards: Column | None = None, template: str = " | ") -> Column:
    """``path | name``, then ``: description`` and ``. Standards: a, b`` where they exist."""
    out = F.concat(path, F.lit(template), name)
    if description is not None:
        out = F.concat(out, F.coalesce(F.concat(F.lit(": "), F.nullif(description, F.lit(""))), F.lit("")))
    if standards is not None:
        listed = F.array_join(F.array_sort(F.array_distinct(standards)), ", ")
        out = F.concat(out, F.when(F.size(standards) > 0, F.concat(F.lit(". Standards: "), listed)).otherwise(""))
    return out


def hyperlink(framework: Column, section: Column, templates: dict[str, str]) -> Column:
    """The framework's template with the section put in; null without a template."""
    if not templates:
        return F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    return F.replace(m[framework], F.lit("{section_id}"), section)


def ascii_letter_ratio(x: Column) -> Column:
    """Share of ASCII letters among letters; null with ten letters or fewer."""
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return F.when(letters > 10, F.length(F.regexp_replace(x, "[^A-Za-z]", "")) / letters)


def mentioned_ids(x: Column, pattern: str = r"\d+-\d+") -> Column:
    """Distinct ids in a free text, in order of mention; a JSON array of strings is read first."""
    parsed = F.from_json(F.regexp_extract(x, r"(?s)(\[.*?\])", 1), "array<string>")
    return F.array_distinct(F.when(F.size(parsed) > 0, parsed).otherwise(F.regexp_extract_all(x, F.lit(f"({pattern})"), 1)))


# Shapes of credentials, home folders and contact data.
SECRET_PATTERNS = {
    "sk_token": r"sk-[a-zA-Z0-9]{20,}",
    "hf_token": r"hf_[a-zA-Z0-9]{20,}",
    "wandb_token": r"wandb_[a-zA-Z0-9]{10,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "home_folder": r"/(?:home|Users)/[A-Za-z][A-Za-z0-9_]*",
    "pass_entry": r"^pass\s+\w+/\w+",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "named_token": r"[A-Z][A-Z0-9]*_(?:TOKEN|API_KEY)\s*=",
    # Beyond those, more of the same kind.
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "password": r"(?i)password\s*[=:]\s*\S+",
}

SLUG = re.compile(r"^[a-z][a-z0-9_]{1,49}$")
