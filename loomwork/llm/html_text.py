"""op9: the main text of web pages by the distribution of text over lines.

Markup is stripped to one line per block element.  A line weighs its length without link text, and
``ARTICLE_FACTOR`` times its length inside an article element.  Weights are summed over a sliding window of lines
that does not reach over an article's edge, and held against one threshold, which comes from the page itself: ``SURGE`` times
the geometric mean of its line lengths.  Where the sums reach it is a surge point, where they fall below it again a
dive point, and the text between the two is kept.

Elements that never hold article text (menus, forms, scripts, ...) and those that their class,
id or role names as something beside it give no line, however long, unless they hold the article or
nothing else on the page has text.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines summed, and the sum that a surge needs as a multiple of the page's mean line.
WINDOW_LINES = 5
SURGE = 4.0
#: What text in an article element weighs more than other text.
ARTICLE_FACTOR = 20

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)|</?\Z", re.S)
_TAG_STOP = re.compile(r">|=\s*+([\"'])")
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it ends at their own end tag only.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg math noscript".split())
_NEVER = frozenset("nav footer aside form button select label fieldset dialog menu head object audio video canvas map datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
#: Of these, what may stand around a whole page.
_HOLDERS = frozenset(["form", "fieldset", "dialog"])
#: Elements that a start tag of the same set closes (end tags that HTML lets out).
_SIBLINGS = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    **{n: {"thead", "tbody", "tfoot", "tr", "td", "th"} for n in ("thead", "tbody", "tfoot")},
}
#: Whole classes or ids that name something beside the article.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments commentlist reply replies respond disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager copyright "
    "legal disclaimer skip tags".split()
)
#: Of these, names that a page's only text may have around it too.
_HOLDING = frozenset("widget legal overlay modal popup header disclaimer notice notices alert tags skip".split())
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")

Tokens = list[tuple[str, str, bool, str]]


def _beside(name: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element holds something beside the article."""
    if name in _NEVER or (name == "header" and not inside_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and not _BESIDE.isdisjoint({*value.split()} - ({"header"} if inside_article else set())):
            return True
        if key == "role" and value in _ROLES or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


def _holding(name: str, attributes: str) -> bool:
    """Whether an element that is set beside the article may be the page's only text after all."""
    if name in _HOLDERS:
        return True
    names = {v for key, value in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id") for v in value.strip("\"'").lower().split()} & _BESIDE
    return name not in _NEVER and name != "header" and bool(names) and names <= _HOLDING


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag that is open at ``at`` has its ``>``; the page's end if it has none.

    ``unclosed`` keeps the quotes that stand nowhere further on, so that none is sought twice."""
    while m := _TAG_STOP.search(page, at):
        quote = m.group(1)
        if quote is None:
            return m.start()
        at = m.end()
        if quote not in unclosed:
            close = page.find(quote, at)
            if close < 0:
                unclosed.add(quote)  # as in a page that is cut off: the quote means nothing
            else:
                at = close + 1
    return len(page)


def _tokens(page: str) -> tuple[Tokens, str]:
    """(text before, name, whether an end tag, attributes) of each tag, and the text after the last.

    Elements whose content is no markup are left out whole."""
    out: Tokens = []
    parts: list[str] = []
    unclosed: set[str] = set()
    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        parts.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        end = _tag_end(page, at, unclosed)
        ending, attributes, at = bool(m.group(1)), page[at:end], min(size, end + 1)
        if not ending and name in _RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}(?![A-Za-z0-9:-])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        out.append(("".join(parts), name, ending, attributes))
        parts = []
    return out, "".join(parts)


def _ends(tokens: Tokens) -> tuple[dict[int, int], set[int]]:
    """For each start tag, the token where the page goes on after its element; those with an end tag.

    An element ends with its end tag, with a sibling that closes it, or with its parent."""
    ends: dict[int, int] = {}
    owned: set[int] = set()
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}  # open elements by name

    def pop(at: int) -> None:
        name, k = stack.pop()
        held[name] -= 1
        ends[k] = at

    for i, (_, name, ending, attributes) in enumerate(tokens):
        if ending:
            if not held.get(name):
                continue
            j = len(stack) - 1
            while stack[j][0] != name and (name in _BLOCKS or name in _NEVER or stack[j][0] not in _BLOCKS):
                j -= 1
            if stack[j][0] == name:  # an inline end tag does not reach over a block
                while len(stack) > j + 1:
                    pop(i)
                owned.add(stack[-1][1])
                pop(i + 1)
            continue
        closed = _SIBLINGS.get(name, ())
        if any(held.get(n) for n in closed) or name in _BLOCKS and held.get("p"):
            # What is closed lies above the nearest other block.
            j, low = len(stack) - 1, len(stack)
            while j >= 0 and (stack[j][0] in closed or stack[j][0] == "p" or stack[j][0] not in _BLOCKS):
                if stack[j][0] in closed or stack[j][0] == "p" and name in _BLOCKS:
                    low = j
                j -= 1
            while len(stack) > low:
                pop(i)
        if name not in _VOID and not attributes.endswith("/"):
            stack.append((name, i))
            held[name] = held.get(name, 0) + 1
    while stack:
        pop(len(tokens))
    return ends, owned


def blocks(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, length without link text, whether in an article) of each block; if any is.

    A block that is links for the most part has no length.  On a page where all text is in elements
    beside the article, the one with the most text of its own among those that may hold a page is read after all."""
    tokens, rest = _tokens(page)
    ends, owned = _ends(tokens)
    out, marked = _lines(tokens, rest, ends, owned, frozenset())
    if not out:
        spared = _fullest(tokens, rest, ends)
        if spared:
            out, marked = _lines(tokens, rest, ends, owned, spared)
    return out, marked


def _fullest(tokens: Tokens, rest: str, ends: dict[int, int]) -> frozenset[int]:
    """Of the elements beside the article that may hold a page's text, that with the most of it outside the
    others, and those around it."""
    own: dict[int, int] = {}
    open_: list[tuple[int, int, bool]] = []  # where it ends, its start tag, whether it may be read
    barred = 0

    def count(text: str) -> None:
        if open_ and not barred:
            own[open_[-1][1]] = own.get(open_[-1][1], 0) + len(text.strip())

    around: dict[int, int] = {}
    for k, (text, name, _, attributes) in enumerate(tokens):
        while open_ and open_[-1][0] < k:
            barred -= not open_.pop()[2]
        count(text)
        while open_ and open_[-1][0] <= k:
            barred -= not open_.pop()[2]
        if k in ends and _beside(name, attributes, False):
            may = _holding(name, attributes)
            around[k] = open_[-1][1] if open_ else -1
            open_.append((ends[k], k, may))
            barred += not may
    count(rest)
    if not any(own.values()):
        return frozenset()
    k = max(own, key=lambda j: (own[j], -j))
    chain = []
    while k >= 0:
        chain.append(k)
        k = around[k]
    return frozenset(chain)


def _lines(tokens: Tokens, rest: str, ends: dict[int, int], owned: set[int], spared: frozenset[int]) -> tuple[list[tuple[str, int, bool]], bool]:
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = article = links = 0
    any_article = False
    n = len(tokens)
    before = [0]
    for text, *_ in tokens:
        before.append(before[-1] + len(text.strip()))
    before.append(before[-1] + len(rest.strip()))

    def held(k: int) -> int:
        """Characters in an element; what stands before the tag that closes it without an end tag is in it."""
        return before[ends[k] if k in owned else ends[k] + 1] - before[k + 1]

    # The outermost article with the most text.
    main, most, k = -1, -1, 0
    while k < n:
        if tokens[k][1] in ("article", "main") and k in ends:
            if held(k) > most:
                main, most = k, held(k)
            k = ends[k]
        else:
            k += 1

    def needed(k: int) -> bool:
        """Whether an element holds the article, or the only text."""
        return k in spared or k < main < ends[k] and (tokens[k][1] not in _NEVER or tokens[k][1] in _HOLDERS)

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            own = len(text) - linked
            out.append((text, own if 2 * own > len(text) else 0, article > 0))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    k, skipped = 0, False
    while k < n:
        text, name, ending, attributes = tokens[k]
        if not skipped:
            add(text)
        skipped = False
        if name in _BLOCKS or name in _NEVER:
            close()
            links = 0
        elif name == "br":
            parts.append(" ")
        if name == "a":
            links = 0 if ending else 1
        if name in ("article", "main"):
            article = max(0, article + (-1 if ending else 1))
            any_article = True
        elif k in ends and _beside(name, attributes, article > 0) and not needed(k):
            close()
            # The tag that closes an element without an end tag is still to be read, the text before it not.
            skipped, k = k not in owned, ends[k]
            continue
        k += 1
    if not skipped:
        add(rest)
    close()
    return out, any_article and any(x[2] for x in out)


def regions(lengths: list[float], window: int, threshold: float) -> list[tuple[int, int]]:
    """Line ranges from each surge point to its dive point.

    A window's sum counts for each of its lines; a range is cut back to lines that have length.
    """
    n = len(lengths)
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    high = [False] * n
    for k in range(n):
        hi = min(n, k + window)
        if total[hi] - total[k] >= threshold:
            high[k:hi] = [True] * (hi - k)
    out, k = [], 0
    while k < n:
        if not high[k]:
            k += 1
            continue
        end = k
        while end < n and high[end]:
            end += 1
        a, b = k, end
        while a < b and not lengths[a]:
            a += 1
        while b > a and not lengths[b - 1]:
            b -= 1
        if a < b:
            out.append((a, b))
        k = end
    return out


def surge_threshold(lengths: list[int], surge: float = SURGE) -> float:
    """``surge`` times the geometric mean of the lengths of lines that have any."""
    logs = [math.log(x) for x in lengths if x]
    return surge * math.exp(sum(logs) / len(logs)) if logs else 0.0


def kept_lines(lines: list[tuple[str, int, bool]], marked: bool, *, window: int = WINDOW_LINES, surge: float = SURGE) -> list[int]:
    """The numbers of the lines between surge and dive points."""
    weights = [ARTICLE_FACTOR * len(t) if inside else n for t, n, inside in lines]
    threshold = surge_threshold([len(t) if inside else n for t, n, inside in lines], surge)
    out: list[int] = []
    start = 0
    for k in range(1, len(lines) + 1):
        if k < len(lines) and lines[k][2] == lines[start][2]:
            continue
        for a, b in regions(weights[start:k], window, threshold):
            a, b = a + start, b + start
            if marked and not lines[start][2]:  # beside an article, only lines that reach it alone begin and end
                while a < b and weights[a] < threshold:
                    a += 1
                while b > a and weights[b - 1] < threshold:
                    b -= 1
            # Beside an article, a line without weight is none of it; elsewhere a list of links may stand in the text.
            out += [j for j in range(a, b) if weights[j] or not marked]
        start = k
    return out


def main_text(page: str | None, *, window: int = WINDOW_LINES, surge: float = SURGE) -> str:
    """Blocks between surge and dive points, two line breaks between them; empty for null or no text."""
    if not page:
        return ""
    lines, marked = blocks(page)
    found = kept_lines(lines, marked, window=window, surge=surge)
    if not found:  # too little to surge: the lines with text of their own
        return "\n\n".join(t for t, n, _ in lines if 2 * n > len(t))
    return "\n\n".join(lines[k][0] for k in found)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``.

    A null or empty page has an empty text.  Repeated rows are read each on its own, a page cut
    off in a tag or an element is read up to there, and other columns are ignored.  Pages of any
    length are read whole, in time linear in it.  Equal sums (ties) at the threshold surge.
    """

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: main_text(p if isinstance(p, str) else None))

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), read(html_col).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
