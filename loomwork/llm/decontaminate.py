"""op10: benchmark passages in documents by a prefix-filtered set join.

An item's windows are its runs of ten words.  A window occurs only where all its words do, so
one word of it is enough to find candidates: its rarest over the corpus (the one-token prefix
that a containment of 1 needs).  Documents are joined on those tokens; the place of the token
gives where the window would begin and end, which must lie inside the document; what remains
is compared word by word.

All words of the benchmark are counted in one pass over the corpus.  Matching takes one pass for
each block of items, whose index (a few numbers a word) goes to every task; a benchmark of one
block needs one.  Between blocks the hits are written, so no task holds more than one index.
Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_IDS, alnum_table, persisted, utf8, word_hashes, word_spans

#: Text of the benchmark in one block (about; a single longer item is a block of its own).
BLOCK_CHARS = 8_000_000
#: Candidates of one document that are looked at together.
CANDIDATES = 1 << 20
_FILTER_BITS = 20


class Seen:
    """Membership of word hashes in a set: a bit table first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(self.keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes``, and which key stands there."""
        at = np.flatnonzero(self.table[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        good = self.keys[k] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[good], k[good]


class Index:
    """Windows of one block by their rarest word, as arrays over the words of its items."""

    def __init__(self, items: list[tuple[object, str | None]], rarity: tuple[np.ndarray, np.ndarray], size: int):
        keep = alnum_table()
        texts = [utf8(t).lower() for _, t in items]
        self.data = b" ".join(texts)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        _, self.starts, self.ends = word_spans(self.data, keep)
        self.words = word_hashes(self.data, keep)
        owner = np.searchsorted(bounds, self.starts, "right") - 1
        self.names = [str(name) for name, _ in items]
        n = len(self.words)
        counts = np.zeros(n, np.int64)
        if len(rarity[0]) and n:
            k = np.minimum(np.searchsorted(rarity[0], self.words), len(rarity[0]) - 1)
            counts = np.where(rarity[0][k] == self.words, rarity[1][k], 0)
        # Each word begins a window, if its item goes on for long enough or is shorter in all.
        first = np.searchsorted(owner, np.arange(len(items)))
        many = np.bincount(owner, minlength=len(items)) if n else np.zeros(len(items), np.int64)
        width = np.minimum(many, size)[owner] if n else np.zeros(0, np.int64)
        start = np.flatnonzero(np.arange(n) + width <= (first + many)[owner]) if n else np.zeros(0, np.int64)
        width = width[start]
        best = start.copy()
        for j in range(1, size):  # the place of the least count in each window, the first on ties
            at = start + np.minimum(j, width - 1)
            best = np.where(counts[at] < counts[best], at, best)
        order = np.argsort(self.words[best], kind="stable")
        small = lambda x: x.astype(np.int32)
        self.starts, self.ends = small(self.starts), small(self.ends)
        self.start, self.width, self.place, self.owner = (small(x[order]) for x in (start, width, best - start, owner[start]))
        keys = self.words[best[order]]
        self.seen = Seen(keys)
        self.cuts = np.append(np.searchsorted(keys, self.seen.keys), len(keys))

    def hits(self, data: bytes, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of ``data`` that are windows, and the items they are of."""
        at, key = self.seen.find(hashes)
        ranges: set[tuple[int, int]] = set()
        items: set[str] = set()
        spans = None
        many = self.cuts[key + 1] - self.cuts[key]
        total = np.concatenate([[0], np.cumsum(many)])
        lo = 0
        while lo < len(at):
            # As many tokens together as have a bounded number of windows (one token at least).
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CANDIDATES, "right")) - 1)
            m = many[lo:hi]
            window = np.repeat(self.cuts[key[lo:hi]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            a = np.repeat(at[lo:hi], m) - self.place[window]
            b = a + self.width[window]
            good = (a >= 0) & (b <= len(hashes))
            a, b, window = a[good], b[good], window[good]
            good = (hashes[a] == self.words[self.start[window]]) & (hashes[b - 1] == self.words[self.start[window] + self.width[window] - 1])
            for x, y, w in zip(a[good].tolist(), b[good].tolist(), window[good].tolist(), strict=True):
                s = int(self.start[w])
                if not np.array_equal(hashes[x:y], self.words[s : s + y - x]):
                    continue
                if spans is None:
                    spans = word_spans(data, alnum_table())
                if all(data[spans[1][x + i] : spans[2][x + i]] == self.data[self.starts[s + i] : self.ends[s + i]] for i in range(y - x)):
                    ranges.add((x, y))
                    items.add(self.names[self.owner[w]])
            lo = hi
        return sorted(ranges), items


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")


def _counted(batches: Iterator[pd.DataFrame], wanted: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """h, c: how often words stand in a task's texts (those ``wanted``, else all)."""
    keep = alnum_table()
    if wanted is not None:
        seen = Seen(wanted)
        total = np.zeros(len(seen.keys), np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                total += np.bincount(seen.find(word_hashes(utf8(text).lower(), keep))[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"h": seen.keys[some].view(np.int64), "c": total[some]})
        return
    for pdf in batches:
        found = [word_hashes(utf8(t).lower(), keep) for t in pdf["text"]]
        h, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pd.DataFrame({"h": h.view(np.int64), "c": c})


def word_counts(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """h, c: how often each word of the benchmark stands in the corpus, in one pass over it.

    Up to ``SENT_IDS`` different words go to the tasks, which count those alone; with more, tasks
    count all their words and the benchmark's are picked in a join."""
    own = persisted(items.mapInPandas(lambda batches: _counted(batches, None), "h long, c long").select("h").distinct(), "words")
    texts = docs.select(F.col(text_col).alias("text"))
    if own.count() <= SENT_IDS:
        shared = docs.sparkSession.sparkContext.broadcast(np.array([r.h for r in own.collect()], np.int64).view(np.uint64))
        found = texts.mapInPandas(lambda batches: _counted(batches, shared.value), "h long, c long")
        return persisted(found.groupBy("h").agg(F.sum("c").alias("c")), "counts")
    found = texts.mapInPandas(lambda batches: _counted(batches, None), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return persisted(found.join(own, "h"), "counts")


def indexes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_chars: int) -> Iterator[Index]:
    """An index of each block of items: bounded parts of the benchmark, one at a time."""
    items = benchmark_items(benchmark, item_col, item_text_col)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if not chars:
        return
    items = persisted(items, "items")
    counts = word_counts(docs, items, text_col)
    n = -(-chars // block_chars)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        words = part.mapInPandas(lambda batches: _counted(batches, None), "h long, c long").select("h").distinct()
        known = sorted((r.h & 0xFFFFFFFFFFFFFFFF, r.c) for r in counts.join(words, "h").collect())
        index = Index([(r.item, r.text) for r in part.collect()], (np.array([h for h, _ in known], np.uint64), np.array([c for _, c in known], np.int64)), window)
        if len(index.start):
            yield index


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and ``items`` (their ids as
    strings, sorted) of each row of ``docs``.

    Null or empty texts and items have no words and no hits; null item ids are left out; of
    repeated item ids every text counts, and items with the same window (ties) are all named.
    Repeated documents are judged each on its own, texts of any length whole; other columns are
    ignored.  An empty benchmark hits nothing, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hit = "ranges array<int>, items array<string>"

    def matched(index: Broadcast | None) -> DataFrame:
        """Every row with its number of words and its hits; ``index``: a broadcast or None."""

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keep = alnum_table()
            for pdf in batches:
                out = []
                for doc_id, text, w, t in zip(pdf["doc_id"], pdf["text"], pdf["w"], pdf["t"], strict=True):
                    data = utf8(text).lower()
                    hashes = word_hashes(data, keep)
                    ranges, names = index.value.hits(data, hashes) if index else ([], set())
                    out.append((doc_id, w, t, len(hashes), [x for r in ranges for x in r], sorted(names)))
                yield pd.DataFrame(out, columns=["doc_id", "w", "t", "n_words", "ranges", "items"]).astype({"doc_id": pdf["doc_id"].dtype})

        named = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("w"), F.hash("text").alias("t"))
        return named.mapInPandas(match, f"doc_id {kind}, w long, t int, n_words long, {hit}")

    parts: list[Broadcast] = []
    hits: DataFrame | None = None
    found: DataFrame | None = None
    for index in indexes(docs, benchmark, text_col, item_col, item_text_col, window, block_chars):
        if found is not None:  # a second block: hits are written, block by block
            part = persisted(found.where("size(ranges) > 0").select("w", "t", "ranges", "items").dropDuplicates(["w", "t"]), "hits")
            hits = part if hits is None else hits.union(part)
            parts.pop().unpersist()
        parts.append(spark.sparkContext.broadcast(index))
        found = matched(parts[-1])
    if found is None:
        found = matched(None)
    if hits is not None:
        last = persisted(found, "hits")
        hits = hits.union(last.where("size(ranges) > 0").select("w", "t", "ranges", "items").dropDuplicates(["w", "t"]))
        hits = hits.groupBy("w", "t").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
        found = last.drop("ranges", "items").join(hits, ["w", "t"], "left").select("doc_id", "n_words", none("ranges", "int"), none("items", "string"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_hit, sha, listed = [], [], []
            for n, ranges, items in zip(pdf["n_words"], pdf["ranges"], pdf["items"], strict=True):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.asarray(ranges[::2], np.int64), 1)
                np.add.at(edge, np.asarray(ranges[1::2], np.int64), -1)
                n_hit.append(int((np.cumsum(edge) > 0).sum()))
                listed.append(sorted(items))
                sha.append(hashlib.sha256(",".join(listed[-1]).encode()).hexdigest())
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": pdf["n_words"], "n_hit": n_hit, "n_items": list(map(len, listed)), "items_sha256": sha})
            yield out.assign(contaminated=out["n_hit"] > 0, items=listed)

    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return found.select("doc_id", "n_words", "ranges", "items").mapInPandas(digest, schema)


def free_of(index: Broadcast):
    """A function of texts: true where no window of the (broadcast) index occurs."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        keep = alnum_table()
        lowered = [utf8(t if isinstance(t, str) else None).lower() for t in texts]
        return pd.Series([not index.value.hits(d, word_hashes(d, keep))[0] for d in lowered], dtype=bool)

    return clean


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their own columns.

    Between blocks of the benchmark what is left is written."""
    left = docs
    for k, index in enumerate(indexes(docs, benchmark, text_col, item_col, item_text_col, window, block_chars)):
        left = persisted(left, "clean") if k else left
        left = left.where(free_of(docs.sparkSession.sparkContext.broadcast(index))(F.col(text_col)))
    return left


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM win), unnest(range(1, len(w) - k + 2)) AS u(i)),
hits AS (SELECT doc_id, i, k, item_id FROM pos JOIN win USING (k, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""
