"""op6: removal of every 200-byte string that starts twice or more, by bucket-pointer refinement
of sampled suffixes.

Sorting every suffix of a corpus would shuffle many times its size, so suffixes are sampled by
content: of each 200-byte window the 64-byte gram with the least hash is its anchor.  Equal
windows have equal anchors, so a window that occurs twice has an anchor that occurs twice.  All
that a window around an anchor can reach (136 bytes before the gram, 136 after) is its context.

Buckets are refined from coarse to fine, and only what a step leaves open goes on:

1. Anchors are dealt by their gram.  Grams met once drop out.
2. What is left is dealt by gram and context hash.  Equal contexts are settled at once: all of
   the context repeats.  Of each context, one place stands for the others from here on.
3. Grams with different contexts: the bytes of each context are fetched, and all their suffixes
   are refined together: buckets of 50-byte grams, then of pairs of bucket numbers 50 bytes
   apart, then of pairs of those 100 bytes apart.  Positions alone in their bucket drop out at
   each step; what remains starts twice.
4. Grams with more than ``HOT`` different contexts never meet in one task: each of their windows
   is dealt by its own hash.

Hot groups: a task settles what its own chunk holds twice before any shuffle and sends on one row
of it, so a group has at most one row a chunk.  Texts move only where they must: those with a
context still open, and those of which a part stays.  Strings are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEED, SENT_IDS, inverse_power, kept, mixed, powers, times_seed, utf8

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM
FIRST = 50
#: Different contexts of a gram beyond which its windows are dealt one by one.
HOT = 5000
#: Bytes of contexts that are refined together.
BATCH_BYTES = 2 << 20
#: Anchors that a task gathers before it settles what it holds twice.
CHUNK_ANCHORS = 400_000
#: Bytes of a text that are looked at together (longer texts in overlapping parts).
PART_BYTES = 4 << 20
_PLACE_BITS = 24


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    value = raw.astype(np.uint64) + np.uint64(1)
    value *= powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return total


def gram_hashes(raw: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` bytes."""
    n = len(raw)
    if n < q:
        return np.zeros(0, np.uint64)
    return _gram_hashes(prefix_sums(raw), q)


def _gram_hashes(total: np.ndarray, q: int) -> np.ndarray:
    n = len(total) - 1
    out = total[q:] - total[:-q]
    out *= powers(n + 1)[q : n + 1][::-1]
    out *= inverse_power(n)
    return mixed(out)


def range_hashes(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the bytes lo to hi of each range, wherever they stand."""
    n = len(total) - 1
    out = (total[hi] - total[lo]) * powers(n + 1)[n - lo] * inverse_power(n)
    return mixed(out ^ ((hi - lo).astype(np.uint64) * SEED))


def least_grams(h: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of ``length`` bytes, the place of its gram of least hash (leftmost on ties)."""
    w = length - gram + 1
    count = len(h) - w + 1
    if count < 1:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = ranked
    grid = padded.reshape(-1, w)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(after[:count], before[w - 1 : w - 1 + count]) & low).astype(np.int64)


def anchors(data: bytes, part_bytes: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the grams that are the least of some window, their hashes, and their contexts'."""
    n = len(data)
    at, key, context = [], [], []
    for first in range(0, n - LENGTH + 1, part_bytes):
        # The windows that start in [first, first + part_bytes), and the contexts of their grams.
        base = max(0, first - REACH)
        stop = min(n, first + part_bytes + LENGTH - 1)
        raw = np.frombuffer(data, np.uint8, min(n, stop + LENGTH) - base, base)
        total = prefix_sums(raw)
        h = _gram_hashes(total, GRAM)
        least = least_grams(h[first - base : stop - base - GRAM + 1]) + (first - base)
        here = np.unique(least)
        lo, hi = np.maximum(here - REACH, 0), np.minimum(here + LENGTH, len(raw))
        at.append(here + base)
        key.append(h[here])
        context.append(mixed(range_hashes(total, lo, hi) ^ ((here - lo).astype(np.uint64) * times_seed(3))))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place, once = np.unique(np.concatenate(at), return_index=True)
    return place, np.concatenate(key)[once], np.concatenate(context)[once]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return inverse, counts


def refine(texts: list[bytes], length: int = LENGTH, first: int = FIRST) -> list[np.ndarray]:
    """For each text, the positions whose ``length`` bytes also start elsewhere in ``texts``.

    ``length`` must be ``first`` times a power of two.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    end = np.repeat(starts[1:], sizes)  # where the text of each position ends
    at = np.flatnonzero(np.arange(len(raw)) + first <= end)
    bucket = np.full(len(raw), -1, np.int64)
    inverse, counts = _grouped(gram_hashes(raw, first)[at]) if len(at) else (at, at)
    keep = counts[inverse] > 1 if len(at) else np.zeros(0, bool)
    bucket[at[keep]] = inverse[keep]
    at, span = at[keep], first
    while span < length and len(at):
        # A position stays if the one ``span`` later is in a bucket of its own text still.
        at = at[at + 2 * span <= end[at]]
        at = at[bucket[at + span] >= 0]
        inverse, counts = _grouped((bucket[at] << 32) | bucket[at + span]) if len(at) else (at, at)
        keep = counts[inverse] > 1 if len(at) else np.zeros(0, bool)
        bucket = np.full(len(raw), -1, np.int64)
        bucket[at[keep]] = inverse[keep]
        at, span = at[keep], 2 * span
    cut = np.searchsorted(at, starts)
    return [at[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], starts[:-1], strict=True)]


def covered(positions: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start at sorted ``positions``."""
    if not len(positions):
        return []
    split = np.flatnonzero(np.diff(positions) > length)
    first = positions[np.concatenate([[0], split + 1])]
    last = positions[np.concatenate([split, [len(positions) - 1]])] + length
    return list(zip(first.tolist(), last.tolist(), strict=True))


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a union of ranges."""
    out: list[list[int]] = []
    for x, y in sorted(zip(a.tolist(), b.tolist(), strict=True)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


#: What a row says of its place: met once in its chunk; its context is settled; its gram has
#: several contexts in the chunk; that a chunk holds such a gram (a row for each, no place).
PLAIN, SETTLED, OPEN, MARK = range(4)
_ANCHOR = "key long, c long, flag byte, salt int, w long, t int, pos int, right short, n byte"


def _anchor_chunk(key: np.ndarray, c: np.ndarray, w: np.ndarray, t: np.ndarray, pos: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((c, key))
    key, c, w, t, pos, right = (x[order] for x in (key, c, w, t, pos, right))
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
    n = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
    contexts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
    several = (contexts > 1)[np.cumsum(new_key) - 1]
    flag = np.where(new, np.where(several, OPEN, PLAIN), SETTLED).astype(np.int8)
    spread = (mixed(w.view(np.uint64) ^ (pos.astype(np.uint64) * times_seed(1))) >> np.uint64(33)).astype(np.int32) | 1
    rows = pd.DataFrame({"key": key.view(np.int64), "c": c.view(np.int64), "flag": flag, "salt": np.where(flag == PLAIN, 0, spread).astype(np.int32),
                         "w": w, "t": t, "pos": pos.astype(np.int32), "right": right.astype(np.int16), "n": np.minimum(n, 2).astype(np.int8)})
    marks = rows[new_key & several].assign(flag=np.int8(MARK), salt=np.int32(0), n=np.int8(2), w=0, t=np.int32(0), pos=np.int32(-1), c=0)
    return pd.concat([rows, marks]) if len(marks) else rows


def _anchor_rows(batches: Iterator[pd.DataFrame], chunk: int, part_bytes: int) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for pdf in batches:
        for text, w, t in zip(pdf["text"], pdf["w"], pdf["t"], strict=True):
            data = utf8(text)
            at, key, c = anchors(data, part_bytes)
            held.append((key, c, np.full(len(at), w, np.int64), np.full(len(at), t, np.int32), at, np.minimum(len(data) - at, LENGTH)))
            size += len(at)
            if size >= chunk:
                yield _anchor_chunk(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield _anchor_chunk(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, text (the bytes of a context), w, t, lo for each open place of a text."""
    for pdf in batches:
        rows = []
        for text, w, t, spots in zip(pdf["text"], pdf["w"], pdf["t"], pdf["spots"], strict=True):
            data = utf8(text)
            for s in spots:
                lo = max(0, s["pos"] - REACH)
                rows.append((s["key"], data[lo : s["pos"] + LENGTH], w, t, lo))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["key", "text", "w", "t", "lo"])
                    rows = []
        yield pd.DataFrame(rows, columns=["key", "text", "w", "t", "lo"])


def _windows(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """h, salt, w, t, start, n: the windows of each open place whose anchor it is; those that a
    chunk holds twice are salted (and settled), but for one of them."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pd.DataFrame:
        h, w, t, start = (np.concatenate(x) for x in zip(*held, strict=True))
        _, one, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        first = np.zeros(len(h), bool)
        first[one] = True
        spread = (mixed(w.view(np.uint64) ^ (start.astype(np.uint64) * times_seed(1))) >> np.uint64(33)).astype(np.int32) | 1
        return pd.DataFrame({"h": h.view(np.int64), "salt": np.where(first, 0, spread), "w": w, "t": t, "start": start, "n": np.minimum(counts[inverse], 2)})

    for pdf in batches:
        for text, w, t, spots in zip(pdf["text"], pdf["w"], pdf["t"], pdf["spots"], strict=True):
            data = utf8(text)
            for s in spots:
                lo = max(0, s["pos"] - REACH)
                total = prefix_sums(np.frombuffer(data[lo : s["pos"] + LENGTH], np.uint8))
                start = np.flatnonzero(least_grams(_gram_hashes(total, GRAM)) == s["pos"] - lo)
                held.append((range_hashes(total, start, start + LENGTH), np.full(len(start), w, np.int64), np.full(len(start), t, np.int32), start + lo))
                size += len(start)
                if size >= chunk:
                    yield flush()
                    held, size = [], 0
    if size:
        yield flush()


def stretches(parts: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """Overlapping parts (w, t, start, bytes) of a text as one, so that no place stands twice."""
    out: list[tuple[int, int, int, bytes]] = []
    pieces: list[bytes] = []
    end = -1
    for w, t, lo, text in sorted(parts):
        if out and out[-1][:2] == (w, t) and lo <= end:
            if lo + len(text) > end:
                pieces.append(text[end - lo :])
                end = lo + len(text)
        else:
            if out:
                out[-1] = (*out[-1][:3], b"".join(pieces))
            out.append((w, t, lo, b""))
            pieces, end = [text], lo + len(text)
    if out:
        out[-1] = (*out[-1][:3], b"".join(pieces))
    return out


def _refined(batches: Iterator[pd.DataFrame], batch_bytes: int) -> Iterator[pd.DataFrame]:
    """w, t, a, b from contexts sorted by key: those of whole keys are refined in batches."""
    parts: list[tuple[int, int, int, bytes]] = []
    held, last_key = 0, None

    def flush() -> pd.DataFrame:
        whole = stretches(parts)
        out = [(w, t, lo + a, lo + b) for (w, t, lo, _), at in zip(whole, refine([x[3] for x in whole]), strict=True) for a, b in covered(at)]
        return pd.DataFrame(out, columns=["w", "t", "a", "b"])

    for pdf in batches:
        for key, text, w, t, lo in zip(*(pdf[c] for c in ("key", "text", "w", "t", "lo")), strict=True):
            if key != last_key and held >= batch_bytes:
                yield flush()
                parts, held = [], 0
            last_key = key
            parts.append((w, t, lo, text))
            held += len(text)
    if parts:
        yield flush()


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [merged(np.array([r["a"] for r in x]), np.array([r["b"] for r in x])) for x in pdf["ranges"]]
        yield pd.DataFrame({"w": pdf["w"], "t": pdf["t"], "n_removed": [sum(b - a for a, b in x) for x in found], "n_spans": [len(x) for x in found],
                            "runs": [[y for r in x for y in r] for x in found]})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, runs in zip(pdf["text"], pdf["runs"], strict=True):
            data, at, digest = utf8(text), 0, hashlib.sha256()
            for a, b in zip(runs[::2], runs[1::2], strict=True):
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append(digest.hexdigest())
        yield pd.DataFrame({"w": pdf["w"], "t": pdf["t"], "kept_sha256": out})


def _with_texts(rows: DataFrame, other: DataFrame) -> DataFrame:
    """``other`` (w, t, ...; a row a text) joined with the texts.  A list of few enough names goes
    to the scan, so that other texts do not move; a longer one meets them in a shuffle."""
    texts = rows.select("w", "t", "text")
    names = other.select("w", "t")
    if names.count() <= SENT_IDS:
        texts = texts.join(F.broadcast(names), ["w", "t"], "left_semi")
    return texts.join(other, ["w", "t"])


def repeated_ranges(rows: DataFrame, hot: int, batch_bytes: int, chunk: int, part_bytes: int) -> DataFrame:
    """w, t, a, b: byte ranges of texts that repeated strings cover.

    ``rows``: w, t (two hashes that name a row's id and text), text.
    """
    spark = rows.sparkSession
    long = rows.where(F.octet_length("text") >= LENGTH)
    found = long.mapInPandas(partial(_anchor_rows, chunk=chunk, part_bytes=part_bytes), _ANCHOR)
    # Grams: a chunk has one row of a gram at most without a salt.
    gram = Window.partitionBy("key", "salt")
    several = (F.max("flag").over(gram) == MARK) | (F.min("c").over(gram) != F.max("c").over(gram))
    met = found.select("*", F.sum("n").over(gram).alias("total"), several.alias("several")).where(f"pos >= 0 AND (total > 1 OR flag IN ({SETTLED}, {OPEN}))")
    met = met.select("key", "c", F.when(F.col("flag") == SETTLED, F.col("salt")).otherwise(0).alias("salt"), "w", "t", "pos", "right", "n", F.when(F.col("flag") == OPEN, True).otherwise(F.col("several")).alias("several"))
    # Contexts: again one row a chunk; the first place stands for the others.
    context = Window.partitionBy("key", "c", "salt")
    first = F.row_number().over(context.orderBy("w", "t", "pos")) == 1
    places = met.select("key", "w", "t", "pos", "right", ((F.col("salt") != 0) | (F.sum("n").over(context) > 1)).alias("settled"),
                        ((F.col("salt") == 0) & F.col("several") & first).alias("open"))
    places, drop_places = kept(places, "places")
    opened = places.where("open").select("key", "w", "t", "pos")
    # Written first: its size is known, so Spark broadcasts it while it is small and splits hot keys beyond.
    hot_keys, drop_keys = kept(opened.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("key", F.lit(True).alias("hot")), "hot")
    spots, drop_spots = kept(opened.join(hot_keys, "key", "left").select("key", "w", "t", "pos", F.coalesce("hot", F.lit(False)).alias("hot")), "spots")

    def by_text(part: DataFrame) -> DataFrame:
        return _with_texts(long, part.groupBy("w", "t").agg(F.collect_list(F.struct("pos", "key")).alias("spots")))

    around = by_text(spots.where("NOT hot")).mapInPandas(_contexts, "key long, text binary, w long, t int, lo int")
    ranges = around.repartition("key").sortWithinPartitions("key").mapInPandas(partial(_refined, batch_bytes=batch_bytes), "w long, t int, a int, b int")
    if not spots.where("hot").isEmpty():
        windows = by_text(spots.where("hot")).mapInPandas(partial(_windows, chunk=chunk), "h long, salt int, w long, t int, start int, n int")
        counted = windows.select("*", F.sum("n").over(Window.partitionBy("h", "salt")).alias("total")).where("salt <> 0 OR total > 1")
        ranges = ranges.union(counted.select("w", "t", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")))
    ranges = ranges.union(places.where("settled").select("w", "t", F.greatest(F.col("pos") - REACH, F.lit(0)).alias("a"), (F.col("pos") + F.col("right")).cast("int").alias("b")))
    listed = ranges.groupBy("w", "t").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    runs, _ = kept(listed.mapInPandas(_runs, "w long, t int, n_removed long, n_spans long, runs array<int>"), "runs")
    for drop in (drop_spots, drop_keys, drop_places):
        drop()
    return runs


def remove_repeated(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, batch_bytes: int = BATCH_BYTES, chunk: int = CHUNK_ANCHORS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``runs`` (start, end, start, ... of
    the removed bytes; null if none are) for each row of ``docs``.

    A null text is empty and a text of fewer than 200 bytes keeps all.  Repeated rows, of one id
    or several, are copies of each other and lose all their bytes if they have 200.  Ties (equal
    strings) have no order: every one goes.  Very long texts are read in overlapping parts of
    ``part_bytes``.  A null id is an id like others.  Other columns are ignored, and an empty
    table gives no rows.  ``hot``, ``batch_bytes``, ``chunk`` and ``part_bytes`` change how the
    work is dealt, not the result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("w"), F.hash("text").alias("t"), "text")
    runs = repeated_ranges(rows.drop("doc_id"), hot, batch_bytes, chunk, part_bytes)
    facts, _ = kept(rows.select("doc_id", "w", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "facts")
    parts = runs.join(facts.select("w", "t", "n_bytes").distinct(), ["w", "t"]).where("n_removed < n_bytes").select("w", "t", "runs")
    # Rows of one id and text are copies: nothing of them stays, so a row of ``parts`` has one text.
    cut = _with_texts(rows, parts).mapInPandas(_hashed, "w long, t int, kept_sha256 string")
    out = facts.join(runs.join(cut, ["w", "t"], "left"), ["w", "t"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.when(F.col("n_removed").isNull(), F.col("sha")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        "runs",
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS g FROM d, unnest(range(0, n - 199)) AS u(i) WHERE n >= 200),
hot AS (SELECT g FROM win GROUP BY 1 HAVING count(*) > 1),
pos AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM win JOIN hot USING (g)),
isl AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM pos),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM isl GROUP BY 1, 2),
keep AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT r.doc_id, max(r.b), any_value(d.n) FROM runs r JOIN d USING (doc_id) GROUP BY 1),
kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS s FROM keep JOIN d USING (doc_id) GROUP BY 1),
tot AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(s, sha256(unhex(h))) AS kept_sha256
FROM d LEFT JOIN tot ON tot.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
