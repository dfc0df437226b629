from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from loomwork.llm import importance as imp

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", " .,;", "one", "One TWO two", "É é x Über ÄB", "a\x00b a", "x" * 5000, "w " * 300, " ".join(f"word{i % 37}" for i in range(900)),
    "alpha beta gamma delta " * 9, "日本語 text、混ぜる", "é é",
]
TARGET = ["alpha beta gamma delta", None, "", "word1 word2 word3 " * 8]


def features(text, longest=2):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bucket(f, buckets):
    return zlib.crc32(f.encode()) % buckets


def plain(rows, target, buckets=10_000, seed=7, share=25, least=20):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(bucket(f, buckets) for f in features(x)[1])
    for x in target:
        t.update(bucket(f, buckets) for f in features(x)[1])
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    out = []
    for key, x in rows:
        words, fs = features(x)
        weight = sum(gain[bucket(f, buckets)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = share * len(may) // 100
    return out, may[:drawn]


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize(("part", "batch"), [(5, 40), (1000, 1500), (1_000_000, 2_000_000)])
def test_counts_equal_plain_python(longest, part, batch):
    counts = imp.BucketCounts(50, longest, part, batch)
    total = Counter()
    for text, (words, buckets, n) in zip(TEXTS, counts.of(TEXTS), strict=True):
        want = Counter(bucket(f, 50) for f in features(text, longest)[1])
        total.update(want)
        assert words == len(features(text)[0]) and dict(zip(buckets.tolist(), n.tolist(), strict=True)) == want and buckets.tolist() == sorted(want)
    assert {b: int(n) for b, n in enumerate(counts.total) if n} == total


def test_no_file_is_written():
    assert imp.connection().execute("SELECT current_setting('temp_directory'), current_setting('threads')").fetchone() == ("", 1)


def test_resampling_equals_plain_python(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(k, " ".join(f"n{k * i % 61}" for i in range(18 + k % 9)), "x") for k in range(100, 240)]
    rows += [(None, "alpha beta " * 12, "y"), (150, "alpha beta gamma " * 9, "z"), (150, "alpha beta gamma " * 9, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(3)
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id bigint, text string")
    got = imp.resample(df, target).collect()
    want, drawn = plain([r[:2] for r in rows], TARGET)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(((k, n, w, s) for k, _, n, w, s in want), key=key)
    ranks = {r["rank"]: (r.doc_id, r.score) for r in got if r["rank"] is not None}
    assert ranks == {i + 1: (r[0], r[4]) for i, r in enumerate(drawn)} and len(drawn) > 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert imp.resample(docs.where("false"), none).collect() == []
    (row,) = imp.resample(docs, none).collect()
    want, _ = plain([(1, "a b " * 20)], [])
    assert (row.n_features, row.weight, row.score, row["rank"]) == (*want[0][2:], None)
