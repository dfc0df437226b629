from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm.near_duplicates import bitmap, block_links, keep_one, near_duplicates, overlap_bound, set_clashes, told_apart
from loomwork.llm.substrings import LENGTH, anchors, merged, refine, remove_repeated
from loomwork.operators.clustering import components


def sets(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s, label = [(d, sets(t)) for d, t in rows], {d: d for d, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return sorted((d, len(x), root(d)) for d, x in s)


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    shared = " ".join(word() for _ in range(12))
    rows = []
    for k in range(n):
        base = [word() for _ in range(rng.randint(3, 80))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy[: rng.choice([len(copy), len(copy) - 2])] + ([shared] if rng.random() < 0.3 else [])))
    rows += ["", None, "   ", "one two", "ONE two", "one  two\n", rows[0].upper(), shared, shared]
    return list(enumerate(rows, 10))


def test_components_equal_brute_force(spark):
    for seed in (3, 4):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id bigint, text string, e string, n int").repartition(5)
        want = brute([(d, t) for d, t in rows])
        # tiles of three are large: worked through in blocks of two, of twenty, or all at once
        for dealt in ({}, {"large_tile": 3, "block_sets": 2}, {"large_tile": 2, "block_sets": 20}):
            got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, **dealt).collect())
            assert got == want, dealt


def test_blocks_equal_brute_force():
    rng = np.random.default_rng(2)
    for percent in (50, 75, 100):
        base = [np.unique(rng.integers(0, 2**60, 40, dtype=np.uint64)) for _ in range(4)]
        every = [np.unique(np.concatenate([b[: 40 - k], rng.integers(0, 2**60, k, dtype=np.uint64)])) for b in base for k in (0, 1, 3, 8, 20)]
        comps = [i // 2 for i in range(len(every))]
        want = {(i, j) for i, x in enumerate(every) for j, y in enumerate(every) if i < j and comps[i] != comps[j] and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}

        def joined(pairs):
            root = {}

            def find(v):
                while root.get(v, v) != v:
                    v = root[v]
                return v

            for i, j in pairs:
                p, q = sorted((find(comps[i]), find(comps[j])))
                root[q] = p
            return [find(c) for c in comps]

        for k in (len(every), 7):
            left, right = every[:k], every[k:] if k < len(every) else None
            found = set(block_links(left, right, comps, percent))
            allowed = want if right is None else {(i, j) for i, j in want if i < k <= j}
            assert found <= allowed and joined(found) == joined(allowed)


def test_sets_with_one_fingerprint_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 9, "a"), (1, 6, 9, "b"), (1, 5, 8, "c"), (2, 5, 9, "d"), (1, 5, 9, "e")], "e long, f long, n int, x string")
    assert set_clashes(rows.where("x IN ('a', 'd', 'e')")) is None
    got = {r.x: r.e for r in told_apart(rows, set_clashes(rows)).collect()}
    assert got["a"] == got["e"] and len({got["a"], got["b"], got["c"], got["d"]}) == 4 and got["d"] == 2


def test_threshold_is_exact(spark):
    # 4 words differ at the end of n + 4 words: overlap n - 4 + ..., around the 0.75 boundary
    rows = [(i, " ".join([*(f"w{j}" for j in range(20 + i // 2)), *(f"{'x' if i % 2 else 'y'}{i}{j}" for j in range(3))])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()) == brute(rows)


def test_repeated_and_missing_ids(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(5, t), (5, t), (5, "other words that are here now"), (7, t), (None, t), (8, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (5, 2, 5), (7, 3, 5), (None, 3, None), (8, 0, 8)], key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, 5, None, 8], key=str)
    assert near_duplicates(df.where("false")).count() == 0


@given(st.sets(st.integers(0, 2**40), max_size=300), st.sets(st.integers(0, 2**40), max_size=300), st.sets(st.integers(0, 2**40), max_size=200))
@settings(max_examples=80, deadline=None)
def test_bitmaps_bound_from_above(a, b, both):
    x, y = a | both | {1}, b | both | {2}
    p, q = (np.array(sorted(s), np.uint64) for s in (x, y))
    assert overlap_bound(bitmap(p), bitmap(q), len(x), len(y)) >= len(x & y)


def test_long_chain(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 101)], "a bigint, b bigint"))
    got = {r.v: r.comp for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert components(edges.where("false")).count() == 0


def removed(texts):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - LENGTH + 1):
            seen.setdefault(t[i : i + LENGTH], []).append((k, i))
    flags = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                flags[k][i : i + LENGTH] = b"\1" * LENGTH
    return flags


@pytest.mark.parametrize("dealt", [{}, {"hot": 3, "chunk": 40, "batch_bytes": 1}, {"hot": 1, "chunk": 1}, {"part_bytes": 100}])
def test_repeated_substrings_equal_brute_force(spark, dealt):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    para = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 80))), rng.choice(para)[: rng.randint(150, 420)]]
        rng.shuffle(parts)
        texts.append(" ".join(parts) if rng.random() < 0.7 else parts[0])
    texts += [texts[0], texts[0], para[0] + "z" + para[0], "a" * 450, "ab" * 260, "x" * 199, "x" * 200, "", None, "short", para[1][:200], para[1][:200] + "q", "\0" * 230]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id bigint, text string, n_bytes int").repartition(7)
    flags = removed([(t or "").encode() for t in texts])
    got = {r.doc_id: r for r in remove_repeated(df, **dealt).collect()}

    for k, t in enumerate(texts):
        data, f, r = (t or "").encode(), flags[k], got[k]
        kept = bytes(b for b, x in zip(data, f, strict=True) if not x)
        spans = sum(1 for i, x in enumerate(f) if x and not (i and f[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(f), spans, hashlib.sha256(kept).hexdigest()), (k, t)


def test_hot_anchor_once_and_twice_in_a_part(spark):
    rng = random.Random(8)
    fill = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = fill(190)  # too short to be removed itself; holds the anchor of most of the passages around it
    around = [fill(5) + line + fill(5) for _ in range(5)]
    parts = [
        # each passage stands once in a part with no other occurrence of the line, and once in a part with more
        *([fill(300) + around[k] + fill(300)] for k in range(5)),
        *([fill(250) + around[k] + fill(90), fill(280) + line + fill(280), *(fill(240) for _ in range(k * 9))] for k in range(5)),
        *([fill(300) + line + fill(300)] for _ in range(4)),
    ]
    texts = [t for part in parts for t in part]
    rows, k = [], 0
    for part in parts:
        rows.append([(k + i, t) for i, t in enumerate(part)])
        k += len(part)
    rdd = spark.sparkContext.parallelize(rows, len(rows)).flatMap(lambda x: x)
    df = spark.createDataFrame(rdd, "doc_id bigint, text string")
    want = [sum(f) for f in removed([t.encode() for t in texts])]
    assert sum(x > 0 for x in want) == 10
    for hot in (3, 18, 5000):
        # a batch of one byte: no group is refined together with another
        got = {r.doc_id: r.n_removed for r in remove_repeated(df, hot=hot, batch_bytes=1, chunk=60).collect()}
        assert [got[k] for k in range(len(texts))] == want, hot


def test_repeated_rows_and_null_ids(spark):
    t = "long text " * 30
    df = spark.createDataFrame([(1, t), (1, t), (None, None), (2, "x")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_removed, r.n_spans) for r in remove_repeated(df).collect()), key=str)
    assert got == sorted([(1, 300, 1), (1, 300, 1), (None, 0, 0), (2, 0, 0)], key=str)
    assert remove_repeated(df.where("false")).count() == 0


@given(st.binary(min_size=0, max_size=700), st.integers(0, 400))
@settings(max_examples=60, deadline=None)
def test_every_window_has_an_anchor(data, cut):
    at = anchors(data)[0]
    assert all((x == y).all() for x, y in zip(anchors(data), anchors(data, 37), strict=True))
    for s in range(len(data) - LENGTH + 1):
        assert ((at >= s) & (at <= s + LENGTH - 64)).any()
    # chosen by content alone: the same window elsewhere has the same anchors inside
    if len(data) >= LENGTH + cut:
        part = anchors(data[cut:])[0] + cut
        inner = part[(part >= cut + LENGTH) & (part < len(data) - LENGTH)]
        assert len(part) and set(inner) <= set(at)


def test_refine_and_merge():
    a, b = b"0" * 10 + bytes(range(200)) + b"1" * 9, bytes(range(200)) + b"zz"
    assert [x.tolist() for x in refine([a, b, b"q" * 150])] == [[10], [0], []]
    assert merged(np.array([5, 0, 8]), np.array([7, 5, 9])) == [(0, 7), (8, 9)] and merged(np.array([]), np.array([])) == []


def test_very_long_texts(spark):
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(150_000))
    near = long.replace("w77 ", "v77 ")
    df = spark.createDataFrame([(1, long), (2, near), (3, long[:400_000])], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: r for r in remove_repeated(df, part_bytes=100_000).collect()}
    assert got[3].n_removed == got[3].n_bytes == 400_000 and 0 < got[1].n_removed < got[1].n_bytes
    assert {r.doc_id: r.n_removed for r in remove_repeated(df).collect()} == {d: r.n_removed for d, r in got.items()}


def test_crowded_tiles_are_joined(spark, monkeypatch):
    """Tiles of crowded slots give what the window gives."""
    from loomwork.llm import near_duplicates as nd

    rng = np.random.default_rng(2)
    shared = [f"s{k}" for k in range(30)]
    texts = [" ".join([*shared, *(f"w{rng.integers(60)}" for _ in range(int(rng.integers(0, 12))))]) for _ in range(60)] + [" ".join(f"x{rng.integers(400)}" for _ in range(20)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = sorted(map(tuple, nd.near_duplicates(df).collect()))
    for crowded in (1, 25):
        monkeypatch.setattr(nd, "CROWDED", crowded)
        assert sorted(map(tuple, nd.near_duplicates(df, large_tile=10).collect())) == want
    assert len({c for _, _, c in want}) < len(want)


def test_shuffle_files_end_with_the_write(spark):
    """What a step shuffled is off the disk once the step is written (they used to stay until the driver collected its garbage)."""
    import time
    from pathlib import Path

    from loomwork.llm.common import kept
    from loomwork.session import SHUFFLES_END, durable

    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(SHUFFLES_END, None)
    held = []  # a reference that garbage collection cannot take
    for write in (lambda df: kept(df, "test")[0], lambda df: durable(df, "test")):
        df = spark.range(20_000).groupBy("id").count().repartition(3, "count")
        out = write(df)
        held.append((df, out))
        assert out.count() == 20_000
    assert spark.conf.get(SHUFFLES_END, None) == setting
    for _ in range(50):
        # The counts' own shuffles, of a few bytes, may still be there.
        left = [f for f in files() - before if f.exists() and f.stat().st_size > 10_000]
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_common_shingles_do_not_depend_on_the_corpus(spark):
    """A shingle that nine documents share is common in a large corpus too, else its tiles grow with the corpus."""
    from pyspark.sql import functions as F

    from loomwork.llm.near_duplicates import common_shingles, shingle_set

    docs = spark.range(0, 220_000, 1, 4).select(F.when(F.col("id") < 9, "one two three four five").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("text"))
    hashes, counts = common_shingles(docs, "text")
    assert hashes.tolist() == shingle_set("one two three four five").tolist() and counts.tolist() == [9]
