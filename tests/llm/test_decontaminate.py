from __future__ import annotations

import hashlib
import re

from loomwork.llm.decontaminate import drop_contaminated, find_contamination
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for name, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(name))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= names
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert rows(find_contamination(docs, bench)) == want and sum(w[5] for w in want) > 10
    # many blocks give the same as one
    assert rows(find_contamination(docs, bench, block_chars=3000)) == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "short item"), (3, None), (4, ""), (5, "!!!"), (6, "Échelle des MOTS"), (2, "another text here"), (None, "w0 w1"), (7, "solo"), (8, "a a a a a a a a a a a")]
    docs = [(1, long.upper()), (2, "x short ITEM, y"), (3, None), (4, ""), (4, "w5-w6.w7 w8 w9 w10 w11 w12 w13 w14"), (5, "w0 w1 w2"), (None, "Échelle des mots"), (6, "ÉCHELLE DES MOTS"), (7, "a " * 500), (8, "solo " * 3 + "another text here")]
    ddf = spark.createDataFrame([(d, t, "i") for d, t in docs], "doc_id bigint, text string, items string")
    idf = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    want = brute(docs, [(i, t) for i, t in items if i is not None])
    assert rows(find_contamination(ddf, idf)) == want
    kept = drop_contaminated(ddf, idf)
    assert kept.columns == ddf.columns and sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(d), str(t)) for (d, t) in docs if not brute([(d, t)], [(i, x) for i, x in items if i is not None])[0][5])
    assert not any(r[5] for r in rows(find_contamination(ddf, idf.where("false")))) and find_contamination(ddf.where("false"), idf).count() == 0
    assert drop_contaminated(ddf, idf.where("false")).count() == len(docs)


def test_very_long_texts_and_common_words(spark):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    ddf = spark.createDataFrame([(1, text + " a b c d e f g h i j"), (2, "a " * 100_000)], "doc_id bigint, text string")
    idf = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a " * 30), (3, "w4999 w0 w1 w2 w3 w4 w5 w6 w7 w8")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in find_contamination(ddf, idf).collect()}
    assert got == {1: (200_010, 10 + 39 * 10, ["1", "3"]), 2: (100_000, 100_000, ["2"])}


def test_many_words_are_counted_in_a_join(spark, monkeypatch):
    from loomwork.llm import decontaminate

    docs, bench = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = rows(find_contamination(docs, bench))
    monkeypatch.setattr(decontaminate, "SENT_IDS", 10)
    assert rows(find_contamination(docs, bench)) == want
