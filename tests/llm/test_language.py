from __future__ import annotations

import zlib

import numpy as np
import pytest

from loomwork.llm.language import ByteConvNet, cut, identify_languages, spread, train, training_sample
from tests.conftest import DATA


def docs(spark, rows, schema="doc_id bigint, text string, lang string"):
    return spark.createDataFrame(rows, schema)


def corpus(spark):
    en, de = "the quick brown fox thinks that this is what they want ", "der schnelle braune fuchs denkt dass sie das nicht wollen "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12345 !!", "en"), (103, en * 3000, None), (103, en, "en"), (None, de, "de")]
    return docs(spark, rows + odd)


def test_windows_cover_every_byte():
    for n in (0, 1, 3, 4, 127, 128, 129, 500):
        w = cut(bytes(range(256))[: min(n, 256)] * (1 if n <= 256 else 2), 128, 4)
        assert w.shape[1] == 128 and len(w) >= 1
    data = np.random.default_rng(0).integers(65, 90, 1000).astype(np.uint8).tobytes()
    w = cut(data, 128, 4)
    step = 125
    assert b"".join(bytes(x[:step]) for x in w)[:1000] == data or b"".join([*(bytes(x[:step]) for x in w[:-1]), bytes(w[-1])])[:1000] == data


def test_predictions(spark):
    got = identify_languages(corpus(spark).selectExpr("*", "1 AS score", "'x' AS held_out"), per_label=50).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    assert all(by[i][0].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [by[i][0].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert [r.lang_pred for r in by[103]] == ["en", "en"] and by[None][0].lang_pred == "de" and by[None][0].held_out is False
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)


def test_nothing_to_learn(spark):
    got = identify_languages(docs(spark, [(1, "abc", None), (2, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert identify_languages(docs(spark, [])).count() == 0


def test_held_out_rows_are_not_learned(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    got = identify_languages(docs(spark, [(held, "unique words here", "xx")])).collect()
    assert got[0].lang_pred == "und"


def test_training_is_seeded():
    a, b = (train([spread(t) for t in ["aaa bbb"] * 4 + ["ccc ddd"] * 4], ["a"] * 4 + ["c"] * 4) for _ in range(2))
    assert np.array_equal(a.filters, b.filters) and a.labels == ["a", "c"]


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    r = identify_languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred AS int)) AS a").first()
    assert r.a == pytest.approx(1, abs=0.03)


def test_the_sample_is_bounded_and_has_every_label(spark):
    names = [f"l{k:03d}" for k in range(230)]
    df = docs(spark, [(k, f"text of {names[k % 230]} number {k} " * (400 if k < 230 else 1), names[k % 230]) for k in range(2300)])
    sample = training_sample(df, id_col="doc_id", text_col="text", label_col="lang", held_out=1, per_label=3)
    assert [r.label for r in sample] == sorted(r.label for r in sample) and {r.label for r in sample} == set(names)
    assert all(sum(r.label == n for r in sample) <= 3 for n in names) and {len(r.windows) for r in sample} <= {128, 256, 384, 512}


def test_long_texts_are_read_to_the_end(spark):
    en, de = "the quick brown fox thinks that this is what they want ", "der schnelle braune fuchs denkt dass sie das nicht wollen "
    df = corpus(spark).union(docs(spark, [(500, en * 100 + de * 60_000, None)]))
    assert identify_languages(df, per_label=50).where("doc_id = 500").first().lang_pred == "de"


def by_loops(net, window):
    """Log-probabilities of one window: every filter at every place, byte by byte."""
    taps, embed = net.taps, net.embedding.shape[1]
    pooled = []
    for f in range(net.filters.shape[1]):
        best = -np.inf
        for place in range(len(window) - taps + 1):
            total = 0.0
            for t in range(taps):
                for e in range(embed):
                    total += float(net.embedding[window[place + t], e]) * float(net.filters[t * embed + e, f])
            best = max(best, total)
        pooled.append(max(best + float(net.bias[f]), 0.0))
    z = [sum(p * float(w) for p, w in zip(pooled, net.dense[:, k], strict=True)) + float(net.dense_bias[k]) for k in range(len(net.labels))]
    top = max(z)
    total = top + np.log(sum(np.exp(v - top) for v in z))
    return [v - total for v in z]


def test_network_equals_plain_loops():
    texts = ["der schnelle braune fuchs", "the quick brown fox", "le renard brun rapide"] * 4
    net = train([spread(t, 24, 4) for t in texts], ["de", "en", "fr"] * 4, per_width=3, embed=2, steps=20)
    for text in ("the fox", "fuchs und du", "", "é" * 30):
        windows = cut(text.encode(), 24, 4)
        got = net.log_probabilities(windows)
        assert np.allclose(got, [by_loops(net, w) for w in windows], atol=1e-4)
    # taps beyond a filter's width stay zero through training
    assert not net.filters.reshape(4, 2, 9)[2:, :, :3].any() and net.filters.reshape(4, 2, 9)[:, :, 6:].any()


def test_a_training_step_follows_the_numerical_gradient():
    """Adam's first step goes against the sign of each gradient that is not zero: compared with differences of the loss."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(97, 101, (6, 10)).astype(np.uint8), ["a", "b"] * 3
    before = train([x[k : k + 1] for k in range(6)], y, widths=(2,), per_width=2, embed=2, epochs=0, steps=0, seed=3)
    after = train([x[k : k + 1] for k in range(6)], y, widths=(2,), per_width=2, embed=2, epochs=1, steps=0, batch=6, rate=1e-3, seed=3)

    def loss(net):
        return -np.mean([net.log_probabilities(x[k : k + 1])[0][net.labels.index(y[k])] for k in range(6)])

    checked = 0
    for name in ("embedding", "filters", "bias", "dense", "dense_bias"):
        flat = getattr(before, name)
        for i in np.ndindex(flat.shape):
            old = flat[i]
            values = []
            for d in (1e-2, -1e-2):
                flat[i] = old + d
                values.append(loss(before))
            flat[i] = old
            slope = (values[0] - values[1]) / 2e-2
            if abs(slope) > 1e-3:
                checked += 1
                assert np.sign(getattr(after, name)[i] - old) == -np.sign(slope), (name, i, slope)
    assert checked >= 10 and isinstance(after, ByteConvNet)


def test_all_windows_may_be_learned(spark):
    df = docs(spark, [(k, "some words of a long text " * 100, "en") for k in range(6)])
    kw = {"id_col": "doc_id", "text_col": "text", "label_col": "lang", "held_out": 1, "per_label": 9}
    few, every = training_sample(df, **kw), training_sample(df, **kw, per_text=None)
    assert {len(r.windows) for r in few} == {4 * 128} and {len(r.windows) for r in every} == {len(cut(b"some words of a long text " * 100, 128, 4)) * 128}
