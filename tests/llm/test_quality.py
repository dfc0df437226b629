from __future__ import annotations

import duckdb
import numpy as np

from loomwork.llm import quality_rules as q
from loomwork.llm.quality_model import STATISTICS, KernelRidge, isotonic, score_quality, statistics, summed
from tests.conftest import DATA

TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h " * 10, " ".join(f"w{i}" for i in range(40)), "\n".join(["same line here"] * 12), " ".join(f"w{i}###" for i in range(30)),
    " ".join(f"W{i}!!" for i in range(30)), "one two three four five six seven eight nine ten eleven twelve\x0bthirteen\x0cfourteen " + " ".join(f"x{i}" for i in range(20)),
    "x" * 200_000, " ".join(f"t{i % 977}" for i in range(20_000)), "a b c d e f g h i a b c d e f g h " + " ".join(f"u{i}" for i in range(30)), "é ü ñ " * 9,
]


def reference(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_signals_equal_reference(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words string")
    got = {r.doc_id: r for r in q.quality_report(df).collect()}
    for k, t in enumerate(TEXTS):
        r = got[k]
        want = reference(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (k, want, r)
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.kept and r.base_failed)
    assert got[5].kept and not any(got[k].kept for k in (0, 1, 2, 3, 4, 6, 7, 8))


def test_filter_agrees_with_report_in_any_order(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words string")
    kept = {r.doc_id for r in q.quality_report(df).where("kept").collect()}
    for flip in (1, -1):
        fake = {"seconds": {r.name: 1.0 + flip * i / 10 for i, r in enumerate(q.RULES)}, "verdicts": {frozenset(r.name for r in q.RULES): 1}}
        out = q.keep_good(df, measured=fake)
        assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
        assert {r.doc_id for r in q.quality_report(df, measured=fake).where("kept").collect()} == kept
    assert q.keep_good(df.where("false")).count() == 0 and q.quality_report(df.where("false")).count() == 0


def test_order_is_by_what_a_rule_adds():
    cost = {"too_short": 1.0, "repeated_windows": 8.0, "symbols": 2.0, "shouting": 1.0, "word_length": 1.0, "repeated_lines": 4.0}
    verdicts = {frozenset(): 50, frozenset(["too_short", "word_length"]): 30, frozenset(["repeated_windows"]): 16, frozenset(["symbols"]): 8, frozenset(["word_length"]): 1}
    # word_length rejects most, but after it too_short rejects nothing more
    assert [r.name for r in q.cascade({"seconds": cost, "verdicts": verdicts})] == ["word_length", "symbols", "repeated_windows", "shouting", "too_short", "repeated_lines"]


def test_measured_over_the_whole_table(spark):
    df = spark.createDataFrame([(k, "one two three" if k % 2 else " ".join(f"w{k}{i}" for i in range(40))) for k in range(3000)], "doc_id bigint, text string").repartition(6)
    m = q.measure(df, "text", sample_rows=600)
    n = sum(m["verdicts"].values())
    assert 400 < n < 800 and set(m["seconds"]) == {r.name for r in q.RULES} and all(s > 0 for s in m["seconds"].values())
    assert abs(sum(c for bad, c in m["verdicts"].items() if "too_short" in bad) / n - 0.5) < 0.1


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.001/documents.parquet'")
    cur = con.execute(q.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in q.quality_report(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")).collect())
    assert got == want


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = q.quality_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_scores_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, labels)
    assert out.count() == docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    held = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95 and len({r.score for r in held}) > len(held) / 2
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97


def test_normal_equations_equal_one_sum(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((200, len(STATISTICS))).astype(np.float32), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<float>, y double").repartition(9)
    model = KernelRidge.of(len(STATISTICS), 16, 0.6, 1)
    z = model.features(x)
    for fan_in in (2, 64):
        a, b = summed(df, model, fan_in)
        assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_edges(spark):
    docs = spark.createDataFrame([(k, t, "q") for k, t in enumerate(TEXTS)] + [(None, "x", "q"), (1, "again", "q")], "doc_id bigint, text string, quality string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(TEXTS))] + [(5, 0), (None, 1), (77, 1), (6, None)], "doc_id bigint, quality int")
    a = sorted((str(r.doc_id), r.score, r.predicted) for r in score_quality(docs, labels).collect())
    assert len(a) == len(TEXTS) + 2 and all(p == (s >= 0.3) for _, s, p in a)
    assert {r.score for r in score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert score_quality(docs.where("false"), labels).count() == 0
    assert all(np.isfinite(statistics(t)).all() for t in TEXTS)


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1] and np.interp(2.5, x, y) == 0.5


def plain_statistics(text):
    """The statistics from words and lines as Python has them."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    many = lambda chars: sum(raw.count(c.encode()) for c in chars)
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    chars = sum(b > 32 for b in raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        min(np.log(1 + n) / 12, 1), min(many("#*$%&|<>") / n, 2) / 2, min(many("!") / n, 2) / 2, upper / max(upper + lower, 1), sum(48 <= b <= 57 for b in raw) / chars, min(chars / n / 20, 1),
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0, len(set(lines)) / len(lines), sum(b > 127 for b in raw) / chars,
        min(np.log(1 + n / len(lines)) / 8, 1), min(many(".,") / n, 1),
    ]


def test_whole_score_equals_plain_numpy(spark):
    """Every step again, without Spark: statistics, kernel ridge, and isotonic values by their min-max definition."""
    import zlib

    sf = f"{DATA}/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "labels"))
    mark = {r.doc_id: float(r.quality) for r in labels if r.quality is not None}
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5, plain_statistics(r.text)) for r in docs]
    x = np.array([s for _, _, s in rows], np.float32)
    assert np.allclose(x, np.array([statistics(r.text) for r in docs], np.float32), atol=1e-6)
    rng = np.random.default_rng(11)
    w, phase = rng.normal(0, 1 / 0.6, (len(STATISTICS), 192)), rng.uniform(0, 2 * np.pi, 192)
    z = np.hstack([np.cos(x @ w + phase) * np.sqrt(2 / 192), np.ones((len(x), 1))])
    fold = np.array([k for _, k, _ in rows])
    known = np.array([d in mark for d, _, _ in rows])
    y = np.array([mark.get(d, 0.0) for d, _, _ in rows])
    learn, calibrate = known & (fold > 1), known & (fold == 1)
    weights = np.linalg.solve(z[learn].T @ z[learn] + 1e-3 * np.eye(193), z[learn].T @ y[learn])
    raw = z @ weights
    binned = np.clip(np.floor((raw[calibrate] + 0.5) / 2 * 2000), 0, 1999)
    bins = sorted(set(binned))
    r, v, n = (np.array([f(b) for b in bins]) for f in (lambda b: raw[calibrate][binned == b].mean(), lambda b: y[calibrate][binned == b].mean(), lambda b: (binned == b).sum()))
    mean = lambda a, b: (v[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum()
    level = np.array([max(min(mean(a, b) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))])
    block = np.concatenate([[0], np.cumsum(np.diff(level) > 1e-12)])
    centres = [(r[block == k] * n[block == k]).sum() / n[block == k].sum() for k in range(block[-1] + 1)]
    values = [level[block == k][0] for k in range(block[-1] + 1)]
    want = np.clip(0.98 * np.interp(raw, centres, values) + 0.02 / (1 + np.exp(1 - 2 * raw)), 0, 1)
    got = {s.doc_id: s.score for s in score_quality(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))).collect()}
    assert np.allclose([got[d] for d, _, _ in rows], want, atol=1e-5) and 0 < want.min() < 0.1 < 0.9 < want.max() < 1
