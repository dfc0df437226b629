"""Traps of the operators: nulls, ties, empty inputs, repeated keys."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import calibration, clustering, compare, evaluation, filters, hierarchy, linking, ordering, proposals, quality, review, similarity, snapshots, summaries
from loomwork.session import durable

A = "id bigint, control_id string, hub_id string, confidence double, is_ood boolean, provenance string, review_status string, original_hub_id string, reviewer_notes string"


def assignments(spark, *more):
    base = [
        (1, "f1:c1", "h1", 0.9, False, "model_prediction", "accepted", None, None),
        (2, "f1:c2", "h1", 0.6, None, "model_prediction", "accepted", None, None),
        (3, "f1:c3", "h2", None, False, "model_prediction", "accepted", None, None),
        (4, "f1:c4", "h2", 0.2, False, "model_prediction", "accepted", None, None),
        (5, "f2:c1", "h1", 0.7, False, "model_prediction", "accepted", None, None),
        (6, "f2:c2", "h3", 0.8, False, "model_prediction", "pending", None, None),
        (7, "f2:c3", "h3", 0.9, False, "ground_truth_ai", "accepted", None, None),
    ]
    return spark.createDataFrame(base + list(more), A)


def controls(spark):
    return spark.createDataFrame([(f"f{f}:c{c}", f"f{f}", f"c{c}", f"Title {c}", "d") for f in (1, 2) for c in (1, 2, 3, 4)], "id string, framework_id string, section_id string, title string, description string")


def hubs(spark):
    return spark.createDataFrame([("r", "Root", None, 0), ("h1", "One", "r", 1), ("h2", "Two", "r", 1), ("h3", "Three", "r", 1)], "id string, name string, parent_id string, depth int")


def test_export_filter_drops_nulls(spark, rows):
    out = filters.exportable(assignments(spark), controls(spark), overrides={"f2": 0.75})
    assert rows(out, "id") == [(1,)]  # null is_ood, null confidence, low, below f2's floor, pending, truth


def test_gap_reasons_take_the_least_bad(spark, rows):
    out = filters.gap_reasons(assignments(spark), controls(spark))
    got = {r.control_id: (r.reason, r.detail) for r in out.collect()}
    assert got["f1:c4"] == ("below_floor", "0.20") and got["f1:c3"][0] == "null_confidence" and got["f1:c2"][0] == "ood"
    assert got["f2:c2"] == ("not_accepted", "pending") and got["f2:c3"][0] == "ground_truth" and got["f2:c4"][0] == "unassigned"
    assert "f1:c1" not in got


def test_compare(spark, rows):
    scope = compare.in_scope(assignments(spark), controls(spark))
    eq = compare.equivalences(scope, hubs(spark)).collect()
    assert [(r.hub_id, r.frameworks, r.n_controls) for r in eq] == [("h1", "f1,f2", 3)]
    assert rows(compare.pair_overlap(scope)) == [("f1", "f2", 1)]
    assert all(a < b for _, a, b, _, _ in rows(compare.related_siblings(scope, hubs(spark))))


def test_empty_tables(spark):
    none = assignments(spark).where("false")
    scope = compare.in_scope(none, controls(spark))
    assert compare.equivalences(scope, hubs(spark)).isEmpty() and compare.gap_controls(scope, hubs(spark)).isEmpty()
    assert summaries.review_metrics(none).first().accepted_rate is None
    assert summaries.framework_metadata(spark.createDataFrame([("f9",)], "id string"), controls(spark), none).first().coverage_type == "model_prediction"


def test_resolver_strategies(spark):
    c = spark.createDataFrame(
        [("m:A.1", "m", "A.1", "Mit"), ("a:a:V1", "a", "a:V1", "Verify"), ("n:cm", "n", "x-2", "CM-2 BASE"), ("n:mem", "n", "y", "Memorized Secrets"), ("o:ai-p", "o", "ai-program", "AI Program")],
        "id string, framework_id string, section_id string, title string",
    )
    links = spark.createDataFrame(
        [(1, "m", "A.1"), (2, "a", "V1"), (3, "n", "CM-2 BASE"), (4, "n", "memorized secrets"), (5, "o", "AI PROGRAM"), (6, "o", "zzz"), (7, "o", None)], "link_id int, framework_id string, section_id string"
    )
    got = {r.link_id: (r.control_id, r.strategy) for r in linking.resolve_sections(links, c).collect()}
    assert got[1] == ("m:A.1", "direct") and got[2] == ("a:a:V1", "prefixed") and got[3] == ("n:cm", "title_exact") and got[4] == ("n:mem", "title_lower")
    assert got[5][0] == "o:ai-p" and got[6] == (None, "unresolved") and got[7] == (None, "unresolved")


def test_best_provenance_ties_by_id(spark, rows):
    a = assignments(spark, (9, "f1:c1", "h1", 0.1, False, "ground_truth", "accepted", None, None), (8, "f1:c1", "h1", 0.2, False, "ground_truth", "accepted", None, None))
    out = linking.best_provenance(a, ["ground_truth", "model_prediction"]).where("control_id = 'f1:c1'")
    assert rows(out, "id") == [(8,)]


def test_longest_description_first_of_equals(spark, rows):
    df = spark.createDataFrame([("a", "xx", 0), ("a", "yy", 1), ("a", None, 2), ("b", None, 3)], "control_id string, description string, pos int")
    assert rows(linking.longest_description(df)) == [("a", "xx", 0), ("b", None, 3)]


def test_sanitize(spark):
    df = spark.createDataFrame([("a\x00b &lt;b&gt;bold&lt;/b&gt; ﬁne exam-\nple​  x y",), ("   ",), (None,), ("é",)], "t string")
    got = [r.s for r in df.select(T.sanitize(F.col("t")).alias("s")).collect()]
    assert got == ["a b bold fine example x y", None, None, "é"]
    cut = spark.createDataFrame([("aaaa bbbb cccc",), ("aaaaaaaaaaaaaa",), ("short",)], "t string").select(T.cut_at_space(F.col("t"), 10)).collect()
    assert [r[0] for r in cut] == ["aaaa bbbb", "aaaaaaaaaa", "short"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("Foo & Bar--Baz!", "Linked To", "", "x"), ("???", "Contains", None, "y")], "a string, l string, b string, c string")
    got = [tuple(r) for r in df.select(T.slug(F.col("a")), T.link_type(F.col("l")), T.join_present(F.col("b"), F.col("c"))).collect()]
    assert got == [("foo-bar-baz", "LinkedTo", "x"), (None, None, "y")]
    ids = spark.createDataFrame([('say ["1-2", "3-4"]',), ("see 12-34 and 12-34 and 5-6",), ("none",)], "t string").select(T.mentioned_ids(F.col("t"))).collect()
    assert [r[0] for r in ids] == [["1-2", "3-4"], ["12-34", "5-6"], []]


def test_tree(spark, rows):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("o", "Orphan"), ("x", "X"), ("y", "Y")], "id string, name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "zz"), ("x", "y"), ("y", "x")], "parent_id string, child_id string")
    got = {r.id: r for r in hierarchy.build_tree(nodes, edges).collect()}
    assert got["c"].path == "A > B > C" and got["c"].depth == 2 and got["c"].branch_root_id == "a" and got["c"].is_leaf
    assert got["o"].depth == 0 and got["o"].is_leaf and got["x"].depth == 0 and len(got) == 6  # a cycle's nodes become roots
    assert hierarchy.integrity_issues(hierarchy.build_tree(nodes, edges)).isEmpty()
    one_way = spark.createDataFrame([("a", "b")], "hub_a string, hub_b string")
    assert rows(hierarchy.integrity_issues(hubs(spark), one_way)) == [("one_way", "a"), ("unknown_related", "a")]


def test_bridges_are_symmetric(spark):
    related = spark.createDataFrame([("a", "c"), ("c", "a")], "hub_a string, hub_b string")
    out = {r.hub_a: r.related for r in hierarchy.add_bridges(related, spark.createDataFrame([("a", "b"), ("a", "b")], "hub_a string, hub_b string")).collect()}
    assert out == {"a": ["b", "c"], "b": ["a"], "c": ["a"]}


def test_diff_compares_nulls(spark, rows):
    old = spark.createDataFrame([("k1", None), ("k2", 1), ("k3", 1), ("k5", None)], "k string, v int")
    new = spark.createDataFrame([("k1", None), ("k2", 2), ("k4", 1), ("k5", 3)], "k string, v int")
    assert rows(snapshots.diff(old, new, ["k"], ["v"]), "operation", "k") == [("add", "k4"), ("delete", "k3"), ("update", "k2"), ("update", "k5")]


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([("g", 1, None), ("g", 2, "x")], "g string, a int, b string")
    h = lambda df: snapshots.content_hash(df, "g", ["a", "b"]).first().content_hash
    assert h(a) == h(a.orderBy(F.desc("a")).repartition(3)) and h(a) != h(a.na.fill("x")) and h(a) != h(a.union(a))


def test_decisions(spark):
    a = assignments(spark, (-1, "cal", "h1", 0.5, False, "model_prediction", "pending", None, None))
    d = spark.createDataFrame([(1, "reassigned", "h3", "why"), (2, "rejected", None, None), (6, "pending", None, None), (-1, "accepted", None, None)], "id bigint, status string, reviewer_hub_id string, notes string")
    got = {r.id: r for r in review.apply_decisions(a, d).collect()}
    assert (got[1].hub_id, got[1].original_hub_id, got[1].confidence, got[1].review_status) == ("h3", "h1", None, "accepted")
    assert got[1].reviewer_notes == "[Reassigned from hub h1] why" and got[2].review_status == "rejected" and got[6].review_status == "pending" and got[-1].review_status == "pending"
    issues = {(r.id, r.rule) for r in quality.review_issues(spark.createDataFrame([(1, "reassigned", None), (99, "accepted", None), (2, "maybe", "nope")], "id bigint, status string, reviewer_hub_id string"), a, hubs(spark)).collect()}
    assert issues == {(1, "missing_hub"), (99, "unknown_id"), (2, "unknown_status"), (2, "unknown_hub"), (2, "needless_hub")}


def test_import_truth_once(spark, rows):
    links = spark.createDataFrame([("f1:c1", "h1", "LinkedTo"), ("f1:c1", "h9", "LinkedTo"), ("f1:c1", "h9", "AutomaticallyLinkedTo")], "control_id string, hub_id string, link_type string")
    assert rows(review.import_truth(assignments(spark), links), "control_id", "hub_id", "source_link_id") == [("f1:c1", "h9", "AutomaticallyLinkedTo")]


def test_calibration_items(spark):
    df = spark.createDataFrame([(f"c{i}", "h", i / 30) for i in range(30)], "control_id string, hub_id string, confidence double")
    out = review.calibration_items(df, 5, 5, 10, 1).collect()
    assert sorted(r.id for r in out) == list(range(-20, 0)) and len({r.control_id for r in out}) == 20
    assert [r.control_id for r in sorted(out, key=lambda r: -r.id)][:5] == ["c29", "c28", "c27", "c26", "c25"]


def vectors(spark, n=30, d=8):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(f"i{k}", [float(v) for v in r]) for k, r in enumerate(x)], "item_id string, embedding array<float>"), x


def test_block_top_k_equals_plain(spark, monkeypatch):
    items, _ = vectors(spark)
    hub = items.where("item_id < 'i2'").withColumnRenamed("item_id", "hub_id")
    plain = {(r.item_id, r.hub_id, r["rank"]) for r in similarity.top_k(similarity.similarities(items, hub), 3).collect()}
    monkeypatch.setattr(similarity, "HUB_BLOCK", 4)
    assert {(r.item_id, r.hub_id, r["rank"]) for r in similarity.top_hubs(items, hub, 3).collect()} == plain
    assert similarity.top_hubs(items, hub, 50).count() == items.count() * hub.count()  # k beyond n: all


def test_prediction_sets_keep_empty(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    probs = spark.createDataFrame([("a", "h1", 0.9), ("a", "h2", 0.1), ("b", "h1", 0.2)], "item_id string, hub_id string, p double")
    got = {r.item_id: r.hubs for r in calibration.prediction_sets(items, probs, 0.5).collect()}
    assert got == {"a": ["h1"], "b": []}


def test_calibration_error_edges(spark):
    df = spark.createDataFrame([(1.0, True), (0.2, False), (0.199, False)], "confidence double, correct boolean")
    assert calibration.calibration_error(df).first().ece == pytest.approx((0 + 0.2 + 0.199) / 3, abs=1e-6)


def test_ranking_metrics_count_misses(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "item_id string, best int")
    r = evaluation.ranking_metrics(df).first()
    assert (r.hit1, r.hit5, r.mrr, r.n) == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), pytest.approx((1 + 1 / 3) / 3, abs=1e-6), 3)


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([(f, float(i % 3 == 0)) for f in "ab" for i in range(20)], "fold string, value double")
    a, b = evaluation.bootstrap(df, 300, 7).first(), evaluation.bootstrap(df.repartition(3), 300, 7, tasks=3).first()
    assert a == b and a.lo < a["mean"] < a.hi


def test_hashed_split_is_exact(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = {r.part: r["count"] for r in evaluation.hashed_split(df, "k", {"cal": 10, "canary": 5}, "train", 1).groupBy("part").count().collect()}
    assert got == {"cal": 10, "canary": 5, "train": 85}


def test_validator(spark):
    c = spark.createDataFrame(
        [("f", "a", 0, "T", "x" * 60, None), ("f", "a", 1, "T", "x" * 60, None), ("f", "b c", 2, "T", "short", None), ("f", "d", 3, "Same text " * 6, "same text " * 6, None), ("f", "e", 4, "T", "See section 4", None), ("f", "g", 5, None, None, None)],
        "framework_id string, control_id string, pos int, title string, description string, full_text string",
    )
    got = {(r.pos, r.rule) for r in quality.validate_controls(c).collect()}
    assert {(1, "duplicate_control_id"), (2, "problematic_control_id_chars"), (2, "empty_description"), (3, "title_description_redundancy"), (4, "reference_only_description"), (4, "short_description"), (5, "empty_description")} <= got
    assert not any(p == 0 for p, _ in got)
    f = spark.createDataFrame([("f", "1", ""), ("Bad", "1", "u")], "framework_id string, version string, source_url string")
    assert {(r.framework_id, r.rule) for r in quality.validate_frameworks(f, c).collect()} == {("f", "low_control_count"), ("f", "missing_source_url"), ("Bad", "zero_controls"), ("f", "invalid_framework_id")}


def test_guardrails(spark):
    one, near, far = [1.0, 0.0], [0.99, 0.141], [0.0, 1.0]
    c = spark.createDataFrame([(1, one, 5, 2), (2, near, 4, 2), (3, far, 3, 2), (4, far, 2, 2)], "cluster_id int, centroid array<double>, n_controls long, n_frameworks long")
    h = spark.createDataFrame([("h1", one), ("h2", far)], "hub_id string, embedding array<double>")
    got = {r.cluster_id: (r.failed, r.parent_hub_id) for r in proposals.guardrails(c, h, budget=1).collect()}
    assert got == {1: (None, "h1"), 2: ("separation", "h1"), 3: ("budget", "h2"), 4: ("evidence", "h2")}


def test_deep_trees_and_cycles(spark):
    deep = [(f"n{k:03d}", f"N{k}") for k in range(60)]
    nodes = spark.createDataFrame([*deep, ("x", "X"), ("y", "Y")], "id string, name string")
    edges = spark.createDataFrame([*((f"n{k:03d}", f"n{k + 1:03d}") for k in range(59)), ("x", "y"), ("y", "x")], "parent_id string, child_id string")
    tree = durable(hierarchy.build_tree(nodes, edges))
    assert tree.where("id = 'n059'").first().depth == 59 and tree.where("depth = 0").count() == 3
    assert hierarchy.integrity_issues(tree).isEmpty()
    loop = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "x"), ("r", None)], "id string, parent_id string")
    assert {(r.ancestor_id, r.id, r.distance) for r in hierarchy.descendants(loop).collect()} >= {("x", "y", 1), ("y", "x", 1), ("y", "z", 2), ("r", "r", 0)}
    assert {(r.rule, r.id) for r in hierarchy.integrity_issues(loop.selectExpr("*", "0 AS depth")).collect() if r.rule == "unreachable"} == {("unreachable", c) for c in "xyz"}


def test_first_negatives_equal_brute_force(spark):
    rng = random.Random(4)
    tree = [("r", None)] + [(f"p{k}", "r") for k in range(5)]
    tree += [(f"c{k:02d}", f"p{rng.randrange(4)}") for k in range(30)]
    up = dict(tree)
    for n in (1, 3, 7):
        want = set()
        for i, p in up.items():
            sib = sorted(x for x, q in up.items() if q == p and x != i and p is not None)
            cousins = sorted(x for x, q in up.items() if p and up[p] and q != p and q and up.get(q) == up[p])
            want |= {(i, x) for x in (sib + [c for c in cousins if c not in sib])[:n]}
        got = {(r.id, r.negative_id) for r in hierarchy.hard_negatives(spark.createDataFrame(tree, "id string, parent_id string"), n).collect()}
        assert got == want, n


def test_running_sums_over_ranges(spark):
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "x int, v int").repartition(5)
    got = sorted((r.x, r.s, r.r) for r in ordering.running(df, [F.col("x")], {"s": F.col("v")}, rank="r").collect())
    total, want = 0, []
    for r, (x, v) in enumerate(sorted((k * 7 % 101, k) for k in range(101)), 1):
        total += v
        want.append((x, total, r))
    assert got == want
    least = {r.x: r.m for r in ordering.least_from_here(df, [F.col("x")], F.col("v"), "m").collect()}
    values = dict(sorted((k * 7 % 101, k) for k in range(101)))
    assert least == {x: min(v for y, v in values.items() if y >= x) for x in values}


def test_bootstraps_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(f, float(v)) for f, n in (("a", 65), ("b", 45), ("c", 64), ("d", 13), ("e", 10)) for v in rng.integers(0, 2, n)]
    got = evaluation.bootstrap(spark.createDataFrame(rows, "fold string, value double"), 2000, 3).first()
    own = [np.mean(np.concatenate([rng.choice([v for g, v in rows if g == f], sum(g == f for g, _ in rows)) for f in "abcde"])) for _ in range(2000)]
    assert got.n == 197 and abs(got.mean - np.mean([v for _, v in rows])) < 1e-6
    assert abs(got.lo - np.percentile(own, 2.5)) < 0.02 and abs(got.hi - np.percentile(own, 97.5)) < 0.02
    c = rng.random(300)
    df = spark.createDataFrame([(float(x), bool(rng.random() < x)) for x in c], "confidence double, correct boolean")
    e = calibration.bootstrap_calibration_error(df, 400, 5).first()
    assert e.n == 300 and e.ece == calibration.calibration_error(df).first().ece and e.lo <= e.hi and e.lo <= e.ece + 0.05
    a = spark.createDataFrame([("f", k, 0.0) for k in range(40)], "fold string, item_id int, value double")
    gain = evaluation.paired_delta(a, a.withColumn("value", (F.col("item_id") % 2).cast("double")), 300, 1).first()
    assert gain.mean == 0.5 and gain.p_positive == 0.0


def test_greedy_separation(spark):
    # a near b, b near c: b goes to a, so c stays
    v = {"a": [1.0, 0.0, 0.0], "b": [0.8, 0.6, 0.0], "c": [0.2, 0.98, 0.0], "d": [0.0, 0.0, 1.0]}
    for sizes, want in (((5, 4, 3, 3), {"b"}), ((3, 4, 5, 3), {"a", "b"}), ((4, 4, 4, 4), {"b"})):
        df = spark.createDataFrame([(k, n, x) for (k, x), n in zip(v.items(), sizes, strict=True)], "cluster_id string, n_controls int, centroid array<double>")
        assert {r.cluster_id for r in proposals.separated(df, 0.7).collect()} == want, sizes


def test_blocks_give_what_one_gives(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"i{k:02d}", [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(rng.normal(size=(40, 6)))], "item_id string, embedding array<double>").repartition(3)
    hub = df.where("item_id < 'i15'").withColumnRenamed("item_id", "hub_id")
    plain = {(r.item_id, r.hub_id): (round(r.sim, 9), round(r.p, 9)) for r in similarity.softmax(similarity.similarities(df, hub), 0.2).collect()}
    x = np.array([r.embedding for r in df.orderBy("item_id").collect()])
    for block in (20_000, 4):
        monkeypatch.setattr(similarity, "HUB_BLOCK", block)
        got = similarity.scored_top(df, hub, 3, 0.2).collect()
        assert len(got) == 120 and all(plain[r.item_id, r.hub_id] == (round(r.sim, 9), round(r.p, 9)) for r in got)
        near = {(r.item_id, r["rank"]): r.neighbour_id for r in similarity.nearest(df.where("item_id < 'i07'"), df, 4).collect()}
        assert near == {(f"i{i:02d}", k): f"i{j:02d}" for i in range(7) for k, j in enumerate([j for j in np.argsort(-(x @ x[i])) if j != i][:4], 1)}


def test_leaks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "hello world"), (2, "  ABCDE "), (3, "abc"), (4, "hello world"), (5, None), (6, "cdefg"), (7, "üßélan vital"), (8, "no such text")], "item_id int, text string")
    texts = spark.createDataFrame([(10, "x Hello World y"), (11, "zabcdefgh"), (12, None), (13, ""), (14, "Üßélan vital!"), (11, "zabcdefgh"), (None, "hello world"), (15, "hello  world")], "id int, text string")
    want = sorted([(1, 10), (2, 11), (4, 10), (6, 11), (7, 14), (2, 11), (6, 11), (1, None), (4, None)], key=repr)
    for part in (1 << 20, 3):
        monkeypatch.setattr(quality, "PART_BYTES", part)
        assert sorted(rows_of(quality.leaked_items(items, texts)), key=repr) == want
    assert quality.leaked_items(items.where("false"), texts).count() == 0
    assert quality.leaked_items(items, texts.where("false")).count() == 0
    with pytest.raises(ValueError):
        quality.leaked_items(items, texts, least=3)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc é") for _ in range(rng.randint(1, 9)))
    texts = [(k, " ".join(word() for _ in range(40))) for k in range(60)]
    items = [(k, texts[k % 60][1][k : k + rng.randint(3, 30)]) for k in range(80)] + [(100 + k, word() + word()) for k in range(30)]
    got = quality.leaked_items(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(texts, "id int, text string"))
    want = [(i, k) for i, n in items for k, t in texts if len(n.strip(" ")) >= 5 and n.strip(" ").lower() in t.lower()]
    assert rows_of(got) == sorted(want)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_clusters_of_near_vectors(spark):
    v = {"a": [1.0, 0.0], "b": [0.99, 0.14], "c": [0.95, 0.31], "z": [0.0, 1.0], "y": [-1.0, 0.0]}
    df = spark.createDataFrame([(k, x, "f" + k) for k, x in v.items()], "item_id string, embedding array<double>, framework_id string")
    got = {r.item_id: r.cluster_id for r in clustering.near_components(df, 0.95, 3).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}
    hubs_ = spark.createDataFrame([("h", [0.0, -1.0])], "hub_id string, embedding array<double>")
    more = [("k", [0.0, 1.0], "x"), ("l", [0.02, 1.0], "x"), ("m", [-0.02, 1.0], "y"), ("q", [0.0, -1.0], "y"), ("r", [0.02, -1.0], "y"), ("s", [0.03, -1.0], "y")]
    df = df.unionByName(spark.createDataFrame(more, df.schema))
    out = sorted((r.cluster_id, r.n_controls, r.failed) for r in proposals.propose_hubs(df, hubs_, ood_threshold=0.5).collect())
    assert out == [("a", 3, None), ("k", 4, None)]


def test_ks_p_values():
    assert calibration.ks_p_value(0.0, 50, 60) == 1.0 and calibration.ks_p_value(0.9, 500, 500) < 1e-9
    assert 5e-5 < calibration.ks_p_value(0.1, 1000, 1000) < 1.2e-4


def test_uneven_rows_and_texts(spark):
    df = spark.createDataFrame([(k,) for k in range(10)], "k int")
    assert sorted(r.k for r in evaluation.evenly_spaced(df, "k", 4).collect()) == [0, 2, 5, 7]
    with pytest.raises(ValueError):
        evaluation.hashed_split(df, "k", {"a": 11}, "rest", 1)
    t = spark.createDataFrame([("S-1", " "), ("S-1", "in S-1 here"), ("S-1", "Name")], "section_id string, name string")
    assert [r.x for r in t.select(evaluation.evaluation_text(F.col("name"), F.col("section_id")).alias("x")).collect()] == ["S-1", "in S-1 here", "S-1: Name"]
    assert evaluation.stopping(0.81, 0.5, 50) and not evaluation.stopping(0.8, 0.9, 90)


def test_resolving_sends_no_side_whole(spark):
    """Neither the links' keys nor the hits go through the driver, whatever Spark takes their size to be."""
    from loomwork import registry
    from tests.conftest import DATA

    out = registry.QUERIES["d8_resolve"](spark, f"{DATA}/sf0.001")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    strategies = {r.link_id: r.strategy for r in out.collect()}
    assert strategies["P0"] == "direct" and strategies["P1"] == "title_exact" and strategies["P3"] == "normalized" and strategies["P4"] == "unresolved"


def test_leak_anchors(monkeypatch):
    """Every text that contains an item shows its anchor, whatever the item's length and the parts; one that only shares the
    rare run does not. Texts are counted together, not each by a table of its own."""
    import random

    import numpy as np

    from loomwork.operators import quality as q

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c\u00e9") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    calls, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or plain(*a, **k))
    often = q._counted(iter(texts))
    assert len(calls) <= 2
    want = np.zeros(q.SLOTS, np.int64)
    for text in texts:
        np.add.at(want, q._slots(q._grams(text.encode())), 1)
    assert (often == want).all()
    for part in (q.PART_BYTES, 7):
        monkeypatch.setattr(q, "PART_BYTES", part)
        for n in (5, 12, 23, 24, 25, 60):
            for text in texts:
                if len(text) < n:
                    continue
                at = rng.choice([0, len(text) - n, rng.randint(0, len(text) - n)])
                gram, wide = q._anchor(text[at : at + n], often)
                short, long, hashes = np.zeros((3, q.SLOTS), bool)
                (long if wide else short)[q._slots(np.array([gram]))] = True
                hashes[q._slots(np.array([wide]))] = bool(wide)
                assert (gram, wide) in set(zip(*(x.tolist() for x in q._found(text, short, long, hashes)), strict=True))
                if wide:
                    run = int(gram).to_bytes(8, "little")[:5].decode("utf-8", "ignore")
                    assert not len(q._found("x" * 30 + run + "x" * 30, short, long, hashes)[0])
