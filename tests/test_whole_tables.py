"""Queries over whole tables against brute force on the smallest ones."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from loomwork import registry
from loomwork.functions.text import SECRET_PATTERNS
from loomwork.operators import compare
from loomwork.plans.views import Views
from loomwork.schemas import IN_SCOPE_STATUSES
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    v = Views(spark, SF)
    return {"a": v.assignments().collect(), "fw": {r.id: r.framework_id for r in v.controls().collect()}, "hubs": {r.id: r.parent_id for r in v.hubs().collect()}}


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_comparison(spark, tables):
    scope = [(r.hub_id, tables["fw"][r.control_id], r.control_id) for r in tables["a"] if r.review_status in IN_SCOPE_STATUSES and r.control_id in tables["fw"]]
    fws, n = defaultdict(set), defaultdict(int)
    for hub, fw, _ in scope:
        fws[hub].add(fw)
        n[hub] += 1
    got = {r.hub_id: (r.frameworks, r.n_rows) for r in run(spark, "e7_equivalences")}
    assert got == {h: (",".join(sorted(f)), n[h]) for h, f in fws.items() if len(f) >= 2}
    pairs = defaultdict(int)
    for f in fws.values():
        for a in f:
            for b in f:
                pairs[a, b] += a < b
    assert {(r.fw_a, r.fw_b): r.n_hubs for r in run(spark, "d5_pair_overlap")} == {k: x for k, x in pairs.items() if x}
    up = tables["hubs"]
    related = {(a, b) for a in fws for b in fws if a < b and up.get(a) and up[a] == up.get(b) and (fws[a] != fws[b] or len(fws[a]) >= 2)}
    v = Views(spark, SF)
    whole = compare.in_scope(v.assignments(), v.controls())
    assert {(r.hub_a, r.hub_b) for r in compare.related_siblings(whole, v.hubs()).collect()} == related
    assert sum(r.n_pairs for r in compare.related_counts(whole, v.hubs()).collect()) == len(related)
    reached = {h for h, f in fws.items() if len(f) >= 2} | {h for p in related for h in p}
    matched = {c for h, _, c in scope if h in reached}
    assert {(r.framework_id, r.control_id) for r in compare.gap_controls(whole, v.hubs()).collect()} == {(f, c) for _, f, c in scope if c not in matched}


def test_knn_vote(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("concat('V', vec_id) AS item_id", "embedding", "label", "vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    sims = x @ x.T
    best = {(r.item_id, r["rank"]): r.vote for r in run(spark, "f11_knn_vote")}
    assert {k for k, _ in best} == {r.item_id for r in rows if r.vec_id % 100 == 0}
    for i, r in enumerate(rows):
        if r.vec_id % 100:
            continue
        near = [j for j in np.argsort(-sims[i], kind="stable") if j != i][:10]
        votes = defaultdict(float)
        for j in near:
            votes[rows[j].label] += max(sims[i, j], 0)
        assert abs(best[r.item_id, 1] - max(votes.values())) < 2e-6


def test_similar_pairs(spark, monkeypatch):
    from loomwork.operators import similarity

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    sims, ids = x @ x.T, [f"V{r.vec_id}" for r in rows]
    want = {}
    for i, r in enumerate(rows):
        if r.vec_id % 100 == 0:
            want |= {tuple(sorted((ids[i], ids[j]))): sims[i, j] for j in range(len(rows)) if j != i and sims[i, j] >= 0.05}
    for block in (20_000, 2):
        monkeypatch.setattr(similarity, "HUB_BLOCK", block)
        got = run(spark, "d12_similar_pairs")
        assert len(got) == len(want) and {(r.id_a, r.id_b) for r in got} == set(want)
        assert all(abs(r.sim - want[r.id_a, r.id_b]) < 2e-6 and (r.tier == "duplicate") == (want[r.id_a, r.id_b] >= 0.15) for r in got)


def test_classes_and_review(spark, tables):
    kinds = defaultdict(set)
    for r in tables["a"]:
        if r.control_id in tables["fw"]:
            kinds[r.hub_id].add(tables["fw"][r.control_id] == "Brand#1")
    name = {frozenset(): "unlinked", frozenset([True]): "ai_only", frozenset([False]): "traditional_only", frozenset([True, False]): "both"}
    assert {r.hub_id: r["class"] for r in run(spark, "h1_hub_classes")} == {h: name[frozenset(kinds[h])] for h in tables["hubs"]}
    decided = lambda r, k: r.id % 4 == k
    want = sorted((r.id, "S1" if decided(r, 2) else r.hub_id, "accepted" if decided(r, 0) or decided(r, 2) else "rejected" if decided(r, 1) else r.review_status) for r in tables["a"])
    assert sorted((r.id, r.hub_id, r.review_status) for r in run(spark, "o3_apply_decisions")) == want
    want = [(r.id, r.hub_id, "corrected" if decided(r, 2) else r.review_status) for r in tables["a"]] + [(r.id, "S1", "accepted") for r in tables["a"] if decided(r, 2)]
    assert sorted((r.id, r.hub_id, r.review_status) for r in run(spark, "o2_update_status")) == sorted(want)


def test_secrets(spark):
    want = []
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for k, line in enumerate((d.text or "").split("\n"), 1):
            want += [(d.doc_id, k, kind, m.group()[:50]) for kind, p in SECRET_PATTERNS.items() if (m := re.search(p, line, re.ASCII))]
    got = [(r.id, r.line_no, r.kind, r.match) for r in run(spark, "q3_secret_scan")]
    assert sorted(got) == sorted(want)


def test_sanitized_pages(spark):
    def clean(x):
        x = unicodedata.normalize("NFC", (x or "").replace("\0", " "))
        x = re.sub(r"</?[a-zA-Z][^>]*>", "", html.unescape(re.sub("[\u200b\u200c\u200d\ufeff]", "", x)))
        for old, new in (("ﬄ", "ffl"), ("ﬃ", "ffi"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
            x = x.replace(old, new)
        return re.sub(r"\s+", " ", re.sub(r"(\w)-\n(\w)", r"\1\2", x)).strip()

    pages = {r.page_id: clean(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in run(spark, "i1_sanitized_pages"):
        whole = pages[r.page_id]
        cut = whole[:2000]
        if len(whole) > 2000 and " " in cut and cut.rindex(" ") >= 1000:
            cut = cut[: cut.rindex(" ")].rstrip()
        assert r.text == (cut or None) and r.n_full == (len(whole) if len(whole) > 2000 else None), r.page_id
