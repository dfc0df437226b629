from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomwork.functions import document_fields as fields
from loomwork.plans import documents
from loomwork.plans.verbs import Crosswalk
from loomwork.plans.views import Views
from loomwork.sources import readers, writers
from loomwork.sources.versions import VersionLog
from tests.conftest import DATA


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_fields(spark):
    assert one(spark, fields.last_token(F.col("t")), [("Area - Sub - IAM",), ("alone",), (None,)], "t string") == ["IAM", "alone", None]
    rows = [("Spec", {"A": "one", "B": None}), (" ", {"A": "one"}), ("Spec", {}), ("Spec", None), (None, None)]
    assert one(spark, fields.with_guidelines(F.col("s"), F.col("g")), rows, "s string, g map<string,string>") == ["Spec\n\nA: one\nB: ", "A: one", "Spec", "Spec", None]
    assert one(spark, fields.distinct_captures(F.col("t"), r"(GV|MP)-\d"), [("MP-1 GV-2 MP-3",), ("none",), (None,)], "t string") == [["GV", "MP"], [], []]
    assert one(spark, fields.level_by_file(F.col("t"), {"threat": "threat", "control": "control"}, "other"), [("1_Threats.md",), ("controls.md",), ("x",), ("threat_controls",)], "t string") == ["threat", "control", "other", "threat"]


def test_positional(spark):
    a = spark.createDataFrame([("f", 3, "x"), ("f", 9, "y"), ("g", 1, "z")], "file string, pos long, text string")
    b = spark.createDataFrame([("f", 0, "A"), ("f", 1, "B"), ("f", 2, "C")], "file string, pos long, name string")
    got = sorted(((r.file, r.text or "", r.name) for r in fields.positional(a, b).collect()), key=repr)
    assert got == sorted([("f", "x", "A"), ("f", "y", "B"), ("f", "", "C"), ("g", "z", None)], key=repr)


def test_guide_and_bundle(spark, tmp_path):
    v = Views(spark, f"{DATA}/sf0.001")
    from loomwork.operators.hierarchy import build_tree

    cw = Crosswalk(v.controls(), build_tree(*v.nodes()), v.assignments())
    cw.write_review(str(tmp_path / "r"))
    lines = lambda name: [json.loads(x) for p in sorted((tmp_path / "r" / name).glob("part-*")) for x in p.read_text().splitlines()]
    hubs = lines("hubs")
    assert [h["path"] for h in hubs] == sorted(h["path"] for h in hubs) and sum(h["is_leaf"] for h in hubs) >= 1 and len(hubs) == v.hubs().count()
    guide = "".join(p.read_text() for p in (tmp_path / "r" / "guide").glob("part-*"))
    rows = lines("assignments")
    assert f"| **all** | {len(rows)} |" in guide and all(f"| {k} | {sum(r['priority'] == k for r in rows)} |" in guide for k in documents.MINUTES)
    empty = documents.reviewer_guide(spark.createDataFrame([], "priority string"))
    assert "| **all** | 0 | | 0.0 to 0.0 |" in empty


def test_cards(spark, tmp_path):
    many = spark.range(1500).select(F.format_string("f%04d", "id").alias("fold"), (F.col("id") / 1500.0).alias("hit1"), F.lit(2).alias("n"))
    assert sum(x.startswith(("| f0", "| f1")) for x in writers.card("All", many, "fold").split("\n")) == 1500  # no row is left out
    few = spark.createDataFrame([("a", 0.5, None, 10), ("b", 1.0, 0.25, 30), ("c", None, 0.75, 10)], "fold string, hit1 double, mrr double, n long")
    text = writers.metrics_card("Model", few, "fold", ["hit1", "mrr"], intro="Held-out folds.", sources=[("One", "CC0")])
    assert "| **all** | 0.875 | 0.375 | 50 |" in text and "Held-out folds." in text and "* One: CC0" in text and text.count("| a |") == 1
    v = Views(spark, f"{DATA}/sf0.001")
    cw = Crosswalk(v.controls(), v.hubs().withColumn("path", F.col("name")), v.assignments())
    log = VersionLog(spark, str(tmp_path / "log"))
    assert cw.publish_dataset(log, "Crosswalk", "first", licence="CC BY") == 1
    card = log.read("card").first().text
    assert card.startswith("# Crosswalk\n") and f"{log.read('crosswalk').count()} assignments" in card and "## Frameworks" in card


def test_holdout_is_kept(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "log"))
    items = spark.range(40).withColumnRenamed("id", "item")
    first = documents.save_holdout(log, items, "item", {"holdout": 10}, "train", 1)
    again = documents.save_holdout(log, items, "item", {"holdout": 20}, "train", 2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(first) == rows(again) and sum(p == "holdout" for _, p in rows(first)) == 10 and log.versions() == [1]


def test_latest_proposals(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "name string, round int")
    assert sorted(r.name for r in documents.latest_proposals(rows).collect()) == ["b", "c"]
    assert documents.latest_proposals(rows.where("false")).count() == 0


def test_united_sources(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), (None, 3)], "id string, n int")
    b = spark.createDataFrame([("y", 9, "b"), ("z", 8, "b"), (None, 7, "b")], "id string, n int, more string")
    got = sorted(map(tuple, readers.united({"first": a, "second": b}, ["id"]).select("id", "n", "source", "more").collect()), key=repr)
    assert got == sorted([("x", 1, "first", None), ("y", 2, "first", None), ("z", 8, "second", "b"), (None, 3, "first", None), (None, 7, "second", "b")], key=repr)


def test_numbers_of_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"folds": [{"name": "a", "hit1": 0.5}, {"hit1": 1}], "t": {"value": 0.07, "on": True}, "none": None}))
    (tmp_path / "n.json").write_text("[3]")
    got = {(r.file, r.name): r.value for r in readers.read_numbers(spark, str(tmp_path)).collect()}
    assert got == {("m.json", "folds.0.hit1"): 0.5, ("m.json", "folds.1.hit1"): 1.0, ("m.json", "t.value"): 0.07, ("n.json", "0"): 3.0}
