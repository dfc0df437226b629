"""Readers, writers, verbs and the stream on small files."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwork.functions.vectors import normalised
from loomwork.plans import verbs
from loomwork.sources import readers, writers
from loomwork.streaming import feed
from tests.test_operators import assignments, controls, hubs, vectors


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_aliases_and_blanks(spark, tmp_path, rows):
    p = write(tmp_path / "a.csv", '﻿ID,Name,Text\nA1,One,"line, one"\n,,\n,Two,\n,Three,three\n')
    assert rows(readers.read_controls(spark, p), "control_id", "title", "description") == [("A1", "One", "line, one"), ("ROW-4", "Two", "Two"), ("ROW-5", "Three", "three")]
    with pytest.raises(ValueError):
        readers.read_controls(spark, write(tmp_path / "b.csv", "x,y\n1,2\n"))


def test_json_shapes(spark, tmp_path, rows):
    a = write(tmp_path / "a.json", json.dumps([{"Id": "X", "Name": "N", "Description": "D"}, 5, {"name": "only"}, {"z": 1}]))
    assert rows(readers.read_controls(spark, a), "control_id", "description") == [("ITEM-003", "only"), ("X", "D")]
    b = write(tmp_path / "b.json", json.dumps({"items": [{"id": "Y", "text": "t"}]}))
    assert rows(readers.read_controls(spark, b), "control_id", "description") == [("Y", "t")]


def test_markdown_level_and_ids(spark, tmp_path, rows):
    text = "# Doc\n\n## ASI01: First\nBody one\n### Sub\nmore\n\n## Second\n\nBody two\n# End\n## Empty\n"
    got = rows(readers.read_controls(spark, write(tmp_path / "a.md", text)), "control_id", "title", "description")
    assert got == [("ASI01", "First", "Body one\n### Sub\nmore"), ("CTRL-02", "Second", "Body two")]


def test_patterned(spark, tmp_path, rows):
    text = "Commitment 1\nMeasure 1.1 Alpha\nbody a\nMeasure 1.2 Beta\nbody b\nCommitment 2\nMeasure 2.1 Gamma\nbody c\nMeasure 1.1 Again\n"
    out = readers.read_patterned(spark, write(tmp_path / "a.txt", text), start=r"^Measure (?P<id>[\d.]+) (?P<title>.*)$", parent=r"^Commitment (?P<id>\d+)$")
    assert rows(out, "control_id", "title", "description", "parent_id") == [("1.1", "Alpha", "body a", "1"), ("1.2", "Beta", "body b", "1"), ("2.1", "Gamma", "body c", "2")]


def test_taxonomy(spark, tmp_path, rows):
    doc = lambda kind, name, sid="", sec="", i="": {"doctype": kind, "id": i, "name": name, "sectionID": sid, "section": sec, "tags": []}
    dump = {"cres": [{"doctype": "CRE", "id": "1-1", "name": "Root", "tags": [], "links": [{"ltype": "Contains", "document": doc("CRE", "Kid", i="2-2")}, {"ltype": "Linked To", "document": doc("Standard", "Std A", "S1")}, {"ltype": "Related", "document": doc("Standard", "Std A", "S2")}]}, {"doctype": "CRE", "id": "2-2", "name": "Kid", "tags": [], "links": [{"ltype": "automatically linked to", "document": doc("Standard", "Std B", "", "Sec name")}]}]}
    cres = readers.read_taxonomy(spark, write(tmp_path / "t.json", json.dumps(dump)))
    links = readers.hub_links(cres, {"Std A": "fw_a"})
    assert rows(links, "cre_id", "section_id", "section_name", "link_type", "framework_id") == [("1-1", "S1", "S1", "LinkedTo", "fw_a"), ("2-2", "Sec name", "Sec name", "AutomaticallyLinkedTo", "std_b")]
    nodes, edges = readers.taxonomy_nodes(cres)
    assert rows(edges) == [("1-1", "2-2")] and nodes.count() == 2
    assert rows(readers.standard_controls(links), "id") == [("fw_a:S1",), ("std_b:Sec name",)]


def test_frameworks(spark, tmp_path, rows):
    fw = {"framework_id": "f", "framework_name": "F", "controls": [{"control_id": "a", "title": "T", "description": "first"}, {"control_id": "a", "title": "T2", "description": "second"}, {"control_id": "b", "title": "", "description": "d", "full_text": "full"}]}
    df = readers.read_frameworks(spark, write(tmp_path / "f.json", json.dumps(fw)))
    c = readers.controls_of(df)
    assert rows(c, "id", "description") == [("f:a", "first"), ("f:b", "d")]
    assert rows(readers.control_texts(c), "text") == [("f:a: T. first",), ("f:b: full",)]
    assert readers.merge_frameworks(df, df.withColumn("framework_name", F.lit("other"))).count() == 1


def test_audit(spark):
    df = spark.createDataFrame([("111-111", "wrong", "use 222-222 not 111-111"), ("111-111", "wrong", "no idea"), ("1", "ok", "No suitable hub"), ("1", "ok", None)], "hub_id string, verdict string, notes string")
    assert [r.action for r in readers.audit_verdicts(df).collect()] == ["correct", "exclude", "exclude", "keep"]


def test_writers(spark, tmp_path):
    scoped = assignments(spark).join(controls(spark).select(F.col("id").alias("control_id"), "framework_id", "title", "section_id"), "control_id")
    writers.write_json(scoped, str(tmp_path / "j"))
    back = {(r.framework_id, r.control_id): r.hubs for r in spark.read.json(str(tmp_path / "j")).collect()}
    assert back["f1", "f1:c1"][0].hub_id == "h1"
    writers.write_csv(scoped, hubs(spark), str(tmp_path / "c"))
    csv = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert csv.count() == 7 and csv.columns == list(writers.CSV_COLUMNS)
    table = writers.standard_csv(scoped.where("id = 1"), hubs(spark), "Std")
    assert table.columns[0] == "CRE 0" and table.first()[0] == "h1|One"
    writers.write_by_framework(scoped, str(tmp_path / "p"))
    assert {r.framework_id for r in spark.read.json(str(tmp_path / "p")).select("framework_id").distinct().collect()} == {"f1", "f2"}
    m = writers.manifest(verbs.Crosswalk(controls(spark), hubs(spark), assignments(spark)).export_stats(), "1", "now")
    assert m["exported"] == 2 and m["excluded"] == m["counts"]["n_ground_truth"] + m["counts"]["n_not_accepted"] + m["counts"]["n_null_confidence"] + m["counts"]["n_below_floor"]
    writers.atomic_json({"b": 1, "a": "é"}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_verbs(spark):
    cw = verbs.Crosswalk(controls(spark), hubs(spark), assignments(spark))
    assert cw.compare(["f1", "f2"])["equivalences"].count() == 1
    with pytest.raises(ValueError):
        cw.compare(["f1"])
    assert cw.snapshot().count() == cw.controls.count() and cw.snapshot().where("size(mappings) > 0").select("framework_id").distinct().count() == 2
    d = spark.createDataFrame([(6, "accepted", None, None)], "id bigint, status string, reviewer_hub_id string, notes string")
    assert cw.review_import(d).assignments.where("id = 6").first().review_status == "accepted"
    with pytest.raises(ValueError):
        cw.review_import(d.withColumn("status", F.lit("what")))
    assert cw.inspect("h1")["siblings"].count() == 2
    rows = spark.createDataFrame([("a", "T", "x" * 2500, None, 0)], "control_id string, title string, description string, full_text string, pos int")
    out = verbs.prepare(rows, "f")["controls"].first()
    assert len(out.description) == 2000 and len(out.full_text) == 2500


def test_assign(spark):
    items, _ = vectors(spark)
    h = items.where("item_id < 'i2'").withColumnRenamed("item_id", "hub_id")
    valid = items.where("item_id < 'i2'").select("item_id", F.col("item_id").alias("hub_id"))
    fit = verbs.calibrate(items, h, valid, grid=[0.05, 0.5])
    out = verbs.assign(items, h, temperature=fit["temperature"], quantile=fit["quantile"], ood_threshold=fit["ood_threshold"], k=2)
    best = {r.item_id: r.hub_id for r in out.where("rank = 1").collect()}
    assert out.count() == items.count() * 2 and all(best[i] == i for i in best if i < "i2")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda *x: json.dumps(dict(zip(("id", "status", "reviewer_hub_id", "notes", "ts"), x, strict=True)))
    write(src / "1.json", "\n".join([line(1, "accepted", None, "", "2026-01-01T00:00:00Z"), line(1, "rejected", None, "", "2026-01-02T00:00:00Z"), line(2, "accepted", None, "", "2026-01-01T00:00:00Z")]))
    q = feed.decisions(spark, str(src), 1).writeStream.foreachBatch(feed.upsert(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    q.start().awaitTermination(120)
    write(src / "2.json", line(2, "rejected", None, "", "2026-01-03T00:00:00Z"))
    q.start().awaitTermination(120)
    out = str(tmp_path / "out")
    got = {r.id: r.status for r in feed.current(spark, out).collect()}
    assert got == {1: "rejected", 2: "rejected"}
    # a new checkpoint starts at epoch 0 again, under a run name of its own, and loses nothing; a repeated batch counts once
    more = spark.createDataFrame([(3, "accepted", None, "", datetime(2026, 1, 4))], feed.DECISIONS)
    for _ in range(2):
        feed.upsert(out, "second")(more, 0)
    feed.upsert(out, "second")(more.withColumn("id", F.lit(4).cast("long")), 7)
    assert {r.id: r.status for r in feed.current(spark, out).collect()} == {1: "rejected", 2: "rejected", 3: "accepted", 4: "accepted"} and len(feed.versions(spark, out)) == 4
    c = feed.windowed_counts(feed.decisions(spark, str(src)))
    s = c.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert sum(r.n for r in spark.sql("SELECT n FROM counts").collect()) == 4


def test_more_aliases_and_heading_ids(spark, tmp_path, rows):
    p = write(tmp_path / "a.tsv", "Control Name\tSection ID\tdesc\tfulltext\nOne\tS1\tD\tF\n")
    assert rows(readers.read_controls(spark, p), "control_id", "title", "description", "full_text") == [("S1", "One", "D", "F")]
    text = "## LLM01 – Injection\na\n## aml-2.1: Lower\nb\n## 3.1 Numbers\nc\n## Plain\nd\n"
    assert rows(readers.read_controls(spark, write(tmp_path / "a.md", text)), "control_id", "title") == [("3.1", "Numbers"), ("CTRL-04", "Plain"), ("LLM01", "Injection"), ("aml-2.1", "Lower")]


def test_nested_standards(spark, tmp_path, rows):
    doc = {"domains": [{"name": "D", "controls": [{"id": "A1", "title": "T", "activities": [{"id": "A1.1", "description": "d1", "category": "Core", "evidence_types": ["e"]}, {"id": "A1.2", "description": "d2"}]}, {"id": "A2", "title": "U", "activities": []}]}]}
    out = readers.read_activities(spark, write(tmp_path / "n.json", json.dumps(doc)))
    assert rows(out, "pos", "control_id", "title", "description", "parent_id") == [(0, "A1.1", "T", "d1", "A1"), (1, "A1.2", "T", "d2", "A1")]
    assert out.first().metadata == {"category": "Core", "domain": "D", "evidence_types": '["e"]'}
    doc = {"matrices": [{"techniques": [{"id": "T1", "name": "a", "description": "x", "subtechniques": [{"id": "T1.1", "name": "b", "description": "y"}]}, {"id": "T2", "name": "c", "description": "z"}], "mitigations": [{"id": "M1", "name": "m", "description": "w"}]}]}
    out = readers.read_techniques(spark, write(tmp_path / "t.json", json.dumps(doc)))
    assert rows(out, "pos", "control_id", "hierarchy_level", "parent_id") == [(0, "T1", "technique", None), (1, "T1.1", "sub-technique", "T1"), (2, "T2", "technique", None), (3, "M1", "mitigation", None)]


def test_html_sections(spark, tmp_path, rows):
    page = "<body><div id='art_1'><h2>Article&nbsp;1</h2><p>Text <b>one</b><br>more</p></div><div id='x'>no</div><div id='art_2'><p>Two</p></div><div id='art_1'>again</div></body>"
    p = write(tmp_path / "a.html", page)
    assert rows(readers.read_html_sections(spark, p, pattern=r"art_\d+"), "control_id", "title", "description") == [("art_1", "Article 1", "Text one more"), ("art_2", "art_2", "Two")]
    with pytest.raises(Exception, match="sections"):
        readers.read_html_sections(spark, p, pattern=r"art_\d+", least=9).collect()


def test_small_readers(spark, tmp_path, rows):
    p = write(tmp_path / "l.jsonl", json.dumps({"cre_id": "1", "section_id": "s", "framework_id": "f"}) + "\n\n" + json.dumps({"cre_id": "2"}) + "\n")
    links = readers.read_links(spark, p)
    assert links.count() == 2
    from loomwork.operators import snapshots

    cols = ["cre_id", "section_id"]
    assert snapshots.table_hash(links, cols).first() == snapshots.table_hash(links.orderBy("cre_id", ascending=False), cols).first()
    items = spark.createDataFrame([("a", '["h1", "zz"]'), ("b", '["zz"]')], "item_id string, truth string")
    assert rows(readers.truth_of(items, hubs(spark)), "item_id", "hub_id") == [("a", "h1"), ("b", None)]
    v = spark.createDataFrame([("f::a", [1.0]), ("f:b", [2.0])], "id string, embedding array<double>")
    assert rows(readers.embedding_slice(v, spark.createDataFrame([("f:a",)], "id string")), "id") == [("f::a",)]
    writers.write_vectors(v, {"temperature": 0.1, "quantile": 0.9}, str(tmp_path / "art"))
    back, params = readers_vectors(spark, str(tmp_path / "art"))
    assert back.count() == 2 and params == {"temperature": 0.1, "quantile": 0.9}


def readers_vectors(spark, path):
    return writers.read_vectors(spark, path)


def test_versions_are_verified(spark, tmp_path):
    from loomwork.operators import snapshots

    df = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 3)], "framework_id string, x int")
    path = writers.versioned(df, str(tmp_path / "t"), "1")
    good = snapshots.content_hash(df, "framework_id", ["x"])
    assert writers.load_version(spark, path, "framework_id", ["x"], good).count() == 3
    with pytest.raises(ValueError):
        writers.load_version(spark, path, "framework_id", ["x"], good.where("framework_id = 'f1'"))
    stats = spark.createDataFrame([("f1", 3), ("f2", 1)], "framework_id string, n_exported bigint")
    assert [(r.framework_id, r.expected, r.found) for r in writers.count_shortfalls(df, stats).collect()] == [("f1", 3, 2)]


def test_ingest(spark):
    def embed(texts):
        return texts.select("item_id", F.transform(F.array(F.lit(1.0), F.length("text") % 7, F.length("text") % 3), lambda x: x.cast("double")).alias("embedding")).select("item_id", normalised(F.col("embedding")).alias("embedding"))

    rows = spark.createDataFrame([("A1", "T one", "A description that is long enough to be kept by the rules of it.", None, 0), ("A2", "T two", "Another description which is long enough and has more words to it.", None, 1)], "control_id string, title string, description string, full_text string, pos int")
    hub = spark.createDataFrame([("h1", [1.0, 0.0, 0.0]), ("h2", [0.0, 1.0, 0.0])], "hub_id string, embedding array<double>")
    known = embed(spark.createDataFrame([("old:1", "f:A1 unrelated")], "item_id string, text string"))
    out = verbs.ingest(rows, "new_fw", known, hub, embed, temperature=0.1, quantile=0.9, ood_threshold=0.1, similar=0.1, k=2)
    s = out["summary"].first()
    assert s.controls == 2 and s.high + s.low == 2 and out["assignments"].count() == 4 and {r.other_id for r in out["duplicates"].collect()} == {"old:1"}
    with pytest.raises(ValueError):
        verbs.ingest(rows.unionByName(rows), "new_fw", known, hub, embed, temperature=0.1, quantile=0.9, ood_threshold=0.1)


def test_functions_in_sql(spark):
    from loomwork.functions import sql

    sql.register(spark)
    r = spark.sql("SELECT nfc('e\u0301') AS a, html_unescape('&amp;&eacute;') AS b").first()
    assert (r.a, r.b) == ("é", "&é")
    got = spark.sql("SELECT s.* FROM VALUES ('## AB12: One\nbody\n## Two\nmore') AS t(x), LATERAL markdown_sections(t.x) s").collect()
    assert [(r.pos, r.control_id, r.title, r.body) for r in got] == [(0, "AB12", "One", "body"), (1, None, "Two", "more")]


def test_canonical_import_and_accept(spark):
    cw = verbs.Crosswalk(controls(spark), hubs(spark), assignments(spark))
    first = cw.canonical()
    assert first["summary"].first().control_add == cw.controls.count() and first["changes"].where("operation <> 'add'").isEmpty()
    same = cw.canonical(cw)
    assert same["changes"].isEmpty() and same["summary"].first().n == 0 and same["impact"].isEmpty()
    c = cw.controls.where("section_id IS NOT NULL").first()
    links = spark.createDataFrame([(1, c.framework_id, c.section_id, "h2", "LinkedTo"), (2, c.framework_id, "nothing", "h2", "LinkedTo")], "link_id int, framework_id string, section_id string, hub_id string, link_type string")
    new, by = cw.import_truth(links)
    assert {r.strategy: r.n for r in by.collect()} == {"direct": 1, "unresolved": 1}
    assert new.import_truth(links)[0].assignments.count() == new.assignments.count() >= cw.assignments.count()
    own = cw.controls.where("framework_id = 'f2'").select("id").collect()
    reviews = spark.createDataFrame([(own[0].id, "corrected", "h1", "h3", 0.5), (own[1].id, "rejected", None, "h3", 0.4)], "control_id string, status string, corrected_hub_id string, top_hub_id string, top_confidence double")
    after = cw.accept("f2", reviews).assignments.where("control_id LIKE 'f2%'").collect()
    assert [(r.control_id, r.hub_id, r.confidence, r.review_status) for r in after] == [(own[0].id, "h1", None, "corrected")]
    out = cw.dataset()
    assert out["frameworks"].count() == 2 and out["crosswalk"].where("assignment_type IS NULL").isEmpty()
    assert cw.review_metrics().where("name = 'total'").first().value == cw.assignments.count()
    assert "| framework_id |" in writers.card("Frameworks", out["frameworks"], "framework_id")


def test_propose(spark):
    v = {"a": [1.0, 0.0], "b": [0.99, 0.14], "c": [0.95, 0.31], "x": [-0.02, 1.0], "y": [0.02, 1.0], "z": [0.0, 1.0]}
    items = spark.createDataFrame([(k, "f" + k, x) for k, x in v.items()], "item_id string, framework_id string, embedding array<double>")
    hub = spark.createDataFrame([("h1", [0.0, -1.0])], "hub_id string, embedding array<double>")
    out = sorted(verbs.propose(items, hub, hubs(spark), ood_threshold=0.5).collect(), key=lambda r: r.cluster_id)
    assert [(r.cluster_id, r.name, r.round) for r in out] == [("a", "Cluster a (near: One)", 1), ("x", "Cluster x (near: One)", 1)]


def test_yaml(spark, tmp_path, rows):
    pytest.importorskip("yaml")
    text = "controls:\n- id: c1\n  title: One\n  description:\n  - first\n  - [second, third]\n- id: c2\n  title: Two\nrisks:\n- id: r1\n  title: Risk\n  description: danger\n"
    assert rows(readers.read_yaml_controls(spark, write(tmp_path / "a.yaml", text)), "control_id", "title", "description") == [("c1", "One", "first\nsecond\nthird"), ("c2", "Two", "Two"), ("r1", "Risk", "danger")]
