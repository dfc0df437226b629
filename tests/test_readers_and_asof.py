"""As-of join, page texts and the data source of control documents."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators.asof import as_of
from loomwork.sources import datasource, pages, readers


def plain_as_of(left, right, strict):
    out = []
    for key, at, name in left:
        found = [(p, v) for k, p, v in right if k is not None and k == key and p is not None and at is not None and (p < at if strict else p <= at)]
        out.append((key, at, name, max(found)[1] if found else None))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_equals_plain_python(spark, strict):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(key(), rng.choice([None, *range(60)]), f"l{k}") for k in range(300)] + [("only left", 3, "x")] * 2
    right = [(key(), rng.choice([None, *range(60)]), k) for k in range(200)] + [("only right", 1, 5)]
    a = spark.createDataFrame(left, "k string, at int, _v string").repartition(3)
    b = spark.createDataFrame(right, "k string, at long, value long").repartition(2)
    got = as_of(a, b, by=["k"], at="at", values=["value"], strict=strict)
    assert got.columns == ["k", "at", "_v", "value"]
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.collect()) == order(plain_as_of(left, right, strict))
    assert as_of(a.where("false"), b, by=["k"], at="at", values=["value"]).count() == 0
    assert as_of(a, b.where("false"), by=["k"], at="at", values=["value"]).where("value IS NOT NULL").isEmpty()


def test_parents_of_measures(spark):
    """Chapters, commitments and measures as lines: a measure's parent is the last commitment before it in its chapter."""
    lines = [("one", 1, "c", "C1"), ("one", 2, "m", "M1"), ("one", 3, "m", "M2"), ("one", 4, "c", "C2"), ("one", 9, "m", "M3"), ("two", 1, "m", "M4"), ("two", 2, "c", "C3"), ("two", 5, "m", "M5")]
    df = spark.createDataFrame(lines, "chapter string, pos int, kind string, id string")
    got = as_of(df.where("kind = 'm'"), df.where("kind = 'c'").select("chapter", "pos", F.col("id").alias("parent_id")), by=["chapter"], at="pos", values=["parent_id"])
    assert {r.id: r.parent_id for r in got.collect()} == {"M1": "C1", "M2": "C1", "M3": "C2", "M4": None, "M5": "C3"}


RULES = pages.PageRules(header=r"(?P<id>RK\d{2})\s+(?P<title>.*)", footers=[r"Page \d+ of \d+", r"Risk Guide 2024"], headings=["How ", "Impact"])
DOCUMENT = "\f".join(
    [
        "Risk Guide 2024\nContents\nRK01 in the list is no header here\nPage 1 of 6",
        "RK01 Leaking of Secrets\nHow it happens\n\n\n\nSecrets leak.\nPage 2 of 6",
        "Risk Guide 2024\nMore about it.\nRK02 is named in a line\nPage 3 of 6",
        "\nRK02 Queries made by Models and Text-\nto-Code Tools\nImpact\nIt is great.\nPage 4 of 6",
        "RK01 Leaking of Secrets\nis described above.\nPage 5 of 6",
        "RK03 A long title of a risk that\nWraps to a second line\nBody of three.\nRisk Guide 2024\nPage 6 of 6",
    ]
)


def test_page_text():
    got = list(pages.page_controls(DOCUMENT, RULES))
    assert [(i, t) for i, t, _ in got] == [("RK01", "Leaking of Secrets"), ("RK02", "Queries made by Models and Text-to-Code Tools"), ("RK03", "A long title of a risk that Wraps to a second line")]
    assert got[0][2] == "How it happens\n\nSecrets leak.\nMore about it.\nRK02 is named in a line"
    assert got[1][2] == "Impact\nIt is great.\nRK01 Leaking of Secrets\nis described above."
    assert got[2][2] == "Body of three." and all("Page " not in b and "Guide" not in b for _, _, b in got)
    assert list(pages.page_controls(None, RULES)) == [] and list(pages.page_controls("no header\fat all", RULES)) == []


def test_page_reader_and_table_function(spark, tmp_path):
    (tmp_path / "a.txt").write_text(DOCUMENT)
    (tmp_path / "b.txt").write_text("RK09 Alone")
    rows = {(r.file, r.control_id): r for r in pages.read_pages(spark, str(tmp_path), RULES, description_chars=10).collect()}
    assert len(rows) == 4 and rows["b.txt", "RK09"].description == "Alone" and rows["a.txt", "RK01"].description == "How it hap" and rows["a.txt", "RK01"].full_text.startswith("How it happens")
    assert pages.read_pages(spark, str(tmp_path / "a.txt"), RULES, expected=3).count() == 3
    with pytest.raises(Exception, match="3 controls, not 4"):
        pages.read_pages(spark, str(tmp_path / "a.txt"), RULES, expected=4).count()
    pages.register_table_function(spark, "risk_controls", RULES)
    spark.createDataFrame([(DOCUMENT,), (None,)], "text string").createOrReplaceTempView("printed")
    got = spark.sql("SELECT c.control_id, c.pos FROM printed, LATERAL risk_controls(text) c ORDER BY c.pos").collect()
    assert [tuple(r) for r in got] == [("RK01", 0), ("RK02", 1), ("RK03", 2)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text("Section ID,Name,Desc,Other\nA-1,First,About the first,x\n\n,No id,,y\n,,,z\nA-3,,Only text,\n")
    (tmp_path / "b.tsv").write_text("id\ttitle\tdescription\n1\tOne\tText, with a comma\n")
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"ID": "J1", "Name": "Json", "Text": "Body"}, {"name": "No id"}, {"id": "gone"}, "no object", {"id": 7, "description": " x "}]}))
    (tmp_path / "d.md").write_text("# Doc\n\n## AB01: First\n\nBody one.\n\n## Second\n\nBody two.\n")
    (tmp_path / "_skipped.csv").write_text("id,description\n1,x\n")
    (tmp_path / "notes.txt").write_text("no known kind")
    return tmp_path


def test_source_gives_what_the_readers_give(spark, folder):
    datasource.register(spark)
    names = ["file", "pos", "control_id", "title", "description", "full_text"]
    source = spark.read.format("controls").load(str(folder))
    assert source.where("error IS NOT NULL").isEmpty() and source.rdd.getNumPartitions() == 4
    got = sorted((tuple(r) for r in source.select(*names).collect()), key=repr)
    want = []
    for name in ("a.csv", "b.tsv", "c.json", "d.md"):
        want += [tuple(r) for r in readers.read_controls(spark, str(folder / name)).select(*names).collect()]
    assert got == sorted(want, key=repr) and len(got) == 9
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW crosswalk_controls USING controls OPTIONS (path '{folder}')")
    assert spark.sql("SELECT count(*) FROM crosswalk_controls WHERE file = 'c.json'").first()[0] == 3


def test_broken_files(spark, folder):
    datasource.register(spark)
    (folder / "bad.json").write_text("{not json")
    (folder / "bad.csv").write_text("x,y\n1,2\n")
    (folder / "bad.md").write_bytes(b"\xff\xfe\x00")
    rows = spark.read.format("controls").load(str(folder)).where("error IS NOT NULL").collect()
    assert sorted(r.file for r in rows) == ["bad.csv", "bad.json", "bad.md"] and all(r.control_id is None for r in rows)
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        spark.read.format("controls").option("mode", "failfast").load(str(folder / "bad.json")).collect()
    with pytest.raises(Exception, match="not there"):
        spark.read.format("controls").load(str(folder / "nowhere")).collect()
    one = spark.read.format("controls").option("kind", "markdown").option("level", "2").load(f"file://{folder / 'd.md'}").collect()
    assert [r.control_id for r in one] == ["AB01", "CTRL-02"]
