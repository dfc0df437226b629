"""Canonical digests against Python's json, and versions that are whole or not there."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import canonical
from loomwork.plans import publish
from loomwork.plans.catalog_models import canonical_tables
from loomwork.plans.views import Views
from loomwork.sources.versions import VersionLog
from tests.conftest import DATA

STRINGS = [None, "", "plain", 'quote " and \\ back', "tab\tnl\ncr\rbs\bff\f", "\x00\x01\x1f\x7f", "é ü ß", "日本", "\U0001f600 x \U0010ffff", "a b", "~ }"]
DOUBLES = [
    None, 0.0, -0.0, 1.0, 0.1, 0.3, 1 / 3, 1e-4, 9.999e-5, 1e-5, 123456.0, 1234567.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 9007199254740993.0, 1e22, 1e23, 2e23, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, -2.5e-7,
    2.0**-44, 4.35, 0.02, math.pi, float("nan"), float("inf"), float("-inf"), 2.2e-322, 8.41e21, 5.0e-324, 1.0e-10,
]


def rows():
    rng = random.Random(1)
    doubles = DOUBLES + [rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30) for _ in range(300)] + [round(rng.random(), rng.randint(1, 17)) for _ in range(300)]
    for k, d in enumerate(doubles):
        s = STRINGS[k % len(STRINGS)]
        yield {
            "id": k, "b": None if k % 7 == 0 else k % 2 == 0, "s": s, "Zd": d, "list": None if k % 5 == 0 else [s, "x", None][: k % 4], "in": None if k % 6 == 0 else {"y": d, "a": k - 9},
            "m": None if k % 8 == 0 else {"k2": 1.5, 'k"1': None, "é": 0.25}, "day": datetime.date(2024, 1, 1 + k % 28), "none": None,
        }


SCHEMA = "id long, b boolean, s string, Zd double, list array<string>, in struct<y: double, a: int>, m map<string,double>, day date, none string"


def test_texts_equal_python(spark):
    data = list(rows())
    df = spark.createDataFrame([tuple(r.values()) for r in data], SCHEMA)
    for separators in (canonical.COMPACT, canonical.DEFAULT):
        got = {r.id: r.j for r in df.select("id", canonical.row_json(df, separators=separators).alias("j")).collect()}
        for r in data:
            assert got[r["id"]] == json.dumps(r, sort_keys=True, ensure_ascii=True, separators=separators, default=str), r
    with pytest.raises(TypeError):
        canonical.row_json(df.select(F.lit(b"x").alias("x")))


def test_list_and_range_digests(spark):
    data = list(rows())
    df = spark.createDataFrame([tuple(r.values()) for r in data], SCHEMA).repartition(5)
    want = hashlib.sha256(json.dumps(data, sort_keys=True, ensure_ascii=True, default=str).encode()).hexdigest()
    assert canonical.list_digest(df, ["id"], df.columns) == want
    assert canonical.list_digest(df.where("false"), ["id"], df.columns) == hashlib.sha256(b"[]").hexdigest()
    whole = canonical.ranged_digest(df, ["id"], df.columns)
    assert whole == canonical.ranged_digest(df.repartition(2), ["id"], df.columns)
    assert whole != canonical.ranged_digest(df.withColumn("s", F.when(F.col("id") == 7, "z").otherwise(F.col("s"))), ["id"], df.columns)


def snapshot(controls, mappings, header, fw):
    head = next(h.asDict(recursive=True) for h in header if h.framework_id == fw)
    cs = sorted(({k: r[k] for k in publish.CONTROL} for r in controls if r.framework_id == fw), key=lambda c: c["control_id"])
    ms = sorted(({k: r[k] for k in publish.MAPPING} for r in mappings if r.framework_id == fw), key=lambda m: (m["control_id"], m["rank"]))
    return {**head, "controls": cs, "mappings": ms}


def test_snapshot_digest_equals_python(spark):
    c, m, h = canonical_tables(Views(spark, f"{DATA}/sf0.001"))
    c = c.withColumn("title", F.when(F.col("control_id").endswith("7"), None).when(F.col("control_id").endswith("3"), 'é "q" \U0001f600').otherwise(F.col("title")))
    h = h.unionByName(h.limit(1).withColumn("framework_id", F.lit("empty")))
    got = {r.framework_id: r for r in publish.snapshot_digests(c, m, h).collect()}
    cs, ms, hs = c.collect(), m.collect(), h.collect()
    assert set(got) == {x.framework_id for x in hs}
    for fw, r in got.items():
        doc = snapshot(cs, ms, hs, fw)
        assert r.content_hash == hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()
        assert (r.n_controls, r.n_mappings) == (len(doc["controls"]), len(doc["mappings"]))
    assert got["empty"].n_controls == 0


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_versions(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "log"))
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    assert log.manifest() is None and log.read("a") is None and log.versions() == []
    assert log.commit({"a": table(1), "b": table(5)}, key="one") == 1
    assert log.commit({"a": table(9)}, key="one") == 1  # the same change again
    assert log.commit({"a": table(1, 2)}, key="two", note={"why": "more"}) == 2
    assert ids(log.read("a")) == [1, 2] and ids(log.read("b")) == [5] and ids(log.read("a", 1)) == [1]
    assert [h["key"] for h in log.history()] == ["one", "two"]
    assert log.commit({"a": table(3)}, key="three", replace=True) == 3 and log.read("b") is None and ids(log.read("b", 2)) == [5]
    with pytest.raises(ValueError):
        log.manifest(9)


def test_a_failure_between_files_leaves_the_old_version(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "log"))
    good = spark.createDataFrame([(1,)], "id long")
    log.commit({"a": good, "b": good}, key="one")
    bad = good.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        log.commit({"a": spark.createDataFrame([(2,)], "id long"), "b": bad}, key="two")
    assert log.versions() == [1] and ids(log.read("a")) == [1] and len(log.orphans()) >= 1
    assert log.commit({"a": spark.createDataFrame([(2,)], "id long"), "b": good}, key="two") == 2 and ids(log.read("a")) == [2]


def test_two_writers_get_two_numbers(spark, tmp_path):
    a, b = VersionLog(spark, str(tmp_path / "log")), VersionLog(spark, str(tmp_path / "log"))
    one = spark.createDataFrame([(1,)], "id long")
    a.commit({"x": one}, key="first")
    slow = a._publish

    def late(number, body):
        if number == 2:  # the other writer is faster
            a._publish = slow
            assert b.commit({"y": one}, key="other") == 2
        return slow(number, body)

    a._publish = late
    assert a.commit({"z": one}, key="mine") == 3
    assert set(a.manifest()["tables"]) == {"x", "y", "z"} and [h["key"] for h in a.history()] == ["first", "other", "mine"]


def test_publish(spark, tmp_path):
    v = Views(spark, f"{DATA}/sf0.001")
    c, m, h = canonical_tables(v)
    h = h.unionByName(h.limit(1).withColumn("framework_id", F.lit("empty")))
    log = VersionLog(spark, str(tmp_path / "log"))
    dry = publish.publish(log, c, m, h, "2024-01-01", dry_run=True)
    n = h.count() - 1
    assert dry.count() == n and dry.where("changed").count() == n and log.versions() == []  # the empty framework is skipped
    vectors = c.select(F.col("control_id").alias("id"), F.array(F.lit(1.0)).alias("embedding")).union(spark.createDataFrame([("other", [1.0])], "id string, embedding array<double>"))
    publish.publish(log, c, m, h, "2024-01-01", vectors=vectors)
    assert log.versions() == [1] and log.read("history").count() == n and log.read("vectors").count() == c.count()
    assert log.read("changes").where("operation <> 'add'").isEmpty()
    again = publish.publish(log, c, m, h, "2024-01-02")
    assert again.where("changed").isEmpty() and log.versions() == [1]
    fw = c.first().framework_id
    some = c.withColumn("title", F.when(F.col("framework_id") == fw, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    third = {r.framework_id: r for r in publish.publish(log, some, m, h, "2024-01-03").collect()}
    assert [f for f, r in third.items() if r.changed] == [fw] and log.versions() == [1, 2]
    assert log.read("changes").count() == c.where(F.col("framework_id") == fw).count() and log.read("history").count() == n + 1
    # one framework alone: the others stay, and its lost control is a major change
    lost = some.where(F.col("framework_id") == fw).orderBy("control_id").offset(1)
    last = publish.publish(log, lost, m, h.where(F.col("framework_id") == fw), "2024-01-04").first()
    assert last.scope == "major" and log.read("controls").count() == c.count() - 1
    assert publish.rebuild(log, {"controls": c}, "again") == 4 and log.read("history") is None


def test_file_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in publish.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": (3, hashlib.sha256(b"abc").hexdigest()), "b.bin": (1, hashlib.sha256(b"\x00").hexdigest())}
