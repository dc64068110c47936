"""Commits, layered tables and keyed tables by versions."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from waymark.sources.commits import Commits
from waymark.sources.versions import Conflict, KeyedTable, LayeredTable

SCHEMA = "id int, v string"


def test_a_record_is_written_once(spark, tmp_path):
    c = Commits(spark, f"file://{tmp_path}/c")
    assert c.names() == []
    assert c.put("a", {"n": 1, "t": "é"})
    assert not c.put("a", {"n": 2})
    assert c.get("a") == {"n": 1, "t": "é"}
    assert c.get("b") is None
    assert c.names() == ["a"]
    assert not [f for f in os.listdir(f"{tmp_path}/c") if f.startswith(".a-")]


def test_a_layer_that_breaks_leaves_no_row(spark, tmp_path):
    t = LayeredTable(spark, f"file://{tmp_path}/t")
    good = spark.range(100).selectExpr("id", "cast(id as string) name")
    half = spark.range(100).selectExpr("if(id = 90, raise_error('gone'), id) id", "1 extra").repartition(4)
    assert t.publish({"a": lambda: good, "b": lambda: half}) == 1
    assert sorted(map(tuple, t.counts().collect())) == [("a", 100, True), ("b", None, False)]
    assert t.read().groupBy("layer").count().collect()[0]["count"] == 100
    mended = spark.range(3).selectExpr("id", "1 extra")
    assert t.publish({"a": lambda: good.limit(0), "b": lambda: mended}) == 2
    assert {r.layer for r in t.read().collect()} == {"b"}
    assert t.read(1).count() == 100  # the version before stays
    with pytest.raises(ValueError, match="no layer"):
        t.publish({"a": lambda: good.limit(0), "b": lambda: half})
    assert t.latest() == 2


def test_a_layer_that_cannot_be_planned(spark, tmp_path):
    t = LayeredTable(spark, f"file://{tmp_path}/t")
    t.publish({"a": lambda: spark.range(2), "b": lambda: spark.read.parquet(f"{tmp_path}/absent")})
    assert "absent" in t.manifest()["failed"]["b"]


def rows(t, version=None):
    return {r.id: r.v for r in t.read(version).collect()}


def df(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_upserts_keep_versions_and_rewrite_what_changed(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "id", SCHEMA, 8)
    assert rows(t) == {}
    assert t.upsert(df(spark, *((i, f"a{i}") for i in range(50)))) == 1
    assert t.upsert(df(spark, *((i, f"a{i}") for i in range(50)))) == 1  # the same again writes nothing
    assert t.upsert(df(spark, (3, "b3"), (60, "n"), (4, "a4")), df(spark, (7, None), (99, None), (3, None)).select("id")) == 2
    assert rows(t) == {i: f"a{i}" for i in range(50) if i != 7} | {3: "b3", 60: "n"}
    assert rows(t, 1) == {i: f"a{i}" for i in range(50)}
    before, after = t.manifest(1)["buckets"], t.manifest(2)["buckets"]
    bucket = {r.id: str(r.b) for r in df(spark, (3, ""), (60, ""), (7, "")).withColumn("b", F.expr("pmod(xxhash64(cast(id as string)), 8)")).collect()}
    assert {b for b in after if after[b] != before.get(b)} == set(bucket.values())
    assert t.manifest(2)["rewritten"] == sorted({int(b) for b in bucket.values()})


def test_last_write_wins_and_nulls_are_values(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "id", SCHEMA, 4)
    ordered = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, None, 1), (None, "x", 1)], "id int, v string, at int")
    t.upsert(ordered, order="at")
    assert rows(t) == {1: "new", 2: None}
    t.upsert(df(spark, (1, "a"), (1, "b")))
    assert rows(t)[1] == "b"
    t.upsert(df(spark, (1, None)))
    assert rows(t)[1] is None
    assert t.upsert(df(spark), df(spark, (1, None), (2, None)).select("id")) == 4
    assert rows(t) == {}
    with pytest.raises(ValueError, match="no version"):
        t.read(9)


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    one, two = (KeyedTable(spark, f"file://{tmp_path}/t", "id", SCHEMA, 4) for _ in range(2))
    one.upsert(df(spark, (1, "a")))
    monkeypatch.setattr(two, "latest", lambda: 1)
    one.upsert(df(spark, (1, "b")))
    with pytest.raises(Conflict):
        two.upsert(df(spark, (1, "c")))
    assert rows(one) == {1: "b"}
