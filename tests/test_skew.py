"""Rows that lack a key of a join are not all dealt to one task."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from waymark.functions.expressions import with_expressions
from waymark.operators import enrich


@contextmanager
def shuffled_joins(spark):
    """Joins by shuffles with partitions as dealt, as large tables have them."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def most_in_a_partition(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_other_layers_are_not_dealt_to_one_task(spark):
    f = spark.range(4000).selectExpr("cast(id as string) fid", "if(id % 4 = 0, 'traffic-sign-abbreviation', 'pole') category", "1e0 x", "2e0 y")
    stacks = f.where("category <> 'pole'").selectExpr("fid", "0 stack_index", "8 stack_off", "1 stack_tier", "3e0 anchor_x", "4e0 anchor_y", "90e0 stack_bearing")
    bearings = f.selectExpr("fid", "45e0 face_bearing")
    with shuffled_joins(spark):
        e = enrich.enriched(f, bearings, stacks)
        assert most_in_a_partition(e) < 1500
        got = e.groupBy("category").agg(F.count("*").alias("n"), F.count("stack_index").alias("s"), F.sum("x").alias("x"), F.max("face_bearing").alias("b"))
        assert {tuple(r) for r in got.collect()} == {("pole", 3000, 0, 3000.0, None), ("traffic-sign-abbreviation", 1000, 1000, 3000.0, 90.0)}


def test_rows_without_the_item_of_a_lookup_are_spread_and_lookups_shared(spark):
    rows = spark.range(4000).selectExpr("id", "if(id % 8 = 0, concat('S', id % 5), null) sign")
    table = spark.createDataFrame([("S0", "a"), ("S1", "b"), ("S1", "c"), (None, "z")], "label string, output string")
    found = {"g": ["match", ["get", "sign"], ["table", "t"], "none"], "again": ["match", ["get", "sign"], ["table", "t"], "other"], "inside": ["in", ["get", "sign"], ["table", "t"]]}
    with shuffled_joins(spark):
        out = with_expressions(rows, found, tables={"t": table})
        assert most_in_a_partition(out) < 2000
        got = {tuple(r) for r in out.groupBy("g", "again", "inside").count().collect()}
        assert got == {("a", "a", True, 100), ("b", "b", True, 100), ("none", "other", False, 3800)}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 2


def test_labels_of_an_expression_do_not_deal_rows_anew(spark):
    """Between two lookups of one sign stands a match of many literal labels: rows are still dealt once, and carry no hash."""
    rows = spark.range(400).selectExpr("id", "concat('S', id % 5) sign", "id % 30 off")
    table = spark.createDataFrame([("S0", "a"), ("S1", "b")], "label string, output string")
    many = ["match", ["get", "off"], *(v for k in range(20) for v in (k, k * 2)), -1]
    found = {"g": ["match", ["get", "sign"], ["table", "t"], "none"], "m": many, "inside": ["in", ["get", "sign"], ["table", "u"]]}
    with shuffled_joins(spark):
        out = with_expressions(rows, found, tables={"t": table, "u": table.where("output = 'a'")})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1
        assert plan.count("Exchange hashpartitioning(_item0") == 1
        assert "_spread" not in plan
        got = {(r.id, r.g, r.m, r.inside) for r in out.collect()}
    assert got == {(i, {0: "a", 1: "b"}.get(i % 5, "none"), float(i % 30 * 2) if i % 30 < 20 else -1.0, i % 5 == 0) for i in range(400)}
