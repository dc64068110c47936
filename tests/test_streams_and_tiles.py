"""Streams against their batch forms, and the tile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import catalogue, enrich, search, tiles
from waymark.streaming import events as streams

SMALL = "/root/testdata/sf0.001"


def test_streamed_windows_are_a_part_of_the_batch(spark, tmp_path):
    stream = streams.tumbling_counts(streams.event_stream(spark, SMALL))
    got = {tuple(r) for r in streams.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).select("start", "event_type", "n").collect()}
    batch = streams.tumbling_counts(streams.with_event_time(spark.read.parquet(f"{SMALL}/events.parquet")))
    want = {tuple(r) for r in batch.select("start", "event_type", "n").collect()}
    assert got and got <= want and len(want) - len(got) < 20


def test_sliding_and_debounced(spark):
    e = spark.createDataFrame([(1, 7, "a", "2024-01-01 00:05:00"), (2, 7, "b", "2024-01-01 00:10:00"), (3, 7, "c", "2024-01-01 02:00:00")], "event_id int, user_id int, event_type string, ts string")
    e = streams.with_event_time(e.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert sorted(r["event_id"] for r in streams.debounced(e).collect()) == [2, 3]
    assert sorted(r["n"] for r in streams.sliding_counts(e).collect()) == [1, 1, 2, 2]
    assert sorted((r["user_id"], r["n"]) for r in streams.sessions(e).collect()) == [(7, 1), (7, 2)]


def test_written_tiles_are_pruned_by_zoom(spark, tmp_path):
    f = spark.createDataFrame([("1", enrich.SIGN_LAYER, 114.1, 22.3), ("2", "pole", 114.2, 22.4)], "fid string, category string, lng double, lat double")
    full = tiles.full_table(f, range(7, 12))
    tiles.write_tiles(full, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["z"] for r in back.collect()) == [9, 10, 11]
    assert "PartitionFilters: [isnotnull(z" in back.where("z = 10")._jdf.queryExecution().executedPlan().toString()
    assert tiles.table_for("sign-id", f, full) is full and tiles.table_for("category", f, full) is f


def test_version_ignores_order_and_sees_change(spark):
    a = spark.range(50).selectExpr("id", "id * 2 v")
    first = tiles.content_version(a).first()["version"]
    assert first == tiles.content_version(a.orderBy(F.desc("id")).repartition(3)).first()["version"] and len(first) == 12
    assert first != tiles.content_version(a.withColumn("v", F.col("v") + 1)).first()["version"]


def test_union_layers_and_pictures(spark):
    a = spark.createDataFrame([("1", "A", None), ("2", None, 3)], "fid string, sign_id string, stack_index int")
    b = spark.createDataFrame([("3", "B", "x")], "fid string, sign_id string, category string")
    both = enrich.union_layers([(a, "pole"), (b, "tourist-sign")])
    assert sorted((r["fid"], r["category"]) for r in both.collect()) == [("1", "pole"), ("2", "pole"), ("3", "tourist-sign")]
    known = spark.createDataFrame([("A",)], "code string")
    assert [tuple(r) for r in catalogue.picture_requests(a, known).collect()] == [("A", "signs/A.png")]


def test_thinning_limit_runs_before_the_shuffle(spark):
    f = spark.range(10).selectExpr("cast(id as string) fid", "114.1 lng", "22.3 lat", "cast(null as int) minzoom", "cast(null as int) maxzoom", "id prio")
    plan = tiles.thinned(tiles.tiled(f, range(9, 10)), F.col("prio"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_search_index_keeps_catalogue_order(spark):
    c = spark.createDataFrame([("B", 1, "warning", None, None), ("A", 2, "warning", None, None), ("Z", 3, "regulatory", None, None), ("X", 4, "other", None, None)], "code string, ord int, grp string, en string, zh string")
    assert [r["code"] for r in search.page(search.search(search.search_index(c, c)), 0, 9).collect()] == ["Z", "B", "A"]
