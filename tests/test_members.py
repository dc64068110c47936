"""Members are written row by row to files of bounded size, and read back whole."""

from __future__ import annotations

import glob

from waymark.sources import features as src


def test_members_are_written_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(src, "MEMBERS_PER_FILE", 100)
    text = """concat('<core:cityObjectMember><gen:intAttribute name="FEATUREID"><gen:value>', id, '</gen:value></gen:intAttribute><gml:Point><gml:pos>', id, ' 2</gml:pos></gml:Point></core:cityObjectMember>') value"""
    src.write_members(spark.range(1000).coalesce(1).selectExpr(text), f"{tmp_path}/m")
    files = glob.glob(f"{tmp_path}/m/*.txt")
    assert len(files) == 10
    assert max(sum(1 for _ in open(f)) for f in files) == 100
    got = src.point_features(src.read_members(spark, f"{tmp_path}/m")).collect()
    assert sorted(int(r.fid) for r in got) == list(range(1000)) and all(r.x == int(r.fid) and r.y == 2 for r in got)


def test_pictures_are_drawn_by_many_tasks(spark):
    from waymark.plans import pictures

    parts = [n for n in (len(p) for p in pictures._pictures(spark, "/root/testdata/sf0.001").rdd.glom().collect()) if n]
    files = pictures._pictures(spark, "/root/testdata/sf0.001").inputFiles()
    assert len(files) >= 4 and sum(parts) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_full_table_is_dealt_once_and_members_may_be_packed(spark, tmp_path):
    from waymark.operators import tiles

    spots = spark.range(4000).selectExpr("cast(id as string) fid", "'traffic-sign-abbreviation' category", "114 + id % 80 / 1e2 lng", "22.3 + id % 7 / 1e2 lat")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tiles.write_full_table(spots, range(9, 14), f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").select("z", "tx", "ty", "fid").collect()}
    assert got == {tuple(r) for r in tiles.full_table(spots, range(9, 14)).select("z", "tx", "ty", "fid").collect()} and len(got) == 20_000
    assert len(glob.glob(f"{tmp_path}/t/z=9/*.parquet")) > 1  # two tiles there, but no file holds a whole one
    text = "concat('<core:cityObjectMember><gml:Point><gml:pos>', id, ' 2</gml:pos></gml:Point></core:cityObjectMember>') value"
    for way in ("none", "gzip"):
        src.write_members(spark.range(3000).coalesce(1).selectExpr(text), f"{tmp_path}/{way}", way)
    sizes = [sum(len(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/{way}/*.txt*")) for way in ("none", "gzip")]
    assert sizes[1] * 5 < sizes[0]
    assert src.point_features(src.read_members(spark, f"{tmp_path}/gzip")).where("x is not null").count() == 3000
