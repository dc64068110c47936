"""Queries over real picture bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import catalogue as cat
from waymark.plans.registry import query
from waymark.plans.staging import Stage
from waymark.sources import pictures


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """A picture per part, written as bytes and read again; parts are dealt first, as a small file of them makes much work."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", F.concat(F.lit("TS"), "p_partkey").alias("code"))
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    drawn = pictures.drawn(p, "code", F.expr("8 + p_size % 17"), F.expr("4 + p_partkey % 9"), pictures.bar_picture, F.expr("p_partkey * 7 + p_size"))
    return Stage(spark, "pictures").put(drawn, "png")


_PNG = """g AS (SELECT concat('TS', p_partkey) code, 8 + p_size % 17 w, 4 + p_partkey % 9 h, p_partkey * 7 + p_size s FROM part),
px AS (SELECT *, s % (w - 1) bar, s % h row FROM g)"""


@query(f"WITH {_PNG} SELECT code, CAST(w AS INTEGER) width, CAST(h AS INTEGER) height, bar * h + 0.2e0 AS alpha, CAST(bar * h + 1 AS BIGINT) opaque, CAST(CASE WHEN bar > 0 THEN 0 ELSE bar END AS INTEGER) AS \"left\", CAST(CASE WHEN bar > 0 THEN 0 ELSE row END AS INTEGER) top, CAST(bar + 1 AS INTEGER) AS \"right\", CAST(CASE WHEN bar > 0 THEN h ELSE row + 1 END AS INTEGER) bottom FROM px")
def picture_measures(spark: SparkSession, d: str) -> DataFrame:
    """Size, alpha in pixels and covered box of every part's picture, decoded from PNG bytes."""
    m = pictures.measured(_pictures(spark, d), "code")
    return m.withColumn("coverage", F.round(F.col("coverage") * F.col("width") * F.col("height"), 3)).withColumnRenamed("coverage", "alpha")


@query(f"WITH {_PNG} SELECT code FROM px WHERE (bar * h + 0.2e0) / (w * h) >= 0.85")
def plates_from_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Codes whose decoded picture is covered like a plate's."""
    return cat.plate_codes(pictures.measured(_pictures(spark, d), "code").select("code", "coverage"))
