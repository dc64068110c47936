"""Queries of nearest lines at any distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import rings
from waymark.plans import adapter
from waymark.plans.registry import _S, query

_POINT = "cast(790000 + ({0} * 7919) % 90000 as double) x, cast(795000 + ({0} * 104729) % 70000 as double) y"


def _ranked(table: str, key: str) -> str:
    return f"""pt AS (SELECT {key} fid, {_POINT.format(key)} FROM {table}),
ds AS (SELECT fid, seg_id, x, y, ax, ay, bx - ax dx, "by" - ay dy, greatest(0e0, least(1e0, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) t
  FROM pt, s WHERE (bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay) >= 9),
dd AS (SELECT fid, seg_id, sqrt((x - (ax + t * dx)) * (x - (ax + t * dx)) + (y - (ay + t * dy)) * (y - (ay + t * dy))) d FROM ds),
rk AS (SELECT fid, CAST(row_number() OVER (PARTITION BY fid ORDER BY d, seg_id) AS INTEGER) rank, seg_id, round(d, 4) d FROM dd)"""


@query(f"WITH {_S}, {_ranked('customer', 'c_custkey')} SELECT fid, seg_id, d FROM rk WHERE rank = 1")
def nearest_any_distance(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's nearest line, however far."""
    points = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey fid", *_POINT.format("c_custkey").split(", "))
    return rings.k_nearest(points, adapter.segments(spark, d)).select("fid", "seg_id", F.round("d", 4).alias("d"))


@query(f"WITH {_S}, {_ranked('supplier', 's_suppkey')} SELECT fid, rank, seg_id, d FROM rk WHERE rank <= 7")
def k_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The seven nearest lines of every supplier, however far."""
    points = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey fid", *_POINT.format("s_suppkey").split(", "))
    return rings.k_nearest(points, adapter.segments(spark, d), 7).withColumn("d", F.round("d", 4))
