"""Queries that search by index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.operators.gramindex import gram_index
from waymark.operators.search import search_index
from waymark.plans import adapter
from waymark.plans.registry import _C, query

_NEEDLES = "SELECT p_partkey AS query, CASE p_partkey % 4 WHEN 0 THEN concat('ts', p_partkey % 997) WHEN 1 THEN lower(substr(p_name, 2 + p_partkey % 3, 5)) WHEN 2 THEN concat(lower(substr(p_name, 1, 1)), ' ') ELSE CASE WHEN p_partkey % 8 = 3 THEN '停車' ELSE '停' END END needle FROM part WHERE p_type = 'PROMO'"


@query(f"WITH {_C}, q AS ({_NEEDLES}) SELECT q.query, c.code FROM q JOIN c ON contains(lower(concat(c.code, ' ', c.en)), q.needle) OR contains(c.zh, q.needle)")
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Many searches at once, in both languages, through an index of both texts of each code."""
    c = adapter.catalogue(spark, d)
    texts = search_index(c, c).selectExpr("code id", "explode(array(haystack, zh)) text")
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("waymark_part")
    needles = spark.sql(_NEEDLES.replace("FROM part", "FROM waymark_part"))
    return gram_index(texts).search(needles).withColumnRenamed("id", "code")  # a query has one needle
