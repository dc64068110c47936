"""Queries of tables that are published by versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans import adapter
from waymark.plans.registry import _C, _F, _O, _overrides, query
from waymark.plans.staging import Stage
from waymark.sources.versions import KeyedTable, LayeredTable


@query(f"WITH {_F} SELECT category AS layer, CAST(count(*) AS BIGINT) n_rows, true published, count(DISTINCT gg) posts FROM f WHERE category <> 'tourist-sign' GROUP BY 1 UNION ALL SELECT 'tourist-sign', NULL, false, NULL")
def published_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers built aside and published together; one whose source breaks half-way leaves no row."""
    f = adapter.features(spark, d)
    broken = f.where("category = 'tourist-sign'").withColumn("x", F.expr("if(prio % 5 = 0, raise_error('the source broke off'), x)"))
    table = LayeredTable(spark, f"{Stage(spark, 'layers').folder}/signs")
    table.publish({"pole": lambda: f.where("category = 'pole'").select("fid", "gg", "x", "y"), "tourist-sign": lambda: broken, "traffic-sign-abbreviation": lambda: f.where("category = 'traffic-sign-abbreviation'")})
    posts = table.read().groupBy("layer").agg(F.count_distinct("gg").alias("posts"))
    return table.counts().join(posts, "layer", "left")


_SCHEMA = "code string, tier long, grp string, en string, zh string"


@query(f"""WITH {_C}, {_O}, v1 AS (SELECT code, tier, grp, en, zh FROM c),
added AS (SELECT concat('TS', p_partkey) code, 2 tier, 'temporary' grp, p_brand en, NULL zh FROM part WHERE (p_type = 'PROMO' OR p_partkey % 11 = 0) AND NOT (p_partkey % 13 = 0)),
rejected AS (SELECT concat('TS', p_partkey) code FROM part WHERE p_partkey % 13 = 0),
v2 AS (SELECT * FROM v1 WHERE code NOT IN (SELECT code FROM added) AND code NOT IN (SELECT code FROM rejected) UNION ALL SELECT * FROM added),
v3 AS (SELECT v2.code, tier, grp, coalesce(v2.en, o.en) en, coalesce(v2.zh, o.zh) zh FROM v2 LEFT JOIN o ON o.code = v2.code)
SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3""")
def catalogue_version(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's versions: as first written, after a review added and rejected codes, and with descriptions filled in."""
    table = KeyedTable(spark, f"{Stage(spark, 'catalogue').folder}/codes", "code", _SCHEMA, 16)
    table.upsert(adapter.catalogue(spark, d).select("code", "tier", "grp", "en", "zh"))
    p = spark.read.parquet(f"{d}/part.parquet")
    added = p.where("(p_type = 'PROMO' or p_partkey % 11 = 0) and p_partkey % 13 <> 0").selectExpr("concat('TS', p_partkey) code", "2 tier", "'temporary' grp", "p_brand en", "cast(null as string) zh")
    table.upsert(added, p.where("p_partkey % 13 = 0").selectExpr("concat('TS', p_partkey) code"))
    texts = _overrides(spark, d).selectExpr("code", "en more_en", "zh more_zh")
    filled = table.read().join(texts, "code").select("code", "tier", "grp", F.coalesce("en", "more_en").alias("en"), F.coalesce("zh", "more_zh").alias("zh"))
    table.upsert(filled)
    return reduce(DataFrame.unionByName, (table.read(v).withColumn("version", F.lit(v)) for v in (1, 2, 3)))
