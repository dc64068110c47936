"""Views of the driver's tables as features, catalogue, segments and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Expressions that Spark and DuckDB read alike; the SQL oracles use the same text.
FEATURE = {
    "fid": "concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice * 100e0 + 0.5e0) as bigint))",
    "gg": "cast(l_orderkey as varchar(20))",
    "sign_id": "concat('TS', l_partkey)",
    "category": "case l_returnflag when 'A' then 'tourist-sign' when 'R' then 'traffic-sign-abbreviation' else 'pole' end",
    "x": "801000e0 + (l_orderkey * 137) % 60000 + l_quantity * 0.4e0",
    "y": "801000e0 + (l_orderkey * 71) % 46000 + l_discount * 100e0",
    "prio": "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey * 17) % 1000003",
}
CATALOGUE = {
    "code": "concat('TS', p_partkey)",
    "ord": "p_partkey",
    "tier": "p_size % 3",
    "grp": "case p_type when 'ECONOMY' then 'regulatory' when 'SMALL' then 'warning' when 'MEDIUM' then 'informatory' when 'LARGE' then 'temporary' else 'supplementary' end",
    "w": "60 + 4 * p_size",
    "h": "120",
    "en": "p_name",
    "zh": "case when p_partkey % 10 = 0 then '停車' when p_partkey % 10 = 1 then '' end",
}
SEGMENT = {
    "seg_id": "o_orderkey",
    "ax": "801000e0 + (o_orderkey * 137) % 60000 + o_custkey % 41 - 20",
    "ay": "801000e0 + (o_orderkey * 71) % 46000 + o_custkey % 37 - 18",
    "bx": "801000e0 + (o_orderkey * 137) % 60000 + o_custkey % 41 - 20 + o_custkey % 61 - 30",
    "by": "801000e0 + (o_orderkey * 71) % 46000 + o_custkey % 37 - 18 + o_custkey % 53 - 26",
}


def _view(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str], where: str = "true") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature per lineitem row."""
    return _view(spark, sf_dir, "lineitem", FEATURE)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue row per part, but for PROMO parts, which are not catalogued."""
    return _view(spark, sf_dir, "part", CATALOGUE, "p_type <> 'PROMO'")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line segment per order."""
    return _view(spark, sf_dir, "orders", SEGMENT)


def as_cte(name: str, table: str, columns: dict[str, str], where: str = "true") -> str:
    """The same view for DuckDB."""
    listed = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
    return f"{name} AS (SELECT {listed} FROM {table} WHERE {where})"
