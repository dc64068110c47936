"""Faceted search over the catalogue in two languages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.catalogue import GROUPS, description


def search_index(catalogue: DataFrame, texts: DataFrame) -> DataFrame:
    """code, grp, group_ord, ord, en, zh and the lowered haystack of each code of a known group."""
    rank = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("grp"))
    own = catalogue.where(F.col("grp").isin(GROUPS)).select("code", "grp", "ord", rank.alias("group_ord"))
    both = own.join(texts.select("code", "en", "zh"), "code", "left")
    return both.withColumn("haystack", F.lower(F.concat("code", F.lit(" "), F.coalesce("en", F.lit("")))))


def parsed_id(query: str) -> str | None:
    """The query as an identifier, or None."""
    cleaned = re.sub(r"[\s_-]+", "", query).upper()
    return cleaned if re.fullmatch(r"[A-Z]{1,4}[0-9]+", cleaned) else None


def _score(code: Column, wanted: str) -> Column:
    return F.when(code == wanted, 2).when(code.startswith(wanted), 1).otherwise(0)


def search(index: DataFrame, query: str = "", groups: list[str] | None = None, locale: str = "en") -> DataFrame:
    """Hits with their score and order columns: by score, then group, then catalogue order.

    A hit's code starts with an identifier query, or its haystack holds the
    lowered query, or its Chinese text the query as it is.  No query: all hits.
    """
    q = query.strip()
    pool = index.where(F.col("grp").isin(groups)) if groups else index
    wanted = parsed_id(q) if q else None
    if q:
        hit = F.col("haystack").contains(q.lower()) | F.coalesce(F.col("zh").contains(q), F.lit(False))
        pool = pool.where(hit | F.col("code").startswith(wanted) if wanted else hit)
    score = _score(F.col("code"), wanted) if wanted else F.lit(0)
    return pool.select("code", "grp", description(F.col("en"), F.col("zh"), locale).alias("description"), score.alias("score"), "group_ord", "ord")


def page(hits: DataFrame, offset: int, rows: int) -> DataFrame:
    """A page of hits in their order."""
    return hits.orderBy(F.desc("score"), "group_ord", "ord").offset(offset).limit(rows)


def all_selected(hits: DataFrame, ids: list[str]) -> DataFrame:
    """Whether every hit is selected; no hit at all counts as not."""
    return hits.agg(F.coalesce(F.bool_and(F.col("code").isin(ids)), F.lit(False)).alias("all_selected"), F.count("*").alias("n_hits"), F.count_if(F.col("code").isin(ids)).alias("n_selected"))
