"""Spatial hits around a point, first-wins dedupe and click cycling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import metre_bounds

# Half the hit box in pixels, and the width of the world at zoom 0.
HIT_PIXELS, WORLD_PIXELS = 6.0, 512.0


def hit_box(lng: float, lat: float, zoom: float) -> tuple[float, float, float, float]:
    """West, south, east and north of the hit box around a point at a zoom, in degrees."""
    reach = HIT_PIXELS / (WORLD_PIXELS * 2.0**zoom)
    r = math.radians(lat)
    x, y = (lng + 180) / 360, (1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2

    def latitude(share: float) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * share))))

    return (x - reach) * 360 - 180, latitude(y + reach), (x + reach) * 360 - 180, latitude(y - reach)


def box_hits(features: DataFrame, lng: float, lat: float, zoom: float) -> DataFrame:
    """Features within the hit box around a point at a zoom: plain bounds of degrees, which scans can use."""
    west, south, east, north = hit_box(lng, lat, zoom)
    return features.where(F.col("lng").between(west, east) & F.col("lat").between(south, north))


def near_hit_box(features: DataFrame, lng: float, lat: float, zoom: float) -> DataFrame:
    """Features whose metres may lie in the hit box: plain bounds that leave few rows to reproject."""
    west, south, east, north = metre_bounds(*hit_box(lng, lat, zoom))
    return features.where(F.col("x").between(west, east) & F.col("y").between(south, north))


def hit_key() -> Column:
    """A hit's identity: place to six digits, the first name it has, and its category."""
    name = F.coalesce("sign_id", "pole_id", "refname", F.lit(""))
    return F.format_string("%.6f,%.6f|%s|%s", "lng", "lat", name, "category")


def first_by(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in a stated order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in a stated order: later writes win."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def click_cycle(clicks: DataFrame, user: str, order: list[str], key: str, hits: str) -> DataFrame:
    """``clicks`` with cycle_index: clicks on one set of hits in a row step through it; another set starts at 0; no hit is null."""
    by = Window.partitionBy(user).orderBy(*order)
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(by))).cast("int")
    runs = clicks.withColumn("_run", changed)
    runs = runs.withColumn("_run", F.sum("_run").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    within = F.row_number().over(Window.partitionBy(user, "_run").orderBy(*order)) - 1
    return runs.withColumn("cycle_index", F.when(F.col(hits) > 0, F.pmod(within, F.col(hits)))).drop("_run")
