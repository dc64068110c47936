"""Feature enrichment and level-of-detail copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.hits import last_by

# The layer that carries signs, and the zoom from which whole assemblies show.
SIGN_LAYER, WHOLE_ZOOM = "traffic-sign-abbreviation", 13


def union_layers(layers: list[tuple[DataFrame, str]]) -> DataFrame:
    """All layers with their category, which replaces a column of that name; columns may differ."""
    tagged = [df.withColumn("category", F.lit(category)) for df, category in layers]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def enriched(features: DataFrame, bearings: DataFrame | None, stacks: DataFrame) -> DataFrame:
    """Features with face_bearing and, if stacked, the assembly's place, order and bearing.

    Only the sign layer takes either.  A stacked feature takes its assembly's
    bearing even if that is null.  Where the right sides have an ``ord`` column, a
    later row of a fid replaces earlier ones; without it one of its rows is taken, the
    least by its values, so a feature never multiplies.  Without ``bearings`` the
    result has no face_bearing and nothing is spent on it.
    """
    own_layer = F.col("category").eqNullSafe(SIGN_LAYER)
    j = features.where(own_layer).withColumn("_k", F.coalesce(F.col("fid").cast("string"), F.lit("")))
    j = j.join(_one_per_fid(stacks, ["stack_index", "stack_off", "stack_tier", "anchor_x", "anchor_y", "stack_bearing"]), "_k", "left")
    if bearings is not None:
        own = _one_per_fid(bearings, ["face_bearing"]).withColumnRenamed("face_bearing", "_own")
        turned = F.when(F.col("stack_index").isNotNull(), F.col("stack_bearing")).otherwise(F.col("_own"))
        j = j.join(own, "_k", "left").withColumn("face_bearing", turned).drop("_own")
    j = j.withColumn("x", F.coalesce("anchor_x", "x")).withColumn("y", F.coalesce("anchor_y", "y")).drop("_k", "anchor_x", "anchor_y", "stack_bearing")
    # the other layers take nothing: they pass by the joins, where their missing key would bring them all to one task
    taken = {c: F.lit(None).cast(t) for c, t in j.dtypes if c not in features.columns}
    return j.unionByName(features.where(~own_layer).withColumns(taken).withColumns({c: F.col(c).cast(t) for c, t in j.dtypes if c in ("x", "y")}))


def _one_per_fid(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per fid: the last by ``ord`` where there is one, else the least by its values."""
    if "ord" in df.columns:
        return last_by(df, "fid", "ord").select(F.col("fid").alias("_k"), *columns)
    return df.groupBy(F.col("fid").alias("_k")).agg(F.min(F.struct(*columns)).alias("_v")).select("_k", "_v.*")


def lod_copies(features: DataFrame) -> DataFrame:
    """Overview copies with minzoom and maxzoom: a post's first sign stands for it below WHOLE_ZOOM, all show from there."""
    low = F.struct(F.lit(None).cast("int").alias("minzoom"), F.lit(WHOLE_ZOOM - 1).alias("maxzoom"))
    high = F.struct(F.lit(WHOLE_ZOOM).alias("minzoom"), F.lit(None).cast("int").alias("maxzoom"))
    free = F.struct(F.lit(None).cast("int").alias("minzoom"), F.lit(None).cast("int").alias("maxzoom"))
    hints = F.when(F.col("stack_index") == 0, F.array(low, high)).when(F.col("stack_index") > 0, F.array(high)).otherwise(F.array(free))
    return features.withColumn("_hint", F.explode(hints)).select("*", "_hint.minzoom", "_hint.maxzoom").drop("_hint")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it is empty: nothing must be built from nothing."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df
