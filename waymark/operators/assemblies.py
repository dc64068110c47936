"""Assemblies: co-located signs ranked and laid out on one post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import js_round
from waymark.functions.text import blank_to_null
from waymark.operators.nearest import nearest_bearings
from waymark.plans.staging import Stage

# Widest span in metres; plate width, gap and offset step in pixels; rank of a group.
SPAN_CAP = 15.0
COMMON_WIDTH, GAP, STEP = 120.0, 10.0, 8.0
RANKS = {"regulatory": 0, "warning": 1, "informatory": 2, "temporary": 3, "supplementary": 9}
OTHER_RANK, DEFAULT_SIDE = 5, 120


def catalogued_members(features: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Placed features of a named assembly whose sign is in the catalogue, with group, tier and picture size."""
    placed = features.where("fid is not null and x is not null and y is not null")
    placed = placed.withColumn("gg", blank_to_null(F.col("gg"))).withColumn("sign_id", blank_to_null(F.col("sign_id"))).where("gg is not null and sign_id is not null")
    wanted = catalogue.select(F.col("code").alias("sign_id"), "grp", "tier", F.coalesce("w", F.lit(DEFAULT_SIDE)).alias("w"), F.coalesce("h", F.lit(DEFAULT_SIDE)).alias("h"))
    rank = F.lit(OTHER_RANK)
    for name, value in RANKS.items():
        rank = F.when(F.col("grp") == name, value).otherwise(rank)
    return placed.join(wanted, "sign_id").withColumn("rank", rank)


def assembly_spans(members: DataFrame) -> DataFrame:
    """gg, stack_size and span (the wider of both axes) of each assembly; a partial aggregate, whatever one holds."""
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return members.groupBy("gg").agg(F.count("*").alias("stack_size"), span.alias("span"))


def stack_assemblies(members: DataFrame, bearings: DataFrame | None = None, lines: DataFrame | None = None, wanted: Column | None = None) -> DataFrame:
    """Members of assemblies of two or more within the span cap, in order, with their layout.

    Assemblies that are too small or too wide leave before any row is ranked, so
    only real posts reach the window.  Members that tie stand in file order where
    ``members`` has an ``ord`` column, which is returned too, else by fid.  Returns fid, gg, sign_id, stack_index,
    stack_size, pic_w, anchor_x, anchor_y, stack_bearing, stack_off and stack_tier;
    anchor, bearing (null if the first member has none) and tier are the first member's.
    Instead of all members' ``bearings``, ``lines`` may be given: then only first members
    are searched for their nearest line (of a fid that repeats in its assembly all places).
    Where ``wanted`` is given, all members are ranked and those that it holds for are returned.
    """
    posts = assembly_spans(members).where((F.col("stack_size") >= 2) & (F.col("span") <= SPAN_CAP)).drop("span")
    m = members.join(posts, "gg")
    m = m.join(bearings, "fid", "left") if bearings is not None else m.withColumn("face_bearing", F.lit(None).cast("double"))
    file_order = ["ord"] if "ord" in members.columns else []
    # the last three follow from the sign: with them both readers of m below want the same columns and share its shuffle
    order = Window.partitionBy("gg").orderBy("rank", "sign_id", *file_order, "fid", "tier", "w", "h")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    height = F.lit(COMMON_WIDTH) * F.col("h") / F.col("w")
    m = m.withColumn("_h", height)
    index = F.row_number().over(order) - 1
    first = {c: F.first(c).over(upto) for c in ("x", "y", "face_bearing", "tier", "_h")}
    centre = F.sum("_h").over(upto) - first["_h"] / 2 + F.lit(GAP) * index - F.col("_h") / 2
    out = m.select(
        *([] if wanted is None else [wanted.alias("_wanted")]),
        "fid",
        "gg",
        "sign_id",
        index.alias("stack_index"),
        "stack_size",
        F.col("w").alias("pic_w"),
        first["x"].alias("anchor_x"),
        first["y"].alias("anchor_y"),
        first["face_bearing"].alias("stack_bearing"),
        (js_round(centre / F.lit(STEP)) * F.lit(STEP)).cast("int").alias("stack_off"),
        first["tier"].alias("stack_tier"),
        *file_order,
    )
    if wanted is not None:
        out = out.where("_wanted").drop("_wanted")
    if lines is None:
        return out
    heads = m.withColumn("_first", F.first("fid").over(upto)).where(F.col("fid") == F.col("_first")).select("gg", "x", "y")
    turned = nearest_bearings(heads, lines, "gg").withColumnRenamed("face_bearing", "_bearing")
    return out.join(turned, "gg", "left").withColumn("stack_bearing", F.col("_bearing")).select(*out.columns)


def companion_index(members: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Distinct (sign_id, gg) pairs of stacked assemblies, long form; with ``wanted`` only of assemblies that hold such a sign.

    Nothing is ranked or laid out: sizes and spans are one aggregate.
    """
    if wanted is not None:
        members = members.join(members.where(F.col("sign_id").isin(wanted)).select("gg").distinct(), "gg", "left_semi")
    posts = assembly_spans(members).where((F.col("stack_size") >= 2) & (F.col("span") <= SPAN_CAP)).select("gg")
    return members.select("sign_id", "gg").distinct().join(posts, "gg", "left_semi").select("sign_id", "gg")


def companions_of(features: DataFrame, catalogue: DataFrame, wanted: list[str]) -> DataFrame:
    """The companion index of assemblies that hold a ``wanted`` sign, out of scans that keep little.

    The assemblies of the wanted signs are written first, then their members; as
    written tables have known sizes, joins with few of them broadcast and joins with
    many shuffle.  Nothing else is read twice, ranked or laid out.
    """
    stage = Stage(features.sparkSession, "companions")
    named = stage.put(features.where(F.col("sign_id").isin(wanted) & F.col("gg").isNotNull()).select("gg").distinct(), "named")
    members = stage.put(catalogued_members(features.join(named, "gg", "left_semi"), catalogue).select("gg", "sign_id", "x", "y"), "members")
    return stage.put(companion_index(members, wanted), "companions")


def sign_group_lists(companions: DataFrame, most: int = 10_000) -> DataFrame:
    """sign_id, part and gg_names of a companion index: a sign's assemblies in lists of about ``most``, so that no common sign makes one huge list."""
    parts = companions.groupBy("sign_id").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    dealt = companions.join(parts, "sign_id").withColumn("part", F.pmod(F.xxhash64("gg"), F.col("_parts")).cast("int"))
    return dealt.groupBy("sign_id", "part").agg(F.array_sort(F.collect_set("gg")).alias("gg_names"))


def write_sign_groups(companions: DataFrame, path: str) -> None:
    """The companion index as JSON lines."""
    sign_group_lists(companions).write.json(path)


def stack_counters(stacks: DataFrame) -> DataFrame:
    """One row: members, assemblies, distinct anchors, the largest assembly and the furthest offset; zeros without stacks."""
    first = F.count_if(F.col("stack_index") == 0)
    furthest = {name: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(name) for name, c in (("largest", "stack_size"), ("furthest", "stack_off"))}
    return stacks.agg(F.count("*").alias("members"), first.alias("assemblies"), F.count_distinct("anchor_x", "anchor_y").alias("anchors"), *furthest.values())
