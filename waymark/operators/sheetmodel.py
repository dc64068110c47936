"""A sheet's table out of its drawn rules: dividers to column groups, borders to rows, cells to codes.

Everything runs per page by joins and windows over the page's rules.  Column groups
stand on a lattice at the median pitch of the number columns that were found;
a group whose dividers were interrupted is made from the median widths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.tablegrid import DEFAULT_PITCH, LEAST_COVER, NUMBER_WIDTH, column_pitch, first_clusters, gated_codes, interval_cover, running_clusters
from waymark.plans.staging import Stage

# Fixed values in points: share of the tallest rule that a full-height one has, reach of the header, least divider, width of a
# symbol column, its default share of the pitch, the default number column, least row, and the shares of a pitch within which
# a found column replaces a made one and the last one may stand out.
TALL, HEADER, LEAST_DIVIDER, SYMBOL_WIDTH, SYMBOL_SHARE, NUMBER_DEFAULT, LEAST_ROW, SNAP, OVERHANG = 0.95, 10.0, 40.0, (24.0, 140.0), 0.52, 20.0, 5.0, 0.35, 0.3
#: Groups of a page at most.
MOST_GROUPS = 25


def frames(v_rules: DataFrame) -> DataFrame:
    """page, top and bottom of each page's table: medians over its full-height rules."""
    longest = v_rules.groupBy("page").agg(F.max(F.col("y1") - F.col("y0")).alias("_most"))
    tall = v_rules.join(longest, "page").where(F.col("y1") - F.col("y0") > F.col("_most") * TALL)
    return tall.groupBy("page").agg(F.median("y0").alias("top"), F.median("y1").alias("bottom"))


def boundaries(v_rules: DataFrame, framed: DataFrame) -> DataFrame:
    """page, i and x of the column boundaries: dividers that begin at the header, doubled ones merged."""
    own = v_rules.join(framed, "page").where((F.col("y0") <= F.col("top") + HEADER) & (F.col("y1") - F.col("y0") > LEAST_DIVIDER))
    lines = own.groupBy("page").agg(running_clusters(F.collect_list("x")).alias("xs"))
    return lines.select("page", F.posexplode("xs").alias("i", "x"))


def column_groups(lines: DataFrame) -> DataFrame:
    """page, k, no_left, no_right, sym_right and made of every column group of ``lines(page, i, x)``."""
    page, order = Window.partitionBy("page"), Window.partitionBy("page").orderBy("i")
    at = lines.withColumns({"right": F.lead("x").over(order), "after": F.lead("x", 2).over(order), "table_left": F.min("x").over(page), "table_right": F.max("x").over(page)})
    number = at.where((F.col("right") - F.col("x")).between(*NUMBER_WIDTH) & (F.col("x") > F.col("table_left") + 1))
    wide = F.col("after") - F.col("right")
    number = number.withColumn("symbol", F.when((wide > SYMBOL_WIDTH[0]) & (wide < SYMBOL_WIDTH[1]), wide)).withColumnRenamed("x", "left")
    widths = number.groupBy("page").agg(F.min("left").alias("first"), F.median(F.col("right") - F.col("left")).alias("_no"), F.median("symbol").alias("_sym"))
    model = at.groupBy("page").agg(F.first("table_left").alias("table_left"), F.first("table_right").alias("table_right"))
    model = model.join(widths, "page", "left").join(column_pitch(number.select("page", "left")), "page", "left")
    model = model.withColumn("pitch", F.coalesce("pitch", F.lit(DEFAULT_PITCH))).withColumn("no", F.coalesce(F.nullif("_no", F.lit(0.0)), F.lit(NUMBER_DEFAULT)))
    model = model.withColumn("sym", F.coalesce(F.nullif("_sym", F.lit(0.0)), F.floor(F.col("pitch") * SYMBOL_SHARE + 0.5).cast("double")))
    origin = F.coalesce("first", F.col("table_left") + F.col("no"))
    steps = model.withColumn("origin", origin).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(MOST_GROUPS - 1)))).withColumn("want", F.col("origin") + F.col("k") * F.col("pitch"))
    steps = steps.where(F.col("want") + F.col("no") + F.col("sym") <= F.col("table_right") + F.col("pitch") * OVERHANG)
    near = steps.select("page", "k", "want", "pitch").join(number.select("page", "i", "left", "right", "symbol"), "page").where(F.abs(F.col("left") - F.col("want")) <= F.col("pitch") * SNAP)
    first = F.row_number().over(Window.partitionBy("page", "k").orderBy("i"))
    hit = near.withColumn("_n", first).where("_n = 1").select("page", "k", "left", "right", "symbol")
    out = steps.join(hit, ["page", "k"], "left")
    right = F.coalesce("right", F.col("want") + F.col("no"))
    return out.select("page", "k", F.coalesce("left", "want").alias("no_left"), right.alias("no_right"), (right + F.coalesce("symbol", "sym")).alias("sym_right"), F.col("left").isNull().alias("made"))


def group_rows(groups: DataFrame, h_rules: DataFrame, framed: DataFrame) -> DataFrame:
    """page, k, row, top and bottom of each group's cells: between borders that cover most of its width together."""
    met = groups.select("page", "k", "no_left", "sym_right").join(h_rules, "page").where("x1 > no_left and x0 < sym_right")
    starts = met.groupBy("page", "k").agg(first_clusters(F.collect_set("y")).alias("_ys"))
    line: Column = F.array_max(F.filter("_ys", lambda s: s <= F.col("y")))
    clipped = met.join(starts, ["page", "k"]).withColumn("line", line).withColumns({"x0": F.greatest("x0", "no_left"), "x1": F.least("x1", "sym_right")})
    cover = interval_cover(clipped, ["page", "k", "no_left", "sym_right", "line"])
    lines = cover.where(F.col("covered") > LEAST_COVER * (F.col("sym_right") - F.col("no_left"))).join(framed, "page")
    lines = lines.where((F.col("line") >= F.col("top") - 1) & (F.col("line") <= F.col("bottom") + 1)).select("page", "k", F.col("line").alias("top"))
    after = F.lead("top").over(Window.partitionBy("page", "k").orderBy("top"))
    bands = lines.withColumn("bottom", after).where(F.col("bottom") - F.col("top") >= LEAST_ROW)
    row = (F.row_number().over(Window.partitionBy("page", "k").orderBy("top")) - 1).alias("row")
    return bands.select("page", "k", row, "top", "bottom")


def sheet_codes(rules: DataFrame, tokens: DataFrame, sheets: DataFrame) -> DataFrame:
    """page, k, row, top, bottom, made, code and falls of every cell whose tokens hold a code of its sheet.

    ``rules`` are those of :func:`waymark.sources.features.drawn_rules`, ``tokens(page, col,
    row, tokens)`` what was read in each number cell, ``sheets(page, prefix, lo, hi, grp)`` each page's range.
    """
    v = rules.where("kind = 'v'").selectExpr("page", "at x", "lo y0", "hi y1")
    h = rules.where("kind = 'h'").selectExpr("page", "at y", "lo x0", "hi x1")
    stage = Stage(rules.sparkSession, "sheets")  # both are small, and several branches read them
    framed = stage.put(frames(v), "frames")
    groups = stage.put(column_groups(boundaries(v, framed)), "groups")
    cells = group_rows(groups, h, framed).join(groups.select("page", "k", "made"), ["page", "k"])
    codes = gated_codes(tokens, sheets).select("page", F.col("col").alias("k"), "row", "code", "falls")
    return cells.join(codes, ["page", "k", "row"])
