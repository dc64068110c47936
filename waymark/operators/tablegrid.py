"""Codes out of ruled tables: rules to columns, rows and cells, then gated codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.text import code_number, unspaced

# Gap of a cluster of column lines, gap of a row from its first rule,
# share of a column that rules must cover, width bounds of a number column.
COLUMN_GAP, ROW_GAP, LEAST_COVER = 4.0, 2.0, 0.6
NUMBER_WIDTH, DEFAULT_PITCH = (12.0, 32.0), 109.0
# Fixed value: pixels that a picture out of a cell has at least, each way.
LEAST_PICTURE = 24


def running_clusters(values: Column, gap: float = COLUMN_GAP) -> Column:
    """Representatives of sorted values: one within ``gap`` of the last representative moves it half way."""
    start = F.array().cast("array<double>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (F.abs(x - last) < gap)
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array((last + x) / 2))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.sort_array(values), start, step)


def first_clusters(values: Column, gap: float = ROW_GAP) -> Column:
    """First members of clusters of sorted values, each within ``gap`` of its cluster's first."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.sort_array(values), start, lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) < gap), acc).otherwise(F.concat(acc, F.array(x))))


def number_columns(v_rules: DataFrame) -> DataFrame:
    """page, left, right of neighbouring column lines whose distance fits a number column."""
    lines = v_rules.groupBy("page").agg(running_clusters(F.collect_list("x")).alias("xs"))
    pos = lines.select("page", F.posexplode("xs").alias("i", "left"))
    nxt = F.lead("left").over(Window.partitionBy("page").orderBy("i"))
    return pos.withColumn("right", nxt).where((F.col("right") - F.col("left")).between(*NUMBER_WIDTH)).drop("i")


def column_pitch(columns: DataFrame) -> DataFrame:
    """page and pitch: the median distance of neighbouring number columns, or the default."""
    step = F.col("left") - F.lag("left").over(Window.partitionBy("page").orderBy("left"))
    return columns.select("page", step.alias("d")).groupBy("page").agg(F.coalesce(F.median("d"), F.lit(DEFAULT_PITCH)).alias("pitch"))


def lattice(columns: DataFrame, pitches: DataFrame, most: int = 24, width: float = 20.0) -> DataFrame:
    """Number columns at every pitch from the first: the detected one within 0.35 of the pitch, else a made one."""
    span = columns.groupBy("page").agg(F.min("left").alias("x0"), F.max("left").alias("x1"))
    points = span.join(pitches, "page").select("page", "pitch", "x1", "x0", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"))
    points = points.withColumn("want", F.col("x0") + F.col("k") * F.col("pitch")).where("want <= x1 + 0.35 * pitch")
    near = points.join(columns, "page").where("abs(left - want) <= 0.35 * pitch")
    best = near.groupBy("page", "k").agg(F.min(F.struct("left", "right")).alias("b"))
    out = points.join(best, ["page", "k"], "left")
    return out.select("page", "k", F.coalesce("b.left", "want").alias("left"), F.coalesce("b.right", F.col("want") + width).alias("right"), F.col("b").isNull().alias("made"))


def interval_cover(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys and covered: the length of the union of [x0, x1] per group, by a running maximum."""
    order = Window.partitionBy(*keys).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("x1") - F.greatest("x0", F.coalesce(F.max("x1").over(order), F.col("x0")))
    return intervals.withColumn("_c", F.greatest(new, F.lit(0.0))).groupBy(*keys).agg(F.sum("_c").alias("covered"))


def covering_rules(columns: DataFrame, h_rules: DataFrame) -> DataFrame:
    """page, left, right, y of horizontal rules that together cover enough of a column at one height."""
    met = columns.join(h_rules, "page").where("x1 > left and x0 < right")
    clipped = met.withColumn("x0", F.greatest("x0", "left")).withColumn("x1", F.least("x1", "right"))
    cover = interval_cover(clipped, ["page", "left", "right", "y"])
    return cover.where(F.col("covered") > LEAST_COVER * (F.col("right") - F.col("left"))).drop("covered")


def cells(rules: DataFrame) -> DataFrame:
    """page, left, right, row, top, bottom between neighbouring row lines of a column."""
    lines = rules.groupBy("page", "left", "right").agg(first_clusters(F.collect_list("y")).alias("ys"))
    pos = lines.select("page", "left", "right", F.posexplode("ys").alias("row", "top"))
    bottom = F.lead("top").over(Window.partitionBy("page", "left", "right").orderBy("row"))
    return pos.withColumn("bottom", bottom).where("bottom is not null")


def gated_codes(tokens: DataFrame, sheets: DataFrame) -> DataFrame:
    """The first token of each cell that is a code within its sheet's range, with prefix and a warning where numbers fall."""
    own = tokens.join(sheets, "page")
    numbers = F.transform("tokens", lambda t: F.struct(F.upper(unspaced(t)).alias("t"), code_number(t).alias("n")))
    fit = F.get(F.filter(numbers, lambda r: r["n"].between(F.col("lo"), F.col("hi"))), F.lit(0))
    got = own.select("page", "col", "row", "grp", "prefix", fit.alias("_f")).select("page", "col", "row", "grp", F.concat("prefix", "_f.t").alias("code"), F.col("_f.n").alias("n"))
    # cells without a code leave after the window: a filter before it would be pushed down and read the tokens twice
    before = F.last("n", ignorenulls=True).over(Window.partitionBy("page", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return got.withColumn("falls", F.coalesce(F.col("n") < before, F.lit(False))).where("n is not null")


def large_enough(pictures: DataFrame) -> DataFrame:
    """Pictures out of cells, without those too small to be one: w and h of LEAST_PICTURE or more."""
    return pictures.where((F.col("w") >= LEAST_PICTURE) & (F.col("h") >= LEAST_PICTURE))
