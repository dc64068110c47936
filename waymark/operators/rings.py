"""The nearest lines of every point at any distance, and the k nearest, by rings of cells.

Lines are cut into short pieces that lie in fine cells; a cell knows the box of its
pieces.  A point looks at the boxes in the nine coarse cells round it: the
furthest corners of boxes that hold k lines bound its k-th distance, and only
boxes that begin within that bound are opened.  If the bound ends inside the nine
cells the point is done; the others go on in cells four times as wide.  So a point
in a dense area opens a few small cells.  Boxes that were opened at a coarse level are
followed down to the finest one, and each level closes what lies beyond the bound that
its smaller boxes give; so a point far off meets few lines, however many there are
behind its boxes.  The result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import projected
from waymark.operators.nearest import LEAST_LENGTH
from waymark.plans.staging import Stage

#: Side of the first coarse cells in metres, fine cells along a side, growth of a round, greatest length of a piece.
FIRST, FINE, FACTOR, PIECE = 64.0, 4, 4, 32.0
#: Points of one coarse cell in one task's share of a join.
CROWD = 10_000


def _cell(c: str, side: float) -> Column:
    return F.floor(F.col(c) / F.lit(side)).cast("long")


def _pieces(segments: DataFrame) -> DataFrame:
    """The pieces of every usable segment: its middle, its box, and whether it is the first."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    own = segments.where("seg_id is not null").select("seg_id", "ax", "ay", "bx", "by").where(dx * dx + dy * dy >= LEAST_LENGTH**2)
    n = F.ceil(F.sqrt(dx * dx + dy * dy) / F.lit(PIECE)).cast("int")
    cut = own.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = {(axis, end): F.col(f"a{axis}") + (F.col(f"b{axis}") - F.col(f"a{axis}")) * ((F.col("i") + end) / F.col("n")) for axis in "xy" for end in (0.0, 0.5, 1.0)}
    boxes = {f"{axis}{k}": f(at[axis, 0.0], at[axis, 1.0]) for axis in "xy" for k, f in ((0, F.least), (1, F.greatest))}
    return cut.select("seg_id", "ax", "ay", "bx", "by", (F.col("i") == 0).cast("int").alias("head"), at["x", 0.5].alias("mx"), at["y", 0.5].alias("my"), *(c.alias(name) for name, c in boxes.items()))


def _box() -> list[Column]:
    return [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]


def _nodes(pieces: DataFrame) -> DataFrame:
    """fx, fy, heads and box of the finest cells that hold pieces."""
    fine = FIRST / FINE
    return pieces.groupBy(_cell("mx", fine).alias("fx"), _cell("my", fine).alias("fy")).agg(F.sum("head").alias("heads"), *_box())


def _parents(nodes: DataFrame) -> DataFrame:
    """The cells FACTOR times as wide."""
    return nodes.groupBy(*(F.floor(F.col(f"f{c}") / FACTOR).cast("long").alias(f"f{c}") for c in "xy")).agg(F.sum("heads").alias("heads"), *_box())


def _reached(met: DataFrame) -> DataFrame:
    """``met`` with near and far, the least and greatest distance of a point and a box."""
    gaps = [F.greatest(F.col(f"{c}0") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"{c}1"), F.lit(0.0)) for c in "xy"]
    reach = [F.greatest(F.abs(F.col(f"{c}0") - F.col(f"p{c}")), F.abs(F.col(f"p{c}") - F.col(f"{c}1"))) for c in "xy"]
    return met.withColumns({"near": F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1]), "far": F.sqrt(reach[0] * reach[0] + reach[1] * reach[1])})


def _bound(k: int, *keys: str) -> tuple[Column, Callable[[str], Column]]:
    """The lines that a point's boxes hold so far by distance, and from that column the distance within which they hold k; null if they hold fewer."""
    point = Window.partitionBy(*keys)
    held = F.sum("heads").over(point.orderBy("far", "fx", "fy").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return held, lambda c: F.min(F.when(F.col(c) >= k, F.col("far"))).over(point)


def _opened(opened: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The next finer boxes of opened ones that begin within the bound, which they may lessen."""
    inside = nodes.withColumnsRenamed({"fx": "cx", "fy": "cy"}).withColumns({f"f{c}": F.floor(F.col(f"c{c}") / FACTOR).cast("long") for c in "xy"})
    met = _reached(opened.join(inside, ["fx", "fy"])).where("bound is null or near <= bound")
    met = met.select("pid", "px", "py", F.col("cx").alias("fx"), F.col("cy").alias("fy"), "heads", "near", "far", "bound")
    held, bound = _bound(k, "pid")
    met = met.withColumn("held", held).withColumn("bound", F.least("bound", bound("held")))
    return met.where("bound is null or near <= bound").select("pid", "px", "py", "fx", "fy", "bound")


def _bounded(left: DataFrame, nodes: DataFrame, side: float, k: int) -> DataFrame:
    """pid, px, py, fx, fy, near, bound and border: the boxes that points may have to open in cells of a size."""
    left = left.withColumns({"cx": _cell("px", side), "cy": _cell("py", side)})
    crowds = left.groupBy("cx", "cy").agg(F.count("*").alias("crowd")).select("cx", "cy", F.ceil(F.col("crowd") / CROWD).cast("int").alias("shares"))
    for c in "xy":  # every node is listed in the nine coarse cells that may look at it
        own = F.floor(F.col(f"f{c}") / FINE).cast("long")
        nodes = nodes.withColumn(f"c{c}", F.explode(F.array(own - 1, own, own + 1)))
    listed = nodes.join(crowds, ["cx", "cy"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    dealt = left.join(crowds, ["cx", "cy"]).withColumn("share", F.pmod("pid", "shares").cast("int")).drop("shares")
    met = dealt.join(listed, ["cx", "cy", "share"])
    held, bound = _bound(k, "cx", "cy", "share", "pid")  # a point's boxes are in one partition already: no shuffle
    met = _reached(met).withColumn("held", held).withColumn("bound", bound("held"))
    edges = [d for c in "xy" for d in (F.col(f"p{c}") - (F.col(f"c{c}") - 1) * F.lit(side), (F.col(f"c{c}") + 2) * F.lit(side) - F.col(f"p{c}"))]
    return met.withColumn("border", F.least(*edges)).select("pid", "px", "py", "fx", "fy", "near", "bound", "border")


def k_nearest(points: DataFrame, segments: DataFrame, k: int = 1, key: str = "fid") -> DataFrame:
    """``key``, rank, seg_id and d of the ``k`` nearest segments of every point of ``points(key, x, y)``.

    Nearer ones come first, ties by smaller seg_id.  Segments shorter than
    LEAST_LENGTH, or with a null, take no part, nor do points without key or
    place; rows that repeat a key are separate points.  A seg_id names one segment.
    Where there are fewer than ``k`` segments all are returned.
    """
    stage = Stage(points.sparkSession, "rings")
    usable = points.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    numbered = stage.put(usable.select(key, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).withColumn("pid", F.monotonically_increasing_id()), "points")
    pieces = stage.put(_pieces(segments), "pieces")
    ends = [f(c) for f in (F.min, F.max) for c in ("mx", "my")]
    x0, y0, x1, y1 = pieces.agg(*ends).first()
    if x0 is None:
        return numbered.where("false").select(key, F.lit(1).alias("rank"), F.lit(0).cast("long").alias("seg_id"), F.lit(0.0).alias("d"))
    px0, py0, px1, py1 = (v if v is not None else 0.0 for v in numbered.agg(*(f(c) for f in (F.min, F.max) for c in ("px", "py"))).first())
    span = max(x1, px1) - min(x0, px0), max(y1, py1) - min(y0, py0)
    last = max(0, math.ceil(math.log(max(*span, FIRST) / FIRST, FACTOR)))
    left, opened, levels = numbered.select("pid", "px", "py"), [], [stage.put(_nodes(pieces), "nodes")]
    for level in range(last + 1):
        if level:
            levels.append(stage.put(_parents(levels[-1]), "nodes"))
        boxes = _bounded(left, levels[level], FIRST * FACTOR**level, k)
        # a piece of which the middle lies outside the nine cells begins half its length nearer at most
        done = "true" if level == last else f"bound <= border - {PIECE / 2}"
        opened.append(stage.put(boxes.where(done).where("bound is null or near <= bound").select("pid", "px", "py", "fx", "fy", "bound"), "opened"))
        if level < last:
            left = stage.put(left.join(opened[-1].select("pid").distinct(), "pid", "left_anti"), "left")
            if left.isEmpty():
                break
    front = opened.pop()
    while opened:
        own = opened.pop()
        front = own.unionByName(stage.put(_opened(front, levels[len(opened)], k), "front"))
    held = pieces.select("seg_id", "ax", "ay", "bx", "by", _cell("mx", FIRST / FINE).alias("fx"), _cell("my", FIRST / FINE).alias("fy"))
    _, _, d = projected(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    near = front.join(held, ["fx", "fy"]).withColumn("d", d).groupBy("pid", "seg_id").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("d", "seg_id"))
    found = near.withColumn("rank", rank).where(f"rank <= {k}")
    return numbered.select("pid", key).join(found, "pid").select(key, "rank", "seg_id", "d")
