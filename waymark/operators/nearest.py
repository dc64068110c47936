"""Nearest line within a radius, and the facing that follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.geo import cell, compass, js_round, projected

# Fixed values in metres: least length of a segment, radius of the search (exclusive), side of a cell.  A cell of two radii
# lists a short segment in two fifths of the rows that one of a radius takes, for 1.6 times the pairs.
LEAST_LENGTH, RADIUS, CELL = 3.0, 25.0, 50.0
#: Cells along a block, by which rows are dealt; pairs of a point and a line that are measured at once; pairs of a cell from which it is measured alone.
SIDE, AT_ONCE, CROWDED = 8, 32_768, 2_000


def polyline_segments(lines: DataFrame, key: str = "line_id", positions: str = "pos") -> DataFrame:
    """Segments of consecutive vertices of ``positions`` (x, y, x, y, ...); an odd last number is ignored.

    seg_id is the line's key and the vertex number, so it follows file order.
    """
    n = F.floor(F.size(positions) / 2).cast("int")
    at = F.when(n >= 2, F.sequence(F.lit(0), n - 2))
    out = lines.select(F.col(key), F.col(positions).alias("_p"), F.explode(at).alias("k"))
    point = [F.element_at("_p", (F.col("k") * 2 + i).cast("int")) for i in (1, 2, 3, 4)]
    return out.select(F.col(key), "k", *(p.alias(name) for p, name in zip(point, ("ax", "ay", "bx", "by"), strict=True)))


def _listed(segments: DataFrame, side: float = CELL) -> DataFrame:
    """Segments that are long enough, in each cell (gx, gy) of this side that they can reach: for every column of cells those beside the
    part of the segment that crosses the column widened by the radius, so a long one is listed along its length."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    long_enough = segments.where((bx - ax) * (bx - ax) + (by - ay) * (by - ay) >= LEAST_LENGTH**2)
    listed = long_enough.select(
        "*",
        F.explode(F.sequence(cell(F.least(ax, bx) - RADIUS, side), cell(F.greatest(ax, bx) + RADIUS, side))).alias("gx"),
    )
    # heights of the segment where it enters and leaves the widened column; an upright one has both ends there
    west, east = F.col("gx") * F.lit(side) - F.lit(RADIUS), (F.col("gx") + 1) * F.lit(side) + F.lit(RADIUS)
    clipped = [F.when(bx != ax, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - ax) / (bx - ax)))).otherwise(F.lit(float(k))) for k, edge in enumerate((west, east))]
    ends = [ay + t * (by - ay) for t in clipped]
    listed = listed.withColumns({"_y0": ends[0], "_y1": ends[1]})
    rows = F.sequence(cell(F.least("_y0", "_y1") - RADIUS, side), cell(F.greatest("_y0", "_y1") + RADIUS, side))
    return listed.select("*", F.explode(rows).alias("gy")).drop("_y0", "_y1")


def _probe(points: DataFrame, key: str, side: float = CELL) -> DataFrame:
    points = points.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    return points.select(key, F.col("x").alias("px"), F.col("y").alias("py"), cell(F.col("x"), side).alias("gx"), cell(F.col("y"), side).alias("gy"))


def _projected() -> tuple[Column, Column, Column]:
    return projected(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))


def nearest_segments(points: DataFrame, segments: DataFrame, key: str = "fid") -> DataFrame:
    """For each point its nearest segment closer than RADIUS: key, seg_id, d, qx, qy, dx, dy, px, py.

    Short segments go first, and points without key or place.  Blocks of SIDE by SIDE
    cells are dealt out, a segment to each block that it can reach; a task goes
    through its blocks and keeps of a point's lines the nearest only, so no pair is
    ever ranked or shuffled.  Ties go to the least seg_id; of a key that repeats, its
    nearest place counts.  Exact within the radius.
    """
    return _least(_found(points, segments, key), key, ["qx", "qy", "dx", "dy", "px", "py"]).select(key, "seg_id", "d", "qx", "qy", "dx", "dy", "px", "py")


def nearest_bearings(points: DataFrame, segments: DataFrame, key: str = "fid") -> DataFrame:
    """``face_bearings(nearest_segments(...))``, with bearings made before rows are sent by their key."""
    found = _found(points, segments, key)
    return _least(found.select(key, "seg_id", "d", _facing().alias("face_bearing")), key, ["face_bearing"]).select(key, "face_bearing")


def _least(found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The row of least d, then seg_id, of each key.  Rows are dealt out first: as keys hardly repeat, there is nothing to gain before."""
    row = F.struct("d", "seg_id", *columns)
    return found.repartition(key).groupBy(key).agg(F.min(row).alias("_r")).select(key, "_r.*")


def _found(points: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Each point row that has a segment closer than RADIUS, with the nearest: what ``nearest_segments`` returns, before keys that repeat are told apart."""
    kinds = {key: points.schema[key].dataType, "seg_id": segments.schema["seg_id"].dataType}
    lines = _listed(segments, CELL * SIDE).select("gx", "gy", F.lit(0).alias("_kind"), F.lit(None).cast(kinds[key]).alias("_key"), "seg_id", *(F.col(c).cast("double").alias(f"_{c}") for c in ("ax", "ay", "bx", "by")))
    none = F.lit(None).cast("double")
    probes = _probe(points, key, CELL * SIDE).select("gx", "gy", F.lit(1).alias("_kind"), F.col(key).alias("_key"), F.lit(None).cast(kinds["seg_id"]).alias("seg_id"), F.col("px").cast("double").alias("_ax"), F.col("py").cast("double").alias("_ay"), none.alias("_bx"), none.alias("_by"))
    # a block's segments come first and by seg_id, so that the first of those equally near is the one wanted
    blocks = lines.unionByName(probes).repartition("gx", "gy").sortWithinPartitions("gx", "gy", "_kind", "seg_id")
    measures = [T.StructField(c, T.DoubleType()) for c in ("d", "qx", "qy", "dx", "dy", "px", "py")]
    return blocks.mapInArrow(_searched, T.StructType([T.StructField("_key", kinds[key]), T.StructField("seg_id", kinds["seg_id"]), *measures])).withColumnRenamed("_key", key)


class _Block:
    """The segments of a block in its cells: as arrays, and as lists by cell that keep their order."""

    def __init__(self, gx: int, gy: int, ends: np.ndarray, ids: pa.Array):
        finite = np.isfinite(ends).all(axis=1)
        self.corner, self.ids = (gx * CELL * SIDE, gy * CELL * SIDE), ids.filter(pa.array(finite))
        self.ax, self.ay, bx, by = (np.ascontiguousarray(c) for c in ends[finite].T)
        self.dx, self.dy = bx - self.ax, by - self.ay
        self.ll = self.dx * self.dx + self.dy * self.dy
        # a hair more than the radius, as cells here are told by differences
        x0, x1 = (self._cells(f(self.ax, bx) + s, 0) for f, s in ((np.minimum, -RADIUS - 1e-3), (np.maximum, RADIUS + 1e-3)))
        y0, y1 = (self._cells(f(self.ay, by) + s, 1) for f, s in ((np.minimum, -RADIUS - 1e-3), (np.maximum, RADIUS + 1e-3)))
        wide = x1 - x0 + 1
        n = wide * (y1 - y0 + 1)
        own = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        at = (y0[own] + k // wide[own]) * SIDE + x0[own] + k % wide[own]
        self.listed = own[np.argsort(at, kind="stable")]
        self.sizes = np.bincount(at, minlength=SIDE * SIDE)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _cells(self, v: np.ndarray, axis: int) -> np.ndarray:
        return np.clip(np.floor((v - self.corner[axis]) / CELL), 0, SIDE - 1).astype(np.int64)

    def _measured(self, px: np.ndarray, py: np.ndarray, s: np.ndarray) -> np.ndarray:
        """d, qx and qy, by the arithmetic of ``geo.projected``."""
        ax, ay, dx, dy = self.ax[s], self.ay[s], self.dx[s], self.dy[s]
        t = np.maximum(0.0, np.minimum(1.0, ((px - ax) * dx + (py - ay) * dy) / self.ll[s]))
        qx, qy = ax + t * dx, ay + t * dy
        return np.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)), qx, qy

    def nearest(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points (their numbers, rising) that have a segment in reach of their cell, and the number of the nearest."""
        cells = self._cells(py, 1) * SIDE + self._cells(px, 0)
        held, best = self.sizes[cells], np.full(len(px), -1)
        crowded = self.sizes * np.bincount(cells, minlength=SIDE * SIDE) > CROWDED
        for c in np.flatnonzero(crowded):
            lines, mine = self.listed[self.starts[c] : self.starts[c] + self.sizes[c]], np.flatnonzero(cells == c)
            step = max(1, AT_ONCE // len(lines))
            for at in range(0, len(mine), step):
                p = mine[at : at + step]
                best[p] = lines[self._measured(px[p, None], py[p, None], lines)[0].argmin(axis=1)]
        few = np.flatnonzero((held > 0) & ~crowded[cells])
        if len(few):
            n = held[few]
            first = np.cumsum(n) - n
            s = self.listed[np.repeat(self.starts[cells[few]] - first, n) + np.arange(n.sum())]
            p = np.repeat(few, n)
            d = self._measured(px[p], py[p], s)[0]
            hits = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, first), n))
            best[few] = s[hits[np.searchsorted(hits, first)]]  # the first hit at or after a point's first pair is its own
        found = np.flatnonzero(best >= 0)
        return found, best[found]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest segment of each point, of rows by block with its segments first: one block's segments are held at once."""
    names = ["_key", "seg_id", "d", "qx", "qy", "dx", "dy", "px", "py"]
    at, parts, block = None, [], None
    for batch in batches:
        gx, gy, kind = (batch.column(i).to_numpy() for i in range(3))
        ends = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5, 9)], 1)
        cuts = np.flatnonzero((np.diff(gx) != 0) | (np.diff(gy) != 0) | (np.diff(kind) != 0)) + 1
        out = []
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if (gx[i], gy[i]) != at:
                at, parts, block = (gx[i], gy[i]), [], None
            if kind[i] == 0:
                parts.append((ends[i:j], batch.column(4).slice(i, j - i)))
                continue
            if not parts:
                continue
            if block is None:
                block = _Block(int(gx[i]), int(gy[i]), np.concatenate([e for e, _ in parts]), pa.concat_arrays([s for _, s in parts]))
            placed = np.flatnonzero(np.isfinite(ends[i:j, :2]).all(axis=1))
            px, py = ends[i:j, 0][placed], ends[i:j, 1][placed]
            p, s = block.nearest(px, py)
            px, py = px[p], py[p]
            d, qx, qy = block._measured(px, py, s)
            near = d < RADIUS
            if near.any():
                out.append((placed[p[near]] + i, block.ids.take(pa.array(s[near])), *(c[near] for c in (d, qx, qy, block.dx[s], block.dy[s], px, py))))
        if out:
            keys, ids, *measures = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(np.concatenate(keys))), pa.concat_arrays(ids), *(pa.array(np.concatenate(m)) for m in measures)], names)


def near_segments(points: DataFrame, segments: DataFrame, key: str = "fid") -> DataFrame:
    """The distinct keys of points that have a segment closer than RADIUS; a point's search ends at the first one, as none is ranked."""
    probe, listed = _probe(points, key).alias("p"), _listed(segments.select("ax", "ay", "bx", "by")).alias("s")
    near = (F.col("p.gx") == F.col("s.gx")) & (F.col("p.gy") == F.col("s.gy")) & (_projected()[2] < RADIUS)
    return probe.join(listed, near, "left_semi").select(key).distinct()


def _facing() -> Column:
    dx, dy = F.col("dx"), F.col("dy")
    tangent = compass(dx, dy)
    z = dx * (F.col("py") - F.col("qy")) - dy * (F.col("px") - F.col("qx"))
    return js_round(F.when(z > 0, tangent).otherwise(F.pmod(tangent + 180.0, F.lit(360.0))), 1)


def face_bearings(nearest: DataFrame, key: str = "fid") -> DataFrame:
    """key and face_bearing in tenths of a degree: the line's bearing, turned round on its right side and on it."""
    return nearest.select(key, _facing().alias("face_bearing"))
