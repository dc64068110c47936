"""The whole chain from a sheet's drawing trace to its codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import sheetmodel
from waymark.plans.registry import query
from waymark.plans.staging import Stage
from waymark.sources import features as src

# A page per customer: 2 to 4 groups of columns with doubled, short and missing dividers, rows with gaps and slivers.
_PAGE = "c_custkey p, 2 + c_custkey % 3 g, 5 + c_custkey % 6 r, 105 + c_custkey % 9 pitch, 20 + c_custkey % 4 rh"

_SHEET = """pg AS (SELECT c_custkey p, 2 + c_custkey % 3 g, 5 + c_custkey % 6 r, 105 + c_custkey % 9 pitch, 20 + c_custkey % 4 rh FROM customer),
gr AS (SELECT *, 40 + k * pitch l FROM (SELECT *, unnest(range(g)) k FROM pg)),
dv AS (SELECT p, l, CASE WHEN k = g - 1 THEN 30 + CAST(floor(r * rh * 0.6e0) AS INTEGER) ELSE 30 + r * rh END y1, k FROM gr WHERE NOT (k > 0 AND (p + k) % 4 = 0)),
vr AS (SELECT p, 20e0 x, 30 y0, 30 + r * rh y1 FROM pg UNION ALL SELECT p, 40 + g * pitch, 30, 30 + r * rh FROM pg UNION ALL SELECT p, l + unnest([0, 20, 65]), 30, y1 FROM dv
  UNION ALL SELECT p, l + 2, 30, y1 FROM dv WHERE p % 2 = 0 UNION ALL SELECT p, l + 30, 50, 60 FROM dv),
hr AS (SELECT p, 30 + row * rh + s.dy y, l + s.a x0, l + s.b x1 FROM (SELECT *, unnest(range(r + 1)) AS row FROM gr), (SELECT unnest([{'a': 0, 'b': 25, 'dy': 0}, {'a': 25, 'b': 50, 'dy': 1}, {'a': 50, 'b': 65, 'dy': 0}]) s) q WHERE s.a = 0 OR NOT ((row + k + p) % 6 = 0 AND row > 0 AND row < r)
  UNION ALL SELECT p, 33, l, l + 65 FROM gr WHERE p % 5 = 0),
tl AS (SELECT p, median(y0) top, median(y1) bot FROM (SELECT *, max(y1 - y0) OVER (PARTITION BY p) mx FROM vr) WHERE y1 - y0 > 0.95 * mx GROUP BY 1),
dl AS (SELECT p, x, x - lag(x) OVER (PARTITION BY p ORDER BY x) < 4 near FROM vr JOIN tl USING (p) WHERE y0 <= top + 10 AND y1 - y0 > 40),
cb AS (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY x) i FROM (SELECT p, avg(x) x FROM (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY p ORDER BY x) c FROM dl) GROUP BY p, c)),
nb AS (SELECT *, lead(x) OVER w rt, lead(x, 2) OVER w af, min(x) OVER (PARTITION BY p) tleft, max(x) OVER (PARTITION BY p) tright FROM cb WINDOW w AS (PARTITION BY p ORDER BY i)),
nc AS (SELECT *, CASE WHEN af - rt > 24 AND af - rt < 140 THEN af - rt END sw, x - lag(x) OVER (PARTITION BY p ORDER BY i) step FROM nb WHERE rt - x BETWEEN 12 AND 32 AND x > tleft + 1),
md AS (SELECT n.p, any_value(n.tright) tright, any_value(n.tleft) tleft, min(c.x) o, coalesce(median(c.step), 109) pitch, coalesce(nullif(median(c.rt - c.x), 0), 20) nw, median(c.sw) sw FROM (SELECT DISTINCT p, tleft, tright FROM nb) n LEFT JOIN nc c USING (p) GROUP BY 1),
mm AS (SELECT p, tright, pitch, nw, coalesce(nullif(sw, 0), floor(pitch * 0.52e0 + 0.5e0)) sw, coalesce(o, tleft + nw) o FROM md),
la AS (SELECT *, o + k * pitch want FROM (SELECT *, unnest(range(25)) k FROM mm) WHERE o + k * pitch + nw + sw <= tright + pitch * 0.3e0),
ht AS (SELECT la.p, k, arg_min(nc.x, i) x, arg_min(nc.rt, i) rt, first(nc.sw ORDER BY i) hw FROM la JOIN nc ON nc.p = la.p AND abs(nc.x - want) <= pitch * 0.35e0 GROUP BY 1, 2),
gp AS (SELECT la.p, la.k, coalesce(x, want) nl, coalesce(rt, want + nw) + coalesce(hw, sw) sr, x IS NULL made FROM la LEFT JOIN ht ON ht.p = la.p AND ht.k = la.k),
hc AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY p, k ORDER BY y, x0, x1 ROWS UNBOUNDED PRECEDING) c FROM (SELECT gp.*, y, greatest(x0, nl) x0, least(x1, sr) x1, coalesce(y - lag(y) OVER (PARTITION BY gp.p, k ORDER BY y, hr.x0, hr.x1) < 2, false) near FROM gp JOIN hr ON hr.p = gp.p AND x1 > nl AND x0 < sr)),
cv AS (SELECT p, k, min(y) y, sum(greatest(x1 - greatest(x0, coalesce(reach, x0)), 0)) cov, any_value(sr - nl) w FROM (SELECT *, max(x1) OVER (PARTITION BY p, k, c ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM hc) GROUP BY p, k, c),
bd AS (SELECT p, k, y top, lead(y) OVER (PARTITION BY p, k ORDER BY y) bottom FROM cv JOIN tl USING (p) WHERE cov > 0.6e0 * w AND y BETWEEN tl.top - 1 AND bot + 1),
ce AS (SELECT p, k, row_number() OVER (PARTITION BY p, k ORDER BY top) - 1 AS row, top, bottom FROM bd WHERE bottom - top >= 5)"""


def _strokes(spark: SparkSession, d: str) -> DataFrame:
    """page and value: the trace XML of every page."""

    def path(x0: str, y0: str, x1: str, y1: str) -> str:
        return f"""concat('<stroke_path linewidth="1"><moveto x="', {x0}, '" y="', {y0}, '"/><lineto x="', {x1}, '" y="', {y1}, '"/></stroke_path>')"""

    end = "case when k = g - 1 then 30 + cast(floor(r * rh * 0.6e0) as int) else 30 + r * rh end"
    left = "40 + k * pitch"
    verticals = [path(f"{left} + {dx}", "30", f"{left} + {dx}", end) for dx in (0, 20, 65)]
    verticals += [f"case when p % 2 = 0 then {path(f'{left} + 2', '30', f'{left} + 2', end)} else '' end", path(f"{left} + 30", "50", f"{left} + 30", "60")]
    groups = f"transform(sequence(0, g - 1), k -> case when k > 0 and (p + k) % 4 = 0 then '' else concat({', '.join(verticals)}) end)"
    pieces = [(0, 25, 0), (25, 50, 1), (50, 65, 0)]
    rows = [path(f"{left} + {a}", f"30 + w * rh + {dy}", f"{left} + {b}", f"30 + w * rh + {dy}") for a, b, dy in pieces]
    borders = f"flatten(transform(sequence(0, g - 1), k -> transform(sequence(0, r), w -> concat({rows[0]}, case when (w + k + p) % 6 = 0 and w > 0 and w < r then '' else concat({rows[1]}, {rows[2]}) end))))"
    slivers = f"transform(sequence(0, g - 1), k -> case when p % 5 = 0 then {path(left, '33', f'{left} + 65', '33')} else '' end)"
    frame = [path("20", "30", "20", "30 + r * rh"), path("40 + g * pitch", "30", "40 + g * pitch", "30 + r * rh")]
    page = spark.read.parquet(f"{d}/customer.parquet").selectExpr(*[c.strip() for c in _PAGE.split(",")])
    page = page.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p")  # a small file grows to long texts
    return page.selectExpr("p page", f"concat_ws('', array({', '.join(frame)}), {groups}, {borders}, {slivers}) value")


@query(f"WITH {_SHEET} SELECT ce.p page, CAST(ce.k AS INTEGER) k, CAST(ce.row AS INTEGER) AS row, top, bottom, made, concat('TS', 101 + p % 40 + ce.k * 12 + ce.row, CASE WHEN ce.row % 3 = 0 THEN 'A' ELSE '' END) code, false falls FROM ce JOIN gp USING (p, k)")
def sheet_chain(spark: SparkSession, d: str) -> DataFrame:
    """Codes of all cells of all pages, from the drawing trace through dividers, groups and rows."""
    pages = _strokes(spark, d)
    rules = Stage(spark, "sheets").put(src.drawn_rules(pages), "rules")
    customers = spark.read.parquet(f"{d}/customer.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    cells = customers.select(F.col("c_custkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(11))))
    number = F.expr("concat(' ', 101 + page % 40 + col * 12 + row, case when row % 3 = 0 then 'a' else '' end)")
    tokens = cells.withColumn("tokens", F.array(F.lit("none"), F.lit("TC 9"), number, F.lit("999")))
    sheets = pages.select("page", F.lit("TS").alias("prefix"), F.lit(101).alias("lo"), F.lit(400).alias("hi"), F.lit("regulatory").alias("grp"))
    return sheetmodel.sheet_codes(rules, tokens, sheets)
