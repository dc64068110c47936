"""The library's queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, style
from waymark.functions.text import code_number, id_query, packed_date
from waymark.operators import assemblies as asm
from waymark.operators import catalogue as cat
from waymark.operators import detail, enrich, hits, merge, nearest, search, tablegrid, tiles
from waymark.operators import visibility as vis
from waymark.plans import adapter
from waymark.plans.staging import Stage
from waymark.sources import features as src
from waymark.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_F = adapter.as_cte("f", "lineitem", adapter.FEATURE)
_C = adapter.as_cte("c", "part", adapter.CATALOGUE, "p_type <> 'PROMO'")
_S = adapter.as_cte("s", "orders", adapter.SEGMENT)
_CAT = "coalesce(c.grp, CASE category WHEN 'tourist-sign' THEN 'tourist' WHEN 'traffic-sign-abbreviation' THEN 'other-traffic' ELSE 'none' END)"
_K = f"k AS (SELECT f.*, {_CAT} category_key FROM f LEFT JOIN c ON c.code = f.sign_id)"
_M = """m AS (SELECT f.*, tier, w, h, CASE grp WHEN 'regulatory' THEN 0 WHEN 'warning' THEN 1 WHEN 'informatory' THEN 2 WHEN 'temporary' THEN 3 WHEN 'supplementary' THEN 9 ELSE 5 END rnk
  FROM f JOIN c ON c.code = f.sign_id),
p AS (SELECT gg, count(*) stack_size, greatest(max(x) - min(x), max(y) - min(y)) span FROM m GROUP BY gg)"""
_N = """n AS (SELECT f.fid, s.seg_id, bx - ax dx, "by" - ay dy, x px, y py, ax, ay, greatest(0e0, least(1e0, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) t
  FROM f JOIN (SELECT *, unnest(range(CAST(floor((least(ax, bx) - 25) / 25) AS BIGINT), CAST(floor((greatest(ax, bx) + 25) / 25) AS BIGINT) + 1)) gx FROM s WHERE (bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay) >= 9) s
  ON CAST(floor(f.x / 25) AS BIGINT) = s.gx AND f.y BETWEEN least(ay, "by") - 25 AND greatest(ay, "by") + 25),
q AS (SELECT *, ax + t * dx qx, ay + t * dy qy FROM n),
d AS (SELECT *, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) d FROM q),
nearest AS (SELECT * FROM d WHERE d < 25 QUALIFY row_number() OVER (PARTITION BY fid ORDER BY d, seg_id) = 1),
bearings AS (SELECT fid, floor((CASE WHEN dx * (py - qy) - dy * (px - qx) > 0 THEN b ELSE (b + 180) % 360 END) * 10 + 0.5e0) / 10 face_bearing
  FROM (SELECT *, (degrees(atan2(dx, dy)) + 360) % 360 b FROM nearest))"""
_ST = """st AS (SELECT fid, gg, sign_id, CAST(row_number() OVER o - 1 AS BIGINT) stack_index, stack_size, w pic_w, first_value(x) OVER o anchor_x, first_value(y) OVER o anchor_y,
  first_value(face_bearing) OVER o stack_bearing,
  CAST(floor((sum(120e0 * h / w) OVER o - first_value(120e0 * h / w) OVER o / 2 + 10 * (row_number() OVER o - 1) - 120e0 * h / w / 2) / 8 + 0.5e0) * 8 AS INTEGER) stack_off, first_value(tier) OVER o stack_tier
  FROM m JOIN p USING (gg) LEFT JOIN bearings USING (fid) WHERE stack_size >= 2 AND span <= 15
  WINDOW o AS (PARTITION BY gg ORDER BY rnk, sign_id, fid ROWS UNBOUNDED PRECEDING))"""
_E = """e AS (SELECT f.fid, f.gg, f.sign_id, f.category, f.prio, stack_index, stack_off, stack_tier, coalesce(anchor_x, x) x, coalesce(anchor_y, y) y,
  CASE WHEN st.fid IS NOT NULL THEN stack_bearing ELSE b.face_bearing END face_bearing
  FROM f LEFT JOIN (SELECT * FROM bearings) b ON b.fid = f.fid AND f.category = 'traffic-sign-abbreviation' LEFT JOIN st ON st.fid = f.fid AND f.category = 'traffic-sign-abbreviation')"""
_L = """l AS (SELECT *, NULL::INTEGER minzoom, NULL::INTEGER maxzoom FROM e WHERE stack_index IS NULL
  UNION ALL SELECT *, NULL, 12 FROM e WHERE stack_index = 0 UNION ALL SELECT *, 13, NULL FROM e WHERE stack_index >= 0)"""


def _wgs84(source: str) -> str:
    lng_lat = ", ".join(f"{e} AS {name}" for name, e in geo.wgs84_sql().items())
    return f"SELECT *, {lng_lat} FROM {source}"


_TX = "CAST(floor((lng + 180) / 360 * pow(2, z)) AS BIGINT)"
_TY = "CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS BIGINT)"


def query(sql: str | None = None):
    """Register a query and its SQL under the function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return cat.with_category(adapter.features(spark, d), adapter.catalogue(spark, d))


def _bearings(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_bearings(adapter.features(spark, d), adapter.segments(spark, d))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once for all branches of a plan that read it."""
    return Stage(df.sparkSession, "plan").put(df, name)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return asm.catalogued_members(adapter.features(spark, d), adapter.catalogue(spark, d))


def _stacks(spark: SparkSession, d: str) -> DataFrame:
    return asm.stack_assemblies(_members(spark, d), lines=adapter.segments(spark, d))


def _enriched(spark: SparkSession, d: str, turned: bool = True) -> DataFrame:
    """Enriched features; only callers that read ``face_bearing`` pay for the search of lines, for the sign layer and first members of posts."""
    f, signs = adapter.features(spark, d), F.col("category") == enrich.SIGN_LAYER
    if not turned:
        return enrich.enriched(f, None, asm.stack_assemblies(_members(spark, d), wanted=signs))
    lines = adapter.segments(spark, d)
    bearings = nearest.nearest_bearings(f.where(signs), lines)
    # all stack rows: to tell those that are wanted, one of the two readers of members would take another column and a shuffle of its own
    return enrich.enriched(f, bearings, asm.stack_assemblies(_members(spark, d), lines=lines))


@query(f"WITH {_F}, {_C}, {_K} SELECT category_key, count(*) n FROM k GROUP BY 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).groupBy("category_key").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, {_C}, {_K} SELECT fid, sign_id, category_key FROM k WHERE category_key IN ('regulatory', 'tourist')")
def category_filter(spark: SparkSession, d: str) -> DataFrame:
    state = vis.FilterState(enabled=frozenset({"regulatory", "tourist"}))
    return vis.visible(_keyed(spark, d), state).select("fid", "sign_id", "category_key")


_IDS = frozenset({"TS1", "TS5", "TS42"})


@query(f"WITH {_F} SELECT fid, gg, sign_id FROM f WHERE sign_id IN ('TS1', 'TS5', 'TS42') AND sign_id NOT IN ('TS5')")
def id_filter(spark: SparkSession, d: str) -> DataFrame:
    state = vis.FilterState(mode="sign-id", ids=_IDS, hidden=frozenset({"TS5"}))
    return vis.visible(adapter.features(spark, d), state).select("fid", "gg", "sign_id")


@query(f"""WITH {_F}, {_C}, {_M}, g AS (SELECT DISTINCT m.gg FROM m JOIN p USING (gg) WHERE stack_size >= 2 AND span <= 15 AND m.sign_id IN ('TS1', 'TS5', 'TS42'))
SELECT fid, gg, sign_id FROM f WHERE (sign_id IN ('TS1', 'TS5', 'TS42') OR gg IN (SELECT gg FROM g)) AND sign_id <> 'TS7'""")
def id_filter_expanded(spark: SparkSession, d: str) -> DataFrame:
    state = vis.FilterState(mode="sign-id", ids=_IDS, hidden=frozenset({"TS7"}))
    companions = asm.companions_of(adapter.features(spark, d), adapter.catalogue(spark, d), sorted(_IDS))
    return vis.visible(adapter.features(spark, d), state, companions).select("fid", "gg", "sign_id")


@query(f"WITH {_F} SELECT category, count(*) n FROM f WHERE sign_id NOT IN ('TS1', 'TS5', 'TS42') GROUP BY 1")
def denylist_only(spark: SparkSession, d: str) -> DataFrame:
    state = vis.FilterState(mode="sign-id", hidden=_IDS)
    return vis.visible(adapter.features(spark, d), state).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, g AS (SELECT fid, CASE WHEN category = 'pole' THEN NULL ELSE sign_id END sign_id FROM f) SELECT sign_id IS NULL unsigned, count(*) n FROM g WHERE NOT coalesce(sign_id IN ('TS1', 'TS5', 'TS42'), false) GROUP BY 1")
def denylist_null_safe(spark: SparkSession, d: str) -> DataFrame:
    f = adapter.features(spark, d).withColumn("sign_id", F.when(F.col("category") != "pole", F.col("sign_id")))
    shown = vis.visible(f, vis.FilterState(mode="sign-id", hidden=_IDS))
    return shown.groupBy(F.col("sign_id").isNull().alias("unsigned")).agg(F.count("*").alias("n"))


@query(f"WITH {_F}, {_S}, {_N} SELECT fid, seg_id, round(d, 6) d FROM nearest")
def nearest_marking(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_segments(adapter.features(spark, d), adapter.segments(spark, d)).select("fid", "seg_id", F.round("d", 6).alias("d"))


@query(f"WITH {_F}, {_S}, {_N} SELECT fid, face_bearing FROM bearings")
def face_bearing(spark: SparkSession, d: str) -> DataFrame:
    return _bearings(spark, d)


@query(f"WITH {_F}, {_S}, {_N} SELECT count(*) features, count(face_bearing) matched, round(100e0 * count(face_bearing) / count(*), 6) percent FROM f LEFT JOIN bearings USING (fid)")
def bearing_coverage(spark: SparkSession, d: str) -> DataFrame:
    f = adapter.features(spark, d)
    matched = nearest.near_segments(f, adapter.segments(spark, d)).withColumn("matched", F.lit(1))  # whatever has a line near has a bearing
    j = f.select("fid").join(matched, "fid", "left")
    n, m = F.count("*"), F.count("matched")
    return j.agg(n.alias("features"), m.alias("matched"), F.round(m * 100.0 / n, 6).alias("percent"))


@query(f"WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST} SELECT fid, gg, sign_id, stack_index, stack_size, pic_w, round(anchor_x, 6) anchor_x, round(anchor_y, 6) anchor_y, stack_bearing, stack_off, stack_tier FROM st")
def assembly_stack(spark: SparkSession, d: str) -> DataFrame:
    s = _stacks(spark, d).withColumn("stack_index", F.col("stack_index").cast("long"))
    return s.withColumn("anchor_x", F.round("anchor_x", 6)).withColumn("anchor_y", F.round("anchor_y", 6))


@query(f"WITH {_F}, {_C}, {_M} SELECT CASE WHEN stack_size < 2 THEN 'single' WHEN span <= 15 THEN 'stacked' ELSE 'skipped' END outcome, count(*) n, max(stack_size) tallest FROM p GROUP BY 1")
def assembly_skipped_span(spark: SparkSession, d: str) -> DataFrame:
    p = asm.assembly_spans(_members(spark, d))
    outcome = F.when(F.col("stack_size") < 2, "single").when(F.col("span") <= asm.SPAN_CAP, "stacked").otherwise("skipped")
    return p.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.max("stack_size").alias("tallest"))


@query(f"WITH {_F}, {_C}, {_M} SELECT DISTINCT m.sign_id, m.gg FROM m JOIN p USING (gg) WHERE stack_size >= 2 AND span <= 15")
def sign_groups(spark: SparkSession, d: str) -> DataFrame:
    return asm.companion_index(_members(spark, d))


@query(f"WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E} SELECT fid, category, round(x, 6) x, round(y, 6) y, face_bearing, stack_index, stack_off, stack_tier FROM e")
def enriched_features(spark: SparkSession, d: str) -> DataFrame:
    e = _enriched(spark, d)
    return e.select("fid", "category", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "face_bearing", F.col("stack_index").cast("long").alias("stack_index"), "stack_off", "stack_tier")


@query(f"WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E}, {_L} SELECT fid, category, stack_index, minzoom, maxzoom FROM l")
def lod_copies(spark: SparkSession, d: str) -> DataFrame:
    return enrich.lod_copies(_enriched(spark, d, turned=False)).select("fid", "category", F.col("stack_index").cast("long").alias("stack_index"), "minzoom", "maxzoom")


@query(f"WITH {_F}, w AS ({_wgs84('f')}), t AS (SELECT *, 13 z FROM w) SELECT {_TX} tx, {_TY} ty, count(*) n FROM t GROUP BY 1, 2")
def tile_assign_z13(spark: SparkSession, d: str) -> DataFrame:
    t = tiles.tiled(geo.to_wgs84(adapter.features(spark, d)), range(13, 14))
    return t.groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E}, w AS ({_wgs84('e')}), t AS (SELECT *, unnest(range(9, 14)) z FROM w WHERE category = 'traffic-sign-abbreviation') SELECT z, {_TX} tx, {_TY} ty, count(*) n FROM t GROUP BY 1, 2, 3")
def tile_full(spark: SparkSession, d: str) -> DataFrame:
    t = tiles.full_table(geo.to_wgs84(_enriched(spark, d, turned=False)), range(9, 14))
    return t.groupBy(F.col("z").cast("long").alias("z"), "tx", "ty").agg(F.count("*").alias("n"))


@query(f"""WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E}, {_L}, w AS ({_wgs84('l')}),
t AS (SELECT *, {_TX} tx, {_TY} ty FROM (SELECT *, unnest(range(9, 14)) z FROM w) WHERE (minzoom IS NULL OR z >= minzoom) AND (maxzoom IS NULL OR z <= maxzoom))
SELECT z, tx, ty, fid, minzoom IS NOT NULL pinned FROM t WHERE minzoom IS NOT NULL
UNION ALL SELECT z, tx, ty, fid, false FROM (SELECT * FROM t WHERE minzoom IS NULL QUALIFY row_number() OVER (PARTITION BY z, tx, ty ORDER BY prio, fid) <= 20)""")
def tile_overview_thinned(spark: SparkSession, d: str) -> DataFrame:
    copies = geo.to_wgs84(enrich.lod_copies(_enriched(spark, d, turned=False)))
    placed = tiles.tiled(copies, range(9, 14)).select("z", "tx", "ty", "fid", "prio", "minzoom")
    kept = tiles.thinned(_written(placed, "placed"), F.col("prio"))
    return kept.select(F.col("z").cast("long").alias("z"), "tx", "ty", "fid", F.col("minzoom").isNotNull().alias("pinned"))


@query(f"WITH {_F} SELECT fid, round(lng, 6) lng, round(lat, 6) lat FROM ({_wgs84('f')})")
def reproject_wgs84(spark: SparkSession, d: str) -> DataFrame:
    return geo.to_wgs84(adapter.features(spark, d)).select("fid", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


_RANK = "CASE grp WHEN 'regulatory' THEN 1 WHEN 'warning' THEN 2 WHEN 'informatory' THEN 3 WHEN 'supplementary' THEN 4 ELSE 5 END"


def _hits(spark: SparkSession, d: str, **how) -> DataFrame:
    c = adapter.catalogue(spark, d)
    return search.search(search.search_index(c, c), **how)


@query(f"WITH {_C} SELECT code, grp, nullif(en, '') description, CASE WHEN code = 'TS1' THEN 2 WHEN starts_with(code, 'TS1') THEN 1 ELSE 0 END score FROM c WHERE starts_with(code, 'TS1') OR contains(lower(concat(code, ' ', en)), 'ts-1')")
def search_id(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, query="ts-1").drop("group_ord", "ord")


@query(f"WITH {_C} SELECT code, grp, coalesce(nullif(zh, ''), nullif(en, '')) description FROM c WHERE contains(lower(concat(code, ' ', en)), 'widget') OR contains(zh, 'widget')")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, query="  Widget ", locale="zh-HK").select("code", "grp", "description")


@query(f"WITH {_C} SELECT code, grp FROM c WHERE contains(zh, '停') AND grp IN ('regulatory', 'warning')")
def search_facet(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, query="停", groups=["regulatory", "warning"]).select("code", "grp")


@query(f"WITH {_C} SELECT code, grp FROM c WHERE starts_with(code, 'TS2') OR contains(lower(concat(code, ' ', en)), 'ts2') ORDER BY CASE WHEN code = 'TS2' THEN 2 WHEN starts_with(code, 'TS2') THEN 1 ELSE 0 END DESC, {_RANK}, ord LIMIT 20 OFFSET 10")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page(_hits(spark, d, query="TS2"), 10, 20).select("code", "grp")


@query(f"WITH {_C} SELECT bool_and(code IN ('TS20', 'TS2')) all_selected, count(*) n_hits, count_if(code IN ('TS20', 'TS2')) n_selected FROM c WHERE starts_with(code, 'TS20')")
def search_selection(spark: SparkSession, d: str) -> DataFrame:
    return search.all_selected(_hits(spark, d, query="ts 20"), ["TS20", "TS2"])


def _overrides(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 7 = 0").selectExpr("concat('TS', p_partkey) code", "case when p_partkey % 2 = 0 then p_brand end en", "case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then '讓路' end zh")


_O = "o AS (SELECT concat('TS', p_partkey) code, CASE WHEN p_partkey % 2 = 0 THEN p_brand END en, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '讓路' END zh FROM part WHERE p_partkey % 7 = 0)"


@query(f"WITH {_C}, {_O}, b AS (SELECT coalesce(c.code, o.code) code, coalesce(o.en, c.en) en, coalesce(o.zh, c.zh) zh FROM c FULL JOIN o ON o.code = c.code) SELECT code, en, zh, nullif(en, '') shown_en, coalesce(nullif(zh, ''), nullif(en, '')) shown_zh FROM b")
def description_resolve(spark: SparkSession, d: str) -> DataFrame:
    b = cat.bilingual(adapter.catalogue(spark, d), _overrides(spark, d))
    return b.select("code", "en", "zh", *(cat.description(F.col("en"), F.col("zh"), loc).alias(f"shown_{loc[:2]}") for loc in ("en", "zh-HK")))


@query(f"WITH {_C} SELECT tier, count(*) n, string_agg(code, ',' ORDER BY ord) codes FROM c GROUP BY tier")
def codes_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return cat.codes_by(adapter.catalogue(spark, d), "tier").select("tier", F.size("codes").cast("long").alias("n"), F.concat_ws(",", "codes").alias("codes"))


@query(f"WITH {_C} SELECT code, CASE WHEN w / 120e0 > 1.7 OR w / 120e0 < 0.58 THEN 2 WHEN w / 120e0 > 1.25 OR w / 120e0 < 0.8 OR greatest(w, 120) > 320 THEN 1 ELSE 0 END picture_tier FROM c")
def picture_tiers(spark: SparkSession, d: str) -> DataFrame:
    return adapter.catalogue(spark, d).select("code", cat.picture_tier(F.col("w").cast("double"), F.col("h")).alias("picture_tier"))


@query("SELECT concat('TS', p_partkey) code FROM part WHERE p_size / 50e0 >= 0.85")
def plate_codes(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    pixels = p.select(F.concat(F.lit("TS"), "p_partkey").alias("code"), F.explode(F.array(F.col("p_size") / 50.0, F.col("p_size") / 50.0)).alias("alpha"))
    return cat.plate_codes(cat.mean_coverage(pixels))


_SIZE = "CASE tier WHEN 0 THEN 0.30e0 WHEN 1 THEN 0.40e0 ELSE 0.55e0 END"
_LEAST = "CASE tier WHEN 0 THEN 13e0 WHEN 1 THEN 14.5e0 ELSE 16e0 END"


@query(f"WITH {_C}, z AS (SELECT *, CAST(unnest(range(12, 21)) AS DOUBLE) zoom, CASE WHEN w >= 200 THEN 0.85e0 ELSE 1e0 END k FROM c) SELECT code, zoom, round(CASE WHEN zoom < {_LEAST} THEN NULL WHEN zoom >= 19 THEN {_SIZE} * k ELSE 0.16e0 * k + ({_SIZE} * k - 0.16e0 * k) * (zoom - {_LEAST}) / (19 - {_LEAST}) END, 6) size FROM z")
def tier_style(spark: SparkSession, d: str) -> DataFrame:
    c = adapter.catalogue(spark, d).withColumn("zoom", F.explode(F.array(*(F.lit(float(z)) for z in range(12, 21)))))
    return c.select("code", "zoom", F.round(style.lone_size(F.col("zoom"), F.col("tier"), F.col("w") >= 200), 6).alias("size"))


@query(f"WITH {_C}, {_F}, {_M}, {_S}, {_N}, {_ST} SELECT stack_off, CASE WHEN stack_off % 8 = 0 AND stack_off BETWEEN 0 AND 2000 THEN stack_off ELSE 0 END shown, count(*) n FROM st GROUP BY 1, 2")
def stack_offset_match(spark: SparkSession, d: str) -> DataFrame:
    return asm.stack_assemblies(_members(spark, d)).groupBy("stack_off", style.grid_offset(F.col("stack_off")).alias("shown")).agg(F.count("*").alias("n"))


@query("SELECT event_id, round(CASE WHEN v <= 11 THEN 2.5e0 WHEN v <= 16 THEN 2.5e0 + 3.5e0 * (v - 11) / 5 WHEN v <= 19 THEN 6 + 3e0 * (v - 16) / 3 ELSE 9 END, 6) radius FROM (SELECT event_id, 9 + event_id % 120 / 10e0 v FROM events)")
def interp_size(spark: SparkSession, d: str) -> DataFrame:
    zoom = F.expr("9 + event_id % 120 / 10e0")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(style.interpolate(zoom, style.DOT_RADIUS), 6).alias("radius"))


_HEX = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in style.CATEGORY_COLOURS.items())


@query(f"WITH {_F}, {_C}, {_K} SELECT category_key, CASE category_key {_HEX} ELSE '#94a3b8' END colour, count(*) n FROM k GROUP BY 1, 2")
def category_colours(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).groupBy("category_key", style.colour(F.col("category_key")).alias("colour")).agg(F.count("*").alias("n"))


_MY = "(1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2"


@query(f"""WITH {_F}, w AS ({_wgs84('f')}), c AS (SELECT *, 'a' AS copy FROM w UNION ALL SELECT *, 'b' FROM w WHERE category <> 'pole'),
h AS (SELECT * FROM c WHERE abs((lng + 180) / 360 - (114.1 + 180) / 360) <= 6 / (512 * pow(2, 8)) AND abs({_MY.format('lat')} - {_MY.format('22.35e0')}) <= 6 / (512 * pow(2, 8)))
SELECT sign_id, category, min(concat(fid, copy)) fid, count(*) copies FROM h GROUP BY printf('%.6f,%.6f', lng, lat), sign_id, category""")
def hit_box_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """A click on features that two rendered layers hold: each once, the first copy."""
    f = adapter.features(spark, d).withColumn("pole_id", F.lit(None).cast("string")).withColumn("refname", F.lit(None).cast("string"))
    w = geo.to_wgs84(hits.near_hit_box(f, 114.1, 22.35, 8))
    both = w.withColumn("copy", F.lit("a")).unionByName(w.where("category <> 'pole'").withColumn("copy", F.lit("b")))
    found = hits.box_hits(both, 114.1, 22.35, 8).withColumn("fid", F.concat("fid", "copy")).withColumn("k", hits.hit_key())
    n = found.groupBy("k").agg(F.count("*").alias("copies"))
    return hits.first_by(found, F.col("k"), "fid").join(n, "k").select("sign_id", "category", "fid", "copies")


@query("""WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM a)
SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) % 3 cycle_index FROM b""")
def click_cycle(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("n_hits", F.lit(3))
    return hits.click_cycle(e, "user_id", ["ts", "event_id"], "event_type", "n_hits").select("event_id", "user_id", F.col("cycle_index").cast("long").alias("cycle_index"))


_D = "SELECT o_orderkey fid, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END text_string, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END sign_id, o_totalprice / 1000 angle, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE '2024' END last_upd, 22 + o_custkey / 10000e0 lat, 114 + o_custkey / 10000e0 lng FROM orders"


@query(f"""WITH d AS ({_D}) SELECT fid, label, value FROM (
SELECT fid, 'title' label, coalesce(nullif(text_string, ''), sign_id) AS value FROM d UNION ALL SELECT fid, 'sign', sign_id FROM d
UNION ALL SELECT fid, 'angle', concat(CAST(floor(angle + 0.5e0) AS BIGINT), '°') FROM d
UNION ALL SELECT fid, 'updated', CASE WHEN length(last_upd) >= 8 THEN concat(last_upd[1:4], '-', last_upd[5:6], '-', last_upd[7:8]) END FROM d
UNION ALL SELECT fid, 'coordinates', printf('%.5f, %.5f', lat, lng) FROM d) WHERE value IS NOT NULL""")
def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey fid", "case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then null else o_orderpriority end text_string",
        "case when o_orderkey % 3 > 0 then o_orderstatus end sign_id", "o_totalprice / 1000 angle",
        "case when o_orderkey % 4 > 0 then date_format(o_orderdate, 'yyyyMMdd') else '2024' end last_upd",
        "22 + o_custkey / 10000e0 lat", "114 + o_custkey / 10000e0 lng", "'' gg", "cast(null as string) refname", "'' pole_id", "cast(null as string) type",
    )
    return detail.detail_rows(o).drop("ord")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') updated FROM orders")
def packed_dates(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", packed_date(F.date_format("o_orderdate", "yyyyMMddHHmmss")).alias("updated"))


@query("WITH l AS (SELECT DISTINCT l_suppkey page, l_quantity x FROM lineitem), g AS (SELECT page, x - lag(x) OVER (PARTITION BY page ORDER BY x) d FROM l) SELECT page, coalesce(median(d), 109) pitch FROM g GROUP BY page")
def median_pitch(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").alias("left")).distinct()
    return tablegrid.column_pitch(lines)


_H = "SELECT l_suppkey page, CAST(l_linenumber AS DOUBLE) y, l_quantity x0, l_quantity + 10 + l_tax * 100 x1 FROM lineitem"


@query(f"""WITH h AS ({_H}), r AS (SELECT *, max(x1) OVER (PARTITION BY page, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM h)
SELECT page, y, round(sum(greatest(x1 - greatest(x0, coalesce(reach, x0)), 0)), 6) covered FROM r GROUP BY 1, 2""")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    h = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey page", "cast(l_linenumber as double) y", "l_quantity x0", "l_quantity + 10 + l_tax * 100 x1")
    return tablegrid.interval_cover(h, ["page", "y"]).select("page", "y", F.round("covered", 6).alias("covered"))


_T = "SELECT p_size page, p_partkey % 4 col, p_partkey AS row, ['none', concat(p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE '' END), concat(' ', 2000 - p_partkey)] tokens FROM part"


@query(f"""WITH t AS (SELECT page, col, row, unnest(tokens) tok, generate_subscripts(tokens, 1) i FROM ({_T})), s AS (SELECT upper(regexp_replace(tok, '\\s+', '', 'g')) c, * FROM t),
n AS (SELECT *, TRY_CAST(regexp_extract(c, '^([0-9]{{2,4}})[A-Z]?$', 1) AS INTEGER) n FROM s),
g AS (SELECT * FROM n WHERE n BETWEEN 100 AND 900 QUALIFY row_number() OVER (PARTITION BY page, col, row ORDER BY i) = 1)
SELECT page, col, row, concat('TS', c) code, n, coalesce(n < lag(n) OVER (PARTITION BY page, col ORDER BY row), false) falls FROM g""")
def range_gate(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    tokens = p.select(F.col("p_size").alias("page"), F.expr("p_partkey % 4").alias("col"), F.col("p_partkey").alias("row"), F.expr("array('none', concat(p_partkey, case when p_partkey % 2 = 0 then 'a' else '' end), concat(' ', 2000 - p_partkey))").alias("tokens"))
    sheets = p.select(F.col("p_size").alias("page")).distinct().selectExpr("page", "'TS' prefix", "100 lo", "900 hi", "'regulatory' grp")
    return tablegrid.gated_codes(tokens, sheets).drop("grp")


@query("SELECT p_partkey, CASE WHEN regexp_matches(q, '^[A-Z]{1,4}[0-9]+$') THEN q END id FROM (SELECT p_partkey, upper(regexp_replace(concat('ts-', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' _' WHEN p_partkey % 3 = 1 THEN 'a' ELSE '' END), '[\\s_-]+', '', 'g')) q FROM part)".replace("\\\\", "\\"))
def id_queries(spark: SparkSession, d: str) -> DataFrame:
    typed = F.expr("concat('ts-', p_partkey, case when p_partkey % 3 = 0 then ' _' when p_partkey % 3 = 1 then 'a' else '' end)")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", id_query(typed).alias("id"))


@query("SELECT l_suppkey page, count(*) n, count_if(l_linenumber < prev) falls FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice) prev FROM lineitem) GROUP BY 1")
def monotonic_check(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("prev", F.lag("l_linenumber").over(order))
    return li.groupBy(F.col("l_suppkey").alias("page")).agg(F.count("*").alias("n"), F.count_if(F.expr("l_linenumber < prev")).alias("falls"))


@query("""WITH RECURSIVE v AS (SELECT page, x, row_number() OVER (PARTITION BY page ORDER BY x) i FROM (SELECT DISTINCT l_suppkey page, l_quantity * 20 + l_linenumber % 4 * 1.5e0 x FROM lineitem)),
r(page, i, k, rep) AS (SELECT page, i, 1, x FROM v WHERE i = 1 UNION ALL
  SELECT v.page, v.i, CASE WHEN abs(v.x - r.rep) < 4 THEN r.k ELSE r.k + 1 END, CASE WHEN abs(v.x - r.rep) < 4 THEN (r.rep + v.x) / 2 ELSE v.x END FROM r JOIN v ON v.page = r.page AND v.i = r.i + 1),
c AS (SELECT page, k, arg_max(rep, i) AS "left" FROM r GROUP BY page, k), n AS (SELECT page, "left", lead("left") OVER (PARTITION BY page ORDER BY k) AS "right" FROM c)
SELECT page, round("left", 6) AS "left", round("right", 6) AS "right" FROM n WHERE "right" - "left" BETWEEN 12 AND 32""")
def number_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lines up to 4.5 apart: neighbours closer than 4 to the running representative merge into it."""
    v = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey page", "l_quantity * 20 + l_linenumber % 4 * 1.5e0 x").distinct()
    return tablegrid.number_columns(v).select("page", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query(f"""WITH {_C}, {_O}, filled AS (SELECT c.code, ord, tier, grp, w, h, coalesce(c.en, o.en) en, coalesce(c.zh, o.zh) zh FROM c LEFT JOIN o ON o.code = c.code),
staged AS (SELECT concat('TS', p_partkey) code, p_partkey ord, 2 tier, 'temporary' grp, 200 w, 120 h, p_brand en, NULL zh FROM part WHERE p_type = 'PROMO' OR p_partkey % 11 = 0),
added AS (SELECT * FROM staged WHERE NOT (ord % 13 = 0))
SELECT code, tier, grp, en, zh FROM filled WHERE code NOT IN (SELECT code FROM added) UNION ALL SELECT code, tier, grp, en, zh FROM added""")
def catalogue_merge(spark: SparkSession, d: str) -> DataFrame:
    c = merge.merge_descriptions(adapter.catalogue(spark, d), _overrides(spark, d))
    p = spark.read.parquet(f"{d}/part.parquet")
    staged = p.where("p_type = 'PROMO' or p_partkey % 11 = 0").selectExpr("concat('TS', p_partkey) code", "p_partkey ord", "2 tier", "'temporary' grp", "200 w", "120 h", "p_brand en", "cast(null as string) zh")
    rejects = p.where("p_partkey % 13 = 0").selectExpr("concat('TS', p_partkey) code")
    return merge.promote(c, staged, rejects).select("code", "tier", "grp", "en", "zh")


@query(f"""WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E}, t AS (SELECT concat(fid, '|', category, '|', CAST(round(x * 1000) AS BIGINT), '|', CAST(round(y * 1000) AS BIGINT), '|', coalesce(CAST(stack_index AS VARCHAR), '')) r FROM e)
SELECT substr(sha256(concat(coalesce(sum(CAST(concat('0x', substr(md5(r), 1, 15)) AS HUGEINT)), 0), '|', count(*))), 1, 12) AS version FROM t""")
def dataset_version(spark: SparkSession, d: str) -> DataFrame:
    milli = [F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("x", "y")]
    return tiles.content_version(_enriched(spark, d, turned=False).select("fid", "category", *milli, "stack_index"))


@query("SELECT CAST(s_suppkey AS VARCHAR) fid, CASE WHEN s_suppkey % 4 > 0 THEN concat('G', s_nationkey) END gg, concat('TS', s_suppkey) sign_id, 801000e0 + s_suppkey x, 802000e0 + s_nationkey y FROM supplier")
def gml_scan(spark: SparkSession, d: str) -> DataFrame:
    """Writes members as GML text to the shared folder and scans them."""
    text = F.expr("""concat('<core:cityObjectMember><gen:intAttribute name="FEATUREID"><gen:value>', s_suppkey, '</gen:value></gen:intAttribute>',
      case when s_suppkey % 4 > 0 then concat('<gen:stringAttribute name="GG_NAME"><gen:value>G', s_nationkey, '</gen:value></gen:stringAttribute>') else '' end,
      '<gen:stringAttribute name="SIGNID"><gen:value>TS', s_suppkey, '</gen:value></gen:stringAttribute><gml:Point><gml:pos>', 801000 + s_suppkey, ' ', 802000 + s_nationkey, '</gml:pos></gml:Point></core:cityObjectMember>')""")
    path = f"{Stage(spark, 'gml').folder}/members"
    src.write_members(spark.read.parquet(f"{d}/supplier.parquet").select(text.alias("value")), path)
    return src.point_features(src.read_members(spark, path))


@query("SELECT s_suppkey fid, 114 + s_suppkey / 1000e0 lng, 22 + s_nationkey / 1000e0 lat, CASE WHEN s_suppkey % 2 = 0 THEN 13 END minzoom FROM supplier")
def geojson_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Writes features as JSON lines to the shared folder and reads them again."""
    f = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey fid", "114 + s_suppkey / 1000e0 lng", "22 + s_nationkey / 1000e0 lat", "case when s_suppkey % 2 = 0 then 13 end minzoom", "cast(null as int) maxzoom")
    path = f"{Stage(spark, 'geojson').folder}/features"
    src.geojson_lines(f, ["fid"]).write.text(path)
    return src.read_geojson_lines(spark, path).select(F.col("properties")["fid"].cast("long").alias("fid"), "lng", "lat", "minzoom")


@query("SELECT line_id, k, ax, ay, bx, \"by\" FROM (SELECT o_custkey line_id, CAST(row_number() OVER w - 1 AS INTEGER) k, CAST(o_orderkey AS DOUBLE) ax, o_totalprice ay, CAST(lead(o_orderkey) OVER w AS DOUBLE) bx, lead(o_totalprice) OVER w AS \"by\" FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE bx IS NOT NULL")
def polyline_segments(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    listed = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    lines = o.groupBy(F.col("o_custkey").alias("line_id")).agg(F.flatten(F.transform(listed, lambda r: F.array(r["o_orderkey"].cast("double"), r["o_totalprice"]))).alias("pos"))
    return nearest.polyline_segments(lines)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = streams.with_event_time(spark.read.parquet(f"{d}/events.parquet"))
    t = streams.tumbling_counts(e)
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM a) SELECT user_id, min(ts) AS start, max(ts) last_at, count(*) n FROM b GROUP BY user_id, run""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = streams.sessions(streams.with_event_time(spark.read.parquet(f"{d}/events.parquet")))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n")


@query(SQL["click_cycle"])
def click_cycle_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same cycling as a stateful stream over the event files, run to the end."""
    folder = Stage(spark, "clicks").folder
    stream = streams.click_cycle_stream(streams.event_stream(spark, d))
    out = streams.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")
    return out.withColumn("cycle_index", F.col("cycle_index").cast("long"))


@query("SELECT s AS start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) s, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2) WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def event_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts as a stream; windows that the watermark has not passed are withheld."""
    folder = Stage(spark, "windows").folder
    w = streams.run_to_table(streams.tumbling_counts(streams.event_stream(spark, d)), f"{folder}/out", f"{folder}/checkpoint")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


from waymark.plans import boxes, distances, edges, indexes, maps, pictures, published, sheets, sides, tilings, timed, usage  # noqa: E402, F401  registers the other queries
