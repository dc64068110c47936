"""Queries of special cases: repeated ids, ties in file order, single layers, selections, grids, the whole build from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, style
from waymark.operators import assemblies as asm
from waymark.operators import catalogue as cat
from waymark.operators import enrich, merge, nearest, tablegrid, tiles
from waymark.operators import visibility as vis
from waymark.plans import adapter
from waymark.plans.registry import _C, _E, _F, _M, _N, _S, _ST, _enriched, _written, query
from waymark.plans.staging import Stage
from waymark.sources import features as src
from waymark.streaming import events as streams

_NONE_STACKED = "stack_index IS NULL"


@query(f"""WITH {_F}, r AS (SELECT gg fid, fid ord, category, x, y FROM f),
b AS (SELECT concat(o_orderkey, '') fid, CAST(CASE WHEN u = 0 THEN o_custkey % 360 ELSE (o_custkey + 7) % 360 END AS DOUBLE) face_bearing FROM orders, (SELECT unnest([0, 1]) u) WHERE u = 0 OR o_orderkey % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY u DESC) = 1),
s AS (SELECT gg fid, prio % 5 stack_index, prio % 7 * 8 stack_off, x + 1 anchor_x, y + 1 anchor_y, CAST(prio % 360 AS DOUBLE) stack_bearing FROM f WHERE prio % 3 > 0 QUALIFY row_number() OVER (PARTITION BY gg ORDER BY fid DESC) = 1)
SELECT r.ord, r.category, round(CASE WHEN k THEN coalesce(s.anchor_x, r.x) ELSE r.x END, 6) x, CASE WHEN k THEN s.stack_index END stack_index, CASE WHEN k THEN s.stack_off END stack_off, CASE WHEN k AND s.fid IS NOT NULL THEN stack_bearing WHEN k THEN face_bearing END face_bearing
FROM (SELECT *, category = 'traffic-sign-abbreviation' k FROM r) r LEFT JOIN b ON b.fid = r.fid LEFT JOIN s ON s.fid = r.fid""")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that several features, bearings and stack rows share: the last write wins, no feature multiplies."""
    f = adapter.features(spark, d)
    repeated = f.select(F.col("gg").alias("fid"), F.col("fid").alias("ord"), "category", "x", "y")
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1)))).where("ord = 0 or o_orderkey % 2 = 0")
    b = o.selectExpr("cast(o_orderkey as string) fid", "cast(case when ord = 0 then o_custkey % 360 else (o_custkey + 7) % 360 end as double) face_bearing", "ord")
    s = f.where("prio % 3 > 0").selectExpr("gg fid", "fid ord", "prio % 5 stack_index", "prio % 7 * 8 stack_off", "0 stack_tier", "x + 1 anchor_x", "y + 1 anchor_y", "cast(prio % 360 as double) stack_bearing")
    return enrich.enriched(repeated, b, s).select("ord", "category", F.round("x", 6).alias("x"), "stack_index", "stack_off", "face_bearing")


@query(f"""WITH {_F.replace('f AS (', 'f0 AS (', 1)}, f AS (SELECT f0.* EXCLUDE (sign_id), concat('TS', prio % 3 + 1) sign_id FROM f0), {_C}, {_M}
SELECT fid, gg, sign_id, row_number() OVER (PARTITION BY gg ORDER BY rnk, sign_id, prio, fid) - 1 stack_index, stack_size FROM m JOIN p USING (gg) WHERE stack_size >= 2 AND span <= 15""")
def stack_file_order(spark: SparkSession, d: str) -> DataFrame:
    """Assemblies of few kinds of signs: those that tie stand in file order, whatever their ids."""
    f = adapter.features(spark, d).withColumn("sign_id", F.expr("concat('TS', prio % 3 + 1)")).withColumn("ord", F.col("prio"))
    s = asm.stack_assemblies(asm.catalogued_members(f, adapter.catalogue(spark, d)))
    return s.select("fid", "gg", "sign_id", F.col("stack_index").cast("long").alias("stack_index"), "stack_size")


@query(f"WITH {_F} SELECT category, count(*) n, count(CASE WHEN category <> 'pole' THEN sign_id END) signed, count(CASE WHEN category = 'pole' THEN gg END) poles FROM f GROUP BY 1")
def union_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of different columns as one table."""
    f = adapter.features(spark, d)
    layers = [(f.where(f"category = '{c}'").select("fid", "category", "gg" if c == "pole" else "sign_id"), c) for c in ("tourist-sign", "traffic-sign-abbreviation", "pole")]
    return enrich.union_layers(layers).groupBy("category").agg(F.count("*").alias("n"), F.count("sign_id").alias("signed"), F.count("gg").alias("poles"))


@query(f"""WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E} SELECT 'lone' AS layer, count(*) n, min(fid) AS first FROM e WHERE {_NONE_STACKED} AND sign_id IN (SELECT code FROM c WHERE tier = 1)
UNION ALL SELECT 'stack', count(*), min(fid) FROM e WHERE NOT {_NONE_STACKED} AND gg <> '7'""")
def sign_layers(spark: SparkSession, d: str) -> DataFrame:
    """What the layer of lone signs of a tier and that of stacked signs, but for one post, hold."""
    e = _written(_enriched(spark, d, turned=False).select("fid", "gg", "sign_id", "stack_index"), "enriched")
    codes = adapter.catalogue(spark, d).where("tier = 1").select("code")
    both = vis.lone_layer(e, codes).withColumn("layer", F.lit("lone")).unionByName(vis.stack_layer(e, "7").withColumn("layer", F.lit("stack")))
    return both.groupBy("layer").agg(F.count("*").alias("n"), F.min("fid").alias("first"))


@query(f"WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E}, a AS (SELECT min(gg) gg FROM e WHERE stack_index >= 1) SELECT fid, gg, stack_index FROM e WHERE gg = (SELECT gg FROM a) AND stack_index IS NOT NULL")
def assembly_of_sign(spark: SparkSession, d: str) -> DataFrame:
    """All members of one assembly in order."""
    e = _written(_enriched(spark, d, turned=False).select("fid", "gg", F.col("stack_index").cast("long").alias("stack_index")), "enriched")
    gg = e.where("stack_index >= 1").agg(F.min("gg")).first()[0]
    return vis.assembly_of(e, gg)


@query(f"WITH {_F} SELECT category, count(*) n FROM (SELECT category, 113.8 + (x - 801000) / 1e5 lng, 22.2 + (y - 801000) / 1e5 lat FROM f) WHERE lng BETWEEN 114.0 AND 114.2 AND lat BETWEEN 22.3 AND 22.5 GROUP BY 1")
def viewport(spark: SparkSession, d: str) -> DataFrame:
    """Features inside a locked view."""
    f = adapter.features(spark, d).selectExpr("category", "113.8 + (x - 801000) / 1e5 lng", "22.2 + (y - 801000) / 1e5 lat")
    return vis.in_bounds(f, 114.0, 22.3, 114.2, 22.5).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E} SELECT fid, CASE WHEN stack_index IS NOT NULL THEN -stack_index ELSE -tier END sort_key, coalesce(face_bearing, 0) rotation FROM e JOIN c ON c.code = e.sign_id")
def draw_order(spark: SparkSession, d: str) -> DataFrame:
    """Sort key and rotation of every catalogued feature."""
    e = _enriched(spark, d).join(adapter.catalogue(spark, d).select(F.col("code").alias("sign_id"), "tier"), "sign_id")
    return vis.draw_order(e).select("fid", F.col("sort_key").cast("long").alias("sort_key"), style.rotation(F.col("face_bearing")).alias("rotation"))


def _ramp(stops: list[tuple[float, float]]) -> str:
    text = f"CASE WHEN v <= {stops[0][0]} THEN {stops[0][1]}e0"
    for (x0, y0), (x1, y1) in zip(stops, stops[1:], strict=False):
        text += f" WHEN v <= {x1} THEN {y0}e0 + ({y1}e0 - {y0}e0) * (v - {x0}) / ({x1} - {x0})"
    return f"{text} ELSE {stops[-1][1]}e0 END"


_RAMPS = {"emphasis": style.EMPHASIS, "opacity": style.OPACITY, "halo": style.HALO_RADIUS, "picked": style.PICKED_RADIUS}


@query(f"SELECT event_id, {', '.join(f'round({_ramp(r)}, 6) {n}' for n, r in _RAMPS.items())} FROM (SELECT event_id, 9 + event_id % 120 / 10e0 v FROM events)")
def zoom_ramps(spark: SparkSession, d: str) -> DataFrame:
    zoom = F.expr("9 + event_id % 120 / 10e0")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", *(F.round(style.interpolate(zoom, r), 6).alias(n) for n, r in _RAMPS.items()))


@query(f"WITH {_C} SELECT count_if(ord % 3 > 0) present, count_if(ord % 3 = 0) missing FROM c")
def pictures_of_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes with and without a picture."""
    pictures = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 3 > 0").selectExpr("concat('TS', p_partkey) code")
    return cat.picture_counts(adapter.catalogue(spark, d), pictures)


@query(f"WITH {_C} SELECT code FROM c WHERE w / 8 >= 24 AND ord % 3 > 0")
def pictures_large_enough(spark: SparkSession, d: str) -> DataFrame:
    """Catalogued codes whose cut-out picture exists and is large enough."""
    cut = tablegrid.large_enough(adapter.catalogue(spark, d).selectExpr("code", "w / 8 w", "40 h", "ord").where("ord % 3 > 0"))
    return cat.with_picture(adapter.catalogue(spark, d), cut).select("code")


@query(f"""WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E} SELECT sign_id, concat(CASE WHEN max(CASE WHEN stack_index IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'signs-stacked/' ELSE 'signs/' END, sign_id, '.png') AS path
FROM e WHERE sign_id IN (SELECT code FROM c) GROUP BY sign_id""")
def picture_requests(spark: SparkSession, d: str) -> DataFrame:
    """The pictures that the features on the map ask for."""
    return cat.picture_requests(_enriched(spark, d, turned=False).select("sign_id", "stack_index"), adapter.catalogue(spark, d))


@query(f"WITH {_F} SELECT count(*) shown, count_if(sign_id IN ('TS1', 'TS5', 'TS42')) hidden, count(DISTINCT CASE WHEN sign_id IN ('TS1', 'TS5', 'TS42') THEN sign_id END) hidden_signs FROM f")
def hidden_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many features, and signs, a denylist hides."""
    state = vis.FilterState(mode="sign-id", hidden=frozenset({"TS1", "TS5", "TS42"}))
    f = adapter.features(spark, d).select("sign_id", (~vis.not_hidden(state)).alias("h"))
    return f.agg(F.count("*").alias("shown"), F.count_if("h").alias("hidden"), F.count_distinct(F.when(F.col("h"), F.col("sign_id"))).alias("hidden_signs"))


_COLS = "SELECT DISTINCT l_suppkey page, l_quantity * 40 AS \"left\", l_quantity * 40 + 20 AS \"right\" FROM lineitem WHERE l_quantity % 3 = l_suppkey % 3 AND l_quantity <= 30"


@query(f"""WITH c AS ({_COLS}), s AS (SELECT page, min("left") x0, max("left") x1 FROM c GROUP BY 1), g AS (SELECT page, "left" - lag("left") OVER (PARTITION BY page ORDER BY "left") d FROM c),
p AS (SELECT page, coalesce(median(d), 109) pitch FROM g GROUP BY page), k AS (SELECT s.page, pitch, x0 + k * pitch want, k FROM s JOIN p USING (page), (SELECT unnest(range(0, 25)) k) WHERE x0 + k * pitch <= x1 + 0.35 * pitch),
n AS (SELECT k.page, k.k, arg_min(c."left", c."left") l, arg_min(c."right", c."left") r FROM k JOIN c ON c.page = k.page AND abs(c."left" - want) <= 0.35 * pitch GROUP BY 1, 2)
SELECT k.page, k.k, coalesce(l, want) AS "left", coalesce(r, want + 20) AS "right", l IS NULL made FROM k LEFT JOIN n USING (page, k)""")
def column_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Number columns at every pitch: detected ones, and made ones in the gaps."""
    c = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity % 3 = l_suppkey % 3 and l_quantity <= 30").selectExpr("l_suppkey page", "l_quantity * 40 left", "l_quantity * 40 + 20 right").distinct()
    return tablegrid.lattice(c, tablegrid.column_pitch(c)).withColumn("k", F.col("k").cast("long"))


@query("""WITH RECURSIVE h AS (SELECT DISTINCT l_suppkey page, l_linenumber * 1.5e0 + floor(l_quantity / 25) y, l_quantity x0, l_quantity + 6 x1 FROM lineitem), c AS (SELECT DISTINCT page, 10e0 AS "left", 40e0 AS "right" FROM h),
m AS (SELECT page, "left", "right", y, greatest(x0, "left") x0, least(x1, "right") x1 FROM h JOIN c USING (page) WHERE x1 > "left" AND x0 < "right"),
w AS (SELECT *, max(x1) OVER (PARTITION BY page, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM m),
g AS (SELECT page, y FROM (SELECT page, y, sum(greatest(x1 - greatest(x0, coalesce(reach, x0)), 0)) covered FROM w GROUP BY 1, 2) WHERE covered > 0.6 * 30),
v AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y) i FROM g),
r(page, i, k, f) AS (SELECT page, i, 0, y FROM v WHERE i = 1 UNION ALL SELECT v.page, v.i, CASE WHEN v.y - r.f < 2 THEN r.k ELSE r.k + 1 END, CASE WHEN v.y - r.f < 2 THEN r.f ELSE v.y END FROM r JOIN v ON v.page = r.page AND v.i = r.i + 1),
t AS (SELECT DISTINCT page, k, f FROM r) SELECT page, CAST(k AS INTEGER) AS row, f AS top, lead(f) OVER (PARTITION BY page ORDER BY k) AS bottom FROM t QUALIFY bottom IS NOT NULL""")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a column from the rules that cover it."""
    h = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey page", "l_linenumber * 1.5e0 + floor(l_quantity / 25) y", "l_quantity x0", "l_quantity + 6 x1").distinct()
    columns = h.select("page", F.lit(10.0).alias("left"), F.lit(40.0).alias("right")).distinct()
    return tablegrid.cells(tablegrid.covering_rules(columns, h)).select("page", "row", "top", "bottom")


_KINDS = ", ".join(f"'{k}'" for k in streams.EVENT_KINDS)


@query(f"WITH e AS (SELECT ts, CASE WHEN event_id % 16 < {len(streams.EVENT_KINDS)} THEN [{_KINDS}][event_id % 16 + 1] ELSE 'other' END kind FROM events) SELECT kind, count(*) n FROM e WHERE kind <> 'other' GROUP BY 1")
def usage_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Usage events by kind; unknown kinds are dropped."""
    kinds = F.array(*map(F.lit, streams.EVENT_KINDS))
    e = streams.with_event_time(spark.read.parquet(f"{d}/events.parquet"))
    e = e.withColumn("event_type", F.coalesce(F.get(kinds, F.expr("cast(event_id % 16 as int)")), F.lit("other")))
    return streams.usage_events(e).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT *, ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) run FROM a)
SELECT user_id, event_id, event_type FROM b QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY ts DESC, event_id DESC) = 1""")
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    """What a debounced input lets through."""
    return streams.debounced(streams.with_event_time(spark.read.parquet(f"{d}/events.parquet"))).select("user_id", "event_id", "event_type")


@query("SELECT s AS start, count(*) n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) s FROM events) GROUP BY 1")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of two hours that start every hour."""
    w = streams.sliding_counts(streams.with_event_time(spark.read.parquet(f"{d}/events.parquet")))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""WITH {_F.replace('f AS (', 'f0 AS (', 1)}, f AS (SELECT * FROM f0 WHERE category = 'traffic-sign-abbreviation'), {_C}, {_S}, {_M}, {_N}, {_ST}, {_E}
SELECT CAST(z AS BIGINT) z, count(*) n, count(DISTINCT fid) features, count(stack_index) stacked, count(face_bearing) turned FROM (SELECT *, unnest(range(9, 14)) z FROM e) GROUP BY 1""")
def build_from_files(spark: SparkSession, d: str) -> DataFrame:
    """The whole build from members written as GML: features, bearings and stacks as files, enriched features, tiles by zoom."""
    stage = Stage(spark, "build")
    folder = stage.folder
    f = adapter.features(spark, d).where("category = 'traffic-sign-abbreviation'")
    text = F.expr("""concat('<core:cityObjectMember><gen:stringAttribute name="FEATUREID"><gen:value>', fid, '</gen:value></gen:stringAttribute><gen:stringAttribute name="GG_NAME"><gen:value>', gg,
      '</gen:value></gen:stringAttribute><gen:stringAttribute name="SIGNID"><gen:value>', sign_id, '</gen:value></gen:stringAttribute><gml:Point><gml:pos>', x, ' ', y, '</gml:pos></gml:Point></core:cityObjectMember>')""")
    src.write_members(f.select(text.alias("value")), f"{folder}/signs", "gzip")  # a file is read whole in any case, and tags are most of it
    members = src.parsed(src.read_members(spark, f"{folder}/signs"))
    pos = src.numbers(F.col("gml:Point")["gml:pos"])
    parsed = members.select(*(src.attribute(name).alias(c) for name, c in (("FEATUREID", "fid"), ("GG_NAME", "gg"), ("SIGNID", "sign_id"))), pos[0].alias("x"), pos[1].alias("y"))
    parsed.withColumn("category", F.lit(enrich.SIGN_LAYER)).write.parquet(f"{folder}/features")
    stage.drop(spark.read.text(f"{folder}/signs"))
    features = spark.read.parquet(f"{folder}/features")
    nearest.nearest_bearings(features, adapter.segments(spark, d)).write.parquet(f"{folder}/bearings")
    bearings = spark.read.parquet(f"{folder}/bearings")
    asm.stack_assemblies(asm.catalogued_members(features, adapter.catalogue(spark, d)), bearings).write.parquet(f"{folder}/stacks")
    enriched = geo.to_wgs84(enrich.enriched(enrich.require_rows(features, "features"), bearings, spark.read.parquet(f"{folder}/stacks")))
    tiles.write_full_table(enriched, range(9, 14), f"{folder}/tiles")
    stage.drop(*(spark.read.parquet(f"{folder}/{name}") for name in ("bearings", "stacks", "features")))
    t = spark.read.parquet(f"{folder}/tiles")
    counts = [F.count("*").alias("n"), F.count_distinct("fid").alias("features"), F.count("stack_index").alias("stacked"), F.count("face_bearing").alias("turned")]
    return t.groupBy(F.col("z").cast("long").alias("z")).agg(*counts)


@query("SELECT count(*) n_members, count_if(s_suppkey % 5 = 0) n_rejected FROM supplier")
def rejected_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of a file that a tolerant scan can't place, counted."""
    path = f"{Stage(spark, 'rejects').folder}/members"
    text = F.expr("""concat('<core:cityObjectMember><gen:stringAttribute name="FEATUREID"><gen:value>', s_suppkey, '</gen:value></gen:stringAttribute>', case when s_suppkey % 5 > 0 then '<gml:Point><gml:pos>1 2</gml:pos></gml:Point>' else '' end, '</core:cityObjectMember>')""")
    src.write_members(spark.read.parquet(f"{d}/supplier.parquet").select(text.alias("value")), path)
    return src.rejected(src.read_members(spark, path))


@query(f"""WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST} SELECT count(*) members, count(DISTINCT gg) assemblies, count(DISTINCT (anchor_x, anchor_y)) anchors,
coalesce(max(stack_size), 0) largest, CAST(coalesce(max(stack_off), 0) AS BIGINT) furthest FROM st""")
def stack_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a run of the assembly build reports."""
    return asm.stack_counters(asm.stack_assemblies(asm.catalogued_members(adapter.features(spark, d), adapter.catalogue(spark, d))))


@query("""WITH p AS (SELECT p_size page, p_partkey k, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END s, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey END tx, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 5 END ty FROM part),
r AS (SELECT page, s * (k % 50) + tx x0, s * (k % 40) + ty y0, s * (k % 50 + k % 7) + tx x1, s * (k % 40 + k % 3 * 4) + ty y1 FROM p UNION ALL SELECT page, tx, ty, tx, 3 * s + ty FROM p)
SELECT page, 'h' AS kind, CAST(y0 AS DOUBLE) AS at, CAST(x0 AS DOUBLE) AS lo, CAST(x1 AS DOUBLE) AS hi FROM r WHERE y0 = y1 AND x1 - x0 > 3
UNION ALL SELECT page, 'v', x0, y0, y1 FROM r WHERE x0 = x1 AND y1 - y0 > 5""")
def drawn_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules out of a page's drawing trace, with and without a transform; a move of the pen draws nothing."""
    path = F.expr("""concat('<stroke_path linewidth="1"', case when p_partkey % 4 > 0 then concat(' transform="2 0 0 2 ', p_partkey, ' 5"') else '' end,
      '><moveto x="', p_partkey % 50, '" y="', p_partkey % 40, '"/><lineto x="', p_partkey % 50 + p_partkey % 7, '" y="', p_partkey % 40 + p_partkey % 3 * 4, '"/><moveto x="0" y="0"/><lineto x="0" y="3"/></stroke_path>')""")
    pages = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("page"), path.alias("p"))
    return src.drawn_rules(pages.groupBy("page").agg(F.array_join(F.collect_list("p"), "\n").alias("value")))


@query(f"WITH {_C} SELECT grp AS sheet, count(*) n, min(code) AS first, sum(w) w FROM c WHERE ord % 5 = 0 GROUP BY 1")
def staging_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Candidates staged for review by sheet, written and read again."""
    path = f"{Stage(spark, 'staging').folder}/manifest"
    merge.write_staged(adapter.catalogue(spark, d).where("ord % 5 = 0").withColumn("sheet", F.col("grp")), path)
    staged = spark.read.schema("code string, ord long, tier long, grp string, w long, h long, en string, zh string, sheet string").json(path)
    return staged.groupBy("sheet").agg(F.count("*").alias("n"), F.min("code").alias("first"), F.sum("w").alias("w"))
