"""Queries of manifests, side inputs, labels, states and the other small parts around the map."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import assemblies as asm
from waymark.operators import catalogue as cat
from waymark.operators import detail, enrich, merge, replay, tablegrid, tiles
from waymark.plans import adapter
from waymark.plans.pictures import _PNG, _pictures
from waymark.plans.registry import _C, _D, _E, _F, _H, _L, _M, _N, _O, _S, _ST, SQL, _enriched, _members, _overrides, _wgs84, query
from waymark.plans.staging import Stage
from waymark.sources import features as src


@query(f"""WITH {_F}, v(file, category, geometry, label, tiled) AS (VALUES ('DTAD_TS_POLE_PT', 'traffic-sign-pole', 'point', 'Traffic sign pole', true), ('DTAD_TS_ABV_PT', 'traffic-sign-abbreviation', 'point', 'Traffic sign abbreviation', true),
('DTAD_PS_POLE_PT', 'pedestrian-sign-pole', 'point', 'Pedestrian sign pole', true), ('DTAD_DS_POLE_PT', 'directional-sign-pole', 'point', 'Directional sign pole', true), ('DTAD_PS_ANNO_PT', 'tourist-sign', 'point', 'Tourist sign', true),
('DTAD_RD_MARK_LINE', 'road-marking', 'line', 'Road marking line (for face-bearing derivation)', false)), n AS (SELECT category, count(*) n FROM f GROUP BY 1)
SELECT concat(file, '.', ext) AS name, label, tiled, coalesce(n, 0) features FROM v LEFT JOIN n USING (category), (SELECT unnest(['gml', 'gfs']) ext)""")
def layer_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every layer's files, label and number of features."""
    n = adapter.features(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    layers = src.layer_manifest(spark)
    files = src.layer_files(layers).withColumn("file", F.regexp_extract("name", r"^([^.]*)", 1))
    return files.join(layers, "file").join(n, "category", "left").select("name", "label", "tiled", F.coalesce("n", F.lit(0)).alias("features"))


_SHEETS = """sh(lo, hi, grp) AS (VALUES (101, 205, 'regulatory'), (206, 310, 'regulatory'), (311, 400, 'regulatory'), (401, 505, 'warning'), (506, 600, 'warning'), (601, 700, 'informatory'), (701, 805, 'supplementary'), (806, 900, 'supplementary'),
(901, 1000, 'temporary'), (2101, 2205, 'regulatory'), (2206, 2310, 'regulatory'), (2601, 2717, 'informatory'), (3601, 3705, 'informatory'), (3706, 3810, 'supplementary'), (3811, 3936, 'informatory'), (3937, 4062, 'warning')),
sp AS (SELECT concat('(TS ', lo, ' - ', hi, ').pdf') pdf, sh.* FROM sh)"""


@query(f"WITH {_C}, {_SHEETS} SELECT pdf, sp.grp, count(c.code) codes, count(CASE WHEN c.grp = sp.grp THEN 1 END) alike, contains(pdf, 'TS 2') chosen FROM sp LEFT JOIN c ON c.ord BETWEEN lo AND hi GROUP BY 1, 2")
def sheets_of_codes(spark: SparkSession, d: str) -> DataFrame:
    """How many catalogued codes lie in every sheet's range, and which sheets a name picks."""
    sheets = src.sheet_manifest(spark)
    numbered = sheets.select("pdf", F.col("grp").alias("own"), F.explode(F.sequence("lo", "hi")).alias("ord"))
    found = numbered.join(adapter.catalogue(spark, d).select("ord", "code", "grp"), "ord", "left").groupBy("pdf", F.col("own").alias("grp"))
    chosen = merge.sheets_named(sheets, "TS 2").select("pdf", F.lit(True).alias("chosen"))
    counted = found.agg(F.count("code").alias("codes"), F.count_if(F.col("grp") == F.col("own")).alias("alike"))
    return counted.join(chosen, "pdf", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


@query("SELECT s_name AS name, s_acctbal AS value, NULL::DOUBLE AS extra, true required_fails FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)")
def side_inputs(spark: SparkSession, d: str) -> DataFrame:
    """A JSON map beside the table; one that is missing leaves its column null, and where it is required it is an error."""
    folder = Stage(spark, "sides").folder
    n = spark.read.parquet(f"{d}/nation.parquet")
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("double"))))).alias("value")).write.text(f"{folder}/regions")
    regions = src.read_json_map(spark, f"{folder}/regions", "double").withColumnRenamed("value", "region")
    extra = src.read_json_map(spark, f"{folder}/absent", "double").withColumnRenamed("value", "extra")
    try:
        src.read_json_map(spark, f"{folder}/absent", "double", required=True)
        fails = False
    except AnalysisException:
        fails = True
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("key", F.col("s_nationkey").cast("string"))
    return s.join(regions, "key").join(extra, "key", "left").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"), "extra", F.lit(fails).alias("required_fails"))


@query(f"WITH {_PNG} SELECT code, CAST(w AS INTEGER) w, CAST(h AS INTEGER) h FROM px")
def picture_headers(spark: SparkSession, d: str) -> DataFrame:
    """Width and height out of picture headers."""
    return src.header_sizes(_pictures(spark, d))


@query("SELECT concat('TS', p_partkey) code, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_name END en, CASE WHEN p_partkey % 3 = 1 THEN '停車' END zh FROM part")
def json_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions out of a JSON dimension in which a text is a string, an object of two languages, or empty."""
    folder = Stage(spark, "dimension").folder
    desc = F.expr("case p_partkey % 3 when 0 then to_json(named_struct('v', p_name)) when 1 then to_json(named_struct('en', p_name, 'zh', '停車')) else '{}' end")
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("TS"), "p_partkey").alias("code"), F.when(F.expr("p_partkey % 3 = 0"), F.regexp_extract(desc, r'^\{"v":(.*)\}$', 1)).otherwise(desc).alias("desc"))
    rows.write.json(f"{folder}/codes")
    return cat.normalised_descriptions(spark.read.schema("code string, desc string").json(f"{folder}/codes"))


@query(f"WITH {_C}, {_O}, fnd AS (SELECT concat('TS', p_partkey * 3 // 2) code, p_partkey ord, p_brand FROM part), nw AS (SELECT * FROM fnd WHERE code NOT IN (SELECT code FROM c) QUALIFY row_number() OVER (PARTITION BY code ORDER BY ord) = 1) SELECT nw.code, nw.ord, o.en, o.zh FROM nw LEFT JOIN o ON o.code = nw.code")
def new_codes_described(spark: SparkSession, d: str) -> DataFrame:
    """Extracted codes that the catalogue lacks, each once, with the texts that were read for them."""
    found = spark.read.parquet(f"{d}/part.parquet").selectExpr("concat('TS', p_partkey * 3 div 2) code", "p_partkey ord", "cast(null as string) en", "cast(null as string) zh")
    return merge.merge_descriptions(merge.new_codes(adapter.catalogue(spark, d), found), _overrides(spark, d))


@query(f"WITH h AS ({_H}), tc AS ({SQL['table_cells']}) SELECT page, longest, coalesce(cells, 0) cells, coalesce(height, 0) height FROM (SELECT page, round(max(x1 - x0), 6) longest FROM h GROUP BY 1) LEFT JOIN (SELECT page, count(*) cells, round(sum(bottom - top), 6) height FROM tc GROUP BY 1) USING (page)")
def page_totals(spark: SparkSession, d: str) -> DataFrame:
    """A page's longest rule, its cells and their height together."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rules = li.selectExpr("l_suppkey page", "l_quantity x0", "l_quantity + 10 + l_tax * 100 x1")
    longest = rules.groupBy("page").agg(F.round(F.max(F.col("x1") - F.col("x0")), 6).alias("longest"))
    h = li.selectExpr("l_suppkey page", "l_linenumber * 1.5e0 + floor(l_quantity / 25) y", "l_quantity x0", "l_quantity + 6 x1").distinct()
    columns = h.select("page", F.lit(10.0).alias("left"), F.lit(40.0).alias("right")).distinct()
    sums = tablegrid.cells(tablegrid.covering_rules(columns, h)).groupBy("page").agg(F.count("*").alias("cells"), F.round(F.sum(F.col("bottom") - F.col("top")), 6).alias("height"))
    return longest.join(sums, "page", "left").select("page", "longest", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("height", F.lit(0.0)).alias("height"))


_ACTION = "CASE event_id % 9 WHEN 0 THEN 'select' WHEN 1 THEN 'hide' WHEN 2 THEN 'deselect' WHEN 3 THEN 'select_all' WHEN 4 THEN 'unhide' WHEN 5 THEN 'toggle' WHEN 6 THEN CASE WHEN event_id % 5 = 0 THEN 'filter_to' ELSE 'select' END WHEN 7 THEN CASE WHEN event_id % 7 = 0 THEN 'clear' ELSE 'hide' END ELSE 'mode' END"
_ITEM = "CASE WHEN event_id % 9 = 8 THEN CASE WHEN event_id % 2 = 0 THEN 'category' ELSE 'sign-id' END WHEN event_id % 9 = 5 THEN event_type ELSE concat('TS', event_id % 13) END"


@query(f"""WITH ac AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) seq, {_ACTION} act, {_ITEM} item FROM events),
st AS (SELECT a.*, (SELECT max(b.seq) FROM ac b WHERE b.user_id = a.user_id AND b.act IN ('clear', 'filter_to')) emptied, (SELECT max(b.seq) FROM ac b WHERE b.user_id = a.user_id AND b.act = 'clear') cleared FROM ac a),
pk AS (SELECT user_id, item FROM st WHERE act IN ('select', 'select_all', 'filter_to', 'deselect', 'hide') QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY seq DESC) = 1 AND act IN ('select', 'select_all', 'filter_to') AND seq >= coalesce(emptied, 0)),
hd AS (SELECT user_id, item FROM st WHERE act IN ('hide', 'unhide', 'select', 'filter_to') QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY seq DESC) = 1 AND act = 'hide' AND seq > coalesce(cleared, 0)),
fc AS (SELECT user_id, item FROM ac WHERE act = 'toggle' GROUP BY 1, 2 HAVING count(*) % 2 = 1),
md AS (SELECT user_id, CASE WHEN act = 'mode' THEN item ELSE 'sign-id' END mode FROM ac WHERE act IN ('mode', 'filter_to') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)
SELECT user_id, coalesce(mode, 'category') mode, coalesce((SELECT string_agg(item, ',' ORDER BY item) FROM pk WHERE pk.user_id = u.user_id), '') picked, coalesce((SELECT string_agg(item, ',' ORDER BY item) FROM hd WHERE hd.user_id = u.user_id), '') hidden,
coalesce((SELECT string_agg(item, ',' ORDER BY item) FROM fc WHERE fc.user_id = u.user_id), '') facets FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN md USING (user_id)""")
def replayed_states(spark: SparkSession, d: str) -> DataFrame:
    """Every viewer's mode, picked and hidden signs and facets after all actions, chips in order of their codes."""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id user", "unix_micros(cast(ts as timestamp)) * 1000 + event_id % 1000 seq", f"{_ACTION} action", f"{_ITEM} item")
    states = replay.replayed(e.withColumn("item", F.when(F.col("action") != "clear", F.col("item"))))
    return states.select(F.col("user").alias("user_id"), "mode", *(F.array_join(c, ",").alias(c) for c in ("picked", "hidden", "facets")))


@query(f"""WITH d AS ({_D}), lb(label, locale, txt) AS (VALUES ('sign', 'en', 'Sign'), ('sign', 'zh-HK', '標誌'), ('angle', 'en', 'Angle'), ('updated', 'zh-HK', '更新日期'), ('coordinates', 'en', 'Coordinates')),
r AS (SELECT fid, 'title' label, coalesce(nullif(text_string, ''), sign_id) AS value FROM d UNION ALL SELECT fid, 'sign', sign_id FROM d UNION ALL SELECT fid, 'angle', concat(CAST(floor(angle + 0.5e0) AS BIGINT), '°') FROM d
UNION ALL SELECT fid, 'updated', CASE WHEN length(last_upd) >= 8 THEN 'x' END FROM d UNION ALL SELECT fid, 'coordinates', 'x' FROM d)
SELECT locale, coalesce(txt, label) AS "text", count(*) n FROM (SELECT r.*, locale FROM r, (SELECT unnest(['en', 'zh-HK']) locale) WHERE value IS NOT NULL) LEFT JOIN lb USING (label, locale) GROUP BY 1, 2""")
def localised_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the detail view under the label of each locale, or under their key."""
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey fid", "case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then null else o_orderpriority end text_string", "case when o_orderkey % 3 > 0 then o_orderstatus end sign_id", "o_totalprice / 1000 angle",
        "case when o_orderkey % 4 > 0 then date_format(o_orderdate, 'yyyyMMdd') else '2024' end last_upd", "22 + o_custkey / 10000e0 lat", "114 + o_custkey / 10000e0 lng", "'' gg", "cast(null as string) refname", "'' pole_id", "cast(null as string) type",
    )
    labels = spark.createDataFrame([("sign", "en", "Sign"), ("sign", "zh-HK", "標誌"), ("angle", "en", "Angle"), ("updated", "zh-HK", "更新日期"), ("coordinates", "en", "Coordinates")], "key string, locale string, text string")
    shown = [detail.localised(detail.detail_rows(o), labels, locale).withColumn("locale", F.lit(locale)) for locale in ("en", "zh-HK")]
    return shown[0].unionByName(shown[1]).groupBy("locale", "text").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, {_C}, {_S}, {_M}, {_N}, {_ST}, {_E}, {_L} SELECT 'category' AS mode, count(*) n, count(DISTINCT fid) features FROM l WHERE minzoom IS NULL UNION ALL SELECT 'sign-id', count(*), count(DISTINCT fid) FROM e WHERE category = 'traffic-sign-abbreviation'")
def source_of_mode(spark: SparkSession, d: str) -> DataFrame:
    """What zoom 12 holds in the table that answers each mode: the overview for categories, the full one for signs."""
    e = geo.to_wgs84(_enriched(spark, d, turned=False))
    overview, full = tiles.tiled(enrich.lod_copies(e), range(12, 13)), tiles.full_table(e, range(12, 13))
    counts = [F.count("*").alias("n"), F.count_distinct("fid").alias("features")]
    both = [tiles.table_for(mode, overview, full).agg(*counts).withColumn("mode", F.lit(mode)) for mode in ("category", "sign-id")]
    return both[0].unionByName(both[1])


@query("SELECT o_orderkey, floor(o_totalprice / 7 + 0.5e0) rounded, round((degrees(atan2(o_custkey % 61 - 30, o_custkey % 53 - 26)) + 360) % 360, 6) bearing, CAST(floor((114 + o_custkey / 10000e0 + 180) / 360 * 8192) AS BIGINT) tx, CAST(floor((1 - ln(tan(radians(22 + o_custkey / 10000e0)) + 1 / cos(radians(22 + o_custkey / 10000e0))) / pi()) / 2 * 8192) AS BIGINT) ty FROM orders")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The library's functions called from SQL."""
    geo.register(spark)
    o = spark.read.parquet(f"{d}/orders.parquet")
    return spark.sql("SELECT o_orderkey, js_round(o_totalprice / 7) rounded, round(compass(o_custkey % 61 - 30, o_custkey % 53 - 26), 6) bearing, tile_x(114 + o_custkey / 10000e0, 13) tx, tile_y(22 + o_custkey / 10000e0, 13) ty FROM {o}", o=o)


@query(f"WITH {_F}, {_C}, {_M}, w AS ({_wgs84('f')}), top AS (SELECT gg FROM p WHERE stack_size >= 2 AND span <= 15) SELECT w.fid, w.sign_id, round(w.lng, 6) lng, round(w.lat, 6) lat FROM w JOIN m ON m.fid = w.fid AND m.gg = w.gg WHERE w.gg IN (SELECT gg FROM top)")
def selection_geojson(spark: SparkSession, d: str) -> DataFrame:
    """The selected assemblies' signs as GeoJSON, read again."""
    picked = asm.stack_assemblies(_members(spark, d)).select("fid", "gg")
    f = geo.to_wgs84(adapter.features(spark, d)).join(picked, ["fid", "gg"])
    path = f"{Stage(spark, 'selection').folder}/features"
    src.geojson_lines(f, ["fid", "sign_id"]).write.text(path)
    got = src.read_geojson_lines(spark, path)
    return got.select(F.col("properties")["fid"].alias("fid"), F.col("properties")["sign_id"].alias("sign_id"), F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query(f"WITH {_F}, {_C}, {_M} SELECT m.sign_id, string_agg(DISTINCT m.gg, ',' ORDER BY m.gg) posts FROM m JOIN p USING (gg) WHERE stack_size >= 2 AND span <= 15 GROUP BY 1")
def sign_groups_file(spark: SparkSession, d: str) -> DataFrame:
    """The posts of every sign as the written companion index lists them."""
    path = f"{Stage(spark, 'groups').folder}/groups"
    asm.write_sign_groups(asm.companion_index(_members(spark, d)), path)
    lists = spark.read.schema("sign_id string, part int, gg_names array<string>").json(path)
    return lists.groupBy("sign_id").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("gg_names"))), ",").alias("posts"))
