"""Hand-computed cases of the operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, style
from waymark.functions.text import bracketed_json, code_number, id_query, packed_date
from waymark.operators import assemblies, catalogue, detail, enrich, hits, merge, nearest, search, tablegrid, tiles, visibility
from waymark.sources import features as src


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("segment", "point", "face"),
    [
        ((0, 0, 0, 10), (-2, 5), 0.0),
        ((0, 0, 0, 10), (2, 5), 180.0),
        ((0, 0, 0, 10), (0, 5), 180.0),
        ((0, 0, 10, 0), (5, 2), 90.0),
        ((0, 0, 10, 0), (5, -2), 270.0),
        ((0, 0, 0, 10), (25, 5), None),
        ((0, 0, 0, 10), (24.999, 5), 180.0),
        ((0, 0, 0, 3), (1, 1), 180.0),
        ((0, 0, 0, 2.99), (1, 1), None),
    ],
)
def test_bearing(spark, segment, point, face):
    s = spark.createDataFrame([(1, *map(float, segment))], "seg_id long, ax double, ay double, bx double, by double")
    p = spark.createDataFrame([("a", *map(float, point))], "fid string, x double, y double")
    got = [r["face_bearing"] for r in nearest.face_bearings(nearest.nearest_segments(p, s)).collect()]
    assert got == ([] if face is None else [face])


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 300, (80, 2))
    b = a + rng.uniform(-60, 60, (80, 2))
    pts = rng.uniform(0, 300, (200, 2))
    s = spark.createDataFrame([(i, *map(float, (*a[i], *b[i]))) for i in range(80)], "seg_id long, ax double, ay double, bx double, by double")
    p = spark.createDataFrame([(str(i), *map(float, pts[i])) for i in range(200)], "fid string, x double, y double")
    got = {r["fid"]: (r["seg_id"], r["d"]) for r in nearest.nearest_segments(p, s).collect()}
    for i, q in enumerate(pts):
        d = b - a
        t = np.clip(((q - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        dist = np.hypot(*(a + t[:, None] * d - q).T)
        dist[np.hypot(*d.T) < 3] = np.inf
        if dist.min() < 25:
            assert got[str(i)][0] == dist.argmin() and abs(got[str(i)][1] - dist.min()) < 1e-9
        else:
            assert str(i) not in got


def _stack(spark, rows, bearings=None):
    f = spark.createDataFrame(rows, "fid string, gg string, sign_id string, x double, y double")
    c = spark.createDataFrame(
        [("A", "regulatory", 0, 120, 120), ("B", "warning", 1, 120, 120), ("C", "supplementary", 2, 120, 120), ("W", "warning", 1, 240, 120)], "code string, grp string, tier int, w int, h int"
    )
    b = None if bearings is None else spark.createDataFrame(bearings, "fid string, face_bearing double")
    return {r["fid"]: r for r in assemblies.stack_assemblies(assemblies.catalogued_members(f, c), b).collect()}


def test_layout_rank_and_bearing(spark):
    got = _stack(spark, [("1", "g", "C", 0.0, 0.0), ("2", "g", " B ", 1.0, 1.0), ("3", "g", "A", 2.0, 2.0)], [("2", 90.0)])
    assert [got[k]["stack_index"] for k in ("3", "2", "1")] == [0, 1, 2]
    assert [got[k]["stack_off"] for k in ("3", "2", "1")] == [0, 128, 264]
    assert {r["stack_bearing"] for r in got.values()} == {None}
    assert {(r["anchor_x"], r["stack_tier"], r["stack_size"]) for r in got.values()} == {(2.0, 0, 3)}


def test_wide_second_plate(spark):
    got = _stack(spark, [("1", "g", "A", 0.0, 0.0), ("2", "g", "W", 0.0, 0.0)])
    assert got["2"]["stack_off"] == 104


@pytest.mark.parametrize(("x", "stacked"), [(15.0, 2), (15.01, 0)])
def test_span_cap(spark, x, stacked):
    assert len(_stack(spark, [("1", "g", "A", 0.0, 0.0), ("2", "g", "B", x, 0.0)])) == stacked


def test_blank_groups_and_unknown_signs_never_stack(spark):
    assert not _stack(spark, [("1", " ", "A", 0.0, 0.0), ("2", " ", "B", 0.0, 0.0), ("3", "g", "Z", 0.0, 0.0), ("4", "g", "A", 0.0, 0.0), (None, "g", "B", 0.0, 0.0)])


def test_enrichment_null_bearing_wins_and_lod_copies(spark):
    f = spark.createDataFrame([("1", enrich.SIGN_LAYER, 5.0, 5.0), ("2", enrich.SIGN_LAYER, 6.0, 6.0), ("3", enrich.SIGN_LAYER, 7.0, 7.0), ("1", "pole", 8.0, 8.0)], "fid string, category string, x double, y double")
    b = spark.createDataFrame([("1", 10.0), ("2", 20.0), ("3", 30.0)], "fid string, face_bearing double")
    s = spark.createDataFrame([("1", 0, 0, 1, 5.0, 5.0, None), ("2", 1, 128, 1, 5.0, 5.0, None)], "fid string, stack_index int, stack_off int, stack_tier int, anchor_x double, anchor_y double, stack_bearing double")
    e = enrich.enriched(f, b, s)
    rows = {(r["fid"], r["category"]): (r["x"], r["face_bearing"]) for r in e.collect()}
    assert rows == {("1", enrich.SIGN_LAYER): (5.0, None), ("2", enrich.SIGN_LAYER): (5.0, None), ("3", enrich.SIGN_LAYER): (7.0, 30.0), ("1", "pole"): (8.0, None)}
    hints = sorted((r["fid"], r["category"], str(r["minzoom"]), str(r["maxzoom"])) for r in enrich.lod_copies(e).collect())
    sign = enrich.SIGN_LAYER
    assert hints == [("1", "pole", "None", "None"), ("1", sign, "13", "None"), ("1", sign, "None", "12"), ("2", sign, "13", "None"), ("3", sign, "None", "None")]
    with pytest.raises(ValueError):
        enrich.require_rows(f.where("false"), "features")


def test_thinning_keeps_pinned_rows(spark):
    f = spark.range(100).selectExpr("cast(id as string) fid", "114.1 lng", "22.3 lat", "case when id < 30 then 13 end minzoom", "cast(null as int) maxzoom", "id prio")
    kept = tiles.thinned(tiles.tiled(f, range(8, 14)), F.col("prio"), 5)
    n = {r["z"]: r["count"] for r in kept.groupBy("z").count().collect()}
    assert n == {9: 5, 10: 5, 11: 5, 12: 5, 13: 35}


def test_visibility_truth_table(spark):
    f = spark.createDataFrame([("1", "g", "A", "regulatory"), ("2", "g", "B", "warning"), ("3", None, None, "none")], "fid string, gg string, sign_id string, category_key string")
    companions = spark.createDataFrame([("A", "g")], "sign_id string, gg string")
    state = visibility.FilterState()

    def shown(s, c=None):
        return sorted(r["fid"] for r in visibility.visible(f, s, c).collect())

    assert shown(state) == ["1", "2"]
    assert shown(state.hide("A")) == ["2"]
    assert shown(state.filter_to("A")) == ["1"]
    assert shown(state.filter_to("A"), companions) == ["1", "2"]
    assert shown(state.filter_to("A").hide("B"), companions) == ["1"]
    assert shown(visibility.FilterState(mode="sign-id")) == []
    assert shown(visibility.FilterState(mode="sign-id", hidden=frozenset({"A"}))) == ["2", "3"]
    assert state.hide("A").select("A").hidden == frozenset()
    assert state.hide("A").select_all({"A"}).hidden == {"A"}
    assert "tourist" not in state.toggle("tourist").enabled


def test_layers_and_detail(spark):
    f = spark.createDataFrame([("1", "g", "A", 0), ("2", "h", "A", None), ("3", None, "B", 1)], "fid string, gg string, sign_id string, stack_index int")
    assert sorted(r["fid"] for r in visibility.stack_layer(f, "g").collect()) == ["3"]
    assert [r["fid"] for r in visibility.lone_layer(f, spark.createDataFrame([("A",)], "code string")).collect()] == ["2"]
    assert [r["fid"] for r in visibility.assembly_of(f, "g").collect()] == ["1"]
    d = spark.createDataFrame([("1", "", "A", "", None, None, None, 12.5, "20240131", 22.0, 114.0)], "fid string, text_string string, sign_id string, gg string, refname string, pole_id string, type string, angle double, last_upd string, lat double, lng double")
    rows = {r["label"]: r["value"] for r in detail.detail_rows(d).collect()}
    assert rows == {"title": "A", "sign": "A", "angle": "13°", "updated": "2024-01-31", "coordinates": "22.00000, 114.00000"}
    labels = spark.createDataFrame([("en", "sign", "Sign")], "locale string, key string, text string")
    assert {r["label"]: r["text"] for r in detail.localised(detail.detail_rows(d), labels, "en").collect()}["sign"] == "Sign"


def test_scalars(spark):
    assert one(spark, packed_date(F.lit("20240131120000"))) == "2024-01-31"
    assert one(spark, packed_date(F.lit("2024"))) is None
    assert one(spark, id_query(F.lit("ts-117"))) == "TS117"
    assert one(spark, id_query(F.lit("TS477A"))) is None
    assert one(spark, code_number(F.lit(" 12 3a"))) == 123
    assert one(spark, geo.js_round(F.lit(-2.5))) == -2.0
    assert one(spark, F.to_json(bracketed_json(F.lit("x [1,2] y"), "array<int>"))) == "[1,2]"
    assert [one(spark, catalogue.picture_tier(F.lit(float(w)), F.lit(float(h)))) for w, h in ((171, 100), (130, 100), (100, 100), (57, 100), (330, 330))] == [2, 1, 0, 2, 1]
    assert one(spark, style.interpolate(F.lit(10.0), style.DOT_RADIUS)) == 2.5
    assert one(spark, style.grid_offset(F.lit(12))) == 0
    geo.register(spark)
    assert spark.sql("SELECT js_round(2.5D) a, compass(1D, 0D) b, tile_x(114.1D, 13) c").first()[:2] == (3.0, 90.0)


def test_reprojection_matches_exact_transform(spark):
    x, y = np.random.default_rng(0).uniform(790000, 870000, (2, 200))
    got = geo.to_wgs84(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")).collect()
    lng, lat = geo.exact_wgs84(x, y)
    assert max(abs(r["lng"] - v) for r, v in zip(got, lng, strict=True)) < 1e-9
    assert max(abs(r["lat"] - v) for r, v in zip(got, lat, strict=True)) < 1e-9


def test_search_order_and_literal_percent(spark):
    c = spark.createDataFrame([("TS2", 1, "warning", "b%", None), ("TS21", 2, "regulatory", "a", "停車"), ("TS3", 3, "regulatory", "see ts2", None)], "code string, ord int, grp string, en string, zh string")
    index = search.search_index(c, c)
    assert [r["code"] for r in search.page(search.search(index, "ts 2"), 0, 9).collect()] == ["TS2", "TS21"]
    assert [r["code"] for r in search.search(index, "%").collect()] == ["TS2"]
    assert [r["code"] for r in search.search(index, "停").collect()] == ["TS21"]
    assert search.search(index).count() == 3
    assert search.all_selected(search.search(index, "nothing"), ["TS2"]).first()["all_selected"] is False


def test_merge_and_first_wins(spark):
    c = spark.createDataFrame([("A", 1, "x", None), ("B", 2, None, None)], "code string, ord int, en string, zh string")
    found = spark.createDataFrame([("A", "new", "中"), ("B", "b", None), ("Z", "z", None)], "code string, en string, zh string")
    assert sorted((r["code"], r["en"], r["zh"]) for r in merge.merge_descriptions(c, found).collect()) == [("A", "x", "中"), ("B", "b", None)]
    assert {r["en"] for r in merge.merge_descriptions(c, found, True).collect()} == {"new", "b"}
    staged = spark.createDataFrame([("B", 5, "s", None), ("B", 4, "first", None), ("R", 6, "r", None)], "code string, ord int, en string, zh string")
    rejects = spark.createDataFrame([("R",)], "code string")
    assert sorted((r["code"], r["en"]) for r in merge.promote(c, staged, rejects).collect()) == [("A", "x"), ("B", "first")]
    assert [r["code"] for r in merge.promote(c, staged, rejects, wipe=True).collect()] == ["B"]
    assert [r["code"] for r in merge.new_codes(c, staged).collect()] == ["R"]
    assert [r["en"] for r in hits.last_by(staged, "code", "ord").where("code = 'B'").collect()] == ["s"]
    raw = spark.createDataFrame([("A", '"only"'), ("B", '{"en": "e", "zh": "z"}'), ("C", None)], "code string, desc string")
    assert sorted((r["code"], r["en"], r["zh"]) for r in catalogue.normalised_descriptions(raw).collect()) == [("A", "only", None), ("B", "e", "z"), ("C", None, None)]


def test_table_grid(spark):
    values = F.array(*(F.lit(v) for v in (10.0, 12.0, 14.5, 40.0)))
    assert one(spark, tablegrid.running_clusters(values)) == [12.75, 40.0]
    assert one(spark, tablegrid.first_clusters(values, 3.0)) == [10.0, 14.5, 40.0]
    h = spark.createDataFrame([(1, 5.0, 0.0, 8.0), (1, 5.0, 6.0, 10.0), (1, 25.0, 0.0, 20.0), (1, 45.0, 0.0, 3.0)], "page int, y double, x0 double, x1 double")
    columns = spark.createDataFrame([(1, 0.0, 10.0)], "page int, left double, right double")
    rules = tablegrid.covering_rules(columns, h)
    assert sorted(r["y"] for r in rules.collect()) == [5.0, 25.0]
    assert [(r["top"], r["bottom"]) for r in tablegrid.cells(rules).collect()] == [(5.0, 25.0)]
    two = spark.createDataFrame([(1, 0.0, 20.0), (1, 210.0, 230.0)], "page int, left double, right double")
    pitch = spark.createDataFrame([(1, 100.0)], "page int, pitch double")
    assert [(r["k"], r["left"], r["made"]) for r in tablegrid.lattice(two, pitch).orderBy("k").collect()] == [(0, 0.0, False), (1, 100.0, True), (2, 210.0, False)]


def test_gml_members(spark, tmp_path):
    (tmp_path / "a.gml").write_text(
        """<core:CityModel xmlns:core="c" xmlns:gen="g" xmlns:gml="m">
<core:cityObjectMember><gen:intAttribute name="FEATUREID"><gen:value>1</gen:value></gen:intAttribute><gen:stringAttribute name="GG_NAME"><gen:value> G </gen:value></gen:stringAttribute>
<gen:stringAttribute name="SIGNID"><gen:value>TS1</gen:value></gen:stringAttribute><gml:Point><gml:pos>1.5 2.5</gml:pos></gml:Point></core:cityObjectMember>
<core:cityObjectMember><gen:intAttribute name="FEATUREID"><gen:value>2</gen:value></gen:intAttribute><gml:LineString><gml:posList>0 0 0 5 0 9 7</gml:posList></gml:LineString><gml:LineString><gml:posList>1 1 2 2</gml:posList></gml:LineString></core:cityObjectMember>
</core:CityModel>"""
    )
    members = src.read_members(spark, str(tmp_path))
    rows = {r["fid"]: (r["gg"], r["sign_id"], r["x"], r["y"]) for r in src.point_features(members).collect()}
    assert rows == {"1": ("G", "TS1", 1.5, 2.5), "2": (None, None, None, None)}
    segments = nearest.polyline_segments(src.line_positions(members)).collect()
    assert sorted((r["line_id"], r["k"], r["by"]) for r in segments) == [("2/0", 0, 5.0), ("2/0", 1, 9.0), ("2/1", 0, 2.0)]


def test_other_sources(spark, tmp_path):
    assert src.read_json_map(spark, str(tmp_path / "none.json"), "double").count() == 0
    (tmp_path / "m.json").write_text('{"1": 2.5, "2": 3}')
    assert {r["key"]: r["value"] for r in src.read_json_map(spark, str(tmp_path / "m.json"), "double").collect()} == {"1": 2.5, "2": 3.0}
    (tmp_path / "A.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (300).to_bytes(4, "big") + (120).to_bytes(4, "big"))
    assert [tuple(r) for r in src.image_sizes(spark, str(tmp_path)).collect()] == [("A", 300, 120)]
    assert src.layer_files(src.layer_manifest(spark)).count() == 12
    want = spark.createDataFrame([("a", 1), ("b", 2), ("c", -1)], "name string, length long")
    have = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "name string, length long")
    assert sorted(r["name"] for r in src.stale_files(want, have).collect()) == ["b", "c"]


def test_click_cycle(spark):
    clicks = spark.createDataFrame([(1, "u", "a", 2), (2, "u", "a", 2), (3, "u", "a", 2), (4, "u", "b", 3), (5, "u", None, 0), (6, "u", "b", 3)], "t int, user string, key string, hits int")
    got = hits.click_cycle(clicks, "user", ["t"], "key", "hits").orderBy("t").collect()
    assert [r["cycle_index"] for r in got] == [0, 1, 0, 0, None, 0]


def test_rules_of_a_drawing(spark):
    text = """<fill_path transform="1 0 0 -1 10 100"><moveto x="0" y="0"/><lineto x="8" y="0.1"/><lineto x="8" y="20"/><closepath/></fill_path>
<stroke_path><moveto x="1" y="1"/><lineto x="3" y="1"/><moveto x="9" y="9"/><lineto x="2" y="9"/></stroke_path><fill_text transform="1 0 0 1 0 0"/>"""
    pages = spark.createDataFrame([(1, text), (2, None), (3, "<page/>")], "page int, value string")
    rows = sorted(tuple(r) for r in src.drawn_rules(pages).collect())
    assert [(p, k) for p, k, *_ in rows] == [(1, "h"), (1, "h"), (1, "v")]
    assert [v for r in rows for v in r[2:]] == pytest.approx([9, 2, 9, 99.95, 10, 18, 18, 80, 99.9])


def test_wanted_members_are_ranked_among_all(spark):
    """A post's members of other layers keep their places in the order, but only wanted ones are returned."""
    m = spark.range(12).selectExpr("cast(id as string) fid", "cast(id div 4 as string) gg", "concat('S', id) sign_id", "1e0 x", "2e0 y", "cast(id % 4 as int) rank", "60 w", "120 h", "0 tier", "if(id % 2 = 1, 'a', 'b') category")
    every, wanted = assemblies.stack_assemblies(m), assemblies.stack_assemblies(m, wanted=F.col("category") == "a")
    assert wanted.columns == every.columns
    assert {tuple(r) for r in wanted.collect()} == {tuple(r) for r in every.where("cast(fid as int) % 2 = 1").collect()}
