"""The sheet chain reads each text once: no filter repeats an expression, no cast fails on empty text."""

from __future__ import annotations

from waymark.operators import tablegrid
from waymark.sources import features as src


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_filter_reads_texts_again(spark, tmp_path):
    spark.range(3).selectExpr("id page", "string(id) value", "array(string(id)) tokens", "1 col", "id row", "'TS' prefix", "1 lo", "9 hi", "'r' grp").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    rules = _plan(src.drawn_rules(t.select("page", "value")))
    codes = _plan(tablegrid.gated_codes(t.select("page", "col", "row", "tokens"), t.select("page", "prefix", "lo", "hi", "grp").distinct()))
    for plan in (rules, codes):
        assert not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line]
        assert "= )" in plan  # empty text is null before a cast
    assert codes.count("regexp_replace") == 0


def test_rules_of_odd_paths(spark):
    def path(*points: str, head: str = "stroke_path") -> str:
        return f"<{head}>{''.join(points)}</{head.split()[0]}>"

    start, across, down = '<moveto x="0" y="0"/>', '<lineto x="9" y="0"/>', '<lineto x="9" y="8"/>'
    texts = [path(start), path(), "", None, path(start, across, down), path(start, across, head='fill_path transform="2 0 0 1 5 7"'), path(start, across, head='fill_path transform="x"')]
    rows = src.drawn_rules(spark.createDataFrame(list(enumerate(texts)), "page int, value string")).collect()
    assert sorted(map(tuple, rows)) == [(4, "h", 0.0, 0.0, 9.0), (4, "v", 9.0, 0.0, 8.0), (5, "h", 7.0, 5.0, 23.0), (6, "h", 0.0, 0.0, 9.0)]


def test_codes_of_odd_tokens(spark):
    cells = [(0, None), (1, []), (2, ["none", None, "1 2\t0a"]), (3, ["", "7777777", "150"]), (4, ["TC 9", "99"]), (5, ["110 B", "300"]), (6, ["120"])]
    tokens = spark.createDataFrame([(1, 0, row, t) for row, t in cells], "page int, col int, row int, tokens array<string>")
    sheets = spark.createDataFrame([(1, "TS", 101, 400, "g")], "page int, prefix string, lo int, hi int, grp string")
    rows = tablegrid.gated_codes(tokens, sheets).select("row", "code", "n", "falls").collect()
    assert sorted(map(tuple, rows)) == [(2, "TS120A", 120, False), (3, "TS150", 150, False), (5, "TS110B", 110, True), (6, "TS120", 120, False)]
