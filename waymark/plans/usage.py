"""Queries of usage events through the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.registry import query
from waymark.plans.staging import Stage
from waymark.streaming import events as streams
from waymark.streaming.sink import EventSink

# Readable by both engines: the kind of every event, and parameters that fit some kinds and not others.
_KIND = """CASE event_id % 16 WHEN 0 THEN 'sign_select' WHEN 1 THEN 'filter_category_toggle' WHEN 2 THEN 'filter_toggle_all' WHEN 3 THEN 'filter_mode_switch' WHEN 4 THEN 'filter_signid_toggle'
  WHEN 5 THEN 'filter_signid_bulk' WHEN 6 THEN 'filter_signid_clear' WHEN 7 THEN 'filter_signid_only' WHEN 8 THEN 'filter_signid_hide' WHEN 9 THEN 'filter_signid_unhide' WHEN 10 THEN 'locale_switch'
  WHEN 11 THEN 'theme_change' WHEN 12 THEN 'info_open' WHEN 13 THEN 'map_init_failed' ELSE event_type END"""
_PARAMS = """CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '{"enabled": true}' WHEN 2 THEN '{"enabled": "yes"}' WHEN 3 THEN '{"sign_id": "TS1", "enabled": false}' WHEN 4 THEN '{"mode": "dark"}'
  WHEN 5 THEN '{"category": "warning", "enabled": true}' WHEN 6 THEN 'nonsense' WHEN 7 THEN '{"sign_id": "TS2"}' WHEN 8 THEN concat('{"count": ', user_id, ', "enabled": true}') WHEN 9 THEN '{"mode": "sign-id"}'
  ELSE concat('{"sign_id": null, "category": "none", "cluster_size": 2, "zoom": ', value, '}') END"""

_ASKED = """pr(kind, ord, name, asked, allowed) AS (VALUES ('sign_select', 1, 'sign_id', 'null or VARCHAR', NULL), ('sign_select', 2, 'category', 'VARCHAR', 'cat'), ('sign_select', 3, 'cluster_size', 'UBIGINT', NULL), ('sign_select', 4, 'zoom', 'number', NULL),
('filter_category_toggle', 1, 'category', 'VARCHAR', 'cat'), ('filter_category_toggle', 2, 'enabled', 'BOOLEAN', NULL), ('filter_toggle_all', 1, 'enabled', 'BOOLEAN', NULL), ('filter_mode_switch', 1, 'mode', 'VARCHAR', 'filter'),
('filter_signid_toggle', 1, 'sign_id', 'VARCHAR', NULL), ('filter_signid_toggle', 2, 'enabled', 'BOOLEAN', NULL), ('filter_signid_bulk', 1, 'count', 'UBIGINT', NULL), ('filter_signid_bulk', 2, 'enabled', 'BOOLEAN', NULL),
('filter_signid_only', 1, 'sign_id', 'VARCHAR', NULL), ('filter_signid_hide', 1, 'sign_id', 'VARCHAR', NULL), ('filter_signid_unhide', 1, 'sign_id', 'VARCHAR', NULL),
('locale_switch', 1, 'from', 'VARCHAR', NULL), ('locale_switch', 2, 'to', 'VARCHAR', NULL), ('theme_change', 1, 'mode', 'VARCHAR', 'theme'))"""


@query(f"""WITH raw AS (SELECT event_id, {_KIND} kind, {_PARAMS} params FROM events), {_ASKED},
j AS (SELECT *, CASE WHEN params IS NULL THEN '{{}}' WHEN json_valid(params) THEN params END p FROM raw),
t AS (SELECT event_id, ord, name, asked, allowed, json_type(p, concat('$.', name)) got, json_extract_string(p, concat('$.', name)) v FROM j JOIN pr USING (kind) WHERE p IS NOT NULL),
w AS (SELECT event_id, arg_min(problem, ord) problem FROM (SELECT event_id, ord, CASE WHEN got IS NULL OR (got = 'NULL' AND asked <> 'null or VARCHAR') THEN concat(name, ' is missing')
  WHEN NOT (got = asked OR (asked = 'null or VARCHAR' AND got IN ('NULL', 'VARCHAR')) OR (asked = 'number' AND got IN ('UBIGINT', 'BIGINT', 'DOUBLE')))
    OR (allowed = 'cat' AND v NOT IN ('regulatory', 'warning', 'informatory', 'supplementary', 'temporary', 'other-traffic', 'tourist', 'none')) OR (allowed = 'filter' AND v NOT IN ('category', 'sign-id')) OR (allowed = 'theme' AND v NOT IN ('light', 'dark', 'system'))
  THEN concat(name, ' is no ', CASE allowed WHEN 'cat' THEN 'category' WHEN 'filter' THEN 'filter_mode' WHEN 'theme' THEN 'theme_mode' ELSE CASE asked WHEN 'UBIGINT' THEN 'int' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'number' THEN 'double' ELSE 'string' END END) END problem FROM t) WHERE problem IS NOT NULL GROUP BY 1),
x AS (SELECT event_id, min(k) k FROM (SELECT event_id, kind, unnest(json_keys(p)) k FROM j WHERE p IS NOT NULL) u WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.kind = u.kind AND pr.name = u.k) GROUP BY 1)
SELECT j.event_id, j.kind, CASE WHEN event_id % 16 > 13 THEN 'unknown kind' WHEN p IS NULL THEN 'no object' ELSE coalesce(w.problem, concat('unknown ', x.k)) END problem,
CASE WHEN p IS NOT NULL THEN json_extract_string(p, '$.mode') END mode, CASE WHEN p IS NOT NULL THEN json_extract_string(p, '$.sign_id') END sign_id, CASE WHEN json_type(p, '$.count') = 'UBIGINT' THEN CAST(json_extract(p, '$.count') AS INTEGER) END AS count
FROM j LEFT JOIN w USING (event_id) LEFT JOIN x USING (event_id)""".replace("concat('unknown ', x.k)", "CASE WHEN x.k IS NOT NULL THEN concat('unknown ', x.k) END"))
def typed_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event once with its parameters, or what is wrong with it: a stream with repeats through the sink, its last batch run twice."""
    folder = Stage(spark, "usage").folder
    stream = streams.event_stream(spark, d).withColumn("times", F.explode(F.array_repeat(F.lit(1), 2))).selectExpr("event_id", "at", f"{_KIND} kind", f"{_PARAMS} params")
    sink = EventSink(spark, f"{folder}/events")
    sink.start(stream, f"{folder}/checkpoint", "400 days").awaitTermination()
    last = int(sink.commits.names()[-1])
    sink.write_batch(sink.events().withColumns({"params": F.lit(None).cast("string"), "problem": F.lit(None).cast("string")}), last)  # as after a failure: changes nothing
    good = sink.events().withColumn("problem", F.lit(None).cast("string"))
    bad = sink.quarantine().withColumns({"mode": F.get_json_object("params", "$.mode"), "sign_id": F.get_json_object("params", "$.sign_id"), "count": F.get_json_object("params", "$.count").cast("int")})
    columns = ["event_id", "kind", "problem", "mode", "sign_id", "count"]
    return good.select(columns).unionByName(bad.select(columns))
