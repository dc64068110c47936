"""The event sink's batches, and processors with timers, across restarts."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.streaming import events as streams
from waymark.streaming import timers
from waymark.streaming.sink import PARAMETERS, EventSink, once, typed

RAW = "event_id long, at timestamp, kind string, params string"
AT = datetime(2024, 5, 1, 12)
GOOD = {
    "sign_select": {"sign_id": None, "category": "none", "cluster_size": 3, "zoom": 14.25}, "filter_category_toggle": {"category": "warning", "enabled": True}, "filter_toggle_all": {"enabled": False},
    "filter_mode_switch": {"mode": "sign-id"}, "filter_signid_toggle": {"sign_id": "TS1", "enabled": True}, "filter_signid_bulk": {"count": 9, "enabled": True}, "filter_signid_clear": {}, "filter_signid_only": {"sign_id": "TS1"},
    "filter_signid_hide": {"sign_id": ""}, "filter_signid_unhide": {"sign_id": "é"}, "locale_switch": {"from": "en", "to": "zh-HK"}, "theme_change": {"mode": "system"}, "info_open": {}, "map_init_failed": {},
}


def problems(spark, rows):
    return {r.event_id: r.problem for r in typed(spark.createDataFrame(rows, RAW)).collect()}


def test_every_kind_is_accepted(spark):
    assert set(GOOD) == set(PARAMETERS)
    rows = [(i, AT, k, json.dumps(p)) for i, (k, p) in enumerate(GOOD.items())]
    assert set(problems(spark, rows).values()) == {None}
    first = typed(spark.createDataFrame(rows[:1], RAW)).first()
    assert (first.sign_id, first.category, first.cluster_size, first.zoom) == (None, "none", 3, 14.25)


@pytest.mark.parametrize(
    ("kind", "params", "want"),
    [
        ("info_open", None, None), ("info_open", " ", None), ("info_open", "{}", None), ("info_open", '{"a": 1}', "unknown a"), ("info_open", "[1]", "no object"), ("info_open", "{", "no object"), ("info_open", '"x"', "no object"),
        ("nothing", "{}", "unknown kind"), (None, "{}", "unknown kind"), ("filter_toggle_all", "{}", "enabled is missing"), ("filter_toggle_all", '{"enabled": null}', "enabled is missing"),
        ("filter_toggle_all", '{"enabled": "true"}', "enabled is no boolean"), ("filter_signid_bulk", '{"count": 1.5, "enabled": true}', "count is no int"), ("filter_signid_bulk", '{"count": 99999999999, "enabled": true}', "count is no int"),
        ("sign_select", '{"category": "none", "cluster_size": 1, "zoom": 2}', "sign_id is missing"), ("sign_select", '{"sign_id": 4, "category": "none", "cluster_size": 1, "zoom": 2}', "sign_id is no string"),
        ("sign_select", '{"sign_id": "A", "category": "none", "cluster_size": 1, "zoom": 2}', None), ("filter_category_toggle", '{"category": "odd", "enabled": true}', "category is no category"), ("theme_change", '{"mode": "sign-id"}', "mode is no theme_mode"),
    ],
)
def test_what_is_wrong(spark, kind, params, want):
    assert problems(spark, [(1, AT, kind, params)]) == {1: want}


def test_missing_id_and_time(spark):
    got = typed(spark.createDataFrame([(None, AT, "info_open", None), (2, None, "info_open", None)], RAW)).collect()
    assert sorted(r.problem for r in got) == ["no id", "no time"]


def test_repeats_go_once_in_a_batch_too(spark):
    rows = [(1, AT, "info_open", None)] * 3 + [(None, AT, "info_open", None)] * 2 + [(None, AT, "info_open", "{}")]
    assert once(spark.createDataFrame(rows, RAW)).count() == 3


def test_sink_across_restarts(spark, tmp_path):
    source, sink = f"{tmp_path}/in", EventSink(spark, f"file://{tmp_path}/out")

    def put(name, rows):
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        stream = spark.readStream.schema(RAW).parquet(f"{source}/*")
        sink.start(stream, f"{tmp_path}/checkpoint").awaitTermination()

    put("a", [(1, AT, "info_open", None), (1, AT, "info_open", None), (2, AT, "odd", None), (3, None, "info_open", None)])
    run()
    run()  # nothing new: nothing written
    put("b", [(1, AT, "info_open", None), (4, AT + timedelta(minutes=1), "theme_change", '{"mode": "dark"}')])
    run()
    assert sorted(r.event_id for r in sink.events().collect()) == [1, 4]
    assert sorted((r.event_id, r.problem) for r in sink.quarantine().collect()) == [(2, "unknown kind"), (3, "no time")]
    number = int(sink.commits.names()[-1])
    sink.write_batch(typed(spark.createDataFrame([(9, AT, "info_open", None)], RAW)), number)
    assert sink.events().count() == 2  # a committed number is not written again


def test_a_batch_that_failed_half_way_shows_nothing(spark, tmp_path):
    sink = EventSink(spark, f"file://{tmp_path}/out")
    bad = typed(spark.createDataFrame([(1, AT, "info_open", None)], RAW)).withColumn("event_id", F.expr("raise_error('gone')").cast("long"))
    with pytest.raises(Exception, match="gone"):
        sink.write_batch(bad, 0)
    assert sink.events().count() == 0
    sink.write_batch(typed(spark.createDataFrame([(1, AT, "info_open", None)], RAW)), 0)
    assert sink.events().count() == 1


def test_timers_across_restarts_and_out_of_order(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, i % 5, AT + timedelta(minutes=int(i * 7 + r.randrange(6)) % 900), r.choice("ab"), 1.0) for i in range(300)]
    schema = "event_id long, user_id long, at timestamp, event_type string, value double"
    rows.sort(key=lambda x: x[2])
    batches = [rows[:100], rows[100:220], rows[220:]]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, own in enumerate(batches):
        own = own[:]
        r.shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        with timers.timer_store(spark):
            got = streams.run_to_table(timers.runs_stream(stream, 600), out, f"{tmp_path}/checkpoint")
    want, end = [], max(x[2] for x in rows) - timedelta(minutes=10)
    for user in range(5):
        own = sorted((x[2], x[0]) for x in rows if x[1] == user)
        run = [own[0]]
        for x in [*own[1:], (datetime.max, 0)]:
            if x[0] - run[-1][0] >= timedelta(seconds=600):
                if run[-1][0] + timedelta(seconds=600) <= end:
                    want.append((user, run[0][0], run[-1][0], len(run)))
                run = []
            run.append(x)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_timers_need_a_stream(spark):
    with pytest.raises(ValueError, match="stream"):
        timers.debounced_stream(spark.createDataFrame([(1, AT, 1, "a")], "user_id long, at timestamp, event_id long, event_type string"))
