"""A point far off opens few lines, however many lie behind its boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import rings


def test_boxes_are_closed_on_the_way_down(spark):
    s = spark.range(4096).selectExpr("id seg_id", "id % 64 * 16e0 ax", "floor(id / 64) * 16e0 ay", "id % 64 * 16e0 + 4 bx", "floor(id / 64) * 16e0 by")
    nodes = rings._nodes(rings._pieces(s))
    coarse = rings._parents(rings._parents(nodes))
    point = coarse.select(F.lit(1).alias("pid"), F.lit(-900.0).alias("px"), F.lit(8.0).alias("py"), "fx", "fy", F.lit(None).cast("double").alias("bound"))
    front = rings._opened(rings._opened(point, rings._parents(nodes), 1), nodes, 1)
    assert 1 <= front.count() <= 40
    assert coarse.agg(F.sum("heads")).first()[0] == 4096
