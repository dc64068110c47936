"""Queries of boxes over features that are written by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.hits import hit_box
from waymark.plans import adapter
from waymark.plans.registry import _F, _MY, _wgs84, query
from waymark.plans.staging import Stage
from waymark.sources.boxes import files_of_box, read_box, write_boxed


@query(f"""WITH {_F}, w AS ({_wgs84('f')}), h AS (SELECT * FROM w WHERE abs((lng + 180) / 360 - (114.1 + 180) / 360) <= 6 / (512 * pow(2, 8)) AND abs({_MY.format('lat')} - {_MY.format('22.35e0')}) <= 6 / (512 * pow(2, 8)))
SELECT fid, category, round(lng, 6) lng, round(lat, 6) lat, true few_files FROM h""")
def box_files_read(spark: SparkSession, d: str) -> DataFrame:
    """What one click hits, read from the files whose boxes meet it: fewer than a twentieth of all."""
    folder = Stage(spark, "boxed").folder
    write_boxed(geo.to_wgs84(adapter.features(spark, d)).select("fid", "category", "lng", "lat"), folder, 256)
    box = hit_box(114.1, 22.35, 8)
    few = len(files_of_box(spark, folder, *box)) * 20 < spark.read.parquet(f"{folder}/index").count()
    return read_box(spark, folder, *box).select("fid", "category", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), F.lit(few).alias("few_files"))
