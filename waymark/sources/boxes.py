"""Features in files by place, and box queries that open only the files that they meet.

Features are dealt by range along a space-filling curve, a file a range, and an
index holds each file's bounding box.  A box query compares boxes first: of a
small box's query most files are never opened, whatever the table's size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.thinning import on_curve
from waymark.operators.visibility import in_bounds

#: Features of a file by plan, and files at least where there are enough features.
FILE_ROWS, LEAST_FILES = 500_000, 64


def write_boxed(features: DataFrame, folder: str, files: int | None = None) -> None:
    """Write ``features(lng, lat, ...)`` by place with the index of their files' boxes.  Rows without a place lie in one range of their own."""
    n = files or max(LEAST_FILES, math.ceil(features.count() / FILE_ROWS))
    placed = on_curve(features)
    # rows of one place, or none, are told apart by their own hash, so that they can lie in several ranges
    dealt = placed.withColumn("_h", F.xxhash64(*features.columns)).repartitionByRange(n, "curve", "_h").sortWithinPartitions("curve")
    dealt.drop("curve", "mx", "my", "_h").write.parquet(f"{folder}/rows")
    written = features.sparkSession.read.schema(features.schema).parquet(f"{folder}/rows").select("lng", "lat", F.col("_metadata.file_path").alias("file"))
    box = {"west": F.min("lng"), "south": F.min("lat"), "east": F.max("lng"), "north": F.max("lat"), "n": F.count("*")}
    written.groupBy("file").agg(*(c.alias(name) for name, c in box.items())).coalesce(1).write.parquet(f"{folder}/index")


def files_of_box(spark: SparkSession, folder: str, west: float, south: float, east: float, north: float) -> list[str]:
    """The files whose box meets the given one."""
    index = spark.read.parquet(f"{folder}/index")
    return [r.file for r in index.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)).select("file").collect()]


def read_box(spark: SparkSession, folder: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """All features inside a box of degrees, edges included."""
    files = files_of_box(spark, folder, west, south, east, north)
    schema = spark.read.parquet(f"{folder}/rows").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return in_bounds(rows, west, south, east, north)
