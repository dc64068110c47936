"""Readers and writers: tagged XML members, GeoJSON lines, JSON maps, image headers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.text import empty_to_null

# The layers with file, category, geometry, label and whether they are tiled.
LAYERS = [
    ("DTAD_TS_POLE_PT", "traffic-sign-pole", "point", "Traffic sign pole", True),
    ("DTAD_TS_ABV_PT", "traffic-sign-abbreviation", "point", "Traffic sign abbreviation", True),
    ("DTAD_PS_POLE_PT", "pedestrian-sign-pole", "point", "Pedestrian sign pole", True),
    ("DTAD_DS_POLE_PT", "directional-sign-pole", "point", "Directional sign pole", True),
    ("DTAD_PS_ANNO_PT", "tourist-sign", "point", "Tourist sign", True),
    ("DTAD_RD_MARK_LINE", "road-marking", "line", "Road marking line (for face-bearing derivation)", False),
]
# The sheets' prefix, first and last number, and group.
SHEETS = [
    ("TS", 101, 205, "regulatory"), ("TS", 206, 310, "regulatory"), ("TS", 311, 400, "regulatory"), ("TS", 401, 505, "warning"), ("TS", 506, 600, "warning"), ("TS", 601, 700, "informatory"),
    ("TS", 701, 805, "supplementary"), ("TS", 806, 900, "supplementary"), ("TS", 901, 1000, "temporary"), ("TS", 2101, 2205, "regulatory"), ("TS", 2206, 2310, "regulatory"), ("TS", 2601, 2717, "informatory"),
    ("TS", 3601, 3705, "informatory"), ("TS", 3706, 3810, "supplementary"), ("TS", 3811, 3936, "informatory"), ("TS", 3937, 4062, "warning"),
]

#: Members of a written file at most, and the start and end of its root.
MEMBERS_PER_FILE = 100_000
ROOT = '<core:CityModel xmlns:core="core" xmlns:gen="gen" xmlns:gml="gml">', "</core:CityModel>"

_ATTRIBUTE = T.ArrayType(T.StructType([T.StructField("_name", T.StringType()), T.StructField("gen:value", T.StringType())]))
_POINT = T.StructType([T.StructField("gml:pos", T.StringType())])
_LINE = T.ArrayType(T.StructType([T.StructField("gml:posList", T.StringType())]))
#: Attributes once or many times are both arrays, which inference would not give.
MEMBER = T.StructType(
    [
        T.StructField("gen:intAttribute", _ATTRIBUTE),
        T.StructField("gen:stringAttribute", _ATTRIBUTE),
        T.StructField("gen:doubleAttribute", _ATTRIBUTE),
        T.StructField("gml:Point", _POINT),
        T.StructField("gml:LineString", _LINE),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def layer_manifest(spark: SparkSession) -> DataFrame:
    """file, category, geometry, label and tiled of every layer."""
    return spark.createDataFrame(LAYERS, "file string, category string, geometry string, label string, tiled boolean")


def sheet_manifest(spark: SparkSession) -> DataFrame:
    """pdf, prefix, lo, hi and grp of every sheet; a sheet's file is named after its numbers."""
    rows = [(f"({prefix} {lo} - {hi}).pdf", prefix, lo, hi, grp) for prefix, lo, hi, grp in SHEETS]
    return spark.createDataFrame(rows, "pdf string, prefix string, lo int, hi int, grp string")


def layer_files(manifest: DataFrame) -> DataFrame:
    """Each layer's file names, data and schema."""
    return manifest.select("file", F.explode(F.array(F.lit("gml"), F.lit("gfs"))).alias("ext")).select(F.concat_ws(".", "file", "ext").alias("name"))


def stale_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted (name, length) that are absent, differ in length or have no known length."""
    have = present.select("name", F.col("length").alias("_have"))
    return wanted.join(have, "name", "left").where("_have is null or length is null or length < 0 or length <> _have").drop("_have")


def read_members(spark: SparkSession, path: str, row_tag: str = "core:cityObjectMember", schema: T.StructType = MEMBER) -> DataFrame:
    """Members of a GML file as rows; members that can't be parsed keep only ``_corrupt_record``."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)


def _rooted(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's members with the root's start before every first of ``most`` and its end after the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, None
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if held is not None:
                    out.append(held + ROOT[1] if n % most == 0 else held)
                held = ROOT[0] + text if n % most == 0 else text
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + ROOT[1]], pa.string())], ["value"])

    return run


def write_members(members: DataFrame, path: str, compression: str = "none") -> None:
    """``members(value)``, the text of one each, row by row into files that hold MEMBERS_PER_FILE at most under a root."""
    members.mapInArrow(_rooted(MEMBERS_PER_FILE), "value string").write.option("maxRecordsPerFile", MEMBERS_PER_FILE).text(path, compression=compression)


def parsed(members: DataFrame) -> DataFrame:
    """Members that could be parsed; ``rejected`` counts the others."""
    return members.where("_corrupt_record is null")


def rejected(members: DataFrame) -> DataFrame:
    """One row: n_members, and n_rejected of them that could not be parsed or have neither place nor line."""
    bad = F.col("_corrupt_record").isNotNull() | (F.col("gml:Point").isNull() & F.col("gml:LineString").isNull())
    return members.agg(F.count("*").alias("n_members"), F.count_if(bad).alias("n_rejected"))


def attribute(name: str, kind: str = "string") -> Column:
    """The first value of a member's generic attribute of this kind and name."""
    own = F.filter(f"`gen:{kind}Attribute`", lambda a: a["_name"] == name)
    return F.try_element_at(own, F.lit(1))["gen:value"]


def numbers(c: Column) -> Column:
    """The white-space separated numbers of a text."""
    return F.transform(F.split(F.trim(c), r"\s+"), lambda v: empty_to_null(v).try_cast("double"))  # a cast that fails costs an exception


def point_features(members: DataFrame) -> DataFrame:
    """fid, gg, sign_id, x and y of members; parts that are missing are null."""
    pos = numbers(F.col("gml:Point")["gml:pos"])
    both = F.size(pos) == 2
    return members.select(
        attribute("FEATUREID", "int").alias("fid"),
        attribute("GG_NAME").alias("gg"),
        attribute("SIGNID").alias("sign_id"),
        F.when(both, pos[0]).alias("x"),
        F.when(both, pos[1]).alias("y"),
    )


def line_positions(members: DataFrame) -> DataFrame:
    """line_id and pos of every position list; a member's lists stay apart."""
    lists = members.select(F.posexplode("gml:LineString").alias("n", "l"), attribute("FEATUREID", "int").alias("fid"))
    return lists.select(F.concat_ws("/", "fid", "n").alias("line_id"), numbers(F.col("l.gml:posList")).alias("pos"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """lng, lat, properties and zoom hints of features, one JSON per line, record separators allowed."""
    text = F.trim(F.regexp_replace("value", "^\u001e", ""))
    schema = "geometry struct<coordinates: array<double>>, properties map<string,string>, tippecanoe struct<minzoom: int, maxzoom: int>"
    rows = spark.read.text(path).select(text.alias("t")).where("t <> ''").select(F.from_json("t", schema).alias("f"))
    place = F.col("f.geometry.coordinates")
    return rows.select(F.try_element_at(place, F.lit(1)).alias("lng"), F.try_element_at(place, F.lit(2)).alias("lat"), "f.properties", F.col("f.tippecanoe.minzoom").alias("minzoom"), F.col("f.tippecanoe.maxzoom").alias("maxzoom"))


def geojson_lines(features: DataFrame, properties: list[str]) -> DataFrame:
    """One JSON text per feature; zoom hints only where there are any."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    props = F.struct(*(F.col(c) for c in properties))
    parts = [F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")]
    if "minzoom" in features.columns:
        hint = F.when(F.col("minzoom").isNotNull() | F.col("maxzoom").isNotNull(), F.struct("minzoom", "maxzoom"))
        parts.append(hint.alias("tippecanoe"))
    return features.select(F.to_json(F.struct(*parts)).alias("value"))


# How straight a rule of a drawing is, and the lengths that horizontal and vertical ones exceed, in points.
STRAIGHT, LEAST_ACROSS, LEAST_DOWN = 0.3, 3.0, 5.0


def drawn_rules(pages: DataFrame) -> DataFrame:
    """page, kind (h or v), at, lo and hi of the axis-aligned rules that ``pages(page, value)`` draw, a page's trace XML per row.

    A path's affine transform applies to its points; a stretch starts at the pen's last place.  Pages without text draw none.
    """
    path = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<(stroke_path|fill_path)\b[^>]*>.*?</\1>"), F.lit(0)))
    m = numbers(F.regexp_extract("p", r'^[^>]*transform="([^"]+)"', 1))
    step = F.lit(r'<(moveto|lineto) x="([-0-9.]+)" y="([-0-9.]+)"')
    op, *xy = (F.regexp_extract_all("p", step, F.lit(i)) for i in (1, 2, 3))
    x, y = (F.transform(v, lambda t: t.cast("double")) for v in xy)

    def placed(t: Column) -> Column:
        known = F.size("m") == 6
        at = [F.when(known, F.col("m")[i] * t["x"] + F.col("m")[i + 2] * t["y"] + F.col("m")[i + 4]).otherwise(t[v]) for i, v in ((0, "x"), (1, "y"))]
        return F.struct(t["op"].alias("op"), at[0].alias("x"), at[1].alias("y"))

    # no filter on what the expressions give: it would be pushed below them and evaluate them twice
    drawn = pages.select("page", path.alias("p")).select("page", m.alias("m"), F.arrays_zip(op.alias("op"), x.alias("x"), y.alias("y")).alias("t"))
    points = drawn.select("page", F.transform("t", placed).alias("a"))
    pairs = points.select("page", F.inline(F.expr("zip_with(slice(a, 1, greatest(size(a) - 1, 0)), slice(a, 2, greatest(size(a) - 1, 0)), (q, r) -> struct(q, r))")))
    dx, dy = (F.abs(F.col(f"r.{c}") - F.col(f"q.{c}")) for c in "xy")
    kind = F.when((dy < STRAIGHT) & (dx > LEAST_ACROSS), "h").when((dx < STRAIGHT) & (dy > LEAST_DOWN), "v")
    rules = pairs.where("r.op = 'lineto'").withColumn("kind", kind).where("kind is not null")
    along = [F.when(F.col("kind") == "h", F.col(f"{p}.x")).otherwise(F.col(f"{p}.y")) for p in "qr"]
    across = [F.when(F.col("kind") == "h", F.col(f"{p}.y")).otherwise(F.col(f"{p}.x")) for p in "qr"]
    return rules.select("page", "kind", ((across[0] + across[1]) / 2).alias("at"), F.least(*along).alias("lo"), F.greatest(*along).alias("hi"))


def read_json_map(spark: SparkSession, path: str, value: str, required: bool = False) -> DataFrame:
    """(key, value) of a JSON object file; a missing file gives no rows unless it is required."""
    try:
        rows = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], f"key string, value {value}")
    return rows.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def header_sizes(pictures: DataFrame, key: str = "code") -> DataFrame:
    """``key``, w and h from the headers of PNG ``content``; w and h are big-endian at bytes 16 and 20."""

    def number(at: int) -> Column:
        return F.conv(F.hex(F.substring("content", at + 1, 4)), 16, 10).cast("int")

    return pictures.select(key, number(16).alias("w"), number(20).alias("h"))


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """code, w and h from the headers of PNG files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return header_sizes(files.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("code"), "content"))
