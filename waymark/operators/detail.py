"""The detail view of one feature: title and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import js_round
from waymark.functions.text import empty_to_null, packed_date


def title() -> Column:
    """The first of text, sign, reference name, pole and type that isn't empty."""
    return F.coalesce(*(empty_to_null(F.col(c)) for c in ("text_string", "sign_id", "refname", "pole_id", "type")))


def detail_rows(features: DataFrame) -> DataFrame:
    """(fid, ord, label, value) of every field that has a value, in display order."""
    angle = F.concat(js_round(F.col("angle")).cast("long").cast("string"), F.lit("°"))
    place = F.concat(F.format_string("%.5f", "lat"), F.lit(", "), F.format_string("%.5f", "lng"))
    shown = [
        ("title", title()),
        ("sign", empty_to_null(F.col("sign_id"))),
        ("assembly", empty_to_null(F.col("gg"))),
        ("reference", empty_to_null(F.col("refname"))),
        ("pole", empty_to_null(F.col("pole_id"))),
        ("type", empty_to_null(F.col("type"))),
        ("angle", angle),
        ("updated", packed_date(F.col("last_upd"))),
        ("coordinates", F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), place)),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("label"), v.alias("value")) for i, (k, v) in enumerate(shown)))
    return features.select("fid", F.explode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("r")).select("fid", "r.*")


def localised(rows: DataFrame, labels: DataFrame, locale: str) -> DataFrame:
    """Rows with the locale's label text, or the key where there is none."""
    own = labels.where(F.col("locale") == locale).select(F.col("key").alias("label"), "text")
    return rows.join(own, "label", "left").withColumn("text", F.coalesce("text", "label"))
