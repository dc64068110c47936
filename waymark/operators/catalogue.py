"""Sign catalogue: descriptions, categories, tiers and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The groups in their order, and the least mean coverage of a plate's picture.
GROUPS = ["regulatory", "warning", "informatory", "supplementary", "temporary"]
PLATE_COVERAGE = 0.85


def layer_category(category: Column) -> Column:
    """Category key of a feature whose sign is in no group."""
    return F.when(category == "tourist-sign", "tourist").when(category == "traffic-sign-abbreviation", "other-traffic").otherwise("none")


def with_category(features: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``features`` with ``category_key``: the sign's group if catalogued, whatever the layer, else by layer."""
    grouped = catalogue.where(F.col("grp").isin(GROUPS)).select(F.col("code").alias("sign_id"), "grp")
    return features.join(grouped, "sign_id", "left").withColumn("category_key", F.coalesce("grp", layer_category(F.col("category")))).drop("grp")


def bilingual(catalogue: DataFrame, overrides: DataFrame) -> DataFrame:
    """Both languages of every code known to either side; an override wins per language, even an empty one."""
    o = overrides.select("code", F.col("en").alias("_en"), F.col("zh").alias("_zh"))
    both = catalogue.select("code", "en", "zh").join(o, "code", "full_outer")
    return both.select("code", F.coalesce("_en", "en").alias("en"), F.coalesce("_zh", "zh").alias("zh"))


def description(en: Column, zh: Column, locale: str) -> Column:
    """The text to show: empty texts are skipped; the Chinese locale falls back to English."""
    en, zh = F.nullif(en, F.lit("")), F.nullif(zh, F.lit(""))
    return F.coalesce(zh, en) if locale == "zh-HK" else en


def normalised_descriptions(raw: DataFrame) -> DataFrame:
    """code, en, zh from a JSON ``desc`` that is a plain English string or an object of both."""
    obj = F.from_json("desc", "en string, zh string")
    plain = F.when(F.col("desc").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "desc", F.lit("}")), "v string")["v"])
    return raw.select("code", F.coalesce(plain, obj["en"]).alias("en"), F.when(~F.col("desc").startswith('"'), obj["zh"]).alias("zh"))


def codes_by(catalogue: DataFrame, key: str) -> DataFrame:
    """Codes of each tier or group in catalogue order."""
    listed = F.sort_array(F.collect_list(F.struct("ord", "code")))
    return catalogue.groupBy(key).agg(F.transform(listed, lambda r: r["code"]).alias("codes"))


def picture_tier(w: Column, h: Column) -> Column:
    """Tier of a picture: long ones 2; longish or large ones 1; others 0."""
    aspect = w / h
    return F.when((aspect > 1.7) | (aspect < 0.58), 2).when((aspect > 1.25) | (aspect < 0.8) | (F.greatest(w, h) > 320), 1).otherwise(0)


def plate_codes(coverage: DataFrame) -> DataFrame:
    """Codes whose picture is a plate: a finite mean coverage at or over the threshold, in order."""
    c = F.col("coverage")
    return coverage.where(c.isNotNull() & ~F.isnan(c) & (c >= PLATE_COVERAGE)).select("code").orderBy("code")


def mean_coverage(pixels: DataFrame) -> DataFrame:
    """code and coverage: the mean alpha of each picture's pixels."""
    return pixels.groupBy("code").agg(F.avg("alpha").alias("coverage"))


def picture_requests(features: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct catalogued codes that features show, with the path of their picture."""
    stacked = F.max(F.col("stack_index").isNotNull().cast("int"))
    used = features.where("sign_id is not null").groupBy("sign_id").agg(stacked.alias("_s"))
    known = used.join(catalogue.select(F.col("code").alias("sign_id")), "sign_id", "left_semi")
    return known.select("sign_id", F.concat(F.when(F.col("_s") == 1, "signs-stacked/").otherwise("signs/"), "sign_id", F.lit(".png")).alias("path"))


def with_picture(catalogue: DataFrame, pictures: DataFrame) -> DataFrame:
    """Catalogue rows whose code has a picture in ``pictures(code)``."""
    return catalogue.join(pictures.select("code"), "code", "left_semi")


def picture_counts(catalogue: DataFrame, pictures: DataFrame) -> DataFrame:
    """How many catalogued codes have a picture, and how many miss one: columns present and missing."""
    flagged = catalogue.select("code").join(pictures.select("code", F.lit(1).alias("_p")).distinct(), "code", "left")
    return flagged.agg(F.count("_p").alias("present"), (F.count("*") - F.count("_p")).alias("missing"))
