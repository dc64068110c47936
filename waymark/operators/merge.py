"""Catalogue merges: additive descriptions, staged additions and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.hits import first_by


def merge_descriptions(catalogue: DataFrame, found: DataFrame, overwrite: bool = False) -> DataFrame:
    """``catalogue`` with found texts filled in; present ones change only with ``overwrite``; unknown codes are ignored.

    Of texts found twice for a code the first counts: by ``ord`` where ``found`` has it, else the least text.
    """
    found = first_by(found, F.col("code"), *(["ord"] if "ord" in found.columns else ["en", "zh"]))
    j = catalogue.join(found.select("code", F.col("en").alias("_en"), F.col("zh").alias("_zh")), "code", "left")
    for c in ("en", "zh"):
        j = j.withColumn(c, F.coalesce(f"_{c}", c) if overwrite else F.coalesce(c, f"_{c}"))
    return j.select(*catalogue.columns)


def promote(catalogue: DataFrame, staged: DataFrame, rejects: DataFrame, wipe: bool = False) -> DataFrame:
    """``catalogue`` with staged rows that aren't rejected added; staged ones replace rows of their code.

    ``staged`` has the catalogue's columns; of repeated codes the first by ord
    counts.  With ``wipe`` only staged rows are left.
    """
    added = first_by(staged.join(rejects.select("code"), "code", "left_anti"), F.col("code"), "ord").select(*catalogue.columns)
    if wipe:
        return added
    return catalogue.join(added.select("code"), "code", "left_anti").select(*catalogue.columns).unionByName(added)


def new_codes(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """Found rows whose code the catalogue lacks, each once."""
    return first_by(found.join(catalogue.select("code"), "code", "left_anti"), F.col("code"), "ord")


def write_staged(staged: DataFrame, path: str) -> None:
    """Write candidates for review as JSON lines, a folder for each ``sheet``; ``promote`` takes them when they are read again."""
    staged.write.partitionBy("sheet").json(path)


def sheets_named(sheets: DataFrame, part: str) -> DataFrame:
    """Sheets whose file holds ``part``; none is an error."""
    own = sheets.where(F.col("pdf").contains(part))
    if own.isEmpty():
        raise ValueError(f"no sheet named {part}")
    return own
