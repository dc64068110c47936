"""Text, date and JSON helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Trimmed text; blank text is null."""
    return F.nullif(F.trim(c), F.lit(""))


def empty_to_null(c: Column) -> Column:
    """Text as it is; only the empty string is null."""
    return F.nullif(c.cast("string"), F.lit(""))


def packed_date(c: Column) -> Column:
    """``YYYY-MM-DD`` of ``YYYYMMDD[hhmmss]``; null if shorter than a date."""
    s = c.cast("string")
    return F.when(F.length(s) >= 8, F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"), F.substring(s, 7, 2)))


def id_query(c: Column) -> Column:
    """A search text as an identifier (letters then digits, separators dropped), or null."""
    cleaned = F.upper(F.regexp_replace(c, r"[\s_-]+", ""))
    return F.when(cleaned.rlike(r"^[A-Z]{1,4}[0-9]+$"), cleaned)


def unspaced(c: Column) -> Column:
    r"""Text without the characters of ``\s``."""
    return F.translate(c, " \t\n\x0b\f\r", "")


def code_number(c: Column) -> Column:
    """Number of a code of two to four digits with an optional letter; null for anything else."""
    cleaned = F.upper(unspaced(c))
    return empty_to_null(F.regexp_extract(cleaned, r"^([0-9]{2,4})[A-Z]?$", 1)).try_cast("int")  # a cast that fails costs an exception


def bracketed_json(c: Column, schema: str) -> Column:
    """The array between the first and last bracket of a text, parsed; null if there is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), schema)
