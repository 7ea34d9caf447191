"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# Texts a CSV reader takes as missing.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Every Unicode white-space character; Spark's plain trim removes the space only.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def missing_to_null(col: Column) -> Column:
    return F.when(~col.isin(*MISSING_TOKENS), col)


def normalise_brand(col: Column) -> Column:
    return F.btrim(F.lower(F.coalesce(col, F.lit(UNKNOWN))), F.lit(WHITESPACE))


def normalise_category(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit(UNKNOWN)))


def top_level(category: Column) -> Column:
    """Text before the first dot, or the whole text when there is none."""
    return F.substring_index(category, ".", 1)
