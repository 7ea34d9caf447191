"""User ids of any form as text keys, and 128 bits that stand for such a key in a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upliftlens.functions.text import WHITESPACE, missing_to_null


def whole_number(text: Column) -> Column:
    """A BIGINT, also from a form with decimal places that are all zero, such as 12345.0."""
    return F.regexp_replace(F.trim(text), r"\.0*$", "").try_cast("bigint")


def user_key(text: Column) -> Column:
    """The id as one text, however the log writes it: `12345`, ` 12345 ` and `12345.0` are one user.

    Ids that are no whole number keep their text without the white space around it; missing ones are NULL.
    """
    trimmed = missing_to_null(F.btrim(text, F.lit(WHITESPACE)))
    return F.coalesce(whole_number(trimmed).cast("string"), trimmed)


def surrogate(key: Column) -> Column:
    """16 bytes for a key of any length. Whoever groups by them checks that a group has one key: see `only_key`."""
    return F.unhex(F.md5(key))


def turned(key_bytes: Column) -> Column:
    """The same 16 bytes with their halves swapped: as good a key, but another expression."""
    return F.concat(F.substring(key_bytes, 9, 8), F.substring(key_bytes, 1, 8))


def only_key(name: str) -> Column:
    """Aggregate: the key that all rows of a group share. Two keys under one surrogate end the query with an error."""
    low, high = F.min(name), F.max(name)
    clash = F.concat(F.lit(f"two values of {name} share 128 bits: "), low, F.lit(" and "), high)
    return F.when(low == high, low).otherwise(F.raise_error(clash))
