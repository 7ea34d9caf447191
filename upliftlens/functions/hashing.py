"""Keyed hashing: the same key gives the same bucket under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(user_id: Column, salt: str) -> Column:
    """MD5 of '<user>_<salt>', read as a 128-bit number, modulo 100."""
    digest = F.md5(F.concat(user_id.cast("string"), F.lit(f"_{salt}")))
    # conv handles 64 bits, so each half is reduced alone: the last two decimal digits of a number
    # are the number modulo 100. 2^64 = 16 (mod 100) joins the halves.
    high, low = (
        F.substring(F.conv(F.substring(digest, start, 16), 16, 10), -2, 2).cast("int")
        for start in (1, 17)
    )
    return (high * 16 + low) % 100


def uniform_draw(keys: Sequence[Column], salt: str) -> Column:
    """A number in [0, 1) fixed by the keys and the salt: the first 52 bits of their MD5."""
    digest = F.md5(F.concat_ws("_", *[k.cast("string") for k in keys], F.lit(salt)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def bernoulli(keys: Sequence[Column], salt: str, probability: Column) -> Column:
    """1 with the given probability, else 0; one fixed draw per key."""
    return (uniform_draw(keys, salt) < probability).cast("int")
