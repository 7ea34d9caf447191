"""Prices, guarded ratios, exact money sums and rounding.

Sums of doubles depend on the order of addition, so a distributed sum would differ from run to run.
Money is therefore summed exactly, as whole millionths in a DECIMAL. An amount that does not fit
(infinite, or at least 10^11) is kept too: it goes to a separate double sum and is added at the end.
"""

from __future__ import annotations

from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from upliftlens.config import DEFAULT, ExperimentConfig

MILLION = 1e6
LARGEST_EXACT = 1e11

# Plain and exponent notation or an infinity. A bare cast also takes Java suffixes such as '1d'.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def coerce_price(col: Column, dtype: DataType) -> Column:
    """A price as a double: 0 when missing or not a number, never negative."""
    if isinstance(dtype, StringType):
        value = F.when(col.rlike(NUMBER), col.try_cast("double"))
    else:
        value = col.cast("double")
    number = F.nanvl(value, F.lit(0.0))
    return F.greatest(F.coalesce(number, F.lit(0.0)), F.lit(0.0))


def price_bucket(price: Column, cfg: ExperimentConfig = DEFAULT) -> Column:
    """Label of the interval (low, high] that holds the price."""
    bucket = None
    for low, high, label in zip(cfg.price_bins, cfg.price_bins[1:], cfg.price_labels):
        inside = price > low if high == inf else (price > low) & (price <= high)
        bucket = F.when(inside, label) if bucket is None else bucket.when(inside, label)
    return bucket.otherwise(cfg.no_bucket_label)


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def ratio_or_null(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def money_sum(amount: Column) -> Column:
    """Aggregate amounts to a struct with an exact part, in millionths, and the part that does not fit it.

    Millionths come from a long: casting the double itself to DECIMAL would go through text.
    """
    fits = F.abs(amount) < LARGEST_EXACT
    millionths = F.rint(amount * MILLION).cast("bigint").cast("decimal(18,0)")
    return F.struct(
        F.sum(F.when(fits, millionths)).alias("exact"), F.sum(F.when(~fits, amount)).alias("rest")
    )


def money_merge(part: Column) -> Column:
    """Aggregate the structs of `money_sum` further."""
    return F.struct(F.sum(part["exact"]).alias("exact"), F.sum(part["rest"]).alias("rest"))


def money_value(total: Column) -> Column:
    """The struct of `money_sum` as a double; 0 when nothing was summed."""
    zero = F.lit(0.0)
    exact = total["exact"].cast("double") / MILLION
    return F.coalesce(exact, zero) + F.coalesce(total["rest"], zero)


def money_rounded(total: Column, places: int = 2) -> Column:
    """The struct of `money_sum` rounded half up, NULL when nothing was summed."""
    exact = F.round(total["exact"] * F.lit("0.000001").cast("decimal(6,6)"), places).cast("double")
    both = F.round(money_value(total), places)
    return F.when(total["rest"].isNull(), exact).otherwise(both)


def rounded_money(amount: Column, places: int = 2) -> Column:
    """A money amount rounded half up in decimal arithmetic."""
    return _rounded(amount, places, "decimal(28,6)")


def rounded_ratio(ratio: Column, places: int) -> Column:
    """A rate or percentage rounded half up in decimal arithmetic."""
    return _rounded(ratio, places, "decimal(28,10)")


def _rounded(value: Column, places: int, dtype: str) -> Column:
    exact = F.round(value.try_cast(dtype), places).cast("double")
    return F.coalesce(exact, F.round(value, places))
