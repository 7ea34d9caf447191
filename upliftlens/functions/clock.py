"""Calendar features of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")  # Monday is 0


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)
