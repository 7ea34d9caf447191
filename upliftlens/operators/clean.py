"""Raw events -> clean events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from upliftlens.functions.clock import hour_of_day, is_weekend, iso_week, weekday_name
from upliftlens.functions.numbers import coerce_price
from upliftlens.functions.text import normalise_brand, normalise_category, top_level

# An event without one of these cannot be placed in a session.
REQUIRED = ("user_id", "user_session", "event_type", "event_time")


def _valid() -> Column:
    condition = F.col(REQUIRED[0]).isNotNull()
    for name in REQUIRED[1:]:
        condition = condition & F.col(name).isNotNull()
    return condition


def clean_events(raw: DataFrame) -> DataFrame:
    """Drop events without keys or time, repair prices and texts, add calendar features.

    The conditions are separate IS NOT NULL tests (unlike `dropna`), which reach the scan.
    """
    category = normalise_category(F.col("category_code"))
    ts = F.col("event_time")
    return raw.filter(_valid()).withColumns(
        {
            "price": coerce_price(F.col("price"), raw.schema["price"].dataType),
            "brand": normalise_brand(F.col("brand")),
            "category_code": category,
            "category_top": top_level(category),
            "hour": hour_of_day(ts),
            "weekday": weekday_name(ts),
            "is_weekend": is_weekend(ts),
            "week_num": iso_week(ts),
        }
    )


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(_valid()).alias("rows_after"),
        F.count_if(~_valid()).alias("rows_removed"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in REQUIRED],
    ]


def observe_cleaning(raw: DataFrame, name: str = "cleaning") -> tuple[DataFrame, Observation]:
    """The events with a flag `valid`, and counts that fill in while they are first used, without a second pass."""
    seen = Observation(name)
    return raw.observe(seen, *_counts()).withColumn("valid", _valid()), seen


def clean_metrics(raw: DataFrame) -> DataFrame:
    """One row: events before and after cleaning, and the events that lack each required column."""
    return raw.agg(*_counts())


def observed_metrics(seen: Observation, spark: SparkSession) -> DataFrame:
    """The row of `clean_metrics`, from counts that have been filled in."""
    got = seen.get
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{name} bigint" for name in got))


def rejected_events(raw: DataFrame) -> DataFrame:
    """The events that cleaning drops, with the names of the missing columns."""
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]
    return raw.filter(~_valid()).withColumn("missing", F.concat_ws(",", *missing))
