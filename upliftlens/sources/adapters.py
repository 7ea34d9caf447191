"""The benchmark's tables seen as raw event logs.

Two sources: a click log (`events`) with many small sessions spread over the day, and order lines
(`lineitem`, `orders`, `part`) with several events per session and prices in every bucket. Both read
their tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns beyond the raw schema that put events of equal time in order.
TIE_BREAKERS = {
    "events": ("event_id",),
    "orders": ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"),
    "dirty": ("event_id",),
}


# Source -> the tables that it reads
INPUTS = {"events": ("events",), "orders": ("lineitem", "orders", "part"), "dirty": ("events",)}


# The columns read, with their types; a fixed schema saves a look into the files while planning.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, "
    "l_extendedprice double, l_discount double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_type string, p_name string, p_brand string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts, kind = F.col("k"), F.col("ts"), F.col("event_type")
    day = F.dayofyear(ts)
    category = (
        F.when(k % 7 == 0, F.lit(None))
        .when(k % 7 == 1, "Electronics.smartphone")
        .when(k % 7 == 2, "appliances.kitchen.mixer")
        .when(k % 7 == 3, "stationery")
        .when(k % 7 == 4, "furniture.living_room")
        .otherwise("apparel.shoes")
    )
    brand = (
        F.when(k % 5 == 0, F.lit(None))
        .when(k % 5 == 1, " Acme ")
        .otherwise(F.concat(F.lit("Brand"), (k % 5).cast("string")))
    )
    product = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return (
        _table(spark, sf_dir, "events")
        .withColumn("k", product)
        .select(
            ts.alias("event_time"),
            F.when(kind == "click", "cart")
            .when(kind == "error", "remove_from_cart")
            .otherwise(kind)
            .alias("event_type"),
            k.alias("product_id"),
            category.alias("category_code"),
            brand.alias("brand"),
            F.col("value").alias("price"),
            (F.col("user_id") * 1000 + day).alias("user_id"),  # a user-day, so that new users exist
            F.concat_ws(
                "-",
                F.col("user_id").cast("string"),
                day.cast("string"),
                F.floor(F.hour(ts) / 6).cast("string"),
            ).alias("user_session"),
            "event_id",
        )
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, parts = (_table(spark, sf_dir, name) for name in ("lineitem", "orders", "part"))
    flag = F.col("l_returnflag")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("o_orderdate").alias("event_time"),
            F.when(flag == "R", "purchase").when(flag == "A", "cart").otherwise("view").alias("event_type"),
            F.col("l_partkey").alias("product_id"),
            F.concat("p_type", F.lit("."), "p_name").alias("category_code"),
            F.col("p_brand").alias("brand"),
            (F.col("l_extendedprice") * F.col("l_discount") / 10).alias("price"),
            # a customer-year, so that new users exist
            (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("user_id"),
            F.col("o_orderkey").cast("string").alias("user_session"),
            *TIE_BREAKERS["orders"],
        )
    )


def from_dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click log with gaps in the columns that an event needs, by event."""
    gaps = {"user_id": 17, "user_session": 19, "event_type": 23, "event_time": 29}
    return from_events(spark, sf_dir).withColumns(
        {c: F.when(F.col("event_id") % n != 0, F.col(c)) for c, n in gaps.items()}
    )


SOURCES = {"events": from_events, "orders": from_orders, "dirty": from_dirty_events}
