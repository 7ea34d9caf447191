"""Fixed schemas of every table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES: dict[str, DataType] = {
    "bigint": LongType(),
    "double": DoubleType(),
    "int": IntegerType(),
    "string": StringType(),
    "timestamp_ntz": TimestampNTZType(),
}


def _schema(columns: str) -> StructType:
    """'name type, ...' as a schema; unlike DDL parsing this needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_EVENTS = _schema(
    "event_time timestamp_ntz, event_type string, product_id bigint, category_code string, "
    "brand string, price string, user_id bigint, user_session string"
)

SESSIONS = _schema(
    "user_session string, user_id bigint, views bigint, carts bigint, removes bigint, "
    "purchases bigint, gross_revenue double, max_price double, category_top string, brand string, "
    "hour int, is_weekend int, week_num int, session_start timestamp_ntz, converted int, "
    "cart_abandon int, price_bucket string, total_sessions bigint, is_new_user int, user_type string"
)

TREATED_SESSIONS = StructType(
    SESSIONS.fields
    + _schema(
        "ab_group string, discount_applied double, net_revenue double, coupon_triggered int"
    ).fields
)

AB_RESULTS = _schema(
    "ab_group string, sessions bigint, conversions bigint, conversion_rate double, "
    "gross_revenue double, discount_cost double, net_revenue double, revenue_per_session double, "
    "avg_order_value double, conv_lift_pct double, rev_change_pct double, p_value double, "
    "is_significant int, profit_pass int"
)

SEGMENT_RESULTS = _schema(
    "category_top string, ab_group string, sessions bigint, conversions bigint, "
    "gross_revenue double, discount_cost double, net_revenue double, conversion_rate double, "
    "revenue_per_session double, segment_type string, price_bucket string, user_type string"
)

PROFIT_IMPACT = _schema(
    "category_top string, ab_group string, sessions bigint, conversions bigint, "
    "gross_revenue double, discount_cost double, net_revenue_b double, conversion_rate_b double, "
    "revenue_per_session double, segment_type string, price_bucket string, user_type string, "
    "net_revenue_a double, conversion_rate_a double, incremental_net_revenue double, "
    "conv_lift_pp double, net_profit_impact double, verdict string"
)

# Texts of a session's first event, the only columns that no KPI depends on and the costly ones.
FIRST_TEXTS = ("category_top", "brand")

# Table name -> schema. `sessions` is the treated table, the one that reports read.
TABLES: dict[str, StructType] = {
    "sessions": TREATED_SESSIONS,
    "ab_results": AB_RESULTS,
    "segment_results": SEGMENT_RESULTS,
    "profit_impact": PROFIT_IMPACT,
}

# The narrow 12-column form of the profit table, as declared rather than as produced.
PROFIT_IMPACT_DECLARED = _schema(
    "segment_type string, category_top string, price_bucket string, user_type string, sessions bigint, "
    "net_revenue_b double, net_revenue_a double, discount_cost double, incremental_net_revenue double, "
    "conv_lift_pp double, net_profit_impact double, verdict string"
)

# Columns with a declared default.
DEFAULTS: dict[str, float] = {
    "views": 0,
    "carts": 0,
    "removes": 0,
    "purchases": 0,
    "gross_revenue": 0.0,
    "max_price": 0.0,
    "discount_applied": 0.0,
    "net_revenue": 0.0,
}


def for_ids(schema: StructType, df: DataFrame) -> StructType:
    """The schema with the user ids of `df`: whole numbers as declared, or texts."""
    text = "user_id" in df.columns and isinstance(df.schema["user_id"].dataType, StringType)
    return StructType([StructField(f.name, StringType()) if text and f.name == "user_id" else f for f in schema.fields])


def conform(df: DataFrame, schema: StructType, optional: Sequence[str] = ()) -> DataFrame:
    """Project `df` to the columns, order and types of `schema`; `optional` columns may be absent. Text ids stay."""
    fields = [f for f in for_ids(schema, df).fields if f.name in df.columns or f.name not in optional]
    return df.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in fields])


def apply_defaults(df: DataFrame) -> DataFrame:
    """Fill missing values of the columns that declare a default."""
    return df.fillna({name: value for name, value in DEFAULTS.items() if name in df.columns})
