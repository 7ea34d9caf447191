"""The fourteen reports. Each takes one table and returns an ordered result.

Session reports aggregate in a single pass. Rounding is half up in decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.functions.numbers import (
    money_rounded,
    money_sum,
    money_value,
    ratio_or_null,
    rounded_money,
    rounded_ratio,
)
from upliftlens.operators.segments import SEGMENT_KEY


def _count() -> Column:
    return F.count(F.lit(1))


def _percent(num: Column, den: Column, places: int = 2) -> Column:
    return rounded_ratio(ratio_or_null(num, den) * 100, places)


def _money(column: str, places: int = 2) -> Column:
    return money_rounded(money_sum(F.col(column)), places)


# --- over ab_results ------------------------------------------------------------------------------


def report_kpi_summary(ab_results: DataFrame) -> DataFrame:
    """A-1: the KPI table for display."""

    def flag(column: str, yes: str, no: str) -> Column:
        return F.when(F.col(column) == 1, yes).otherwise(no)

    return ab_results.select(
        "ab_group",
        "sessions",
        "conversions",
        rounded_ratio(F.col("conversion_rate") * 100, 2).alias("conversion_rate_pct"),
        rounded_money(F.col("gross_revenue")).alias("gross_revenue"),
        rounded_money(F.col("discount_cost")).alias("coupon_cost"),
        rounded_money(F.col("net_revenue")).alias("net_revenue"),
        rounded_ratio(F.col("revenue_per_session"), 2).alias("revenue_per_session"),
        rounded_ratio(F.col("avg_order_value"), 2).alias("avg_order_value"),
        rounded_ratio(F.col("conv_lift_pct"), 2).alias("conversion_lift_pct"),
        rounded_ratio(F.col("rev_change_pct"), 2).alias("net_revenue_change_pct"),
        rounded_ratio(F.col("p_value"), 4).alias("p_value"),
        flag("is_significant", "YES", "NO").alias("statistically_significant"),
        flag("profit_pass", "PASS", "FAIL").alias("profit_guardrail"),
    ).orderBy("ab_group")


# --- over treated sessions ------------------------------------------------------------------------


def report_lift(sessions: DataFrame) -> DataFrame:
    """A-2: both groups side by side; the inputs are rounded before they are compared."""

    def inside(group: str, column: str) -> Column:
        return F.when(F.col("ab_group") == group, F.col(column))

    totals = []
    for g in ("A", "B"):
        n = F.count_if(F.col("ab_group") == g)
        totals += [
            _percent(F.sum(inside(g, "converted")), n, 4).alias(f"rate_{g}"),
            money_rounded(money_sum(inside(g, "net_revenue"))).alias(f"net_{g}"),
        ]
    totals.append(money_rounded(money_sum(inside("B", "discount_applied"))).alias("coupon"))
    rate_a, rate_b = F.col("rate_A"), F.col("rate_B")
    gain = F.col("net_B") - F.col("net_A")
    return (
        sessions.agg(*totals)
        # like a join of the two groups: no row unless both have sessions
        .filter(F.col("net_A").isNotNull() & F.col("net_B").isNotNull())
        .select(
            rate_b.alias("group_b_cr"),
            rate_a.alias("group_a_cr"),
            rounded_ratio(rate_b - rate_a, 4).alias("absolute_lift_pp"),
            _percent(rate_b - rate_a, rate_a).alias("relative_lift_pct"),
            rounded_money(gain).alias("incremental_net_revenue"),
            F.col("coupon").alias("total_coupon_spend"),
            rounded_money(gain - F.col("coupon")).alias("true_roi"),
        )
    )


def report_funnel(sessions: DataFrame) -> DataFrame:
    """A-3: views, carts and purchases per group. Percentages may exceed 100."""
    views, carts, purchases = F.sum("views"), F.sum("carts"), F.sum("purchases")
    return sessions.groupBy("ab_group").agg(
        F.count_distinct("user_session").alias("total_sessions"),
        views.alias("total_views"),
        carts.alias("total_carts"),
        purchases.alias("total_purchases"),
        _percent(carts, views).alias("view_to_cart_pct"),
        _percent(purchases, carts).alias("cart_to_purchase_pct"),
        _percent(F.sum("cart_abandon"), carts).alias("cart_abandonment_pct"),
        _percent(F.sum("converted"), _count()).alias("overall_conversion_pct"),
    )


def _by_group_and(sessions: DataFrame, key: str, *more: Column) -> DataFrame:
    converted = F.sum("converted")
    return sessions.groupBy("ab_group", key).agg(
        _count().alias("sessions"),
        converted.alias("conversions"),
        _percent(converted, _count()).alias("conversion_rate_pct"),
        _money("net_revenue").alias("net_revenue"),
        *more,
    )


def report_user_type(sessions: DataFrame) -> DataFrame:
    """A-4: new against returning users."""
    net = money_value(money_sum(F.col("net_revenue")))
    per_session = rounded_ratio(ratio_or_null(net, _count()), 2)
    return _by_group_and(
        sessions,
        "user_type",
        _money("discount_applied").alias("coupon_cost"),
        per_session.alias("revenue_per_session"),
    ).orderBy("ab_group", "user_type")


def report_cart_abandon(sessions: DataFrame) -> DataFrame:
    """A-5: sessions that left a cart behind."""
    return _by_group_and(sessions, "cart_abandon").orderBy("ab_group", F.desc("cart_abandon"))


def report_hourly(sessions: DataFrame) -> DataFrame:
    """A-6: conversion by hour of day."""
    return _by_group_and(sessions, "hour").orderBy("ab_group", "hour")


def report_weekend(sessions: DataFrame) -> DataFrame:
    """A-7: weekend against weekday."""
    day_type = F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday")
    return (
        _by_group_and(sessions, "is_weekend")
        .orderBy("ab_group", "is_weekend")
        .withColumn("is_weekend", day_type)
        .withColumnRenamed("is_weekend", "day_type")
    )


# --- over profit_impact ---------------------------------------------------------------------------


def _mean_lift() -> Column:
    return rounded_ratio(F.avg("conv_lift_pp"), 2)


def report_profit_category(profit_impact: DataFrame) -> DataFrame:
    """B-1: profit impact per product category."""
    return (
        profit_impact.filter(F.col("segment_type") == "category_top")
        .groupBy("category_top", "verdict")
        .agg(
            _count().alias("segment_count"),
            _money("net_profit_impact").alias("total_profit_impact"),
            _mean_lift().alias("avg_conv_lift_pp"),
            _money("discount_cost").alias("total_coupon_spend"),
        )
        .orderBy(F.desc("total_profit_impact"))
    )


def report_profit_price(profit_impact: DataFrame) -> DataFrame:
    """B-2: return per price bucket."""
    return (
        profit_impact.filter(F.col("segment_type") == "price_bucket")
        .groupBy("price_bucket", "verdict")
        .agg(
            _mean_lift().alias("avg_conversion_lift_pp"),
            _money("incremental_net_revenue").alias("incremental_revenue"),
            _money("discount_cost").alias("coupon_spend"),
            _money("net_profit_impact").alias("net_roi"),
        )
        .select(
            "price_bucket",
            "avg_conversion_lift_pp",
            "incremental_revenue",
            "coupon_spend",
            "net_roi",
            "verdict",
        )
        .orderBy(F.desc("net_roi"))
    )


def report_cross(profit_impact: DataFrame) -> DataFrame:
    """B-3: category by price bucket, worst first (segments without control lead)."""
    return (
        profit_impact.filter(F.col("segment_type") == "category_top+price_bucket")
        .orderBy(F.asc_nulls_first("net_profit_impact"))
        .select(
            "category_top",
            "price_bucket",
            rounded_ratio(F.col("conv_lift_pp"), 2).alias("conversion_lift_pp"),
            rounded_money(F.col("incremental_net_revenue")).alias("incremental_revenue"),
            rounded_money(F.col("discount_cost")).alias("coupon_cost"),
            rounded_money(F.col("net_profit_impact")).alias("net_roi"),
            "verdict",
        )
    )


def _ranked(profit_impact: DataFrame, verdict: str, order: Column, limit: int) -> DataFrame:
    """The first segments of a verdict; the segment key breaks ties."""
    return (
        profit_impact.filter(F.col("verdict") == verdict)
        .orderBy(order, *SEGMENT_KEY)
        .limit(limit)
        .select(
            *SEGMENT_KEY,
            rounded_ratio(F.col("conv_lift_pp"), 2).alias("conv_lift_pp"),
            rounded_money(F.col("net_profit_impact")).alias("net_roi"),
            "verdict",
        )
    )


def report_top_profitable(profit_impact: DataFrame, limit: int = 10) -> DataFrame:
    """B-4: the most profitable segments."""
    return _ranked(profit_impact, "Profitable", F.desc_nulls_last("net_profit_impact"), limit)


def report_top_loss(profit_impact: DataFrame, limit: int = 10) -> DataFrame:
    """B-5: the segments that lose most; those without control come first."""
    return _ranked(profit_impact, "Loss", F.asc_nulls_first("net_profit_impact"), limit)


def report_user_type_profit(profit_impact: DataFrame) -> DataFrame:
    """B-6: profit of new and returning users."""
    return (
        profit_impact.filter(F.col("user_type").isNotNull())
        .groupBy("user_type")
        .agg(
            _mean_lift().alias("avg_conv_lift_pp"),
            _money("incremental_net_revenue").alias("total_incremental_rev"),
            _money("discount_cost").alias("total_coupon_spend"),
            _money("net_profit_impact").alias("total_net_roi"),
            _percent(F.count_if(F.col("verdict") == "Profitable"), _count(), 1).alias(
                "profitable_segment_pct"
            ),
        )
        .orderBy(F.desc("total_net_roi"))
    )


def report_recommendation(profit_impact: DataFrame) -> DataFrame:
    """B-7: seven headline figures from one pass. The segment types overlap: money is counted once per type."""

    def verdicts(name: str) -> Column:
        return F.count_if(F.col("verdict") == name)

    # The labels of the published report.
    figures = {
        "Total Segments Analysed": _count(),
        "Profitable Segments": verdicts("Profitable"),
        "Break-Even Segments": verdicts("Break-Even"),
        "Loss-Making Segments": verdicts("Loss"),
        "Total Coupon Spend ($)": _money("discount_cost"),
        "Net ROI ($)": _money("net_profit_impact"),
        "Avg Conv Lift (pp)": _mean_lift(),
    }
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
            for name, value in figures.items()
        ]
    )
    return profit_impact.agg(rows.alias("rows")).select(F.inline("rows"))


# Report name -> (table it reads, function)
REPORTS = {
    "report_kpi_summary": ("ab_results", report_kpi_summary),
    "report_lift": ("sessions", report_lift),
    "report_funnel": ("sessions", report_funnel),
    "report_user_type": ("sessions", report_user_type),
    "report_cart_abandon": ("sessions", report_cart_abandon),
    "report_hourly": ("sessions", report_hourly),
    "report_weekend": ("sessions", report_weekend),
    "report_profit_category": ("profit_impact", report_profit_category),
    "report_profit_price": ("profit_impact", report_profit_price),
    "report_cross": ("profit_impact", report_cross),
    "report_top_profitable": ("profit_impact", report_top_profitable),
    "report_top_loss": ("profit_impact", report_top_loss),
    "report_user_type_profit": ("profit_impact", report_user_type_profit),
    "report_recommendation": ("profit_impact", report_recommendation),
}
