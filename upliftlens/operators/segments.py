"""Segment KPIs, profit impact and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens import schemas
from upliftlens.config import DEFAULT, ExperimentConfig
from upliftlens.functions.numbers import money_merge, money_sum, money_value
from upliftlens.operators.kpis import MONEY_MEASURES

DIMENSIONS = ("category_top", "price_bucket", "user_type")

# The segment types of the segment table.
SEGMENTS: tuple[tuple[str, ...], ...] = (
    ("category_top",),
    ("price_bucket",),
    ("user_type",),
    ("category_top", "price_bucket"),
)

SEGMENT_KEY = ("segment_type", *DIMENSIONS)


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("sessions"),
        F.sum("converted").alias("conversions"),
        *[money_sum(F.col(source)).alias(name) for name, source in MONEY_MEASURES.items()],
    ]


def _finish(totals: DataFrame) -> DataFrame:
    """Money structs to doubles, plus the two ratios."""
    return totals.withColumns({m: money_value(F.col(m)) for m in MONEY_MEASURES}).withColumns(
        {
            "conversion_rate": F.col("conversions") / F.col("sessions"),
            "revenue_per_session": F.col("net_revenue") / F.col("sessions"),
        }
    )


def segment_kpis(treated: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """KPIs per combination of any grouping columns, one row per A/B group."""
    totals = treated.groupBy(*group_cols, "ab_group").agg(*_measures())
    return _finish(totals).withColumn("segment_type", F.lit("+".join(group_cols)))


def segment_results(treated: DataFrame) -> DataFrame:
    """The four segment types in one table; dimensions outside a segment's type are NULL.

    Every measure adds up, so the sessions are aggregated once to the finest cube and the grouping
    sets expand only its rows, not the sessions.
    """
    cube = treated.groupBy(*DIMENSIONS, "ab_group").agg(*_measures())
    absent = [F.grouping(d).alias(f"no_{d}") for d in DIMENSIONS]
    sets = cube.groupingSets(
        [[*cols, "ab_group"] for cols in SEGMENTS], *DIMENSIONS, "ab_group"
    ).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("conversions").alias("conversions"),
        *[money_merge(F.col(m)).alias(m) for m in MONEY_MEASURES],
        *absent,
    )
    label = F.concat_ws("+", *[F.when(F.col(f"no_{d}") == 0, F.lit(d)) for d in DIMENSIONS])
    rows = _finish(sets).withColumn("segment_type", label)
    return schemas.conform(rows, schemas.SEGMENT_RESULTS)


def verdict(impact: Column, cfg: ExperimentConfig = DEFAULT) -> Column:
    """An unknown impact (no control sessions to compare with) counts as a loss."""
    return (
        F.when(impact > 0, "Profitable")
        .when(impact >= cfg.break_even_floor, "Break-Even")
        .otherwise("Loss")
    )


def profit_impact(segments: DataFrame, cfg: ExperimentConfig = DEFAULT) -> DataFrame:
    """One row per segment that has treated sessions, next to its control segment.

    The segment table holds one row per segment and group, and grouping takes NULL keys as equal, so
    the two rows of a segment meet in a group: no join is needed. Values of a missing control are NULL.
    """

    def of(group: str, measure: str) -> Column:
        return F.max(F.when(F.col("ab_group") == group, F.col(measure)))

    treated_side = [
        "sessions",
        "conversions",
        "gross_revenue",
        "discount_cost",
        "net_revenue",
        "conversion_rate",
        "revenue_per_session",
    ]
    compared = ("net_revenue", "conversion_rate")
    rows = (
        segments.groupBy(*SEGMENT_KEY)
        .agg(
            *[of("B", m).alias(f"{m}_b" if m in compared else m) for m in treated_side],
            *[of("A", m).alias(f"{m}_a") for m in compared],
        )
        .filter(F.col("sessions").isNotNull())
        .withColumns(
            {
                "ab_group": F.lit("B"),
                "incremental_net_revenue": F.col("net_revenue_b") - F.col("net_revenue_a"),
                "conv_lift_pp": (F.col("conversion_rate_b") - F.col("conversion_rate_a")) * 100,
            }
        )
        .withColumn("net_profit_impact", F.col("incremental_net_revenue") - F.col("discount_cost"))
        .withColumn("verdict", verdict(F.col("net_profit_impact"), cfg))
    )
    return schemas.conform(rows, schemas.PROFIT_IMPACT)


def verdict_counts(impact: DataFrame) -> DataFrame:
    """Segments per verdict, verdicts without segments included."""
    names = ("Profitable", "Break-Even", "Loss")
    counted = impact.agg(
        F.array(
            *[
                F.struct(
                    F.lit(v).alias("verdict"), F.count_if(F.col("verdict") == v).alias("segments")
                )
                for v in names
            ]
        ).alias("rows")
    )
    return counted.select(F.inline("rows"))
