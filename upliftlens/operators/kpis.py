"""Group KPIs, the significance test and the profit guardrail.

Everything follows from one pass that folds the sessions into a single row with a set of totals per
group; comparing the groups is then plain column arithmetic, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens import schemas
from upliftlens.config import DEFAULT, ExperimentConfig
from upliftlens.functions.numbers import money_sum, money_value, ratio_or_null, ratio_or_zero
from upliftlens.functions.statistics import (
    log10_two_sided_p,
    significant,
    two_proportion_z,
    two_sided_p,
    two_sided_p_tail,
)
from upliftlens.operators.assignment import GROUPS

MONEY_MEASURES = {
    "gross_revenue": "gross_revenue",
    "discount_cost": "discount_applied",
    "net_revenue": "net_revenue",
}


def _totals(treated: DataFrame) -> DataFrame:
    """One row with the columns `a` and `b`, each a struct of totals."""
    structs = []
    for name in GROUPS:
        inside = F.col("ab_group") == name
        structs.append(
            F.struct(
                F.count_if(inside).alias("sessions"),
                F.coalesce(F.sum(F.when(inside, F.col("converted"))), F.lit(0)).alias("conversions"),
                *[
                    money_value(money_sum(F.when(inside, F.col(source)))).alias(measure)
                    for measure, source in MONEY_MEASURES.items()
                ],
            ).alias(name.lower())
        )
    return treated.agg(*structs)


def _kpis(group: str) -> Column:
    t = F.col(group.lower())
    return F.struct(
        F.lit(group).alias("ab_group"),
        t["sessions"].alias("sessions"),
        t["conversions"].alias("conversions"),
        ratio_or_zero(t["conversions"], t["sessions"]).alias("conversion_rate"),
        t["gross_revenue"].alias("gross_revenue"),
        t["discount_cost"].alias("discount_cost"),
        t["net_revenue"].alias("net_revenue"),
        ratio_or_zero(t["net_revenue"], t["sessions"]).alias("revenue_per_session"),
        ratio_or_zero(t["gross_revenue"], t["conversions"]).alias("avg_order_value"),
    )


def _z(a: Column, b: Column) -> Column:
    return two_proportion_z(a["sessions"], a["conversions"], b["sessions"], b["conversions"])


def _one_row_of_kpis(treated: DataFrame) -> DataFrame:
    return _totals(treated).select(_kpis("A").alias("a"), _kpis("B").alias("b"))


def group_kpis(treated: DataFrame) -> DataFrame:
    """Two rows, A and B, also when a group is empty."""
    return _one_row_of_kpis(treated).select(F.inline(F.array("a", "b")))


def z_test(treated: DataFrame, cfg: ExperimentConfig = DEFAULT) -> DataFrame:
    """One row: the two-proportion z-test of the conversion rates."""
    a, b = F.col("a"), F.col("b")
    z, p = F.col("z"), F.col("p_value")
    return (
        _totals(treated)
        .select(
            a["sessions"].alias("n_a"),
            a["conversions"].alias("conversions_a"),
            b["sessions"].alias("n_b"),
            b["conversions"].alias("conversions_b"),
            _z(a, b).alias("z"),
        )
        .withColumn("p_value", two_sided_p(z))
        .withColumn("p_value_tail", two_sided_p_tail(z))
        .withColumn("log10_p", log10_two_sided_p(z))
        .withColumn("is_significant", significant(p, cfg.confidence_level))
    )


def compare(kpis: DataFrame, cfg: ExperimentConfig = DEFAULT) -> DataFrame:
    """Add lift, revenue change, p-value and guardrail to one row with the KPI structs `a` and `b`."""
    a, b = F.col("a"), F.col("b")
    lift = ratio_or_null(b["conversion_rate"] - a["conversion_rate"], a["conversion_rate"]) * 100
    change = ratio_or_zero(b["net_revenue"] - a["net_revenue"], a["net_revenue"]) * 100
    # z has a name before the p-value uses it many times
    named = kpis.withColumns({"conv_lift_pct": lift, "rev_change_pct": change, "z": _z(a, b)})
    return named.withColumns(
        {
            "p_value": two_sided_p(F.col("z")),
            "profit_pass": (b["net_revenue"] >= a["net_revenue"]).cast("int"),
        }
    ).withColumn("is_significant", significant(F.col("p_value"), cfg.confidence_level))


def ab_results(treated: DataFrame, cfg: ExperimentConfig = DEFAULT) -> DataFrame:
    """The KPI table: one row per group, each with the comparison of both."""
    summary = ["conv_lift_pct", "rev_change_pct", "p_value", "is_significant", "profit_pass"]
    both = compare(_one_row_of_kpis(treated), cfg)
    rows = both.select(F.explode(F.array("a", "b")).alias("kpi"), *summary)
    return schemas.conform(rows.select("kpi.*", *summary), schemas.AB_RESULTS)


def guardrail_report(treated: DataFrame, cfg: ExperimentConfig = DEFAULT) -> DataFrame:
    """One row: does the treatment pay, and what to do if it does not."""
    passed = F.col("profit_pass") == 1
    return compare(_one_row_of_kpis(treated), cfg).select(
        F.col("a.net_revenue").alias("net_revenue_a"),
        F.col("b.net_revenue").alias("net_revenue_b"),
        F.col("b.discount_cost").alias("discount_cost"),
        "conv_lift_pct",
        "rev_change_pct",
        "is_significant",
        "profit_pass",
        F.when(passed, "PASS").otherwise("FAIL").alias("guardrail"),
        F.when(~passed, "DO NOT launch globally: look for profitable segments first").alias(
            "recommendation"
        ),
    )
