"""What-if effect of a capped coupon on the treatment group."""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.config import DEFAULT, ExperimentConfig
from upliftlens.functions.hashing import bernoulli
from upliftlens.functions.numbers import money_sum, money_value, ratio_or_null
from upliftlens.operators.sessions import SESSION_KEY


def lift_probability(cfg: ExperimentConfig = DEFAULT) -> Column:
    """Chance that a session without purchase buys when offered the coupon."""
    price = F.col("max_price")
    by_price = None
    for limit, factor in cfg.price_multipliers:
        if limit == inf:
            by_price = F.lit(factor) if by_price is None else by_price.otherwise(F.lit(factor))
        elif by_price is None:
            by_price = F.when(price < limit, factor)
        else:
            by_price = by_price.when(price < limit, factor)

    def factor_if(flag: str, factor: float) -> Column:
        return F.when(F.col(flag) == 1, factor).otherwise(1.0)

    chance = (
        F.lit(cfg.base_conversion_lift)
        * by_price
        * factor_if("is_new_user", cfg.new_user_multiplier)
        * factor_if("cart_abandon", cfg.cart_abandon_multiplier)
        * factor_if("is_weekend", cfg.weekend_multiplier)
    )
    return F.least(chance, F.lit(cfg.max_lift_probability))


def hash_bernoulli(
    df: DataFrame, probability: Column, salt: str, name: str, keys: tuple[str, ...] = SESSION_KEY
) -> DataFrame:
    """Add a 0/1 draw per row, fixed by the row's key and the salt."""
    return df.withColumn(name, bernoulli([F.col(k) for k in keys], salt, probability))


def keyed_trigger(cfg: ExperimentConfig = DEFAULT) -> Column:
    """The default response: a keyed draw with the session's lift probability."""
    return bernoulli([F.col(k) for k in SESSION_KEY], cfg.experiment_name, lift_probability(cfg))


def discount(gross: Column, cfg: ExperimentConfig = DEFAULT) -> Column:
    """A share of the order, capped; nothing on orders without value."""
    capped = F.least(F.lit(cfg.max_coupon_value), gross * cfg.max_coupon_pct)
    return F.when(gross > 0, capped).otherwise(0.0)


def apply_treatment(
    assigned: DataFrame, cfg: ExperimentConfig = DEFAULT, trigger: Column | None = None
) -> DataFrame:
    """Let non-buyers of group B respond, then grant the discount to every buyer of group B.

    `trigger` is a 0/1 column expression; pass real redemptions to replace the keyed draw. Cart
    flags and event counts keep their values from before the treatment.
    """
    eligible = (F.col("ab_group") == "B") & (F.col("converted") == 0)
    response = keyed_trigger(cfg) if trigger is None else trigger
    triggered = F.col("coupon_triggered") == 1
    pays = (F.col("ab_group") == "B") & (F.col("converted") == 1)
    granted = F.col("discount_applied")
    net = F.greatest(F.col("gross_revenue") - granted, F.lit(0.0))
    return (
        assigned.withColumn(
            "coupon_triggered", F.when(eligible & (response == 1), 1).otherwise(0)
        )
        .withColumns(
            {
                "converted": F.when(triggered, 1).otherwise(F.col("converted")),
                "purchases": F.when(triggered, F.lit(1).cast("bigint")).otherwise(F.col("purchases")),
                "gross_revenue": F.when(triggered, F.col("max_price")).otherwise(F.col("gross_revenue")),
                # what a session outside the discount keeps
                "net_revenue": F.col("gross_revenue"),
            }
        )
        .withColumn(
            "discount_applied",
            F.when(pays, discount(F.col("gross_revenue"), cfg)).otherwise(0.0),
        )
        .withColumn("net_revenue", F.when(pays, net).otherwise(F.col("net_revenue")))
    )


def treatment_summary(treated: DataFrame) -> DataFrame:
    """One row: responses, discount total and the conversion rates of both groups."""
    group, converted = F.col("ab_group"), F.col("converted")

    def rate(name: str) -> Column:
        inside = group == name
        hits = F.sum(F.when(inside, converted))
        return ratio_or_null(hits, F.count_if(inside)) * 100

    return treated.agg(
        F.count_if(F.col("coupon_triggered") == 1).alias("triggered"),
        money_value(money_sum(F.col("discount_applied"))).alias("discount_cost"),
        rate("A").alias("conversion_pct_a"),
        rate("B").alias("conversion_pct_b"),
    ).withColumn("lift_pp", F.col("conversion_pct_b") - F.col("conversion_pct_a"))
