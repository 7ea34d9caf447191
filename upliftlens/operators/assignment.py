"""Deterministic traffic split and its sample-ratio check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.config import DEFAULT, ExperimentConfig
from upliftlens.functions.hashing import hash_bucket
from upliftlens.functions.numbers import ratio_or_zero
from upliftlens.functions.statistics import chi2_p, chi2_two_groups

GROUPS = ("A", "B")  # control, treatment


def user_group(user_id: Column, cfg: ExperimentConfig = DEFAULT) -> Column:
    bucket = hash_bucket(user_id, cfg.experiment_name)
    return F.when(bucket >= cfg.split_ratio * 100, "B").otherwise("A")


def assign_groups(sessions: DataFrame, cfg: ExperimentConfig = DEFAULT) -> DataFrame:
    """Add `ab_group`. A projection: no shuffle, and a user's sessions agree by construction."""
    return sessions.withColumn("ab_group", user_group(F.col("user_id"), cfg))


def _counts(assigned: DataFrame, unit: str) -> DataFrame:
    if unit not in ("session", "user"):
        raise ValueError("unit must be 'session' or 'user'")
    if unit == "user":
        assigned = assigned.groupBy("user_id").agg(F.min("ab_group").alias("ab_group"))
    group = F.col("ab_group")
    return assigned.agg(
        F.count_if(group == "A").alias("n_a"), F.count_if(group == "B").alias("n_b")
    )


def group_sizes(assigned: DataFrame) -> DataFrame:
    """Sessions and share of each group, empty groups included."""
    total = F.col("n_a") + F.col("n_b")
    rows = [
        F.struct(
            F.lit(g).alias("ab_group"),
            n.alias("sessions"),
            (ratio_or_zero(n, total) * 100).alias("share_pct"),
        )
        for g, n in zip(GROUPS, (F.col("n_a"), F.col("n_b")))
    ]
    return _counts(assigned, "session").select(F.inline(F.array(*rows)))


def srm_check(
    assigned: DataFrame, cfg: ExperimentConfig = DEFAULT, unit: str = "session"
) -> DataFrame:
    """One row: observed and expected sizes, chi-square, p and the pass flag."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    total = n_a + n_b
    return (
        _counts(assigned, unit)
        .select(
            "n_a",
            "n_b",
            (total * cfg.split_ratio).alias("expected_a"),
            (total * (1 - cfg.split_ratio)).alias("expected_b"),
            chi2_two_groups(n_a, n_b, cfg.split_ratio).alias("chi2"),
        )
        .withColumn("p_value", chi2_p(F.col("chi2")))
        .withColumn("srm_ok", F.when(F.col("p_value") > cfg.srm_alpha, 1).otherwise(0))
    )
