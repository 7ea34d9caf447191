import math

import pytest
from conftest import rows
from golden import GROUPS
from pyspark.sql import functions as F

from upliftlens import schemas
from upliftlens.config import ExperimentConfig
from upliftlens.functions import statistics
from upliftlens.operators import assignment, kpis, treatment
from upliftlens.plans import pipeline

COLUMNS = (
    "user_session string, user_id bigint, purchases bigint, gross_revenue double, max_price double, "
    "is_weekend int, converted int, cart_abandon int, is_new_user int"
)


def make_sessions(spark, n=4000):
    """Sessions of n/2 users with every mix of flags and prices."""
    i = F.col("id")
    bought = i % 5 == 0
    return spark.range(n).select(
        F.concat(F.lit("s"), i.cast("string")).alias("user_session"),
        (i / 2).cast("bigint").alias("user_id"),
        F.when(bought, 2).otherwise(0).cast("bigint").alias("purchases"),
        F.when(bought, (i % 700) * 1.25).otherwise(0.0).alias("gross_revenue"),
        ((i % 1300) * 1.01).alias("max_price"),
        (i % 3 == 0).cast("int").alias("is_weekend"),
        bought.cast("int").alias("converted"),
        (~bought & (i % 2 == 0)).cast("int").alias("cart_abandon"),
        (i % 7 == 0).cast("int").alias("is_new_user"),
    )


def treated_from(spark, tuples):
    """(group, converted, gross, discount, net) -> the columns that KPIs read."""
    return spark.createDataFrame(
        tuples,
        "ab_group string, converted int, gross_revenue double, discount_applied double, net_revenue double",
    )


def test_assignment_ignores_partitioning_and_order(spark):
    df = make_sessions(spark)
    straight = assignment.assign_groups(df)
    shuffled = assignment.assign_groups(df.orderBy(F.rand(1)).repartition(7))
    assert rows(straight) == rows(shuffled.select(*straight.columns))
    per_user = straight.groupBy("user_id").agg(F.count_distinct("ab_group").alias("n"))
    assert per_user.agg(F.max("n")).first()[0] == 1


def test_assignment_share_follows_the_ratio(spark):
    users = spark.range(20000).withColumnRenamed("id", "user_id")
    for ratio in (0.5, 0.2):
        cfg = ExperimentConfig(split_ratio=ratio)
        share = assignment.assign_groups(users, cfg).agg(F.avg((F.col("ab_group") == "A").cast("int"))).first()[0]
        assert abs(share - ratio) < 3 * math.sqrt(ratio * (1 - ratio) / 20000)


def test_group_sizes_and_srm_with_an_empty_group(spark):
    df = spark.createDataFrame([(1, "B"), (1, "B"), (2, "B")], "user_id bigint, ab_group string")
    assert rows(assignment.group_sizes(df)) == [("A", 0, 0.0), ("B", 3, 100.0)]
    assert assignment.srm_check(df).first().chi2 == 3.0
    by_user = assignment.srm_check(df, unit="user").first()
    assert (by_user.n_a, by_user.n_b) == (0, 2)
    with pytest.raises(ValueError):
        assignment.srm_check(df, unit="event")


def test_srm_published_values(spark):
    n_a, n_b = GROUPS["A"][0], GROUPS["B"][0]
    chi2 = statistics.chi2_two_groups(F.lit(n_a), F.lit(n_b), 0.5)
    row = spark.range(1).select(chi2.alias("chi2"), statistics.chi2_p(chi2).alias("p")).first()
    assert row.chi2 == pytest.approx(47.60328028909408, rel=1e-12)
    assert row.p == pytest.approx(5.218109617432757e-12, rel=1e-9)


@pytest.mark.parametrize(
    ("price", "new", "abandon", "weekend", "chance"),
    [
        (24.99, 0, 0, 0, 0.16),
        (25.0, 0, 0, 0, 0.12),
        (100.0, 0, 0, 0, 0.08),
        (300.0, 0, 0, 0, 0.04),
        (1000.0, 0, 0, 0, 0.016),
        (10.0, 1, 1, 1, 0.576),
    ],
)
def test_lift_probability(spark, price, new, abandon, weekend, chance):
    df = spark.createDataFrame(
        [(price, new, abandon, weekend)],
        "max_price double, is_new_user int, cart_abandon int, is_weekend int",
    )
    assert df.select(treatment.lift_probability().alias("p")).first().p == pytest.approx(chance)
    high = ExperimentConfig(base_conversion_lift=5.0)
    assert df.select(treatment.lift_probability(high).alias("p")).first().p == 0.95


@pytest.mark.parametrize(("gross", "granted"), [(0.0, 0.0), (10.0, 2.0), (250.0, 50.0), (1000.0, 50.0)])
def test_discount(spark, gross, granted):
    out = spark.range(1).select(treatment.discount(F.lit(gross)).alias("d")).first().d
    assert out == granted


def test_treatment_rules(spark):
    before = make_sessions(spark)
    assigned = assignment.assign_groups(before)
    out = treatment.apply_treatment(assigned)
    old = before.select("user_session", *[F.col(c).alias(f"old_{c}") for c in before.columns[2:]])
    both = out.join(old, "user_session")

    def never(condition):
        assert both.filter(condition).count() == 0

    triggered = F.col("coupon_triggered") == 1
    gross, cost, net = F.col("gross_revenue"), F.col("discount_applied"), F.col("net_revenue")
    buyer_b = (F.col("ab_group") == "B") & (F.col("converted") == 1)
    assert both.filter(triggered).count() > 50
    never(triggered & ((F.col("ab_group") == "A") | (F.col("old_converted") == 1)))
    never(triggered & ((F.col("converted") != 1) | (F.col("purchases") != 1) | (gross != F.col("max_price"))))
    never(~triggered & ((F.col("converted") != F.col("old_converted")) | (gross != F.col("old_gross_revenue"))))
    never(F.col("cart_abandon") != F.col("old_cart_abandon"))
    never((cost < 0) | (cost > 50) | (cost > gross * 0.2 + 1e-9) | (net < 0))
    never(~buyer_b & ((cost != 0) | (net != F.col("old_gross_revenue"))))
    never(buyer_b & (net != F.greatest(gross - cost, F.lit(0.0))))
    assert rows(out) == rows(treatment.apply_treatment(assigned.repartition(5)).select(*out.columns))


def test_real_redemptions_replace_the_draw(spark):
    assigned = assignment.assign_groups(make_sessions(spark, 200)).withColumn("redeemed", F.lit(1))
    out = treatment.apply_treatment(assigned, trigger=F.col("redeemed"))
    assert out.filter("ab_group = 'B' and converted = 0").count() == 0
    none = treatment.apply_treatment(assigned, trigger=F.lit(0))
    assert none.filter("coupon_triggered = 1").count() == 0


def test_treatment_summary(spark):
    df = treated_from(
        spark, [("A", 1, 1.0, 0.0, 1.0), ("A", 0, 0.0, 0.0, 0.0), ("B", 1, 5.0, 1.0, 4.0)]
    ).withColumn("coupon_triggered", (F.col("ab_group") == "B").cast("int"))
    assert treatment.treatment_summary(df).first().asDict() == {
        "triggered": 1,
        "discount_cost": 1.0,
        "conversion_pct_a": 50.0,
        "conversion_pct_b": 100.0,
        "lift_pp": 50.0,
    }


def published(spark):
    names = ("sessions", "conversions", "gross_revenue", "discount_cost", "net_revenue")
    structs = [
        F.struct(
            *[F.lit(v).alias(n) for n, v in zip(names, values)],
            F.lit(values[1] / values[0]).alias("conversion_rate"),
        ).alias(group.lower())
        for group, values in GROUPS.items()
    ]
    return spark.range(1).select(*structs)


def test_published_comparison(spark):
    row = kpis.compare(published(spark)).first()
    assert row.conv_lift_pct == pytest.approx(624.2634982232754, rel=1e-12)
    assert row.rev_change_pct == pytest.approx(152.99660617753372, rel=1e-12)
    assert (row.p_value, row.is_significant, row.profit_pass) == (0.0, 1, 1)
    counts = [F.lit(v) for g in "AB" for v in GROUPS[g][:2]]
    z = spark.range(1).select(statistics.two_proportion_z(*counts).alias("z")).first().z
    assert z == pytest.approx(279.894114529679, rel=1e-12)


def test_ab_results_by_hand(spark):
    df = treated_from(
        spark,
        [("A", 1, 10.0, 0.0, 10.0)] * 2
        + [("A", 0, 0.0, 0.0, 0.0)] * 2
        + [("B", 1, 20.0, 4.0, 16.0)] * 3
        + [("B", 0, 0.0, 0.0, 0.0)],
    )
    a, b = kpis.ab_results(df).orderBy("ab_group").collect()
    assert tuple(a)[:9] == ("A", 4, 2, 0.5, 20.0, 0.0, 20.0, 5.0, 10.0)
    assert tuple(b)[:9] == ("B", 4, 3, 0.75, 60.0, 12.0, 48.0, 12.0, 20.0)
    assert tuple(a)[9:] == tuple(b)[9:]
    assert (a.conv_lift_pct, a.rev_change_pct, a.profit_pass) == (50.0, 140.0, 1)
    assert a.p_value == pytest.approx(math.erfc(0.25 / math.sqrt(0.625 * 0.375 / 2) / math.sqrt(2)))
    assert [tuple(r)[:9] for r in kpis.group_kpis(df).orderBy("ab_group").collect()] == [
        tuple(a)[:9],
        tuple(b)[:9],
    ]
    assert kpis.ab_results(df).schema.simpleString() == schemas.AB_RESULTS.simpleString()
    test = kpis.z_test(df).first()
    assert (test.n_a, test.conversions_a, test.n_b, test.conversions_b) == (4, 2, 4, 3)
    assert test.p_value == pytest.approx(test.p_value_tail)


def test_empty_control_group(spark):
    a, b = kpis.ab_results(treated_from(spark, [("B", 1, 20.0, 4.0, 16.0)])).orderBy("ab_group").collect()
    assert tuple(a)[:9] == ("A", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert (b.conv_lift_pct, b.rev_change_pct, b.p_value, b.is_significant, b.profit_pass) == (
        None, 0.0, None, 0, 1)


def test_control_without_conversions(spark):
    df = treated_from(spark, [("A", 0, 0.0, 0.0, 0.0)] * 3 + [("B", 1, 20.0, 4.0, 16.0)] * 3)
    row = kpis.ab_results(df).first()
    assert row.conv_lift_pct is None and row.rev_change_pct == 0.0
    assert row.is_significant == 1


def test_guardrail_texts(spark):
    loss = kpis.guardrail_report(treated_from(spark, [("A", 1, 5.0, 0.0, 5.0), ("B", 1, 5.0, 1.0, 4.0)])).first()
    assert (loss.profit_pass, loss.guardrail) == (0, "FAIL") and loss.recommendation.startswith("DO NOT")
    gain = kpis.guardrail_report(treated_from(spark, [("A", 1, 5.0, 0.0, 5.0), ("B", 1, 8.0, 1.0, 7.0)])).first()
    assert (gain.profit_pass, gain.guardrail, gain.recommendation) == (1, "PASS", None)


def test_hash_is_computed_once_per_session(spark, sf_dir):
    """The projections keep the draw and the group in one place instead of repeating them per use."""
    import __spark_entry__ as entry

    plan = entry.queries()["treatment_summary"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 3  # group (two halves of one digest) and draw
    assert "PythonUDF" not in plan and "EvalPython" not in plan


def test_treat_has_the_fixed_schema(spark, sf_dir):
    import __spark_entry__ as entry

    t = entry.Tables("events", spark, sf_dir)
    assert t.full_treated().schema.simpleString() == schemas.TREATED_SESSIONS.simpleString()
    assert set(schemas.TREATED_SESSIONS.names) - set(t.treated().columns) == set(schemas.FIRST_TEXTS)
    _, kpi = pipeline.run_experiment(t.full_sessions())
    assert kpi.columns == schemas.AB_RESULTS.names
