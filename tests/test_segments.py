import pytest
from conftest import executed_plan, rows
from golden import GROUPS, SEGMENTS
from pyspark.sql import functions as F

from upliftlens import schemas
from upliftlens.operators import quality, segments
from upliftlens.plans import reports


@pytest.fixture(scope="module")
def published(spark):
    """The published segment table."""
    out = []
    for (category, bucket, user_type), control, treated in SEGMENTS:
        keys = {"category_top": category, "price_bucket": bucket, "user_type": user_type}
        label = "+".join(k for k, v in keys.items() if v is not None)
        sides = [("B", *treated)] + ([("A", control[0], control[1], control[2], 0.0)] if control else [])
        for group, n, hits, gross, cost in sides:
            net = gross - cost
            out.append((category, group, n, hits, gross, cost, net, hits / n, net / n, label, bucket, user_type))
    return spark.createDataFrame(out, schemas.SEGMENT_RESULTS)


@pytest.fixture(scope="module")
def impact(published):
    return segments.profit_impact(published)


def test_published_verdicts(impact):
    got = {(r.category_top, r.price_bucket, r.user_type): r for r in impact.collect()}
    assert len(got) == len(SEGMENTS)
    assert got["unknown", None, None].net_profit_impact == pytest.approx(438720.302)
    assert got["unknown", None, None].conv_lift_pp == pytest.approx(21.17839842)
    assert got["stationery", None, None].verdict == "Loss"
    assert got[None, "<$25", None].net_profit_impact == pytest.approx(204721.784)
    nan = got[None, "nan", None]
    assert (nan.net_profit_impact, nan.verdict) == (0.0, "Break-Even")
    lonely = got["accessories", "$300-$1k", None]
    assert (lonely.net_revenue_a, lonely.conversion_rate_a, lonely.incremental_net_revenue) == (None,) * 3
    assert (lonely.conv_lift_pp, lonely.net_profit_impact, lonely.verdict) == (None, None, "Loss")
    assert impact.schema.simpleString() == schemas.PROFIT_IMPACT.simpleString()
    assert set(schemas.PROFIT_IMPACT_DECLARED.names) <= set(impact.columns)


def test_published_segments_add_up_to_the_groups(published):
    by_type = published.groupBy("segment_type", "ab_group").agg(
        F.sum("sessions").alias("n"), F.sum("conversions").alias("c"), F.sum("net_revenue").alias("net")
    )
    for r in by_type.filter("segment_type = 'user_type'").collect():
        n, c, _, _, net = GROUPS[r.ab_group]
        assert (r.n, r.c) == (n, c) and r.net == pytest.approx(net)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_published_category_report(impact):
    got = values(
        reports.report_profit_category(impact),
        "category_top", "verdict", "segment_count", "total_profit_impact", "avg_conv_lift_pp", "total_coupon_spend",
    )
    assert got == [
        ("unknown", "Profitable", 1, 438720.30, 21.18, 316030.38),
        ("appliances", "Profitable", 1, 24129.36, 17.28, 10873.21),
        ("furniture", "Profitable", 1, 16111.30, 15.57, 5277.16),
        ("accessories", "Profitable", 1, 5384.35, 17.25, 2159.04),
        ("apparel", "Profitable", 1, 461.40, 23.72, 729.75),
        ("stationery", "Loss", 1, -296.19, 21.82, 522.84),
    ]


def test_published_price_report(impact):
    assert [tuple(r) for r in reports.report_profit_price(impact).collect()] == [
        ("<$25", 22.09, 391681.75, 186959.97, 204721.78, "Profitable"),
        ("$25-$100", 16.26, 283811.90, 105010.97, 178800.93, "Profitable"),
        ("$100-$300", 10.38, 143742.62, 43199.04, 100543.58, "Profitable"),
        ("$300-$1k", 1.13, 866.63, 422.41, 444.23, "Profitable"),
        ("nan", 19.70, 0.0, 0.0, 0.0, "Break-Even"),
    ]


def test_published_rankings(impact):
    best = [r.net_roi for r in reports.report_top_profitable(impact).collect()]
    assert best == [
        438720.30, 243422.87, 241087.65, 204721.78, 201203.58,
        178800.93, 147303.61, 100543.58, 89768.89, 24129.36,
    ]
    worst = values(reports.report_top_loss(impact), "category_top", "price_bucket", "net_roi")
    assert worst == [
        ("accessories", "$300-$1k", None),
        ("stationery", None, -296.19),
        ("appliances", "$100-$300", -220.24),
        ("stationery", "<$25", -152.70),
        ("stationery", "$25-$100", -130.11),
    ]


def test_published_user_report(impact):
    assert [tuple(r) for r in reports.report_user_type_profit(impact).collect()] == [
        ("New", 26.28, 360515.14, 117092.28, 243422.87, 100.0),
        ("Returning", 18.88, 459587.76, 218500.11, 241087.65, 100.0),
    ]


def test_cross_report_starts_with_the_segment_without_control(impact):
    out = reports.report_cross(impact).collect()
    assert out[0].net_roi is None and out[0].verdict == "Loss"
    known = [r.net_roi for r in out[1:]]
    assert known == sorted(known) and len(out) == 7


def test_recommendation_report(impact):
    got = {r.metric: r.value for r in reports.report_recommendation(impact).collect()}
    assert got["Total Segments Analysed"] == 20.0
    assert (got["Profitable Segments"], got["Break-Even Segments"], got["Loss-Making Segments"]) == (14.0, 1.0, 5.0)
    assert got["Total Coupon Spend ($)"] == round(sum(t[3] for _, _, t in SEGMENTS) + 1e-9, 2)


def test_verdict_limits(spark):
    df = spark.createDataFrame([(0.01,), (0.0,), (-100.0,), (-100.01,), (None,)], "x double")
    assert [r.v for r in df.select(segments.verdict(F.col("x")).alias("v")).collect()] == [
        "Profitable", "Break-Even", "Break-Even", "Loss", "Loss"]


def test_verdict_counts_without_rows(spark):
    empty = spark.createDataFrame([], "verdict string")
    assert rows(segments.verdict_counts(empty)) == [("Break-Even", 0), ("Loss", 0), ("Profitable", 0)]


def treated(spark):
    return spark.createDataFrame(
        [
            ("shoes", "<$25", "New", "A", 1, 10.0, 0.0, 10.0),
            ("shoes", "<$25", "New", "B", 1, 20.0, 4.0, 16.0),
            ("shoes", "nan", "Returning", "B", 0, 0.0, 0.0, 0.0),
            ("hats", "<$25", "Returning", "A", 0, 0.0, 0.0, 0.0),
        ],
        "category_top string, price_bucket string, user_type string, ab_group string, converted int, "
        "gross_revenue double, discount_applied double, net_revenue double",
    )


def test_segment_results_equal_the_single_aggregations(spark):
    df = treated(spark)
    whole = segments.segment_results(df)
    parts = None
    for keys in segments.SEGMENTS:
        part = segments.segment_kpis(df, list(keys))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    assert rows(whole) == rows(schemas.conform(parts, schemas.SEGMENT_RESULTS))


def test_segment_only_in_control_or_only_in_treatment(spark):
    impact = segments.profit_impact(segments.segment_results(treated(spark)))
    got = {(r.category_top, r.price_bucket): r for r in impact.filter("segment_type like '%+%'").collect()}
    assert set(got) == {("shoes", "<$25"), ("shoes", "nan")}
    assert got["shoes", "nan"].verdict == "Loss" and got["shoes", "<$25"].net_profit_impact == 2.0


def test_profit_impact_needs_no_join(published):
    assert "Join" not in executed_plan(segments.profit_impact(published))


def test_lift_report_published_values(spark):
    """The report rounds its inputs before it compares them."""
    parts = []
    for group, (n, hits, _, cost, net) in GROUPS.items():
        # one row carries the money, the others only count
        parts.append(
            spark.range(n).select(
                F.lit(group).alias("ab_group"),
                (F.col("id") < hits).cast("int").alias("converted"),
                F.when(F.col("id") == 0, net).otherwise(0.0).alias("net_revenue"),
                F.when(F.col("id") == 0, cost).otherwise(0.0).alias("discount_applied"),
            )
        )
    row = reports.report_lift(parts[0].unionByName(parts[1])).first()
    assert row.asDict() == {
        "group_b_cr": 24.4808,
        "group_a_cr": 3.3801,
        "absolute_lift_pp": 21.1007,
        "relative_lift_pct": 624.26,
        "incremental_net_revenue": 820102.90,
        "total_coupon_spend": 335592.39,
        "true_roi": 484510.51,
    }
    assert reports.report_lift(parts[0]).count() == 0


def test_audit_finds_violations(spark):
    sessions = spark.createDataFrame(
        [("s", 1, 0, 1, 0, 0, 0, "New", "A"), ("s", None, 2, 1, 0, 0, None, "Old", "C"), (None, 2, 1, 5, 0, 1, 1, "New", "B")],
        "user_session string, user_id bigint, is_weekend int, converted int, cart_abandon int, is_new_user int, "
        "coupon_triggered int, user_type string, ab_group string",
    )
    ab = spark.createDataFrame([("A", 1, 3), ("A", 0, 1)], "ab_group string, is_significant int, profit_pass int")
    found = {
        (r.table_name, r.rule): r.violations
        for r in quality.quality_audit({"sessions": sessions, "ab_results": ab}).collect()
        if r.violations
    }
    assert found == {
        ("sessions", "user_session not null"): 1,
        ("sessions", "user_id not null"): 1,
        ("sessions", "is_weekend in (0,1)"): 1,
        ("sessions", "converted in (0,1)"): 1,
        ("sessions", "user_type in (New,Returning)"): 1,
        ("sessions", "ab_group in (A,B)"): 1,
        ("ab_results", "profit_pass in (0,1)"): 1,
    }
    assert rows(quality.quality_duplicates({"sessions": sessions, "ab_results": ab})) == [
        ("ab_results", "ab_group", 1, 1),
        ("sessions", "user_session", 1, 1),
    ]
    assert rows(quality.duplicate_keys(sessions, "user_session")) == [("s", 2)]
