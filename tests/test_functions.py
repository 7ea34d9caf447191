import hashlib
import math

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from upliftlens.config import ExperimentConfig
from upliftlens.functions import clock, hashing, numbers, statistics, text


def column(spark, values, dtype):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def apply(spark, values, dtype, f):
    df = column(spark, values, dtype).select("i", f(F.col("v")).alias("r")).orderBy("i")
    return [r.r for r in df.collect()]


@pytest.mark.parametrize(
    ("value", "price"),
    [
        ("12.5", 12.5),
        (" 5 ", 5.0),
        ("5\t", 5.0),
        ("\n5\r\f", 5.0),
        (" inf ", math.inf),
        (".5", 0.5),
        ("5.", 5.0),
        ("+5", 5.0),
        ("1e3", 1000.0),
        ("1E+3", 1000.0),
        ("inf", math.inf),
        ("Infinity", math.inf),
        ("-inf", 0.0),
        ("-5", 0.0),
        ("abc", 0.0),
        ("1d", 0.0),
        ("1f", 0.0),
        ("0x10", 0.0),
        ("1_000", 0.0),
        ("1,000", 0.0),
        ("1e", 0.0),
        ("--5", 0.0),
        ("NaN", 0.0),
        ("", 0.0),
        (None, 0.0),
    ],
)
def test_coerce_price_from_text(spark, value, price):
    assert apply(spark, [value], "string", lambda c: numbers.coerce_price(c, StringType())) == [price]


def test_coerce_price_from_numbers(spark):
    df = column(spark, [1.5, -2.0, float("nan"), None], "double")
    out = df.select(numbers.coerce_price(F.col("v"), df.schema["v"].dataType).alias("p"))
    assert [r.p for r in out.collect()] == [1.5, 0.0, 0.0, 0.0]


def test_brand_strips_every_white_space(spark):
    values = ["\tAcme ", " Ärzte　", " two  words\n", None, "\x1cx\x1f"]
    assert apply(spark, values, "string", text.normalise_brand) == [
        "acme",
        "ärzte",
        "two  words",
        "unknown",
        "x",
    ]


def test_category(spark):
    values = ["Stationery", "a.b.c", None, ".x", "Electronics.Phone"]
    f = lambda c: text.top_level(text.normalise_category(c))
    assert apply(spark, values, "string", f) == ["stationery", "a", "unknown", "", "electronics"]


def test_missing_tokens(spark):
    values = ["NA", "null", "", "N/A", "None", " NA", "na", "x"]
    out = apply(spark, values, "string", text.missing_to_null)
    assert out == [None, None, None, None, None, " NA", "na", "x"]


def test_price_bucket_is_closed_on_the_right(spark):
    prices = [0.0, 0.01, 25.0, 25.01, 100.0, 300.0, 1000.0, 1000.01, math.inf]
    assert apply(spark, prices, "double", numbers.price_bucket) == [
        "nan",
        "<$25",
        "<$25",
        "$25-$100",
        "$25-$100",
        "$100-$300",
        "$300-$1k",
        "$1k+",
        "$1k+",
    ]


def test_price_bucket_follows_the_configuration(spark):
    cfg = ExperimentConfig(price_bins=(0.0, 10.0, 20.0), price_labels=("low", "high"), no_bucket_label="?")
    assert apply(spark, [0.0, 10.0, 15.0, 21.0], "double", lambda c: numbers.price_bucket(c, cfg)) == [
        "?",
        "low",
        "high",
        "?",
    ]


@pytest.mark.parametrize(
    "bad",
    [
        {"split_ratio": 0.0},
        {"price_labels": ("a",)},
        {"price_bins": (0.0, 0.0, 1.0, 2.0, 3.0, 4.0)},
        {"price_multipliers": ((25.0, 2.0),)},
        {"confidence_level": 1.0},
    ],
)
def test_configuration_is_checked(bad):
    with pytest.raises(ValueError):
        ExperimentConfig(**bad)


def test_configuration_from_json():
    cfg = ExperimentConfig.from_json('{"price_bins": [0, 10, Infinity], "price_labels": ["low", "high"]}')
    assert cfg.price_bins == (0, 10, math.inf) and cfg.split_ratio == 0.5
    assert cfg.price_labels == ("low", "high")
    with pytest.raises(ValueError, match="unknown parameters: nope"):
        ExperimentConfig.from_json('{"nope": 1}')


def test_calendar(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1, timestamp_ntz'2019-12-07 23:59:59'), (2, timestamp_ntz'2019-12-08 00:00:00'),
           (3, timestamp_ntz'2019-12-09 07:00:00'), (4, timestamp_ntz'2019-12-30 12:00:00') AS t(i, ts)"""
    )
    ts = F.col("ts")
    out = df.select(
        "i", clock.hour_of_day(ts), clock.weekday_name(ts), clock.is_weekend(ts), clock.iso_week(ts)
    )
    assert rows(out) == [
        (1, 23, "Saturday", 1, 49),
        (2, 0, "Sunday", 1, 49),
        (3, 7, "Monday", 0, 50),
        (4, 12, "Monday", 0, 1),
    ]


def test_hash_bucket_known_values(spark):
    users = {1: 91, 8: 74, 46: 16, 899: 72, 12345: 91, 512345678: 35}
    out = apply(spark, list(users), "bigint", lambda c: hashing.hash_bucket(c, "Coupon_Test_V1"))
    assert out == list(users.values())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=200), st.text(max_size=8))
def test_hash_bucket_is_the_digest_modulo_100(spark, users, salt):
    salt = salt.replace("\x00", "").encode("utf-8", "ignore").decode()
    expected = [int(hashlib.md5(f"{u}_{salt}".encode()).hexdigest(), 16) % 100 for u in users]
    assert apply(spark, users, "bigint", lambda c: hashing.hash_bucket(c, salt)) == expected


def test_draw_is_uniform_and_follows_its_probability(spark):
    n = 20000
    df = spark.range(n).withColumn("p", F.lit(0.16))
    out = df.agg(
        F.avg(hashing.uniform_draw([F.col("id")], "s")).alias("mean"),
        F.avg(hashing.bernoulli([F.col("id")], "s", F.col("p"))).alias("rate"),
        F.min(hashing.uniform_draw([F.col("id")], "s")).alias("low"),
        F.max(hashing.uniform_draw([F.col("id")], "s")).alias("high"),
    ).first()
    assert abs(out["mean"] - 0.5) < 3 * math.sqrt(1 / 12 / n)
    assert abs(out["rate"] - 0.16) < 3 * math.sqrt(0.16 * 0.84 / n)
    assert 0 <= out["low"] and out["high"] < 1


def test_normal_cdf_against_erfc(spark):
    grid = [i / 50 for i in range(-400, 401)] + [10.0, -10.0, 40.0, -40.0]
    out = apply(spark, grid, "double", statistics.normal_cdf)
    for z, value in zip(grid, out):
        assert abs(value - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-15


def test_normal_tail_far_out(spark):
    grid = [0.0, 1.0, 5.0, 7.0, 7.1, 10.0, 20.0, 36.0]
    for z, value in zip(grid, apply(spark, grid, "double", statistics.normal_tail)):
        assert value == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-7)
    assert apply(spark, [40.0], "double", statistics.normal_tail) == [0.0]


def test_logarithm_of_the_tail(spark):
    found = apply(spark, [0.0, 1.0, 5.0, -9.0, 30.0, 280.0], "double", statistics.log10_two_sided_p)
    exact = [math.log10(math.erfc(abs(z) / math.sqrt(2))) for z in (0.0, 1.0, 5.0, -9.0, 30.0)]
    # beyond the doubles by the asymptotic series
    z = 280.0
    series = 1 - z**-2 + 3 * z**-4
    exact.append((-z * z / 2 + math.log(2 * series / (z * math.sqrt(2 * math.pi)))) / math.log(10))
    assert found == pytest.approx(exact, rel=1e-9, abs=1e-12)


def test_z_statistic_edges(spark):
    df = spark.createDataFrame(
        [(10, 0, 10, 0), (0, 0, 10, 1), (10, 10, 10, 10), (100, 20, 100, 30)],
        "na bigint, ca bigint, nb bigint, cb bigint",
    )
    z = statistics.two_proportion_z(*[F.col(c) for c in ("na", "ca", "nb", "cb")])
    out = df.select(z.alias("z"), statistics.significant(statistics.two_sided_p(z), 0.95).alias("s"))
    first, empty, all_bought, usual = out.collect()
    assert (first.z, first.s) == (0.0, 0)
    assert (empty.z, empty.s) == (None, 0)
    assert (all_bought.z, all_bought.s) == (0.0, 0)
    assert usual.z == pytest.approx(0.1 / math.sqrt(0.25 * 0.75 * 0.02))


def test_money_sum_is_exact_and_keeps_what_does_not_fit(spark):
    df = column(spark, [0.1] * 10 + [None], "double")
    total = numbers.money_sum(F.col("v"))
    assert df.agg(numbers.money_value(total).alias("t")).first().t == 1.0
    large = column(spark, [1.5, math.inf], "double")
    assert large.agg(numbers.money_value(total).alias("t")).first().t == math.inf
    larger = column(spark, [1.5, 1e15], "double")
    assert larger.agg(numbers.money_value(total).alias("t")).first().t == 1e15 + 1.5
    empty = column(spark, [], "double")
    got = empty.agg(
        numbers.money_value(total).alias("t"), numbers.money_rounded(total).alias("r")
    ).first()
    assert (got.t, got.r) == (0.0, None)


def test_rounding_is_half_up(spark):
    values = [1.005, 2.675, -1.005, None, 1e30]
    assert apply(spark, values, "double", numbers.rounded_money) == [1.01, 2.68, -1.01, None, 1e30]
