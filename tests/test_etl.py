import os

import pytest
from conftest import executed_plan, rows
from pyspark.sql import functions as F

from upliftlens import schemas
from upliftlens.operators import clean, sessions
from upliftlens.sources import storage
from upliftlens.sources.events import load_raw

HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"


@pytest.fixture
def log(tmp_path):
    """A small event log with every kind of dirt, one column more than needed."""
    lines = [
        "2019-12-07 10:00:00 UTC,view,1,99,electronics.smartphone, Apple ,100.00,1,s1",
        "2019-12-07 10:05:00 UTC,cart,1,99,electronics.smartphone,apple,100.00,1,s1",
        "2019-12-07 10:09:00 UTC,purchase,2,99,Stationery,,25.00,1,s1",
        "2019-12-09 09:00:00 UTC,cart,3,99,NA,NA,abc,1,s2",
        "2019-12-30 23:00:00 UTC,signup,3,99,,,-5,2,s3",
        "2019-12-30 23:00:01 UTC,remove_from_cart,3,99,a.b,x,1d,2,s3",
        "2019-12-30 23:00:02 UTC,view,3,99,a.b,x,1,3,s1",
        "2019-12-30 23:00:02 UTC,view,3,99,a.b,x,1,,s9",
        "2019-12-30 23:00:02 UTC,view,3,99,a.b,x,1,9,null",
        "2019-12-30 23:00:02 UTC,,3,99,a.b,x,1,9,s9",
        "not a time,view,3,99,a.b,x,1,9,s9",
        '2019-12-31 08:00:00 UTC,purchase,3,99,"a,b.c","say ""hi""",0.00,4,s4',
        "2019-12-31 08:00:00 UTC,purchase,3,99,z.first,zz,7.25,4,s4",
    ]
    path = tmp_path / "log.csv"
    path.write_text(HEADER + "\n".join(lines) + "\n")
    return str(path)


def test_load_raw_types_and_nulls(spark, log):
    raw = load_raw(spark, log)
    assert raw.drop("input_order", "user_id_text").schema == schemas.RAW_EVENTS
    assert raw.count() == 13
    na = raw.filter("user_session = 's2'").first()
    assert (na.category_code, na.brand, na.price) == (None, None, "abc")
    quoted = raw.filter("user_id = 4 and price = '0.00'").first()
    assert (quoted.category_code, quoted.brand) == ("a,b.c", 'say "hi"')
    assert raw.filter("event_time is null").count() == 1


def test_load_raw_reads_only_the_named_columns(spark, log):
    assert "category_id" not in executed_plan(load_raw(spark, log))


def test_load_raw_finds_columns_by_name(spark, tmp_path):
    (tmp_path / "other.csv").write_text(
        "user_session,user_id,price,brand,category_code,product_id,event_type,event_time\n"
        "s,1,2.5,b,c.d,7,view,2019-12-01 00:00:00\n"
    )
    row = load_raw(spark, str(tmp_path / "other.csv")).first()
    assert (row.user_session, row.user_id, row.product_id, row.price) == ("s", 1, 7, "2.5")


def test_load_raw_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no event log"):
        load_raw(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "short.csv").write_text("event_time,event_type\n1,2\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        load_raw(spark, str(tmp_path / "short.csv"))


def test_clean_metrics_and_rejects(spark, log):
    raw = load_raw(spark, log)
    assert clean.clean_metrics(raw).first().asDict() == {
        "rows_before": 13,
        "rows_after": 9,
        "rows_removed": 4,
        "missing_user_id": 1,
        "missing_user_session": 1,
        "missing_event_type": 1,
        "missing_event_time": 1,
    }
    missing = rows(clean.rejected_events(raw).select("missing"))
    assert missing == [("event_time",), ("event_type",), ("user_id",), ("user_session",)]


def test_observed_cleaning_counts_while_it_runs(spark, log):
    raw = load_raw(spark, log)
    flagged, seen = clean.observe_cleaning(raw)
    assert flagged.count() == 13 and flagged.filter("valid").count() == 9
    assert rows(clean.observed_metrics(seen, spark)) == rows(clean.clean_metrics(raw))


def test_sessions_from_csv(spark, log):
    out = sessions.build_sessions(clean.clean_events(load_raw(spark, log)))
    assert out.schema.simpleString() == schemas.SESSIONS.simpleString()
    got = {(r.user_session, r.user_id): r for r in out.collect()}
    assert set(got) == {("s1", 1), ("s2", 1), ("s3", 2), ("s1", 3), ("s4", 4)}

    s1 = got["s1", 1]
    assert (s1.views, s1.carts, s1.removes, s1.purchases) == (1, 1, 0, 1)
    assert (s1.gross_revenue, s1.max_price, s1.price_bucket) == (25.0, 100.0, "$25-$100")
    assert (s1.category_top, s1.brand, s1.hour, s1.is_weekend, s1.week_num) == (
        "electronics", "apple", 10, 1, 49)
    assert (s1.converted, s1.cart_abandon) == (1, 0)
    assert (s1.total_sessions, s1.is_new_user, s1.user_type) == (2, 0, "Returning")

    s2 = got["s2", 1]
    assert (s2.category_top, s2.brand, s2.max_price, s2.price_bucket) == ("unknown", "unknown", 0.0, "nan")
    assert (s2.converted, s2.cart_abandon) == (0, 1)

    s3 = got["s3", 2]  # the unknown event type counts nowhere but opens the session
    assert (s3.views, s3.carts, s3.removes, s3.purchases) == (0, 0, 1, 0)
    assert (s3.category_top, s3.week_num, s3.is_new_user, s3.user_type) == ("unknown", 1, 1, "New")

    s4 = got["s4", 4]  # equal times: the file order decides, not the alphabet
    assert (s4.category_top, s4.brand, s4.gross_revenue) == ("a,b", 'say "hi"', 7.25)


def test_equal_times_follow_the_file_across_splits(spark, tmp_path):
    n = 3000
    path = tmp_path / "ties.csv"
    lines = [f"2019-12-01 00:00:00 UTC,view,1,1,c{n - i:05d}.x,b,1,7,s" for i in range(n)]
    path.write_text(HEADER + "\n".join(lines) + "\n")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = load_raw(spark, str(path))
        assert raw.rdd.getNumPartitions() > 3
        assert sessions.session_build(clean.clean_events(raw)).first().category_top == f"c{n:05d}"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)


def test_staged_sessions_equal_lazy_sessions(spark, log):
    events = clean.clean_events(load_raw(spark, log))
    lazy = sessions.build_sessions(events)
    staged = sessions.build_sessions(events, stage=storage.materialise)
    assert rows(lazy) == rows(staged)
    slim = sessions.build_sessions(events, stage=storage.materialise, texts=False)
    assert slim.columns == [c for c in lazy.columns if c not in ("category_top", "brand")]
    assert rows(slim) == rows(lazy.drop("category_top", "brand"))


def test_run_summary(spark, log):
    out = sessions.run_summary(sessions.build_sessions(clean.clean_events(load_raw(spark, log))))
    assert out.first().asDict() == {"sessions": 5, "unique_users": 4, "baseline_conversion_pct": 40.0}


def test_defaults(spark):
    df = spark.createDataFrame([(None, 2, None)], "views bigint, carts bigint, net_revenue double")
    assert rows(schemas.apply_defaults(df)) == [(0, 2, 0.0)]


def test_csv_sink_keeps_texts_nulls_and_microseconds(spark, tmp_path):
    schema = "a string, b string, c double, d timestamp_ntz"
    df = spark.sql(
        "SELECT ' x ' a, 'nan' b, 0.1D c, timestamp_ntz'2019-12-01 01:02:03.000004' d "
        "UNION ALL SELECT 'say \"hi\", ok', '', NULL, NULL UNION ALL SELECT NULL, 'b', 1e-5D, NULL"
    )
    storage.write_csv(df, str(tmp_path / "out"))
    from pyspark.sql.types import StructType

    back = storage.read_csv(spark, str(tmp_path / "out"), StructType.fromDDL(schema))
    assert rows(back) == rows(df)


def test_table_sink_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.create_table(spark, "sink_t", schemas.AB_RESULTS, path)
    assert spark.table("sink_t").count() == 0
    assert spark.table("sink_t").schema == schemas.AB_RESULTS
    storage.write_table(spark.range(3), "sink_t", path)
    storage.write_table(spark.range(5), "sink_t", path)
    assert spark.table("sink_t").count() == 5
    storage.drop_table(spark, "sink_t")
    assert not spark.catalog.tableExists("sink_t")


def test_scratch_lies_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = storage.scratch_dir(spark, "x"), storage.scratch_dir(spark, "x")
    assert first.startswith(root + "/x-") and first != second


def test_cleaning_pushes_key_filters(spark, sf_dir):
    from upliftlens.sources.adapters import from_events

    plan = clean.clean_events(from_events(spark, sf_dir)).select(F.max("price"))
    text = executed_plan(plan)
    assert "IsNotNull(ts)" in text and "IsNotNull(user_id)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
