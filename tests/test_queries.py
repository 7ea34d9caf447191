"""Every registered query against its DuckDB counterpart, over both sources."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import executed_plan, rows
from oracle import sql
from pyspark.sql import functions as F
from upliftlens import schemas
from upliftlens.operators import quality
from upliftlens.plans import pipeline
from upliftlens.sources import sizing, storage

DEFINITIONS = entry.definitions()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in ("events", "lineitem", "orders", "part"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def normal(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def table(names, records):
    order = [names.index(n) for n in sorted(names)]
    out = [tuple(normal(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def test_names_match():
    assert set(entry.queries()) >= set(DEFINITIONS)
    assert set(entry.queries()) - set(entry.LLM_QUERIES) == set(DEFINITIONS)
    assert set(entry.oracle_sql()) - set(entry.LLM_SQL) == set(DEFINITIONS)
    assert len(DEFINITIONS) == 60


def test_the_dirty_source_loses_events(spark, sf_dir):
    counts = entry.queries()["clean_metrics"](spark, sf_dir).first()
    assert counts.rows_removed > 0
    assert counts.rows_removed == entry.queries()["rejected_events"](spark, sf_dir).count()


def test_the_log_with_text_ids_loses_only_events_without_a_user(spark, sf_dir):
    counts = entry.queries()["text_id_metrics"](spark, sf_dir).first()
    events = entry.queries()["text_id_events"](spark, sf_dir)
    assert counts.rows_after + counts.rows_removed == counts.rows_before == events.count()
    kept = events.filter("kept = 1")
    assert counts.rows_after == kept.count() > 0
    assert kept.filter("user_id like 'u-%'").count() > 0
    assert kept.filter("user_id rlike '[.]| '").count() == 0


def test_the_gate_sees_every_rule_broken(spark, sf_dir):
    report = entry.queries()["quality_gate"](spark, sf_dir).collect()
    assert all(r.violations > 0 and r.accepted + r.quarantined == r.checked for r in report)
    assert {(r.table_name, r.rule) for r in report} == {(t, n) for t in schemas.TABLES for n in quality.rule_names(t)}
    masks = [r.broken_rules for r in entry.queries()["quarantined_rows"](spark, sf_dir).collect()]
    assert any(m.bit_count() > 1 for m in masks) and all(masks)


def test_the_gate_reads_the_events_once(spark, sf_dir, monkeypatch):
    """However many tables the gate checks, the events behind them are joined and aggregated once."""
    source, seen = entry.SOURCES["orders"], spark.sparkContext.accumulator(0)

    def counted(session, path):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        raw = source(session, path)
        return raw.mapInArrow(run, raw.schema)

    monkeypatch.setitem(entry.SOURCES, "orders", counted)
    entry.queries()["quality_gate"](spark, sf_dir).collect()
    assert seen.value == source(spark, sf_dir).count() > 0


def test_a_sink_that_alters_any_one_column_is_seen(spark, sf_dir):
    t = entry.Tables("orders", spark, sf_dir)
    df = storage.materialise(t.full_treated().limit(300), "some")
    assert entry.compared_sink(df, df.orderBy("net_revenue"), "sessions", "x", True).first().same_rows == 1
    changed = {"string": F.lit("~"), "timestamp_ntz": F.expr("timestamp_ntz'2001-01-01 00:00:00'")}
    one = F.col("user_session") == df.first().user_session
    for name, kind in df.dtypes:
        other = changed.get(kind, F.col(name) + 1)
        for value in (other, F.lit(None)):
            back = df.withColumn(name, F.when(one, value.cast(kind)).otherwise(F.col(name)))
            assert entry.compared_sink(df, back, "sessions", "x", True).first().same_rows == 0, name
    swapped = df.withColumns({"carts": F.col("views"), "views": F.col("carts")})
    assert entry.compared_sink(df, swapped, "sessions", "x", True).first().same_rows == 0
    assert entry.compared_sink(df, df.unionByName(df.limit(1)), "sessions", "x", True).first().same_rows == 0


def test_stored_types_are_compared_with_declared_ones(spark, sf_dir):
    tables = entry.Tables("events", spark, sf_dir).files()
    tables["ab_results"] = tables["ab_results"].withColumn("conversions", F.col("conversions").cast("int"))
    wrong = quality.table_schemas(tables).filter("type_ok = 0").collect()
    assert [(r.table_name, r.column_name) for r in wrong] == [("ab_results", "conversions")]


def test_shuffles_are_as_wide_as_the_input_needs(spark, sf_dir, monkeypatch):
    query = entry.queries()["report_funnel"]
    narrow = query(spark, sf_dir)
    size = sizing.stored_bytes(spark, *[f"{sf_dir}/{n}.parquet" for n in ("lineitem", "orders", "part")])
    assert size > 100_000
    monkeypatch.setattr(sizing, "INPUT_PER_PARTITION", size // 37)
    wide = query(spark, sf_dir)
    plan = executed_plan(wide)
    assert "hashpartitioning" in plan and ", 37), ENSURE_REQUIREMENTS" in plan
    assert ", 4), ENSURE_REQUIREMENTS" in executed_plan(narrow)
    assert spark.conf.get(sizing.WIDTH) == "4"  # the caller's session is as it was
    assert rows(wide) == rows(narrow)


@pytest.mark.parametrize("source", ["events", "orders"])
@pytest.mark.parametrize("name", list(DEFINITIONS))
def test_query_equals_sql(spark, sf_dir, duck, name, source):
    df = DEFINITIONS[name][1](entry.Tables(source, spark, sf_dir))
    cursor = duck.execute(sql.oracle(name, source))
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, cursor.fetchall())


def test_entry_is_lazy_and_small(spark, sf_dir):
    assert entry.entry(spark).count() == 2


# sessions, users, New, converted, cart abandon, sessions per price bucket
PROFILE = (773, 397, 136, 191, 179, {"<$25": 247, "$25-$100": 392, "$100-$300": 133, "$300-$1k": 1})


def test_click_log_profile(spark, sf_dir):
    found = entry.Tables("events", spark, sf_dir).sessions().collect()
    buckets = {}
    for r in found:
        buckets[r.price_bucket] = buckets.get(r.price_bucket, 0) + 1
    assert PROFILE == (
        len(found),
        len({r.user_id for r in found}),
        sum(r.is_new_user for r in found),
        sum(r.converted for r in found),
        sum(r.cart_abandon for r in found),
        buckets,
    )


SESSION_QUERIES = [n for n in DEFINITIONS if n.startswith("report_")] + [
    "user_type", "run_summary", "apply_treatment", "treatment_summary", "z_test", "group_kpis", "ab_results",
    "guardrail_report", "segment_kpis", "segment_results", "profit_impact", "verdict_counts",
]


@pytest.mark.parametrize("name", SESSION_QUERIES)
def test_query_over_staged_sessions_equals_sql(spark, sf_dir, duck, name, monkeypatch):
    """With the aggregated sessions stored on the way, as whole runs do."""
    lazy = pipeline.run_etl
    monkeypatch.setattr(pipeline, "run_etl", lambda *a, **b: lazy(*a, **b, stage=storage.materialise))
    source, make = DEFINITIONS[name]
    df = make(entry.Tables(source, spark, sf_dir))
    assert all("session_base" in file for file in df.inputFiles())
    cursor = duck.execute(sql.oracle(name, source))
    names = [d[0] for d in cursor.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, cursor.fetchall())


def test_the_statistic_is_computed_once(spark, sf_dir):
    plan = executed_plan(entry.queries()["ab_results"](spark, sf_dir))
    assert plan.count("SQRT") < 8
