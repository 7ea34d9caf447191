import hashlib
import os
import shutil

import pytest
from conftest import executed_plan, rows
from pyspark.sql import functions as F

from upliftlens import schemas
from upliftlens.__main__ import main
from upliftlens.config import ExperimentConfig
from upliftlens.operators import sessions
from upliftlens.operators.segments import segment_results
from upliftlens.plans import pipeline
from upliftlens.plans.reports import REPORTS
from upliftlens.sources import runs, sizing, storage
from upliftlens.sources.adapters import from_events
from upliftlens.sources.events import load_raw


@pytest.fixture(scope="module")
def raw_path(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "events")
    storage.write_csv(from_events(spark, sf_dir).select(*schemas.RAW_EVENTS.names), path)
    return path


def test_whole_run_restart_and_rerun(spark, raw_path, tmp_path):
    out = str(tmp_path / "out")
    tables = pipeline.run_pipeline(spark, raw_path, out)
    assert set(tables) == set(schemas.TABLES)
    first = {name: rows(df) for name, df in tables.items()}
    for name, schema in schemas.TABLES.items():
        assert tables[name].schema.simpleString() == schema.simpleString()
        back = storage.read_csv(spark, f"{runs.latest(spark, out).folder}/csv/{name}", schema)
        assert rows(back) == first[name]

    # a stage restarts from what is stored, and running it twice changes nothing
    stored = runs.latest(spark, out).tables["untreated_sessions"].read(spark)
    for _ in range(2):
        treated, kpi = pipeline.run_experiment(stored)
        assert rows(treated) == first["sessions"]
        assert rows(kpi) == first["ab_results"]
    segment, profit = pipeline.run_segments(pipeline.load_tables(spark, out)["sessions"])
    assert rows(segment) == first["segment_results"]
    assert rows(profit) == first["profit_impact"]

    again = pipeline.run_pipeline(spark, raw_path, out, csv=False)
    assert {name: rows(df) for name, df in again.items()} == first

    # totals of every segment type equal the group KPIs
    totals = again["segment_results"].groupBy("segment_type", "ab_group").agg(
        F.sum("sessions").alias("n"), F.sum("net_revenue").alias("net")
    )
    by_group = {r.ab_group: r for r in again["ab_results"].collect()}
    for r in totals.collect():
        assert r.n == by_group[r.ab_group].sessions
        assert r.net == pytest.approx(by_group[r.ab_group].net_revenue)


def test_every_report_runs_on_stored_tables_and_as_views(spark, raw_path, tmp_path):
    out = str(tmp_path / "out")
    tables = pipeline.run_pipeline(spark, raw_path, out, csv=False)
    for name in REPORTS:
        assert pipeline.run_report(tables, name).collect()
    for _ in range(2):
        pipeline.register_tables(spark, out)
    assert rows(spark.table("default.profit_impact")) == rows(tables["profit_impact"])
    assert spark.table("default.sessions").schema.simpleString() == schemas.TREATED_SESSIONS.simpleString()
    for name in schemas.TABLES:
        storage.drop_table(spark, f"default.{name}")
    pipeline.register_views(tables)
    buyers = spark.sql(
        """WITH paid AS (SELECT * FROM sessions WHERE converted = 1)
           SELECT max_by(s.hour, n) AS busiest, sum(n) AS buyers, count(DISTINCT p.verdict) AS verdicts
           FROM (SELECT hour, count(*) AS n FROM paid GROUP BY hour) s CROSS JOIN
                (SELECT DISTINCT verdict FROM profit_impact) p"""
    ).first()
    verdicts = tables["profit_impact"].select("verdict").distinct().count()
    assert buyers.verdicts == verdicts
    assert buyers.buyers == verdicts * tables["sessions"].filter("converted = 1").count()


def test_command_line(spark, raw_path, tmp_path, capsys):
    out = str(tmp_path / "cli")
    parameters = tmp_path / "parameters.json"
    parameters.write_text('{"experiment_name": "other", "split_ratio": 0.2}')
    main(["run", "--raw", raw_path, "--out", out, "--no-csv", "--config", str(parameters)])
    assert "Total Segments Analysed" in capsys.readouterr().out
    share = {r.ab_group: r.sessions for r in pipeline.load_tables(spark, out)["ab_results"].collect()}
    assert share["A"] < 0.5 * share["B"]
    assert not os.path.exists(f"{runs.latest(spark, out).folder}/csv")
    main(["report", "--out", out, "report_weekend"])
    assert "Weekday" in capsys.readouterr().out
    before = rows(pipeline.load_tables(spark, out)["profit_impact"])
    for stage in ("experiment", "segments"):
        main(["stage", "--out", out, "--config", str(parameters), stage])
    assert "profit_impact" in capsys.readouterr().out
    assert rows(pipeline.load_tables(spark, out)["profit_impact"]) == before


def test_a_run_keeps_what_it_removed(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text(
        "event_time,event_type,product_id,category_code,brand,price,user_id,user_session\n"
        "2019-12-01 10:00:00 UTC,view,1,a.b,x,5.5,12345.0,s1\n"
        "2019-12-01 10:01:00 UTC,purchase,1,a.b,x,5.5,12345,s1\n"
        "2019-12-01 10:02:00 UTC,view,1,a.b,x,5.5,u-77,s2\n"
        "2019-12-01 10:03:00 UTC,view,1,a.b,x,5.5,,s3\n"
        "no time,view,1,a.b,x,5.5,9,s4\n"
    )
    out = str(tmp_path / "out")
    pipeline.run_pipeline(spark, str(log), out, csv=False)
    counts = pipeline.run_counts(spark, out)
    seen = counts["cleaning"].first()
    assert (seen.rows_before, seen.rows_after, seen.rows_removed) == (5, 2, 3)
    assert counts["rejected_events"].count() == seen.rows_removed
    assert counts["rejected_events"].filter("user_id_text = 'u-77'").count() == 1
    assert counts["run_summary"].first().sessions == 1


def test_a_run_reads_the_log_once(spark, raw_path, tmp_path, monkeypatch):
    """The log goes away as soon as its rows are stored: nothing later may read it."""
    log = shutil.copytree(raw_path, str(tmp_path / "log"))
    plain = runs.Run.store

    def store(run, df, name, made_of=""):
        stored = plain(run, df, name, made_of)
        if name == "events":
            shutil.rmtree(log)
        return stored

    monkeypatch.setattr(runs.Run, "store", store)
    tables = pipeline.run_pipeline(spark, log, str(tmp_path / "out"), csv=False)
    assert tables["profit_impact"].count() > 0
    counts = pipeline.run_counts(spark, str(tmp_path / "out"))
    assert counts["cleaning"].first().rows_before == load_raw(spark, raw_path).count()


def test_a_killed_run_leaves_the_one_before_it(spark, raw_path, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError, match="no published run"):
        pipeline.load_tables(spark, out)
    first = {name: rows(df) for name, df in pipeline.run_pipeline(spark, raw_path, out, csv=False).items()}
    other = ExperimentConfig(experiment_name="other", split_ratio=0.3)
    plain = pipeline._gated

    def dies(run, df, name, *rest):
        if name == "segment_results":  # sessions and ab_results are written by then
            raise KeyboardInterrupt
        return plain(run, df, name, *rest)

    monkeypatch.setattr(pipeline, "_gated", dies)
    with pytest.raises(KeyboardInterrupt):
        pipeline.run_pipeline(spark, raw_path, out, other, csv=False)
    assert len(os.listdir(f"{out}/runs")) == 2
    assert {name: rows(df) for name, df in pipeline.load_tables(spark, out).items()} == first
    monkeypatch.undo()
    held = pipeline.load_tables(spark, out)
    second = pipeline.run_pipeline(spark, raw_path, out, other, csv=False)
    assert rows(second["sessions"]) != first["sessions"]
    assert rows(pipeline.load_tables(spark, out)["profit_impact"]) == rows(second["profit_impact"])
    assert {name: rows(df) for name, df in held.items()} == first  # who holds the old run reads it whole


def test_a_stage_knows_what_it_reads(spark, raw_path, tmp_path):
    out, log = str(tmp_path / "out"), shutil.copytree(raw_path, str(tmp_path / "log"))
    pipeline.run_pipeline(spark, log, out, csv=False)
    # a parameter of the last stage only: nothing before it is stale
    floor = ExperimentConfig(break_even_floor=-1e12)
    verdicts = pipeline.run_stage(spark, out, "segments", floor)["profit_impact"].select("verdict").distinct()
    assert "Loss" not in {r.verdict for r in verdicts.collect()} or verdicts.count() > 1
    # a parameter of the stage before it
    other = ExperimentConfig(split_ratio=0.2)
    with pytest.raises(pipeline.StaleStage, match="'experiment'.*parameters have changed"):
        pipeline.run_stage(spark, out, "segments", other)
    rebuilt = pipeline.run_stage(spark, out, "segments", other, rebuild=True)
    assert set(rebuilt) == {"sessions", "ab_results", "segment_results", "profit_impact"}
    fresh = pipeline.run_pipeline(spark, log, str(tmp_path / "fresh"), other, csv=False)
    assert {n: rows(t) for n, t in rebuilt.items()} == {n: rows(t) for n, t in fresh.items()}
    # one stage alone: tables of the next one would mix two sets of parameters
    pipeline.run_stage(spark, out, "experiment", ExperimentConfig(split_ratio=0.4))
    with pytest.raises(pipeline.StaleStage, match="segments"):
        pipeline.load_tables(spark, out)
    # buckets are part of the first stage
    with pytest.raises(pipeline.StaleStage, match="'etl'.*parameters have changed"):
        pipeline.run_stage(spark, out, "experiment", ExperimentConfig(no_bucket_label="none"))
    # the log itself
    with open(f"{log}/more.csv", "w") as more:
        more.write(",".join(schemas.RAW_EVENTS.names) + "\n2019-12-01 10:00:00,view,1,a.b,x,5.5,999999999,new-session\n")
    with pytest.raises(pipeline.StaleStage, match="'etl'.*log has changed"):
        pipeline.run_stage(spark, out, "experiment", other)
    again = pipeline.run_stage(spark, out, "experiment", other, rebuild=True)
    assert again["sessions"].filter("user_session = 'new-session'").count() == 1


def test_text_ids_through_the_whole_run(spark, tmp_path):
    log = tmp_path / "log.csv"
    ids = ["12345.0", "12345", " 12345", "u-77", "u-77 ", "", "NaN", "0x1F", "9" * 30]
    lines = [f"2019-12-01 10:0{i}:00 UTC,purchase,1,a.b,x,5.5,{u},s{i}" for i, u in enumerate(ids)]
    log.write_text(",".join(schemas.RAW_EVENTS.names) + "\n" + "\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    tables = pipeline.run_pipeline(spark, str(log), out, csv=True, ids="text")
    got = {(r.user_id, r.user_session): r for r in tables["sessions"].collect()}
    assert {u for u, _ in got} == {"12345", "u-77", "0x1F", "9" * 30}
    assert got["12345", "s0"].total_sessions == 3 and got["u-77", "s4"].total_sessions == 2
    for user in ("12345", "u-77", "0x1F", "9" * 30):
        bucket = int(hashlib.md5(f"{user}_Coupon_Test_V1".encode()).hexdigest(), 16) % 100
        assert {r.ab_group for (u, _), r in got.items() if u == user} == {"B" if bucket >= 50 else "A"}
    seen = pipeline.run_counts(spark, out)["cleaning"].first()
    assert (seen.rows_before, seen.rows_after, seen.rows_removed) == (9, 7, 2)
    pipeline.register_tables(spark, out)
    assert dict(spark.table("default.sessions").dtypes)["user_id"] == "string"
    for name in schemas.TABLES:
        storage.drop_table(spark, f"default.{name}")
    with pytest.raises(ValueError, match="ids must be"):
        load_raw(spark, str(log), ids="uuid")


def test_two_ids_under_one_surrogate_end_the_query(spark, monkeypatch):
    monkeypatch.setattr(sessions, "surrogate", lambda key: F.unhex(F.md5(F.substring(key, 1, 1))))
    base = spark.createDataFrame([("s1", "ab"), ("s2", "ac"), ("s3", "b")], "user_session string, user_id string")
    with pytest.raises(Exception, match="share 128 bits"):
        sessions.user_session_counts(base).collect()


def test_rows_that_break_rules_are_set_aside(spark, raw_path, tmp_path, monkeypatch):
    plain = pipeline.treat

    def damaged(df, cfg):
        return plain(df, cfg).withColumn("user_type", F.when(F.col("user_id") % 3 == 0, "Lapsed").otherwise(F.col("user_type")))

    monkeypatch.setattr(pipeline, "treat", damaged)
    out = str(tmp_path / "out")
    tables = pipeline.run_pipeline(spark, raw_path, out)
    counts = pipeline.run_counts(spark, out)
    aside = counts["quarantine_sessions"]
    assert {r.rules for r in aside.select("rules").distinct().collect()} == {"user_type in (New,Returning)"}
    assert aside.count() + tables["sessions"].count() == counts["run_summary"].first().sessions
    assert tables["sessions"].filter("user_type = 'Lapsed'").count() == 0
    gates = runs.latest(spark, out).about["gates"]
    assert gates["sessions"]["user_type in (New,Returning)"] == aside.count() > 0
    with pytest.raises(ValueError, match="user_type"):
        pipeline.run_pipeline(spark, raw_path, out, on_violation="fail")


def test_catalog_tables_declare_their_defaults(spark, raw_path, tmp_path):
    out = str(tmp_path / "out")
    pipeline.run_pipeline(spark, raw_path, out, csv=False)
    pipeline.register_tables(spark, out)
    before = spark.table("default.sessions").count()
    new = spark.createDataFrame([("fresh", 5)], "user_session string, user_id bigint")
    storage.insert_by_name(new, "default.sessions")
    row = spark.table("default.sessions").filter("user_session = 'fresh'").first()
    assert [row[c] for c in schemas.DEFAULTS] == [0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0]
    assert row.brand is None and spark.table("default.sessions").count() == before + 1
    for name in schemas.TABLES:
        storage.drop_table(spark, f"default.{name}")


def test_sized_sessions_keep_the_callers_settings(spark, raw_path, monkeypatch):
    assert sizing.sized_session(spark, raw_path) is spark
    size = sizing.stored_bytes(spark, raw_path)
    assert size == sum(os.path.getsize(f"{raw_path}/{p}") for p in os.listdir(raw_path) if not p.startswith((".", "_")))
    monkeypatch.setattr(sizing, "INPUT_PER_PARTITION", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12345")
    try:
        own = sizing.sized_session(spark, raw_path)
        assert int(own.conf.get(sizing.WIDTH)) == size // 1000 > 4
        assert own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "12345b" or own.conf.get(
            "spark.sql.autoBroadcastJoinThreshold"
        ).startswith("12345")
        assert own.conf.get("spark.sql.session.timeZone") == "UTC"
        assert spark.conf.get(sizing.WIDTH) == "4"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def hot_events(spark, n=60000):
    """A third of all events is one session, another third is one user's many sessions."""
    i = F.col("id")
    hot_session, hot_user = i % 3 == 0, i % 3 == 1
    return spark.range(0, n, 1, 6).select(
        F.expr("timestamp_ntz'2019-12-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("event_time"),
        F.when(i % 11 == 0, "purchase").when(i % 4 == 0, "cart").otherwise("view").alias("event_type"),
        F.when(hot_session | hot_user, 7).otherwise(i % 5000 + 100).cast("bigint").alias("user_id"),
        F.when(hot_session, "hot").otherwise(F.concat(F.lit("s"), (i / 6).cast("bigint").cast("string"))).alias("user_session"),
        ((i % 97) * 0.37).alias("price"),
        F.concat(F.lit("c"), (i % 10).cast("string")).alias("category_top"),
        F.lit("b").alias("brand"),
    )


def test_hot_session_and_hot_user(spark):
    events = hot_events(spark)
    got = {(r.user_session, r.user_id): r for r in sessions.build_sessions(events).collect()}
    assert sum(r.views + r.carts + r.purchases for r in got.values()) == 60000
    hot = got["hot", 7]
    assert hot.views + hot.carts + hot.purchases == 20000
    assert hot.category_top == "c0" and hot.hour == 0
    per_user = events.groupBy("user_id").agg(F.count_distinct("user_session").alias("n")).collect()
    expected = {r.user_id: r.n for r in per_user}
    assert all(r.total_sessions == expected[u] for (_, u), r in got.items())


def test_hot_session_is_aggregated_before_the_shuffle(spark):
    base = sessions.session_build(hot_events(spark))
    plan = executed_plan(base)
    shuffle = plan.index("Exchange hashpartitioning")
    assert "Aggregate(" in plan[:shuffle] and "partial_min" in plan[shuffle:]
    assert "SortAggregate" in plan
    assert "SortAggregate" not in executed_plan(base.drop("category_top", "brand"))


def spread(df, label):
    """Stored in several files, so that several tasks write the shuffle, as in any large input."""
    return storage.materialise(df.repartition(6), label)


def test_hot_user_partition_is_split_in_the_join(spark, tmp_path):
    """With thresholds scaled down to the test, the adaptive plan splits the hot user's partition."""
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        events = hot_events(spark)
        # lazily the partition is split at run time; over stored sessions the user is known and dealt out
        for built, sign in ((sessions.build_sessions(events), "skew=true"), (sessions.build_sessions(events, stage=spread), "join_part")):
            for final in (built, segment_results(pipeline.treat(built))):
                final.collect()
                assert sign in executed_plan(final)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_heavy_users_are_dealt_out_by_design(spark):
    """At the default thresholds of adaptive execution: one user owns a third of the sessions."""
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    i = F.col("id")
    for cast in ("bigint", "string"):
        base = spark.range(0, 120000, 1, 6).select(
            F.concat(F.lit("s"), i.cast("string")).alias("user_session"),
            F.when(i % 3 == 0, 7).otherwise(i % 20000 + 100).cast(cast).alias("user_id"),
        )
        counts = sessions.user_session_counts(base)
        heavy = sessions.heavy_users(base)
        assert heavy == [7 if cast == "bigint" else "7"]
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            joined = storage.materialise(sessions.with_user_type(base, counts, heavy), "joined")
            sizes = sorted(r.n for r in sessions.with_user_type(base, counts, heavy)
                           .groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
            plain = sorted(r.n for r in sessions.with_user_type(base, counts)
                           .groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        finally:
            for k in settings:
                spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]
        assert plain[-1] > 4 * plain[8]
        assert rows(joined.groupBy("total_sessions", "user_type").count()) == rows(
            sessions.with_user_type(base, counts).groupBy("total_sessions", "user_type").count()
        )
