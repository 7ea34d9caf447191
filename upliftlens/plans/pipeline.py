"""The three stages, each with a table as its boundary, and the whole run."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upliftlens import schemas
from upliftlens.config import DEFAULT, ExperimentConfig
from upliftlens.operators import quality
from upliftlens.operators.assignment import assign_groups
from upliftlens.operators.clean import clean_events, observe_cleaning, observed_metrics, rejected_events
from upliftlens.operators.kpis import ab_results
from upliftlens.operators.segments import profit_impact, segment_results
from upliftlens.operators.sessions import Stage, build_sessions, run_summary
from upliftlens.operators.treatment import apply_treatment
from upliftlens.plans.reports import REPORTS
from upliftlens.sources.events import INPUT_ORDER, load_raw
from upliftlens.sources.runs import Manifest, Run, fingerprint, input_fingerprint, latest
from upliftlens.sources.sizing import sized_session
from upliftlens.sources.storage import declare_table, write_csv


def run_etl(
    raw: DataFrame,
    cfg: ExperimentConfig = DEFAULT,
    order_by: tuple[str, ...] | None = None,
    texts: bool = True,
    stage: Stage | None = None,
) -> DataFrame:
    """Stage 1: raw events -> sessions.

    Lazy without `stage`; with it, the aggregated sessions are stored on the way and the events are
    read once. The caller chooses; both ways give the same rows.
    """
    return build_sessions(clean_events(raw), cfg, order_by, stage, texts)


def treat(sessions: DataFrame, cfg: ExperimentConfig = DEFAULT) -> DataFrame:
    """Sessions -> treated sessions: a projection from end to end. The texts may be absent."""
    treated = apply_treatment(assign_groups(sessions, cfg), cfg)
    return schemas.conform(treated, schemas.TREATED_SESSIONS, schemas.FIRST_TEXTS)


def run_experiment(
    sessions: DataFrame, cfg: ExperimentConfig = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Stage 2: sessions -> (treated sessions, KPI table)."""
    treated = treat(sessions, cfg)
    return treated, ab_results(treated, cfg)


def run_segments(
    treated: DataFrame, cfg: ExperimentConfig = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Stage 3: treated sessions -> (segment table, profit table)."""
    segments = segment_results(treated)
    return segments, profit_impact(segments, cfg)


# The parameters that each stored table depends on, beside the table that it is made of.
PARAMETERS = {
    "untreated_sessions": ("price_bins", "price_labels", "no_bucket_label"),
    "sessions": (
        "experiment_name",
        "split_ratio",
        "base_conversion_lift",
        "price_multipliers",
        "new_user_multiplier",
        "cart_abandon_multiplier",
        "weekend_multiplier",
        "max_lift_probability",
        "max_coupon_value",
        "max_coupon_pct",
    ),
    "ab_results": ("confidence_level",),
    "segment_results": (),
    "profit_impact": ("break_even_floor",),
}
MADE_OF = {
    "untreated_sessions": "input",
    "sessions": "untreated_sessions",
    "ab_results": "sessions",
    "segment_results": "sessions",
    "profit_impact": "segment_results",
}
# Stage -> the table it reads and the tables it writes
STAGES = {
    "etl": ("input", ("untreated_sessions",)),
    "experiment": ("untreated_sessions", ("sessions", "ab_results")),
    "segments": ("sessions", ("segment_results", "profit_impact")),
}


class StaleStage(ValueError):
    """What a stage would read was made with other parameters or from other input."""


def fingerprints(source: str, cfg: ExperimentConfig) -> dict[str, str]:
    """For each table a hash of the input and of all parameters that it depends on."""
    found, values = {"input": source}, asdict(cfg)
    for table, parent in MADE_OF.items():
        found[table] = fingerprint(table, found[parent], [(p, values[p]) for p in PARAMETERS[table]])
    return found


def _publishable(df: DataFrame) -> DataFrame:
    return schemas.apply_defaults(df)


def _gated(run: Run, df: DataFrame, name: str, made_of: dict[str, str], on_violation: str) -> DataFrame:
    """Store what keeps the declared rules; rows that break one go to a quarantine table beside it."""
    folder = run.path(name)
    accepted, broken, counts = quality.gate(_publishable(df), name, folder)
    if counts["checked"] > counts["accepted"]:
        if on_violation == "fail":
            named = [f"{rule}: {counts[rule]}" for rule in quality.rule_names(name) if counts[rule]]
            raise ValueError(f"rows of {name} break declared rules ({'; '.join(named)}); see {folder}/part=quarantine")
        run.store(broken, f"quarantine_{name}", made_of[name])
    run.about.setdefault("gates", {})[name] = counts
    return run.add(name, f"{folder}/part=accepted", accepted.schema, made_of[name])


def _run_etl_stage(run: Run, raw_path: str, cfg: ExperimentConfig, multiline: bool, ids: str, made_of: dict[str, str]) -> DataFrame:
    """The log is read once: its rows are stored, split by validity, and counted on the way."""
    raw = load_raw(run.spark, raw_path, multiline, ids)
    flagged, seen = observe_cleaning(raw)
    events = run.store(flagged, "events", made_of["input"])
    run.store(observed_metrics(seen, run.spark), "cleaning", made_of["input"])
    run.store(rejected_events(events.filter("not valid").drop("valid", INPUT_ORDER)), "rejected_events", made_of["input"])

    def stage(df: DataFrame, name: str) -> DataFrame:
        return run.store(df, name, made_of["untreated_sessions"])

    kept = events.filter(F.col("valid")).drop("valid")
    sessions = run.store(run_etl(kept, cfg, stage=stage), "untreated_sessions", made_of["untreated_sessions"])
    run.store(run_summary(sessions), "run_summary", made_of["untreated_sessions"])
    return sessions


def _run_experiment_stage(run: Run, sessions: DataFrame, cfg: ExperimentConfig, made_of: dict[str, str], on_violation: str) -> DataFrame:
    treated = _gated(run, treat(sessions, cfg), "sessions", made_of, on_violation)
    _gated(run, ab_results(treated, cfg), "ab_results", made_of, on_violation)
    return treated


def _run_segments_stage(run: Run, treated: DataFrame, cfg: ExperimentConfig, made_of: dict[str, str], on_violation: str) -> None:
    segments = _gated(run, segment_results(treated), "segment_results", made_of, on_violation)
    _gated(run, profit_impact(segments, cfg), "profit_impact", made_of, on_violation)


def run_pipeline(
    spark: SparkSession,
    raw_path: str,
    out_dir: str,
    cfg: ExperimentConfig = DEFAULT,
    csv: bool = True,
    multiline: bool = False,
    ids: str = "number",
    on_violation: str = "quarantine",
) -> dict[str, DataFrame]:
    """Everything, from a CSV event log to stored tables; returns the tables that reports read.

    The log is scanned once. A stage reads what the stage before it stored, so nothing is computed twice. All
    tables go to a folder of this run; its manifest row comes last, so readers see the whole run or none of it.
    Rows that break a declared rule are stored apart, or end the run if `on_violation` is "fail". `ids` says
    how user ids are read, see `load_raw`. Shuffles are as wide as the log needs, whatever the session says.
    """
    if on_violation not in ("quarantine", "fail"):
        raise ValueError("on_violation must be 'quarantine' or 'fail'")
    load_raw(spark, raw_path, multiline, ids)  # missing files and columns are told here
    source = input_fingerprint(spark, raw_path)
    about = {"raw": raw_path, "multiline": multiline, "ids": ids, "on_violation": on_violation, "input": source, "csv": csv}
    run, made_of = Run(sized_session(spark, raw_path), out_dir, about), fingerprints(source, cfg)
    sessions = _run_etl_stage(run, raw_path, cfg, multiline, ids, made_of)
    treated = _run_experiment_stage(run, sessions, cfg, made_of, on_violation)
    _run_segments_stage(run, treated, cfg, made_of, on_violation)
    if csv:
        _write_csv(run, schemas.TABLES)
    return _tables(spark, run.publish())


def _write_csv(run: Run, names) -> None:
    for name in names:
        write_csv(run.tables[name].read(run.spark), f"{run.folder}/csv/{name}")


def _tables(spark: SparkSession, manifest: Manifest) -> dict[str, DataFrame]:
    return {name: manifest.tables[name].read(spark) for name in schemas.TABLES}


COUNTS = ("cleaning", "run_summary", "rejected_events")


def run_counts(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """Of the latest run: events before and after cleaning, the events removed, sessions and users, quarantined rows."""
    found = latest(spark, out_dir).tables
    return {name: t.read(spark) for name, t in found.items() if name in COUNTS or name.startswith("quarantine_")}


def run_stage(
    spark: SparkSession, out_dir: str, stage: str, cfg: ExperimentConfig = DEFAULT, rebuild: bool = False
) -> dict[str, DataFrame]:
    """One stage again, from what the stage before it stored; published as a new run with the other tables as they were.

    What the stage reads must have been made with the parameters of `cfg` and from the log as it is now. If
    not, the call fails and names the stage that is stale, or runs that stage again if `rebuild` is set.
    Tables of later stages stay in the new run only while they fit; others would mix two sets of parameters.
    """
    if stage not in STAGES:
        raise ValueError(f"no such stage: {stage}")
    before = latest(spark, out_dir)
    about = before.about
    now = input_fingerprint(spark, about["raw"])
    order = list(STAGES)
    wanted = fingerprints(now, cfg)
    stale = [
        name for name in order[: order.index(stage)]
        if any(before.tables[t].fingerprint != wanted[t] for t in STAGES[name][1])
    ]
    if stale and not rebuild:
        why = "the log has changed" if now != about["input"] else "the parameters have changed"
        raise StaleStage(f"stage '{stage}' reads what stage '{stale[0]}' stored, and {why} since: run '{stale[0]}' first")
    first = order.index(stale[0] if stale else stage)
    fits = {name: t for name, t in before.tables.items() if wanted.get(name, t.fingerprint) == t.fingerprint}
    run = Run(sized_session(spark, about["raw"]), out_dir, {**about, "input": now, "stage": stage}, dict(fits))
    written: list[str] = []
    for name in order[first : order.index(stage) + 1]:
        source, targets = STAGES[name]
        if name == "etl":
            _run_etl_stage(run, about["raw"], cfg, about["multiline"], about["ids"], wanted)
        elif name == "experiment":
            _run_experiment_stage(run, run.tables[source].read(run.spark), cfg, wanted, about["on_violation"])
        else:
            _run_segments_stage(run, run.tables[source].read(run.spark), cfg, wanted, about["on_violation"])
        written += targets
    if about["csv"]:
        _write_csv(run, [name for name in schemas.TABLES if name in run.tables])
    manifest = run.publish()
    return {name: manifest.tables[name].read(spark) for name in written}


def load_tables(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of the latest published run. A stage run alone may have left later tables out."""
    manifest = latest(spark, out_dir)
    missing = [name for name in schemas.TABLES if name not in manifest.tables]
    if missing:
        raise StaleStage(f"run stage 'segments' for {', '.join(missing)}: the stored ones had other parameters")
    return _tables(spark, manifest)


def register_tables(spark: SparkSession, out_dir: str, database: str = "default") -> None:
    """Enter the tables of the latest run into the catalog, with declared types and defaults; no data is copied."""
    manifest = latest(spark, out_dir)
    for name, schema in schemas.TABLES.items():
        stored = manifest.tables[name]
        shape = schemas.for_ids(schema, stored.read(spark))
        declare_table(spark, f"{database}.{name}", shape, schemas.DEFAULTS, stored.path)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make the tables available to `spark.sql` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_report(tables: dict[str, DataFrame], name: str) -> DataFrame:
    source, report = REPORTS[name]
    return report(tables[source])
