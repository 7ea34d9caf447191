"""Command line: `spark-submit --py-files ... upliftlens/__main__.py run --raw LOG --out FOLDER`."""

from __future__ import annotations

import argparse
from pathlib import Path

from upliftlens.config import DEFAULT, ExperimentConfig
from upliftlens.operators.assignment import srm_check
from upliftlens.operators.kpis import guardrail_report
from upliftlens.operators.segments import verdict_counts
from upliftlens.operators.treatment import treatment_summary
from upliftlens.plans.pipeline import STAGES, load_tables, run_counts, run_pipeline, run_report, run_stage
from upliftlens.plans.reports import REPORTS
from upliftlens.session import build_session
from upliftlens.sources.events import IDS


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="upliftlens")
    parser.add_argument("--master", help="Spark master, if not set by spark-submit")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run the whole pipeline and store its tables")
    run.add_argument("--raw", required=True, help="CSV event log, file or folder")
    run.add_argument("--out", required=True, help="output folder")
    run.add_argument("--config", type=Path, help="JSON file with parameters that differ from the defaults")
    run.add_argument("--no-csv", action="store_true", help="store Parquet tables only")
    run.add_argument("--multiline", action="store_true", help="quoted fields may span lines")
    run.add_argument("--ids", choices=IDS, default="number", help="read user ids as numbers or as texts of any form")
    run.add_argument("--strict", action="store_true", help="fail on rows that break a declared rule")
    stage = commands.add_parser("stage", help="run one stage again from the stored tables")
    stage.add_argument("--rebuild", action="store_true", help="run stale stages before it again, too")
    stage.add_argument("--out", required=True, help="output folder of an earlier run")
    stage.add_argument("--config", type=Path, help="JSON file with parameters that differ from the defaults")
    stage.add_argument("name", choices=sorted(STAGES))
    show = commands.add_parser("report", help="print one report from stored tables")
    show.add_argument("--out", required=True, help="output folder of an earlier run")
    show.add_argument("name", choices=sorted(REPORTS))
    args = parser.parse_args(argv)

    spark = build_session("upliftlens", args.master)
    config = getattr(args, "config", None)
    cfg = ExperimentConfig.from_json(config.read_text()) if config else DEFAULT
    if args.command == "run":
        policy = "fail" if args.strict else "quarantine"
        tables = run_pipeline(spark, args.raw, args.out, cfg, not args.no_csv, args.multiline, args.ids, policy)
        counts = run_counts(spark, args.out)
        for result in (
            counts["cleaning"],
            counts["run_summary"],
            srm_check(tables["sessions"], cfg),
            treatment_summary(tables["sessions"]),
            guardrail_report(tables["sessions"], cfg),
            verdict_counts(tables["profit_impact"]),
            run_report(tables, "report_kpi_summary"),
            run_report(tables, "report_recommendation"),
        ):
            result.show(truncate=False)
    elif args.command == "stage":
        for name, table in run_stage(spark, args.out, args.name, cfg, args.rebuild).items():
            print(f"{name}: {table.count()} rows")
    else:
        report = run_report(load_tables(spark, args.out), args.name)
        print("\t".join(report.columns))
        for row in report.toLocalIterator():
            print("\t".join("" if value is None else str(value) for value in row))


if __name__ == "__main__":
    main()
