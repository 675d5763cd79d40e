"""The command line: python -m statewright.plans.cli COMMAND --config FILE --database FOLDER ...

A database is a folder with a Parquet table for each model's table. Commands that change it write the new
states into another folder, --out. Exit codes: 0 agreement or done, 1 differences or findings, 2 wrong use,
3 refused.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from ..sources import history
from . import changeset, config, reports, scaffold
from .project import Project, Report

COMMANDS = ("check", "generate", "plan", "apply", "revert", "sync", "status", "baseline", "export", "scaffold")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="statewright", description="State diffs and guarded changes of master data.")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--config", help="YAML file of models and policies")
    parser.add_argument("--database", help="folder of Parquet tables")
    parser.add_argument("--files", nargs="*", default=[], help="row files, in order")
    parser.add_argument("--revision", help="read the row files as they were at this revision")
    parser.add_argument("--sets", default=".", help="folder of change sets")
    parser.add_argument("--set", help="path of one change set")
    parser.add_argument("--name", default="change", help="name of a new set")
    parser.add_argument("--log", help="folder of the audit log")
    parser.add_argument("--out", help="folder for new states, a baseline or an export")
    parser.add_argument("--json", action="store_true", help="results as JSON")
    return parser


def _database(spark: SparkSession, folder: str, made: config.Config) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{m.table}") for n, m in made.models.items()}


def _written(states: dict[str, DataFrame], made: config.Config, folder: str) -> None:
    for name, df in states.items():
        df.write.mode("overwrite").parquet(f"{folder}/{made.models[name].table}")


def _log(spark: SparkSession, folder: str | None) -> DataFrame | None:
    return spark.read.parquet(folder) if folder and os.path.isdir(folder) else None


def _show(report: Report, as_json: bool) -> int:
    print(reports.check_json(report) if as_json else "\n".join(report.lines()) or "nothing differs")
    return reports.AGREES if report.agree() else reports.DIFFERS


def run(argv: list[str], spark: SparkSession) -> int:
    """One command; its exit code."""
    try:
        args = arguments().parse_args(argv)
    except SystemExit as stop:
        return reports.MISUSED if stop.code else reports.AGREES
    needs = {"check": "config database files", "generate": "config database files", "sync": "config database files out", "plan": "config database set", "apply": "config database set out", "revert": "config database set out", "status": "config log", "baseline": "config database out", "export": "config database out", "scaffold": "database"}
    if missing := [n for n in needs[args.command].split() if not getattr(args, n)]:
        print(f"{args.command} needs --{', --'.join(missing)}", file=sys.stderr)
        return reports.MISUSED
    try:
        return _run(args, spark)
    except Exception as error:  # noqa: BLE001  every error has a verdict
        code, said = reports.verdict(error)
        print(said, file=sys.stderr)
        return code


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "scaffold":
        found = {d: spark.read.parquet(f"{args.database}/{d}") for d in sorted(os.listdir(args.database)) if not d.startswith((".", "_"))}
        found = {n.removesuffix(".parquet"): df for n, df in found.items()}
        print(scaffold.text(scaffold.scaffold({n: found[n] for n in scaffold.listed(list(found))})))
        return reports.AGREES
    made = config.load(args.config)
    project = Project(spark, made, args.sets)
    texts = [history.at(args.revision, f) if args.revision else open(f, encoding="utf-8").read() for f in args.files]
    database = _database(spark, args.database, made) if args.database else {}
    if args.command == "check":
        return _show(project.check(database, project.head(*texts)), args.json)
    if args.command == "generate":
        path = project.generate(args.name, database, project.head(*texts))
        sha = changeset.header(path)["sha256"] if path else None
        print(reports.generated_json(path, sha) if args.json else path or "nothing to do")
        return reports.AGREES
    if args.command == "status":
        log = _log(spark, args.log)
        if log is None:
            print("\n".join(f"{n}: pending" for n in project.names()))
            return reports.DIFFERS if project.names() else reports.AGREES
        status = project.status(log)
        print(reports.status_json(status) if args.json else "\n".join(reports.status_lines(status, log)))
        return reports.AGREES if status.where("not applied or out_of_order or edited or not in_directory").isEmpty() else reports.DIFFERS
    if args.command == "baseline":
        project.baseline(args.out, database)
        return reports.AGREES
    if args.command == "export":
        changeset.write_atomic(args.out, project.export(database, project.head(*texts) if texts else None))
        return reports.AGREES
    if args.command == "sync":
        states, outcomes = project.sync(database, project.head(*texts))
    elif args.command == "plan":
        states, outcomes = project.plan(args.set, database)
    else:
        log = _log(spark, args.log)
        revert = args.command == "revert"
        states, entry = project.apply(args.set, database, log, revert=revert)
        newest = entry.orderBy(entry["id"].desc()).limit(1)
        if args.log:
            newest.write.mode("append").parquet(args.log)
        _written(states, made, args.out)
        print(f"{'reverted' if revert else 'applied'} {changeset.header(args.set)['name']}")
        return reports.AGREES
    if args.command == "sync":
        _written(states, made, args.out)
    print(reports.outcomes_json(outcomes) if args.json else "\n".join(reports.plan_lines(outcomes)) or "nothing to do")
    return reports.AGREES


def main() -> int:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(sys.argv[1:], spark)


if __name__ == "__main__":
    sys.exit(main())
