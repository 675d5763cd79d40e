"""Results as text and as JSON with stable keys, and the verdicts on what went wrong."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit
from .changeset import SetError
from .config import Config, ConfigError
from .project import Refused, Report
from .state import StateError

#: Exit codes. Agreement, difference or findings, wrong use, refusal.
AGREES, DIFFERS, MISUSED, REFUSED = 0, 1, 2, 3


def dumped(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2, default=str)


def check_json(report: Report) -> str:
    """A report of a check: agreement, changes by model and kind, numbers of findings, and the findings themselves."""
    found = [r.asDict() for r in report.findings.orderBy("model", "kind", "row").toLocalIterator()]
    return dumped({"agree": report.agree(), "changes": report.summary(), "findings": found})


def outcomes_json(outcomes: DataFrame) -> str:
    """What a plan, an apply or a sync did: numbers by status, and each change that was not simply applied."""
    counts = {r["status"]: r["count"] for r in outcomes.groupBy("status").count().collect()}
    rest = [r.asDict() for r in outcomes.where("status <> 'applied'").orderBy("model", "seq").toLocalIterator()]
    return dumped({"counts": counts, "notes": rest})


def plan_lines(outcomes: DataFrame) -> list[str]:
    """A line for each model, kind and status, then one for each change with a problem."""
    counts = outcomes.groupBy("model", "kind", "status").count().orderBy("model", "kind", "status").collect()
    out = [f"{r['model']}: {r['count']} {r['kind']}{'' if r['count'] == 1 else 's'} {r['status']}" for r in counts]
    return out + [f"change {r['seq']} of {r['model']} {r['key']}: {r['problem']} ({r['mode']})" for r in outcomes.where("status = 'problem'").orderBy("model", "seq").toLocalIterator()]


def status_lines(status: DataFrame, log: DataFrame | None = None) -> list[str]:
    """A line for each set of the directory or the log, the newest run's numbers behind the applied ones."""
    said = {}
    if log is not None:
        newest = audit.latest(log)
        for r in newest.select("set_name", F.size("outcomes").alias("n"), F.col("applied_by").alias("by")).toLocalIterator():
            said[r["set_name"]] = f"{r['n']} changes, by {r['by']}"
    out = []
    for r in status.orderBy("name").toLocalIterator():
        notes = [said.get(r["name"], "applied")] if r["applied"] else ["pending"]
        notes += ["not in the directory"] * (not r["in_directory"]) + ["older than an applied set"] * r["out_of_order"] + ["edited since"] * r["edited"]
        out.append(f"{r['name']}: {', '.join(notes)}")
    return out


def status_json(status: DataFrame) -> str:
    return dumped([r.asDict() for r in status.orderBy("name").toLocalIterator()])


def generated_json(path: str | None, sha256: str | None = None) -> str:
    return dumped({"path": path, "sha256": sha256, "changes": path is not None})


def origin(config: Config, model: str, policy: str) -> str:
    """Where a policy's value comes from."""
    if policy in config.models[model].policy.values:
        return f"policy of {model}"
    return "policy of the project" if policy in config.policy.values else "default"


def verdict(error: Exception) -> tuple[int, str]:
    """(exit code, sentence) of an error: refusals and broken sets are for the user to mend, the rest tells nothing."""
    if isinstance(error, Refused):
        return REFUSED, f"refused: {error}"
    if isinstance(error, (SetError, StateError)):
        return REFUSED, f"broken: {error}"
    if isinstance(error, (ConfigError, FileNotFoundError)):
        return MISUSED, f"cannot start: {error}"
    return MISUSED, f"inconclusive: {type(error).__name__}" + (f" {error.getCondition()}" if isinstance(error, PySparkException) and error.getCondition() else f" {error}")
