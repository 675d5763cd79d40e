"""A starter configuration from tables: keys that the data suggests, references that names and values suggest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import key_candidates
from ..operators.lints import Index

#: Column names that suggest a natural key, the best first.
LIKELY = ("code", "slug", "key", "name", "email", "number", "title")


def guess_key(df: DataFrame, id_col: str | None) -> str | None:
    """The text column that no two rows share and whose name suggests a key most; None if there is none."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != id_col]
    if not texts:
        return None
    unique = {r["column"] for r in key_candidates(df, texts).where("is_key").collect()}  # no more rows than columns
    rank = lambda c: (next((i for i, w in enumerate(LIKELY) if c.lower().endswith(w)), len(LIKELY)), texts.index(c))
    return min(unique, key=rank, default=None)


def guess_id(df: DataFrame) -> str | None:
    """id, or the first whole-number column whose name ends in id or key."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    return next((c for c in whole if c == "id"), None) or next((c for c in whole if c.lower().endswith(("id", "key"))), None)


def guess_refs(tables: dict[str, DataFrame], ids: dict[str, str]) -> dict[str, dict[str, str]]:
    """Columns that hold only ids of another table and are named after it."""
    out: dict[str, dict[str, str]] = {}
    for name, df in tables.items():
        for f in df.schema:
            for target, id_col in ids.items():
                stem = id_col.split("_")[-1].removesuffix("key").removesuffix("id") or target.rstrip("s").lower()
                if f.name == ids.get(name) or stem not in f.name.lower() or f.dataType != tables[target].schema[id_col].dataType and not isinstance(f.dataType, T.NumericType):
                    continue
                held = tables[target].select(F.col(id_col).cast("long").alias("__id"))
                if df.where(F.col(f.name).isNotNull()).join(held, F.col(f.name).cast("long") == F.col("__id"), "left_anti").isEmpty():
                    out.setdefault(name, {})[f.name] = target
    return out


def singular(table: str) -> str:
    """A table's name as a model's: words joined and capitalised, the last one in the singular."""
    words = [w for w in re.split("[^A-Za-z0-9]+", table) if w]
    last = words[-1].lower()
    for end, to in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zzes", "z")):
        if last.endswith(end) and len(last) > len(end) + 1:
            last = last[: -len(end)] + to
            break
    else:
        if last.endswith("s") and not last.endswith(("ss", "us", "is")):
            last = last[:-1]
    return "".join(w[:1].upper() + w[1:] for w in [*words[:-1], last])


def listed(tables: list[str], only: tuple[str, ...] = ()) -> list[str]:
    """Tables that hold master data: not those of migration tools, audit logs or partitions (name_p1, name_2024)."""
    kept = [t for t in tables if not only or t in only]
    stems = set(kept)
    part = lambda t: (m := re.fullmatch(r"(.+?)_(p?\d+|default)", t)) and m[1] in stems
    return [t for t in kept if not re.search(r"(^|_)(migrations?|schema_versions?|audit(_log)?|locks?)$", t.lower()) and not part(t)]


def guess_soft_delete(df: DataFrame) -> str | None:
    """The nullable timestamp whose name says that a row was deleted."""
    return next((f.name for f in df.schema if f.nullable and f.dataType.typeName().startswith("timestamp") and re.fullmatch(r"(.*_)?(deleted|removed)_(at|on|time)", f.name.lower())), None)


def guess_written(df: DataFrame, defaults: dict[str, str] | None = None) -> list[str]:
    """Columns that the database writes: timestamps named after a row's making or change, and defaults that call for the time."""
    named = [f.name for f in df.schema if f.dataType.typeName().startswith("timestamp") and re.fullmatch(r"(created|updated|modified|inserted)(_(at|on|time))?", f.name.lower())]
    called = [c for c, d in (defaults or {}).items() if c in df.columns and re.match(r"(?i)\(*\s*(now\(|current_timestamp|transaction_timestamp|clock_timestamp)", d)]
    return list(dict.fromkeys([*named, *called]))


def guess_guard(refs: dict[str, dict[str, str]], order: list[str]) -> str | None:
    """The model that most others refer to, the first in order on a tie: without its rows there is nothing to seed."""
    counts = {m: sum(t == m for columns in refs.values() for t in columns.values()) for m in order}
    best = max(counts.values(), default=0)
    return next((m for m in order if counts[m] == best), None) if best else None


def owner_of(table: str, id_refs: dict[str, str]) -> str:
    """The table at the end of a chain of primary keys that are references, one to one; a circle ends where it began."""
    seen = [table]
    while (up := id_refs.get(seen[-1])) and up not in seen:
        seen.append(up)
    return seen[-1]


def ranked_keys(df: DataFrame, id_col: str | None, indexes: list[Index] = ()) -> list[tuple[str, ...]]:
    """Candidates for the natural key, best first: whole unique indexes without nulls, without a condition, of few columns; then what the data suggests."""
    nullable = {f.name for f in df.schema if f.nullable}
    rank = lambda i: (not i.valid, bool(i.expressions), i.where is not None, bool(set(i.columns) & nullable) and not i.nulls_equal, len(i.columns), i.columns)
    out = [tuple(i.columns) for i in sorted(indexes, key=rank) if i.valid and not i.expressions and i.columns != (id_col,)]
    guess = guess_key(df, id_col)
    return list(dict.fromkeys([*out, *([(guess,)] if guess else [])]))


def text(made: dict) -> str:
    """A scaffolded configuration as YAML, under a header that says what was guessed and from what."""
    import yaml

    names = list(made["models"])
    lines = ["# Guessed from the tables' data: keys are text columns that no two rows share, references are columns", "# whose values are all ids of another table. Check each before use.", f"# Models: {', '.join(names) or 'none'}"]
    return "\n".join(lines) + "\n" + yaml.safe_dump(made, sort_keys=False)


def scaffold(tables: dict[str, DataFrame]) -> dict:
    """A configuration's dictionary for plans.config.from_dict; tables without a key are left out."""
    ids = {n: i for n, df in tables.items() if (i := guess_id(df))}
    refs = guess_refs(tables, ids)
    models = {}
    for name, df in tables.items():
        key = guess_key(df, ids.get(name))
        if key:
            models[name] = {"table": name, "id": ids.get(name), "key": [key], "ref": key, "refs": refs.get(name, {})}
            if gone := guess_soft_delete(df):
                models[name]["soft_delete"] = gone
            if written := guess_written(df):
                models[name]["ignore"] = written
    for m in models.values():
        m["refs"] = {c: t for c, t in m["refs"].items() if t in models}
    return {"models": models}
