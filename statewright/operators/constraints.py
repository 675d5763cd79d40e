"""Declared constraints: what a database would know of its tables, held against frames.

Spark enforces no keys, so tables come with declarations: defaults, checks, unique indexes, foreign keys.
Each can be checked on a state as a whole, which is what deferred constraints come to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import index_clashes
from .lints import Index
from .references import dangling

#: What a foreign key does to the rows that point at a deleted one.
ACTIONS = ("no action", "restrict", "cascade", "set null", "set default")


@dataclass(frozen=True)
class ColumnSpec:
    """A column: its type, whether it takes nulls, its default as written, whether the table computes it."""

    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    generated: bool = False


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    target: str = "id"
    on_delete: str = "no action"


@dataclass(frozen=True)
class Table:
    """A table's declarations. checks are named conditions; a row passes unless a condition is false."""

    name: str
    columns: dict[str, ColumnSpec]
    indexes: tuple[Index, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()


def declared(name: str, df: DataFrame, spec: dict | None = None) -> Table:
    """A table from a frame's schema and what is declared about it (not_null, defaults, generated, unique, checks, references)."""
    spec = spec or {}
    if unknown := set(spec) - {"not_null", "defaults", "generated", "unique", "checks", "references"}:
        raise ValueError(f"{name}: unknown {', '.join(sorted(unknown))}")
    strict, defaults, computed = set(spec.get("not_null", ())), spec.get("defaults", {}), set(spec.get("generated", ()))
    columns = {f.name: ColumnSpec(f.name, f.dataType.simpleString(), f.nullable and f.name not in strict, defaults.get(f.name), f.name in computed) for f in df.schema}
    indexes = tuple(Index(tuple(u["columns"]), u.get("where"), u.get("nulls_equal", False), u.get("valid", True), tuple(u.get("expressions", ()))) for u in spec.get("unique", ()))
    keys = []
    for r in spec.get("references", ()):
        key = ForeignKey(**r)
        if key.on_delete not in ACTIONS:
            raise ValueError(f"{name}.{key.column}: on_delete is one of {', '.join(ACTIONS)}")
        keys.append(key)
    if missing := [c for c in (*strict, *defaults, *computed, *(c for i in indexes for c in i.columns), *(k.column for k in keys)) if c not in columns]:
        raise ValueError(f"{name}: no column {', '.join(missing)}")
    return Table(name, columns, indexes, dict(spec.get("checks", {})), tuple(keys))


def incoming(tables: dict[str, Table], name: str) -> list[tuple[str, ForeignKey]]:
    """(table, foreign key) of all that point at a table."""
    return [(t.name, k) for t in tables.values() for k in t.foreign_keys if k.table == name]


def violations(table: Table, df: DataFrame, key: list[str], others: dict[str, DataFrame]) -> DataFrame:
    """constraint, row (the key, or the digest of clashing values), n: all that a state breaks. Uncapped.

    Unique constraints are looked at once the whole state is there, so values may change places in a set.
    """
    spot = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    one = lambda kind, at: df.where(at).select(F.lit(kind).alias("constraint"), spot.alias("row"), F.lit(1).cast("long").alias("n"))
    parts = [one(f"not null {c.name}", F.col(c.name).isNull()) for c in table.columns.values() if not c.nullable and c.name in df.columns]
    parts += [one(f"check {name}", ~F.coalesce(F.expr(said).cast("boolean"), F.lit(True))) for name, said in table.checks.items()]
    for i in table.indexes:
        if i.valid:
            held = [*map(F.col, i.columns), *map(F.expr, i.expressions)]
            clash = index_clashes(df, held, F.expr(i.where) if i.where else None, i.nulls_equal)
            parts.append(clash.select(F.lit(f"unique {', '.join((*i.columns, *i.expressions))}").alias("constraint"), F.col("digest").alias("row"), F.col("n").cast("long").alias("n")))
    for k in table.foreign_keys:
        if k.table in others:
            lost = dangling(df, k.column, others[k.table], k.target)
            parts.append(lost.select(F.lit(f"reference {k.column}").alias("constraint"), spot.alias("row"), F.lit(1).cast("long").alias("n")))
    if not parts:
        return df.sparkSession.createDataFrame([], "constraint string, row string, n long")
    return reduce(DataFrame.unionByName, parts)


def literal_default(text: str | None) -> str | None:
    """The value of a default that is a literal, casts taken off; None for expressions, which are never evaluated."""
    if text is None:
        return None
    said = bare(text.strip())
    while m := re.fullmatch(r"(?s)(.+)::[A-Za-z_][\w ,.\[\]()\"]*", said):
        said = bare(m[1].strip())
    if m := re.fullmatch(r"(?s)[eE]?'((?:[^']|'')*)'", said):
        return m[1].replace("''", "'")
    if said.lower() in ("true", "false"):
        return said.lower()
    return said if re.fullmatch(r"[+-]?\d+(\.\d+)?", said) else None


def non_null_default(text: str | None) -> tuple[str, bool] | None:
    """(default, whether it is a literal); None where there is no default or it is null."""
    if text is None or re.fullmatch(r"(?i)null(::.*)?", bare(text.strip())):
        return None
    literal = literal_default(text)
    return (literal, True) if literal is not None else (text.strip(), False)


def bare(expression: str) -> str:
    """An expression without parentheses around the whole of it."""
    said = expression.strip()
    while said.startswith("(") and said.endswith(")"):
        depth, quoted = 0, False
        for i, ch in enumerate(said):
            quoted ^= ch == "'"
            if not quoted:
                depth += (ch == "(") - (ch == ")")
            if depth == 0 and i < len(said) - 1:
                return said
        said = said[1:-1].strip()
    return said


def mentions(df: DataFrame, condition: str, column: str) -> bool:
    """Whether a condition reads a column: without that column it has no meaning. The analyser decides, nothing runs."""
    return not _analyses(df.drop(column), condition)


def reads_only(df: DataFrame, expression: str, columns: list[str]) -> bool:
    """Whether an expression needs no columns but these."""
    return _analyses(df.select(*columns), expression)


def _analyses(df: DataFrame, expression: str) -> bool:
    try:
        df.select(F.expr(expression)).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def null_over(df: DataFrame, expression: str, columns: list[str]) -> bool:
    """Whether an expression is null where all these columns are (one row is evaluated)."""
    kinds = {f.name: f.dataType for f in df.schema}
    row = df.sparkSession.createDataFrame([tuple(None for _ in columns)], T.StructType([T.StructField(c, kinds[c]) for c in columns]))
    return row.select(F.expr(expression).isNull()).first()[0]


def definition(index: Index) -> str:
    """An index in words of DDL."""
    parts = ", ".join((*index.columns, *(f"({e})" for e in index.expressions)))
    return f"UNIQUE ({parts})" + (" NULLS NOT DISTINCT" if index.nulls_equal else "") + (f" WHERE {index.where}" if index.where else "") + ("" if index.valid else " (invalid)")


def coalesced(table: Table, index: Index) -> tuple[str, ...]:
    """An index's columns with those that may be null wrapped, so that nulls count as one value."""
    zero = {"string": "''", "boolean": "false"}
    return tuple(f"coalesce({c}, {zero.get(table.columns[c].type, 0)})" if table.columns[c].nullable else c for c in index.columns)


def nulls_remedy(table: Table, index: Index) -> str:
    """What keeps rows with nulls in the key apart."""
    loose = [c for c in index.columns if table.columns[c].nullable]
    return f"declare {', '.join(loose)} NOT NULL, or the index NULLS NOT DISTINCT, or index ({', '.join(coalesced(table, index))})"


def create_index(table: str, key: tuple[str, ...], where: str | None = None) -> str:
    """The index that would back a key."""
    return f"CREATE UNIQUE INDEX ON {table} ({', '.join(key)})" + (f" WHERE {where}" if where else "")


def advice(table: Table, key: tuple[str, ...], said: str, where: str | None = None) -> str:
    """One sentence for each verdict on a key: why nothing backs it, and what would."""
    loose = [c for c in key if c in table.columns and table.columns[c].nullable]
    over = [i for i in table.indexes if set(i.columns) <= set(key)]
    reasons = {
        "backed": "a unique index backs the key",
        "unsure": "an index of expressions may back the key; the data cannot tell",
        "nullable": f"rows with a null in {', '.join(loose)} are not kept apart: " + (nulls_remedy(table, over[0]) if over else "declare the columns NOT NULL"),
        "partial": "an index covers only some of the rows: " + "; ".join(definition(i) for i in over if i.where),
        "superset": "an index of more columns than the key lets two rows hold one key",
        "invalid": "the index is not valid; rebuild it",
        "none": "no unique index backs the key",
    }
    return reasons[said] + ("" if said in ("backed", "unsure", "nullable") else f". {create_index(table.name, key, where)}")
