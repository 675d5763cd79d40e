"""Lints: findings with kind, row, detail and unsure, and the verdict on a natural key."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import float_reading_differs, is_zero, session_dependent, too_long
from .diff import left_out
from .groups import equal_keys


def findings(df: DataFrame, kind: str, row: Column, at: Column, detail: Column | str, unsure: bool = False) -> DataFrame:
    said = F.lit(detail) if isinstance(detail, str) else detail
    return df.where(at).select(F.lit(kind).alias("kind"), row.cast("string").alias("row"), said.cast("string").alias("detail"), F.lit(unsure).alias("unsure"))


def zero_defaults(df: DataFrame, row: Column, defaults: dict[str, str]) -> DataFrame:
    """Zeros (not nulls) where the column's default is something else: a load would write the default."""
    hits = F.filter(F.array(*[F.when(is_zero(df, c) & F.col(c).isNotNull(), F.lit(c)) for c, d in defaults.items() if d not in ("", "0", "false")]), lambda x: x.isNotNull())
    return df.select(row.alias("__row"), F.explode(hits).alias("c")).select(F.lit("zero_default").alias("kind"), F.col("__row").cast("string").alias("row"), F.col("c").alias("detail"), F.lit(False).alias("unsure"))


def null_defaults(df: DataFrame, row: Column, columns: list[str]) -> DataFrame:
    """Nulls where the column has a default or must not be null."""
    hits = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(row.alias("__row"), F.explode(hits).alias("c")).select(F.lit("null_default").alias("kind"), F.col("__row").cast("string").alias("row"), F.col("c").alias("detail"), F.lit(False).alias("unsure"))


def invalid_casts(df: DataFrame, row: Column, column: str, as_type: str) -> DataFrame:
    """Texts that the column's type does not take; a null is no text."""
    return findings(df, "invalid_value", row, F.col(column).isNotNull() & F.col(column).try_cast(as_type).isNull(), F.col(column))


def long_values(df: DataFrame, row: Column, column: str, kind: str, n: int) -> DataFrame:
    return findings(df, "too_long", row, too_long(F.col(column), kind, n), F.char_length(column).cast("string"))


def moving_values(df: DataFrame, row: Column, column: str) -> DataFrame:
    return findings(df, "session_dependent", row, F.coalesce(session_dependent(F.col(column)), F.lit(False)), F.col(column))


def float_readings(df: DataFrame, row: Column, column: str) -> DataFrame:
    return findings(df, "float_reading", row, float_reading_differs(F.col(column)), F.col(column), unsure=True)


def unknown_columns(df: DataFrame, known: list[str], generated: list[str] = ()) -> list[str]:
    """Columns of the files that the table does not have or generates itself."""
    return [c for c in df.columns if c not in known or c in generated]


def json_nulls(df: DataFrame, row: Column, column: str, has_default: bool = False) -> DataFrame:
    """Nulls in a JSON column without a default: null the value and null the JSON cannot be told apart."""
    return findings(df, "json_null", row, F.col(column).isNull() & F.lit(not has_default), F.lit(column))


def zero_times(df: DataFrame, row: Column, column: str) -> DataFrame:
    """Rows whose soft-delete column holds the zero time, which reads as deleted and is meant as not."""
    return findings(df, "zero_time", row, F.year(column) <= 1, F.lit(column))


def soft_delete_problem(schema, column: str, nullable: bool = True, default: str | None = None) -> str | None:
    """Why a column cannot be a soft-delete column: it must be a nullable timestamp without a default."""
    kinds = {f.name: f.dataType.typeName() for f in schema}
    if column not in kinds:
        return "no such column"
    if not kinds[column].startswith("timestamp"):
        return f"{kinds[column]} is no timestamp"
    return "must be nullable" if not nullable else "must not have a default" if default is not None else None


def by_kind(found: DataFrame) -> DataFrame:
    """kind, n, unsure: how many findings of each kind, and how many of them are unsure."""
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("unsure").alias("unsure"))


def worst(found: DataFrame, modes: dict[str, str], *by: str) -> DataFrame:
    """by, mode: the worst that the findings' kinds come to; a kind without a mode is an error."""
    rank = F.lit(2)
    for kind, mode in modes.items():
        rank = F.when(F.col("kind") == kind, {"ignore": 0, "warn": 1, "error": 2}[mode]).otherwise(rank)
    top = F.coalesce(F.max(rank), F.lit(0))
    return found.groupBy(*by).agg(F.when(top == 2, "error").when(top == 1, "warn").otherwise("ignore").alias("mode"))


def equality(index: Index) -> bool:
    """Whether an index keeps rows apart by equality: it is valid and names columns or expressions."""
    return index.valid and bool(index.columns or index.expressions)


def equal_key_findings(df: DataFrame, key: str, as_type: Column) -> DataFrame:
    """Keys that differ as text and are one value to the column's type, as findings."""
    held = equal_keys(df, key, as_type)
    return held.select(F.lit("equal_key").alias("kind"), F.col("folded").cast("string").alias("row"), F.col("spellings").alias("detail"), F.lit(False).alias("unsure"))


def left_out_findings(changes: DataFrame, key: list[str]) -> DataFrame:
    """Inserts that do not write what other inserts write, as findings."""
    return left_out(changes, key).select(F.lit("left_out").alias("kind"), F.to_json(F.struct(*key)).alias("row"), F.col("column").alias("detail"), F.lit(False).alias("unsure"))


def advice_to_warn(found: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """kind, advice: which policy would turn a kind's findings into warnings; kinds without a policy have none."""
    return found.groupBy("kind").agg(F.count("*").alias("n")).where(F.col("kind").isin(*policies)).select("kind", F.concat(F.lit("policy "), "kind", F.lit(": warn lets "), F.col("n").cast("string"), F.lit(" through")).alias("advice"))


@dataclass(frozen=True)
class Index:
    """A declared unique index: columns, the predicate it holds for, whether nulls count as equal, whether it is valid."""

    columns: tuple[str, ...]
    where: str | None = None
    nulls_equal: bool = False
    valid: bool = True
    expressions: tuple[str, ...] = field(default=())


#: Verdicts on a key, the most specific first.
VERDICTS = ("backed", "unsure", "nullable", "partial", "superset", "invalid", "none")


def conjuncts(predicate: str | None) -> set[str]:
    """The parts of a predicate that AND joins at the top level, spelled alike."""
    parts, depth, quoted, word = [], 0, False, ""
    tokens = (predicate or "").replace("\n", " ")
    i = 0
    while i < len(tokens):
        ch = tokens[i]
        quoted ^= ch == "'"
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if depth == 0 and tokens[i : i + 5].upper() == " AND ":
                parts.append(word)
                word, i = "", i + 5
                continue
        word += ch if quoted else ch.lower()
        i += 1
    parts.append(word)
    return {" ".join(p.split()) for p in parts if p.strip()}


def implied(row_filter: str | None, predicate: str | None) -> bool:
    """Whether every part of an index's predicate stands in the rows' filter as written."""
    return conjuncts(predicate) <= conjuncts(row_filter)


def effective_keys(key: list[str], any_of: list[list[str]]) -> list[tuple[str, ...]]:
    """The keys a model can have: its key columns with one column out of each "any of" group."""
    return [(*key, *choice) for choice in product(*any_of)]


def verdict(key: tuple[str, ...], indexes: list[Index], nullable: set[str], row_filter: str | None = None) -> str:
    """How well unique indexes back a natural key."""
    best = "none"
    for index in indexes:
        said = "backed"
        if not index.valid:
            said = "invalid"
        elif not set(index.columns) <= set(key):
            said = "superset" if set(key) < set(index.columns) else "none"
        elif not implied(row_filter, index.where):
            said = "partial"
        elif not index.nulls_equal and set(index.columns) & nullable:
            said = "nullable"
        elif index.expressions:
            said = "unsure"
        best = min(best, said, key=VERDICTS.index)
    return best


def empirical_key(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """name, rows, keys, nulls, verdict: what the data says about a key that nothing declares."""
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    out = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(null).alias("z")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum("z"), F.lit(0)).alias("nulls"))
    said = F.when(F.col("nulls") > 0, "nullable").when(F.col("rows") == F.col("keys"), "unique").otherwise("repeated")
    return out.select(F.lit(name).alias("name"), "rows", "keys", "nulls", said.alias("verdict"))
