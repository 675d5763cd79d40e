"""Groups of rows: duplicates, keys equal to a type, multisets, columns that could be keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import comparable, null_safe, text_of


def duplicates(df: DataFrame, key: list[str], id_col: str | None = None) -> DataFrame:
    """Keys that more than one row holds: key, n, and ids (sorted, comma-joined) if an id column is given."""
    many = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    if not id_col:
        return many
    # Ids are gathered of repeated keys alone, once the counts have said which those are.
    held = many.select(*[F.col(k).alias(f"__{k}") for k in key], "n")
    met = df.select(*key, id_col).join(held, null_safe([(F.col(k), F.col(f"__{k}")) for k in key]))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(id_col)), lambda x: x.cast("string")), ",")
    return met.groupBy(*key, "n").agg(ids.alias("ids"))


def equal_keys(df: DataFrame, key: str, as_type: Column) -> DataFrame:
    """Values that differ as text and are equal to the column's type: folded, n, spellings."""
    groups = df.where(F.col(key).isNotNull()).groupBy(as_type.alias("folded")).agg(F.count_distinct(key).alias("n"), F.array_join(F.sort_array(F.collect_set(key)), "|").alias("spellings"))
    return groups.where("n > 1")


def index_clashes(df: DataFrame, expressions: list[Column], where: Column | None = None, nulls_equal: bool = False) -> DataFrame:
    """Rows that a stricter unique index would refuse: digest of the indexed values, n."""
    held = df if where is None else df.where(where)
    if not nulls_equal:
        for e in expressions:
            held = held.where(e.isNotNull())
    value = F.to_json(F.struct(*[e.alias(f"e{i}") for i, e in enumerate(expressions)]), {"ignoreNullFields": "false"}) if len(expressions) > 1 else expressions[0]
    return held.groupBy(F.sha2(value.cast("string"), 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


def row_sets(base: DataFrame, head: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys held by several rows on a side, and whether the sides hold the same multiset of rows.

    Both sides are counted by value in one aggregate of signed counts, in the columns' own types, so a key
    with many rows costs one row for each value.
    """
    kinds = {c: base.schema[c].dataType for c in columns}
    value = lambda df, c: F.col(c) if comparable(kinds[c]) else text_of(df, c).alias(c)
    side = lambda df, sign: df.select(*key, *[value(df, c) for c in columns], F.lit(sign).alias("__sign"))
    both = side(base, -1).unionByName(side(head, 1))
    net = both.groupBy(*key, *[c for c in columns if c not in key]).agg(F.sum("__sign").alias("net"), F.count_if(F.col("__sign") < 0).alias("b"), F.count_if(F.col("__sign") > 0).alias("h"))
    out = net.groupBy(*key).agg(F.sum("b").alias("base_rows"), F.sum("h").alias("head_rows"), (F.count_if(F.col("net") != 0) == 0).alias("same"))
    return out.where("base_rows > 1 or head_rows > 1")


def key_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, different, is_key: whether no two rows share a value (exact; nulls are no values).

    Each column is counted by itself, so a scan reads that column alone and partial counts are what moves.
    """

    def one(c: str) -> DataFrame:
        counts = df.groupBy(text_of(df, c).alias("value")).agg(F.count("*").alias("n"))
        return counts.agg(F.lit(c).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("value").alias("different"))

    out = reduce(DataFrame.unionByName, [one(c) for c in columns])
    return out.select("column", "rows", "different", (F.col("rows") == F.col("different")).alias("is_key"))
