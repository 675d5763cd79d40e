"""Table scans: only the columns in use, only the rows a model owns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import Model


def wanted_columns(model: Model, table: list[str], used: list[str]) -> list[str]:
    """Key, id, soft-delete column and what the files use, in the table's order; the scan reads no others."""
    keep = {*model.key, *(c for group in model.key_any_of for c in group), *used} - set(model.ignore) - set(model.derived)
    keep |= {c for c in (model.id, model.ref, model.soft_delete) if c}
    return [c for c in table if c in keep]


def scan(df: DataFrame, model: Model, used: list[str] | None = None, deleted: bool = False) -> DataFrame:
    """A model's live rows, or its soft-deleted ones: the filters and the projection reach the file scan."""
    if model.where:
        df = df.where(F.expr(model.where))
    if model.soft_delete:
        df = df.where(F.col(model.soft_delete).isNotNull() if deleted else F.col(model.soft_delete).isNull())
    elif deleted:
        df = df.where(F.lit(False))
    return df.select(*wanted_columns(model, df.columns, used if used is not None else df.columns))


def newest(df: DataFrame, model: Model) -> DataFrame:
    """The newest soft-deleted row of each key."""
    gone = scan(df, model, deleted=True)
    rest = [c for c in gone.columns if c not in model.key]
    return gone.groupBy(*model.key).agg(F.max_by(F.struct(*rest), model.soft_delete).alias("r")).select(*model.key, "r.*")


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
