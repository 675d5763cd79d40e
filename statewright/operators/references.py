"""References between models: resolved by id or by name, dangling, anchored above, moved by renames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolved(rows: DataFrame, ref: str, target: DataFrame, target_id: str, target_ref: str) -> DataFrame:
    """rows with <ref>_ref, the referred row's name; null where it refers to nothing."""
    names = target.select(F.col(target_id).alias("__id"), F.col(target_ref).alias(f"{ref}_ref"))
    return rows.join(names, F.col(ref) == F.col("__id"), "left").drop("__id")


def dangling(rows: DataFrame, ref: str, target: DataFrame, target_id: str) -> DataFrame:
    """Rows that refer to a row which is not there; null refers to nothing and is fine."""
    return rows.where(F.col(ref).isNotNull()).join(target.select(F.col(target_id).alias("__id")), F.col(ref) == F.col("__id"), "left_anti")


def pointing_at(rows: DataFrame, ref: str, target: DataFrame, target_id: str) -> DataFrame:
    """Rows that refer to one of the target's rows (soft-deleted ones, say)."""
    return rows.join(target.select(F.col(target_id).alias("__id")), F.col(ref) == F.col("__id"), "left_semi")


def anchored(rows: DataFrame, by: list[str], anchor: str, order: str, value: str) -> DataFrame:
    """rows with above: the value of the nearest earlier row with the same anchor. Later rows are never seen."""
    above = Window.partitionBy(*by, anchor).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("above", F.last(value, ignorenulls=True).over(above))


def cardinality(wanted: DataFrame, name: str, target: DataFrame, target_ref: str, target_id: str) -> DataFrame:
    """wanted with found (rows that hold the name), target_id where it is exactly one, and verdict."""
    held = target.groupBy(F.col(target_ref).alias("__name")).agg(F.count("*").alias("found"), F.min(target_id).alias("target_id"))
    met = wanted.join(held, F.col(name) == F.col("__name"), "left").withColumn("found", F.coalesce("found", F.lit(0)))
    verdict = F.when(F.col("found") == 0, "missing").when(F.col("found") == 1, "one").otherwise("many")
    return met.select(*wanted.columns, "found", F.when(F.col("found") == 1, F.col("target_id")).alias("target_id"), verdict.alias("verdict"))


def referring(target: DataFrame, target_id: str, rows: DataFrame, ref: str, cap: int = 1001) -> DataFrame:
    """How many rows refer to each target row, up to a cap: the question is only whether there are many."""
    counts = rows.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("__ref")).agg(F.count("*").alias("n"))
    return target.join(counts, F.col(target_id) == F.col("__ref"), "left").select(*target.columns, F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).alias("referring"))


def shared(*sides: tuple[DataFrame, str]) -> DataFrame:
    """Reference values that more than one row holds on any side: value. A reference by them names no row."""
    each = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("value") for df, c in sides]
    return reduce(DataFrame.unionByName, each).distinct()


def moved(base: DataFrame, head: DataFrame, key: list[str], ref: str) -> DataFrame:
    """Rows with the same key and another reference value: key, from, to; referrers follow them."""
    b, h = base.select(*key, F.col(ref).alias("from")), head.select(*key, F.col(ref).alias("to"))
    return b.join(h, key).where(~F.col("from").eqNullSafe(F.col("to")))


def followed(rows: DataFrame, ref: str, moves: DataFrame) -> DataFrame:
    """rows with a reference rewritten from an old name to the new one (moves: from, to; one row for each from)."""
    to = moves.select(F.col("from").alias("__from"), F.col("to").alias("__to"))
    return rows.join(to, F.col(ref) == F.col("__from"), "left").withColumn(ref, F.coalesce("__to", ref)).drop("__from", "__to")


def cascaded(models: dict[str, DataFrame], order: list[str], refs: dict[str, dict[str, str]], moves: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every model with the references of renamed rows rewritten, in dependency order.

    refs: model to (column to the model it refers to); moves: model to (from, to). A pass for each
    reference suffices, since a rename changes names and not which row is meant.
    """
    out = dict(models)
    for model in order:
        for column, target in refs.get(model, {}).items():
            if target in moves:
                out[model] = followed(out[model], column, moves[target])
    return out


def cascaded_names(models: dict[str, DataFrame], order: list[str], refs: dict[str, dict[str, str]], names: dict[str, str], moves: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(models, moves): as cascaded, where a model's own name can be made of a reference.

    names: model to the column that others call its rows by. Where that column is itself a reference that
    moves, the model's names move with it, and so do the references to them, in dependency order.
    """
    out, known = dict(models), dict(moves)
    for model in order:
        for column, target in refs.get(model, {}).items():
            if target not in known:
                continue
            if names.get(model) == column:
                own = out[model].join(known[target].withColumnRenamed("from", "__f"), F.col(column) == F.col("__f")).select(F.col("__f").alias("from"), "to").distinct()
                known[model] = own.unionByName(known[model]) if model in known else own
            out[model] = followed(out[model], column, known[target])
    return out, known


def index_of(rows: DataFrame, key: list[str], refs: dict[str, str]) -> DataFrame:
    """The reverse index of references: model, name (what is referred to), column, and the referring row's key."""
    each = F.array(*[F.struct(F.lit(target).alias("model"), F.col(column).cast("string").alias("name"), F.lit(column).alias("column")) for column, target in refs.items()])
    return rows.select(*key, F.explode(each).alias("r")).where("r.name is not null").select("r.model", "r.name", "r.column", *key)


def refused_by(changes: DataFrame, refs: DataFrame, refused: DataFrame, seq: str = "seq") -> DataFrame:
    """Changes that refer to a row which will not be there under that name.

    refs: seq, model, name of what changes refer to; refused: model, name of rows whose rename was refused, or
    whose new name an insert-only model does not take over.
    """
    hit = refs.join(refused.select("model", "name").distinct(), ["model", "name"], "left_semi")
    return changes.join(hit.select(seq).distinct(), seq, "left_semi")


def kept_names(base: DataFrame, head: DataFrame, key: list[str], ref: str) -> DataFrame:
    """Names that the files give to rows which keep the base's name, because the files own no column of theirs: name, kept."""
    return moved(base, head, key, ref).where("`to` is not null").select(F.col("to").alias("name"), F.col("from").alias("kept"))


def missing_refs(refs: DataFrame, live: DataFrame, made: DataFrame) -> DataFrame:
    """References that neither a live row nor an earlier change of the set stands for.

    refs: seq, model, name; live: model, name; made: seq, model, name of what the set's inserts and renames make.
    """
    lost = refs.join(live.select("model", "name").distinct(), ["model", "name"], "left_anti")
    first = made.groupBy("model", "name").agg(F.min("seq").alias("__made"))
    met = lost.join(first, ["model", "name"], "left")
    return met.where("__made is null or __made >= seq").select("seq", "model", "name")


def removed_refs(refs: DataFrame, lost: DataFrame) -> DataFrame:
    """References to rows that the set itself deletes or renames away before: seq, model, name, by (the change that does).

    refs: seq, model, name; lost: seq, model, name.
    """
    gone = lost.groupBy("model", "name").agg(F.min("seq").alias("by"))
    return refs.join(gone, ["model", "name"]).where("by < seq").select("seq", "model", "name", "by")


def still_pointing(deletes: DataFrame, rows: DataFrame, ref: str, id_col: str, live: str | None = None) -> DataFrame:
    """Softly deleted rows that live rows still point at: id, pointing. live is the condition of a live referring row."""
    held = rows.where(F.expr(live)) if live else rows
    counts = held.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("__ref")).agg(F.count("*").alias("pointing"))
    return deletes.join(counts, F.col(id_col) == F.col("__ref")).select(F.col(id_col).alias("id"), "pointing")


def newest_deleted(rows: DataFrame, key: list[str], deleted: str) -> DataFrame:
    """By key, the newest deletion: key, deleted_at."""
    return rows.where(F.col(deleted).isNotNull()).groupBy(*key).agg(F.max(deleted).alias("deleted_at"))
