"""Guarded application of a change set, as joins of the changes with the live rows.

Every change carries what it expects to find. All changes of one level (rows that no other change of the
level touches) are decided by one join, and the result is a new state and a table of outcomes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import null_safe, text_of, value_of
from .diff import moved_key

#: Problems and the mode in which each stops a run unless a policy says otherwise.
PROBLEM_MODES = {"benign": "ignore", "missing": "error", "changed": "warn", "id_drift": "error", "duplicate": "error", "referenced": "error", "outside": "error"}


def _row_map(df: DataFrame, columns: list[str]) -> Column:
    return F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), text_of(df, c).alias("v")) for c in columns]))


def _agrees(have: Column, want: Column) -> Column:
    """Whether a row's map holds every value of another map, nulls equal."""
    return F.coalesce(F.forall(F.map_entries(want), lambda e: F.try_element_at(have, e["key"]).eqNullSafe(e["value"])), F.lit(True))


def diagnose(changes: DataFrame, live: DataFrame, key: list[str], columns: list[str] | None = None, id_col: str | None = None) -> DataFrame:
    """changes with status (applied, unchanged, problem) and problem, decided against the live rows.

    In order: a key held twice is a duplicate; a delete whose row is gone has been made already; a rename
    whose row stands under the new key has been made already or has changed; an update without its row is
    missing; values as wanted have been made already; the guard holds and the change is made, unless a
    rename's new key is taken; a row that differs in its id alone has drifted; else it has changed. An
    insert whose row is there is unchanged, drifted or changed. Only live rows that a change names are spelled out.
    """
    columns = columns or [c for c in live.columns if c not in key]
    every = [*key, *[c for c in columns if c not in key]]
    renames = (F.col("kind") == "update") & F.arrays_overlap(F.map_keys("new"), F.lit(list(key)))
    marked = changes.withColumns({f"__m_{k}": F.when(renames, moved_key(k, live.schema[k].dataType)) for k in key} | {"__moves": F.coalesce(renames, F.lit(False))})
    named = marked.select(*[F.col(k).alias(f"__{k}") for k in key])
    named = named.unionByName(marked.where("__moves").select(*[F.col(f"__m_{k}").alias(f"__{k}") for k in key])).distinct()
    wanted = live.join(named, null_safe([(F.col(k), F.col(f"__{k}")) for k in key]), "left_semi")
    held = wanted.select(*[F.col(k).alias(f"__{k}") for k in key], _row_map(wanted, every).alias("__row"))
    held = held.groupBy(*[f"__{k}" for k in key]).agg(F.count("*").alias("__n"), F.first("__row").alias("__row"))
    there = held.select(*[F.col(f"__{k}").alias(f"__t_{k}") for k in key], F.col("__n").alias("__tn"), F.col("__row").alias("__trow"))
    met = marked.join(held, null_safe([(F.col(k), F.col(f"__{k}")) for k in key]), "left")
    met = met.join(there, F.col("__moves") & null_safe([(F.col(f"__m_{k}"), F.col(f"__t_{k}")) for k in key]), "left")
    n, tn = F.coalesce("__n", F.lit(0)), F.coalesce("__tn", F.lit(0))
    insert, delete = F.col("kind") == "insert", F.col("kind") == "delete"
    made = (n == 1) & ~delete & _agrees(F.col("__row"), F.col("new"))
    guard = (n == 1) & ~insert & _agrees(F.col("__row"), F.col("old"))
    bare = (lambda m: F.map_filter(m, lambda k, v: k != id_col)) if id_col else (lambda m: m)
    drifted = F.lit(id_col is not None) & _agrees(F.col("__row"), bare(F.when(insert, F.col("new")).otherwise(F.col("old"))))
    problem = (
        F.when(n > 1, "duplicate")
        .when(insert & (n == 0), "")
        .when(insert, F.when(made, "benign").when(drifted, "id_drift").otherwise("changed"))
        .when(delete & (n == 0), "benign")
        .when((n == 0) & (tn > 1), "duplicate")
        .when((n == 0) & (tn == 1), F.when(_agrees(F.col("__trow"), F.col("new")), "benign").otherwise("changed"))
        .when(n == 0, "missing")
        .when(made, "benign")
        .when(guard & (tn > 0), "changed")
        .when(guard, "")
        .when(drifted, "id_drift")
        .otherwise("changed")
    )
    out = met.select(*changes.columns, problem.alias("problem"))
    return out.withColumn("status", F.when(F.col("problem") == "", "applied").when(F.col("problem") == "benign", "unchanged").otherwise("problem"))


def judged(outcomes: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """outcomes with mode (ignore, warn, error) by policy."""
    modes = PROBLEM_MODES | {k: v for k, v in (policy or {}).items() if k not in ("benign", "referenced", "outside")}
    mode = F.lit("ignore")
    for problem, m in modes.items():
        mode = F.when(F.col("problem") == problem, m).otherwise(mode)
    return outcomes.withColumn("mode", mode)


def changed_rows(live: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """The state after the outcomes that were applied. Live rows move only if the changes are too many to send to them."""
    done = outcomes.where("status = 'applied'")
    named = [F.col(k).alias(f"__{k}") for k in key]
    edits = done.where("kind <> 'insert'").select(*named, F.col("kind").alias("__kind"), F.col("new").alias("__new"))
    met = live.join(edits, null_safe([(F.col(k), F.col(f"__{k}")) for k in key]), "left").where(~F.col("__kind").eqNullSafe("delete"))

    def value(c: str) -> Column:
        wrote = F.col("__kind").isNotNull() & F.array_contains(F.map_keys("__new"), c)
        return F.when(wrote, value_of(F.try_element_at("__new", F.lit(c)), live.schema[c].dataType)).otherwise(F.col(c)).alias(c)

    def fresh(c: str) -> Column:
        said = value_of(F.try_element_at("new", F.lit(c)), live.schema[c].dataType)
        return (F.col(c) if c in key else said).cast(live.schema[c].dataType).alias(c)

    return met.select(*map(value, live.columns)).unionByName(done.where("kind = 'insert'").select(*map(fresh, live.columns)))


def apply_changes(live: DataFrame, changes: DataFrame, key: list[str], id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state, outcomes). Only changes whose guard holds take effect; values are read back into the live types."""
    outcomes = diagnose(changes, live, key, id_col=id_col)
    return changed_rows(live, outcomes, key), outcomes


def in_scope(where: str | None, soft_delete: str | None, deleted: bool = False) -> Column:
    """The rows that a model owns: those of its condition that are not deleted, or those that are."""
    scope = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    if soft_delete:
        return scope & (F.col(soft_delete).isNotNull() if deleted else F.col(soft_delete).isNull())
    return scope & F.lit(not deleted)


def apply_scoped(table: DataFrame, changes: DataFrame, key: list[str], now: Column, *, id_col: str | None = None, where: str | None = None, soft_delete: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after the changes, outcomes) where a model owns only part of a table.

    Rows outside the condition and deleted rows are never matched and stay as they are. With a soft-delete
    column a delete sets the time, and an insert brings back the newest deleted row that holds its values:
    two equally new ones are a duplicate, a deleted row with the wanted id and other values has changed.
    A written row that the condition does not take has status problem and problem "outside".
    """
    live, rest = table.where(in_scope(where, soft_delete)), table.where(~in_scope(where, soft_delete))
    outcomes = diagnose(changes, live, key, id_col=id_col)
    if where:
        wrote = outcomes.where("status = 'applied' and kind <> 'delete'")
        after = changed_rows(live.join(wrote.select(*key), key, "left_semi"), wrote, key)
        stray = after.where(~F.coalesce(F.expr(where), F.lit(False))).select(*[F.col(k).alias(f"__{k}") for k in key], F.lit(True).alias("__stray")).distinct()
        moved = [F.when(F.col("new").isNull(), F.col(k)).otherwise(moved_key(k, table.schema[k].dataType)) for k in key]
        outcomes = outcomes.join(stray, null_safe([(m, F.col(f"__{k}")) for m, k in zip(moved, key, strict=True)]), "left")
        bad = F.coalesce("__stray", F.lit(False)) & (F.col("status") == "applied") & (F.col("kind") != "delete")
        outcomes = outcomes.withColumns({"problem": F.when(bad, "outside").otherwise(F.col("problem")), "status": F.when(bad, "problem").otherwise(F.col("status"))}).select(*changes.columns, "problem", "status")
    if not soft_delete:
        return changed_rows(live, outcomes, key).unionByName(rest), outcomes

    history = table.where(in_scope(where, soft_delete, deleted=True))
    values = [c for c in table.columns if c not in (*key, id_col, soft_delete)]
    digest = F.sha2(F.to_json(F.struct(*[text_of(table, c).alias(c) for c in table.columns]), {"ignoreNullFields": "false"}), 256)
    old = history.withColumn("__rid", digest)
    inserts = outcomes.where("status = 'applied' and kind = 'insert'")
    old_map = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), text_of(history, c).alias("v")) for c in values])) if values else F.create_map().cast("map<string,string>")
    past = old.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(soft_delete).alias("__past_when"), "__rid", old_map.alias("__map"), (text_of(history, id_col) if id_col else F.lit(None).cast("string")).alias("__past_id"))
    met = inserts.join(past, null_safe([(F.col(k), F.col(f"__{k}")) for k in key]))
    bare = F.map_filter("new", lambda k, v: ~k.isin(*[c for c in (id_col, soft_delete, *key) if c]))
    same = _agrees(F.col("__map"), bare)
    newest = met.groupBy(*key).agg(
        F.max(F.when(same, F.struct("__past_when", "__rid"))).alias("__top"),
        F.max(F.when(same, F.col("__past_when"))).alias("__at"),
        F.bool_or(~same & F.col("__past_id").eqNullSafe(F.try_element_at("new", F.lit(id_col or ""))) & F.col("__past_id").isNotNull()).alias("__other"),
    )
    ties = met.where(same).join(newest.select(*[F.col(k).alias(f"__g_{k}") for k in key], "__at"), null_safe([(F.col(k), F.col(f"__g_{k}")) for k in key])).where(F.col("__past_when") == F.col("__at")).groupBy(*key).agg(F.count("*").alias("__ties"))
    decided = newest.join(ties.select(*[F.col(k).alias(f"__y_{k}") for k in key], "__ties"), null_safe([(F.col(k), F.col(f"__y_{k}")) for k in key]), "left")
    decided = decided.select(*[F.col(k).alias(f"__d_{k}") for k in key], F.when(F.col("__ties") > 1, "duplicate").when(F.col("__ties") == 1, "restored").when(F.col("__other"), "changed").alias("__said"), F.col("__top.__rid").alias("__back"))
    outcomes = outcomes.join(decided, (F.col("kind") == "insert") & (F.col("status") == "applied") & null_safe([(F.col(k), F.col(f"__d_{k}")) for k in key]), "left")
    back = F.col("__said").eqNullSafe("restored")
    wrong = F.coalesce(F.col("__said").isin("duplicate", "changed"), F.lit(False))
    marked = outcomes.withColumns({"problem": F.when(wrong, F.col("__said")).otherwise(F.col("problem")), "status": F.when(wrong, "problem").when(back, "restored").otherwise(F.col("status"))})
    outcomes = marked.select(*changes.columns, "problem", "status")
    after = changed_rows(live, outcomes, key)
    gone = live.join(outcomes.where("status = 'applied' and kind = 'delete'").select(*[F.col(k).alias(f"__{k}") for k in key]), null_safe([(F.col(k), F.col(f"__{k}")) for k in key]), "left_semi")
    chosen = marked.where(back).select(F.col("__back").alias("__rid"))
    risen = old.join(chosen, "__rid", "left_semi").drop("__rid")
    kind = table.schema[soft_delete].dataType
    still = rest.withColumn("__rid", digest).join(chosen, "__rid", "left_anti").drop("__rid")
    parts = [after, gone.withColumn(soft_delete, now.cast(kind)), risen.withColumn(soft_delete, F.lit(None).cast(kind)), still]
    return reduce(DataFrame.unionByName, [p.select(*table.columns) for p in parts]), outcomes


def referenced_deletes(changes: DataFrame, key: str, rows: DataFrame, ref: str, cap: int = 1001) -> DataFrame:
    """Deletes of rows that others refer to: key, referring (up to cap). They are refused, or cascade."""
    counts = rows.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("__ref")).agg(F.count("*").alias("n"))
    return changes.where("kind = 'delete'").join(counts, F.col(key) == F.col("__ref")).select(key, F.least("n", F.lit(cap)).alias("referring"))


def insert_or_restore(wanted: DataFrame, history: DataFrame, key: list[str], values: list[str], id_col: str, deleted: str) -> DataFrame:
    """What an insert does where rows are deleted softly: key, decision, id of the row restored.

    A live row: unchanged or changed. A deleted row with all values: the newest is restored, a tie on time is
    a duplicate. A deleted row with the id wanted but other values: changed. Deleted rows with the key
    alone: insert beside them. None: insert.
    """
    w = wanted.select(*[F.col(c).alias(f"w_{c}") for c in [*key, *values, id_col]])
    met = w.join(history, null_safe([(F.col(f"w_{k}"), F.col(k)) for k in key]), "left")
    same = null_safe([(F.col(f"w_{v}"), F.col(v)) for v in values])
    there, live = F.col(key[0]).isNotNull(), F.col(deleted).isNull()
    group = met.groupBy(*[f"w_{k}" for k in key]).agg(
        F.count_if(there & live).alias("live"),
        F.count_if(there & live & same).alias("live_same"),
        F.max(F.when(there & ~live & same, F.col(deleted))).alias("newest"),
        F.max(F.when(there & ~live & same, F.struct(F.col(deleted), F.col(id_col)))).alias("pick"),
        F.count_if(there & ~live & ~same & F.col(id_col).eqNullSafe(F.col(f"w_{id_col}"))).alias("other_values"),
        F.count_if(there & ~live).alias("gone"),
    )
    at_newest = met.where(there & ~live & same).groupBy(*[f"w_{k}" for k in key], deleted).agg(F.count("*").alias("ties"))
    ties = group.join(at_newest.withColumnRenamed(deleted, "newest"), [*[f"w_{k}" for k in key], "newest"], "left")
    decision = (
        F.when(F.col("live_same") > 0, "unchanged")
        .when(F.col("live") > 0, "changed")
        .when(F.col("ties") > 1, "duplicate")
        .when(F.col("ties") == 1, "restore")
        .when(F.col("other_values") > 0, "changed")
        .when(F.col("gone") > 0, "insert beside")
        .otherwise("insert")
    )
    return ties.select(*[F.col(f"w_{k}").alias(k) for k in key], decision.alias("decision"), F.when(decision == "restore", F.col(f"pick.{id_col}")).alias(f"restored_{id_col}"))


def soft_deleted(live: DataFrame, deletes: DataFrame, key: list[str], column: str, now: Column) -> DataFrame:
    """live with the deletion time set on the rows that deletes name and that are not deleted yet."""
    gone = deletes.select(*key, F.lit(True).alias("__gone")).distinct()
    met = live.join(gone, key, "left")
    return met.withColumn(column, F.when(F.col("__gone") & F.col(column).isNull(), now).otherwise(F.col(column))).select(*live.columns)


def latest_state(history: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return history.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


def ids_taken(wanted: DataFrame, live: DataFrame, id_col: str, key: list[str]) -> DataFrame:
    """Inserts whose id another row holds: the key wanted, and the id."""
    held = live.select(F.col(id_col).alias("__id"), *[F.col(k).alias(f"__{k}") for k in key])
    met = wanted.join(held, F.col(id_col) == F.col("__id"))
    return met.where(~null_safe([(F.col(k), F.col(f"__{k}")) for k in key])).select(*key, id_col)


def noted(inserts: DataFrame, deleted: DataFrame, key: list[str]) -> DataFrame:
    """inserts with deleted_at where the key has been deleted softly before (deleted: key, deleted_at)."""
    return inserts.join(deleted, key, "left")


def cascade(changes: DataFrame, key: str, rows: DataFrame, ref: str, row_key: str, action: str) -> DataFrame:
    """What deleting referred rows does to those that refer to them: row_key and effect (delete, set null, refuse)."""
    gone = changes.where("kind = 'delete'").select(F.col(key).alias("__gone"))
    effect = {"cascade": "delete", "set null": "set null"}.get(action, "refuse")
    return rows.join(gone, F.col(ref) == F.col("__gone"), "left_semi").select(row_key, F.lit(effect).alias("effect"))


def sequences(tables: dict[str, tuple[DataFrame, str]], recorded: dict[str, int] | None = None) -> DataFrame:
    """name, next: the id that each table gives out next. It only moves forward: the largest id and one, or what was recorded."""
    recorded = recorded or {}
    each = [df.agg(F.coalesce(F.max(F.col(id_col)).cast("long"), F.lit(0)).alias("m")).select(F.lit(name).alias("name"), F.greatest(F.col("m") + 1, F.lit(recorded.get(name, 1))).cast("long").alias("next")) for name, (df, id_col) in tables.items()]
    return reduce(DataFrame.unionByName, each)


def unique_conflicts(live: DataFrame, outcomes: DataFrame, key: list[str], columns: list[str], where: str | None = None) -> DataFrame:
    """Applied changes whose new row another live row's unique value meets: the key and "changed", as a run would find them.

    columns are a unique index; rows with a null in them are held by no index.
    """
    after = changed_rows(live, outcomes, key)
    held = after.where(F.expr(where)) if where else after
    for c in columns:
        held = held.where(F.col(c).isNotNull())
    many = held.groupBy(*columns).agg(F.count("*").alias("__n")).where("__n > 1")
    clash = held.join(many, columns, "left_semi").select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    done = outcomes.where("status = 'applied' and kind <> 'delete'")
    return done.join(clash, null_safe([(F.col(k), F.col(f"__{k}")) for k in key]), "left_semi").select(*key, F.lit("changed").alias("problem"))
