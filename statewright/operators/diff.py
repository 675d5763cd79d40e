"""The keyed, null-safe difference of two states, and what follows from it.

A change has the key's columns, kind (insert, update, delete), and old and new: maps from column to
canonical text that hold every column of an insert or delete and the changed ones of an update. A column
that one side does not have is absent there, which is not the same as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.interval import interval_text
from ..functions.values import comparable, fold, null_safe, text_of, value_of

#: What each ownership mode lets the files do.
MODES = {"sync": ("insert", "update", "delete"), "upsert": ("insert", "update"), "insert": ("insert",)}


class _Pair:
    """Two states side by side: a full outer join on a null-safe key, with the columns as they are.

    Rows move in their own types; whether a column differs is one null-safe comparison, and only rows that
    end up as changes are spelled out as text.
    """

    def __init__(self, base: DataFrame, head: DataFrame, key: list[str], columns: list[str] | None):
        self.key = key
        self.columns = [c for c in columns or head.columns if c not in key]
        self.base = [c for c in self.columns if c in base.columns]
        self.head = [c for c in self.columns if c in head.columns]
        b = base.select(*[F.col(c).alias(f"__b_{c}") for c in [*key, *self.base]], F.lit(True).alias("__b"))
        h = head.select(*[F.col(c).alias(f"__h_{c}") for c in [*key, *self.head]], F.lit(True).alias("__h"))
        self.df = b.join(h, null_safe([(b[f"__b_{k}"], h[f"__h_{k}"]) for k in key]), "full_outer")
        self.in_base, self.in_head = F.col("__b").isNotNull(), F.col("__h").isNotNull()

    def keys(self) -> list[Column]:
        return [F.coalesce(f"__b_{k}", f"__h_{k}").alias(k) for k in self.key]

    def differs(self, c: str) -> Column:
        """Whether a column that both sides have differs; a column of one side always does."""
        if c not in self.base or c not in self.head:
            return F.lit(True)
        one, two = self.df.schema[f"__b_{c}"].dataType, self.df.schema[f"__h_{c}"].dataType
        if one == two and comparable(one):
            return ~F.col(f"__b_{c}").eqNullSafe(F.col(f"__h_{c}"))
        return ~text_of(self.df, f"__b_{c}").eqNullSafe(text_of(self.df, f"__h_{c}"))

    def texts(self, side: str, columns: list[str], changed: bool) -> Column:
        """A map of a side's columns to their texts: all, or the changed ones."""
        held = [c for c in columns if c in (self.base if side == "b" else self.head)]
        each = [F.struct(F.lit(c).alias("c"), text_of(self.df, f"__{side}_{c}").alias("v")) for c in held]
        if not each:
            return F.create_map().cast("map<string,string>")
        if changed:
            picked = F.filter(F.array(*[F.when(self.differs(c), e) for c, e in zip(held, each, strict=True)]), lambda x: x.isNotNull())
            return F.map_from_entries(picked)
        return F.map_from_entries(F.array(*each))


def state_diff(base: DataFrame, head: DataFrame, key: list[str], columns: list[str] | None = None, mode: str = "sync", insert_only: tuple[str, ...] = (), id_col: str | None = None) -> DataFrame:
    """The changes that lead from base to head under an ownership mode; keys must be unique on either side.

    Columns in insert_only are written by inserts and never compared. id_col, if it is one of the columns, is
    written by inserts and held by deletes, so that a revert brings the row back under its id.
    """
    pair = _Pair(base, head, key, columns)
    owned = [c for c in pair.columns if c not in insert_only and c != id_col]
    held = [c for c in pair.columns if c in owned or c == id_col]
    other = reduce(lambda a, b: a | b, [pair.differs(c) for c in owned], F.lit(False))
    kind = F.when(~pair.in_base, "insert").when(~pair.in_head, "delete").when(other, "update")
    marked = pair.df.withColumn("__kind", kind).where(F.col("__kind").isin(*MODES[mode]))
    said = F.col("__kind")
    return marked.select(
        *pair.keys(),
        said.alias("kind"),
        F.when(said == "update", pair.texts("b", owned, True)).when(said == "delete", pair.texts("b", held, False)).alias("old"),
        F.when(said == "update", pair.texts("h", owned, True)).when(said == "insert", pair.texts("h", pair.columns, False)).alias("new"),
    )


def one_sided(changes: DataFrame) -> DataFrame:
    """Updates that hold a column on one side only: such a difference is refused, not applied."""
    lone = F.array_union(F.array_except(F.map_keys("old"), F.map_keys("new")), F.array_except(F.map_keys("new"), F.map_keys("old")))
    return changes.where(F.col("kind") == "update").withColumn("lone", lone).where(F.size("lone") > 0)


def long_form(changes: DataFrame, key: list[str]) -> DataFrame:
    """One row per changed column: key, kind, column, old, new."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("old", empty), F.coalesce("new", empty)
    names = F.array_union(F.map_keys(old), F.map_keys(new))
    each = changes.withColumn("o", old).withColumn("n", new).select(*key, "kind", "o", "n", F.explode(names).alias("column"))
    return each.select(*key, "kind", "column", F.try_element_at("o", F.col("column")).alias("old"), F.try_element_at("n", F.col("column")).alias("new"))


def renames(base: DataFrame, head: DataFrame, id_col: str, key: list[str]) -> DataFrame:
    """Rows that keep their id and get another key: id, old_<key>, new_<key>, and occupied.

    occupied says that another base row holds the new key, so the rename is refused. Ids that two rows of
    a side share name no row and are left out.
    """
    only = lambda df: df.join(df.groupBy(id_col).agg(F.count("*").alias("n")).where("n = 1").select(id_col), id_col)
    b = only(base).select(id_col, *[F.col(k).alias(f"old_{k}") for k in key])
    h = only(head).select(id_col, *[F.col(k).alias(f"new_{k}") for k in key])
    moved = b.join(h, id_col).where(~null_safe([(F.col(f"old_{k}"), F.col(f"new_{k}")) for k in key]))
    held = base.select(*[F.col(k).alias(f"held_{k}") for k in key], F.lit(True).alias("held")).distinct()
    at = null_safe([(moved[f"new_{k}"], held[f"held_{k}"]) for k in key])
    return moved.join(held, at, "left").select(id_col, *[c for k in key for c in (f"old_{k}", f"new_{k}")], F.coalesce("held", F.lit(False)).alias("occupied"))


def id_drift(base: DataFrame, head: DataFrame, id_col: str, key: list[str]) -> DataFrame:
    """Rows with the same key under another id: key, base_id, head_id."""
    b, h = base.select(*key, F.col(id_col).alias("base_id")), head.select(*key, F.col(id_col).alias("head_id"))
    return b.join(h, key).where(~F.col("base_id").eqNullSafe(F.col("head_id")))


def drifted(base: DataFrame, head: DataFrame, id_col: str, key: list[str]) -> DataFrame:
    """id_drift, without rows that a rename accounts for: neither id has moved to another key."""
    gone = renames(base, head, id_col, key).select(F.col(id_col).alias("__id"))
    out = id_drift(base, head, id_col, key)
    for side in ("base_id", "head_id"):
        out = out.join(gone, F.col(side) == F.col("__id"), "left_anti")
    return out


def fold_pairs(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """One-sided keys that differ in case alone, where the pairing is one to one: old_key, new_key."""
    gone = base.select(F.col(key).alias("old_key")).join(head.select(F.col(key).alias("old_key")), "old_key", "left_anti")
    come = head.select(F.col(key).alias("new_key")).join(base.select(F.col(key).alias("new_key")), "new_key", "left_anti")
    alone = lambda df, c: df.groupBy(fold(F.col(c)).alias("folded")).agg(F.count("*").alias("n"), F.min(c).alias(c)).where("n = 1").drop("n")
    return alone(gone, "old_key").join(alone(come, "new_key"), "folded").select("old_key", "new_key")


def renamed_diff(base: DataFrame, head: DataFrame, key: list[str], id_col: str, columns: list[str] | None = None, mode: str = "sync", insert_only: tuple[str, ...] = (), policy: str = "refuse") -> tuple[DataFrame, DataFrame]:
    """(changes, refused renames): the difference with rows told apart by their id first and their key then.

    A row that keeps its id and gets another key is one update, found under its old key, which writes the
    new one along with whatever else differs. It is refused if the policy says so or another base row holds
    the new key; then neither of its two keys changes at all.
    """
    moves = renames(base, head, id_col, key)
    refused = moves.where("occupied") if policy == "update" else moves
    stay = refused.select(*[F.col(f"old_{k}").alias(k) for k in key]).unionByName(refused.select(*[F.col(f"new_{k}").alias(k) for k in key])).distinct()
    if policy != "update":
        changes = state_diff(base, head, key, columns, mode, insert_only, id_col)
        return _without(changes, stay, key), refused
    done = moves.where("not occupied").drop("occupied")
    to = done.select(F.col(id_col).alias("__id"), *[F.col(f"new_{k}").alias(f"__to_{k}") for k in key], F.lit(True).alias("__moved"))
    there = base.join(to, F.col(id_col) == F.col("__id"), "left")
    there = there.select(*[F.when(F.col("__moved"), F.col(f"__to_{k}")).otherwise(F.col(k)).alias(k) if k in key else F.col(k) for k in base.columns])
    changes = _without(state_diff(there, head, key, columns, mode, insert_only, id_col), stay, key)
    if mode == "insert":
        return changes, refused
    side = lambda name: F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), text_of(done, f"{name}_{k}").alias("v")) for k in key]))
    named = done.select(*[F.col(f"old_{k}").alias(f"__old_{k}") for k in key], *[F.col(f"new_{k}").alias(f"__new_{k}") for k in key], side("old").alias("__was"), side("new").alias("__is"))
    both = changes.join(named, null_safe([(F.col(k), F.col(f"__new_{k}")) for k in key]), "full_outer")
    moved = F.col("__was").isNotNull()
    none = F.create_map().cast("map<string,string>")
    return both.select(
        *[F.coalesce(f"__old_{k}", k).alias(k) for k in key],
        F.when(moved, "update").otherwise(F.col("kind")).alias("kind"),
        F.when(moved, F.map_concat("__was", F.coalesce("old", none))).otherwise(F.col("old")).alias("old"),
        F.when(moved, F.map_concat("__is", F.coalesce("new", none))).otherwise(F.col("new")).alias("new"),
    ), refused


def _without(changes: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    gone = keys.select(*[F.col(k).alias(f"__{k}") for k in key])
    return changes.join(gone, null_safe([(F.col(k), F.col(f"__{k}")) for k in key]), "left_anti")


def respelled_intervals(base: DataFrame, head: DataFrame, key: list[str], column: str) -> DataFrame:
    """Rows whose column holds one interval in two spellings, where no type says which counts: key, old, new."""
    b, h = base.select(*key, F.col(column).alias("old")), head.select(*key, F.col(column).alias("new"))
    met = b.join(h, key).where(~F.col("old").eqNullSafe(F.col("new")))
    said = met.withColumns({"__o": interval_text(F.col("old")), "__n": interval_text(F.col("new"))})
    return said.where("__o = __n").select(*key, "old", "new")


def touched(changes: DataFrame, refs: dict[str, dict[str, str]], model: str = "model") -> DataFrame:
    """The models that a set changes or points at: model."""
    names = [(m, t) for m, columns in refs.items() for t in columns.values()]
    own = changes.select(F.col(model).alias("model")).distinct()
    if not names:
        return own
    points = changes.sparkSession.createDataFrame(names, "__m string, target string")
    return own.unionByName(own.join(points, F.col("model") == F.col("__m")).select(F.col("target").alias("model"))).distinct()


def written_columns(changes: DataFrame, model: str = "model") -> DataFrame:
    """model, columns: every column that a model's changes hold, sorted."""
    empty = F.create_map().cast("map<string,string>")
    names = F.array_union(F.map_keys(F.coalesce("old", empty)), F.map_keys(F.coalesce("new", empty)))
    return changes.select(model, F.explode(names).alias("c")).distinct().groupBy(model).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("columns"))


def undecided_groups(refusals: DataFrame) -> DataFrame:
    """Refusals told by column and not by row: model, column, n."""
    return refusals.groupBy("model", "column").agg(F.count("*").alias("n"))


def left_alone(base: DataFrame, head: DataFrame, key: list[str], mode: str, insert_only: tuple[str, ...] = ()) -> DataFrame:
    """What a mode leaves as it is: rows only the base holds, rows that differ, and by insert-only column."""
    pair = _Pair(base, head, key, None)
    met = pair.in_base & pair.in_head
    free = F.lit(mode != "sync") & ~pair.in_head
    any_ = reduce(lambda a, b: a | b, [pair.differs(c) for c in pair.columns], F.lit(False))
    counts = [F.count_if(met & pair.differs(c)).alias(f"changed_{c}") for c in insert_only]
    return pair.df.agg(F.count_if(free).alias("rows"), F.count_if(F.lit(mode == "insert") & met & any_).alias("changed"), *counts)


def left_out(changes: DataFrame, key: list[str]) -> DataFrame:
    """Inserts that do not write a column which other inserts write: key, column. Column names are no more than the schema's."""
    inserts = changes.where(F.col("kind") == "insert")
    written = [r[0] for r in inserts.select(F.explode(F.map_keys("new"))).distinct().collect()]
    every = F.lit(sorted(written)) if written else F.array().cast("array<string>")
    return inserts.select(*key, F.explode(F.array_except(every, F.map_keys("new"))).alias("column"))


def default_hints(changes: DataFrame, key: list[str], defaults: dict[str, str]) -> DataFrame:
    """Updates where the database holds a column's default and the files a zero or null: key, column, hint."""
    each = long_form(changes.where(F.col("kind") == "update"), key)
    zero = F.col("new").isNull() | F.col("new").isin("", "0", "false")
    at = F.lit(False)
    for column, default in defaults.items():
        at = at | ((F.col("column") == column) & (F.col("old") == default))
    hint = F.when(F.col("new").isNull(), "null against default").otherwise("zero against default")
    return each.where(at & zero).select(*key, "column", hint.alias("hint"))


def moved_key(key: str, kind) -> Column:
    """A key column after a change: the new value if the change writes one."""
    return F.when(F.array_contains(F.map_keys("new"), key), value_of(F.try_element_at("new", F.lit(key)), kind)).otherwise(F.col(key))


def inverted(changes: DataFrame, key: list[str] = ()) -> DataFrame:
    """The changes that take a set back: inserts become deletes, old and new change places.

    A renamed row is found under the key it has by then: in the columns `key`, or in a map column named key.
    """
    kind = F.when(F.col("kind") == "insert", "delete").when(F.col("kind") == "delete", "insert").otherwise(F.col("kind"))
    moved = F.coalesce(F.col("kind") == "update", F.lit(False))
    out = changes
    if key:
        out = out.withColumns({k: F.when(moved, moved_key(k, changes.schema[k].dataType)).otherwise(F.col(k)) for k in key})
    elif "key" in changes.columns:
        now = F.transform_values("key", lambda k, v: F.when(moved & F.array_contains(F.map_keys("new"), k), F.try_element_at("new", k)).otherwise(v))
        out = out.withColumn("key", now)
    return out.withColumn("kind", kind).withColumns({"old": F.col("new"), "new": F.col("old")})


def respelled(base: DataFrame, head: DataFrame, key: list[str], column: str, canonical) -> DataFrame:
    """Rows whose column says the same in another spelling: key, old, new."""
    b, h = base.select(*key, F.col(column).alias("old")), head.select(*key, F.col(column).alias("new"))
    return b.join(h, key).where(~F.col("old").eqNullSafe(F.col("new")) & canonical(F.col("old")).eqNullSafe(canonical(F.col("new"))))


def undecided(df: DataFrame, key: list[str], readings: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows with a column whose two readings differ: key, column, first, second."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), a.alias("first"), b.alias("second")) for c, (a, b) in readings.items()])
    return df.select(*key, F.explode(each).alias("r")).where(~F.col("r.first").eqNullSafe(F.col("r.second"))).select(*key, "r.*")


def summary(changes: DataFrame, model: str = "model") -> DataFrame:
    """Inserts, updates and deletes by model."""
    return changes.groupBy(model).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("insert", "update", "delete")])

