"""The audit log: an append-only table of runs with the outcome of each change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "id long, set_name string, direction string, set_sha256 string, applied_at timestamp, applied_by string, outcomes array<struct<index:int,model:string,key:string,kind:string,status:string,problem:string>>"


def latest(log: DataFrame) -> DataFrame:
    """The newest run of each set, in one aggregate without a sort."""
    rest = [c for c in log.columns if c != "set_name"]
    return log.groupBy("set_name").agg(F.max_by(F.struct(*rest), "id").alias("r")).select("set_name", "r.*")


def since_down(log: DataFrame) -> DataFrame:
    """The up runs after a set's last down run: what a revert has to follow."""
    down = log.groupBy("set_name").agg(F.max(F.when(F.col("direction") == "down", F.col("id"))).alias("__down"))
    return log.join(down, "set_name").where((F.col("direction") == "up") & (F.col("id") > F.coalesce("__down", F.lit(-1)))).drop("__down")


def by_status(log: DataFrame) -> DataFrame:
    """id, status, n: how the changes of each run ended."""
    return log.select("id", F.explode("outcomes.status").alias("status")).groupBy("id", "status").agg(F.count("*").alias("n"))


def made(log: DataFrame) -> DataFrame:
    """Changes that a run since the last down made: set_name, index, made."""
    each = since_down(log).select("set_name", F.explode("outcomes").alias("o"))
    return each.groupBy("set_name", F.col("o.index").alias("index")).agg(F.bool_or(F.col("o.status") == "applied").alias("made"))


def applied_and_pending(directory: DataFrame, applied: DataFrame) -> DataFrame:
    """name, in_directory, applied, out_of_order: pending names older than the newest applied one."""
    d, a = directory.select("name", F.lit(True).alias("d")), applied.select("name", F.lit(True).alias("a"))
    newest = applied.agg(F.max("name")).first()[0]
    both = d.join(a, "name", "full_outer").select("name", F.coalesce("d", F.lit(False)).alias("in_directory"), F.coalesce("a", F.lit(False)).alias("applied"))
    late = ~F.col("applied") & (F.col("name") < F.lit(newest)) if newest is not None else F.lit(False)
    return both.withColumn("out_of_order", F.coalesce(late, F.lit(False)))


def edited(directory: DataFrame, log: DataFrame) -> DataFrame:
    """Sets whose file no longer has the digest under which it was applied last: set_name."""
    newest = latest(log).where("direction = 'up'").select("set_name", F.col("set_sha256").alias("was"))
    return directory.join(newest, "set_name").where("sha256 <> was").select("set_name")


def outcome_of(log: DataFrame, changes: DataFrame) -> DataFrame:
    """seq, status, problem of each change as a run recorded it: by its place, or, where the set was edited
    since, by model, key and kind if just one outcome has them.

    log holds the outcomes of one run (index, model, key, kind, status, problem); changes seq, model, key, kind.
    """
    spot = ["model", "key", "kind"]
    here = log.select(F.col("index").alias("seq"), *spot, F.col("status").alias("__s1"), F.col("problem").alias("__p1"))
    alone = log.groupBy(*spot).agg(F.count("*").alias("n"), F.min("status").alias("__s2"), F.min("problem").alias("__p2")).where("n = 1").drop("n")
    met = changes.join(here, ["seq", *spot], "left").join(alone, spot, "left")
    return met.select("seq", F.coalesce("__s1", "__s2").alias("status"), F.when(F.col("__s1").isNotNull(), F.col("__p1")).otherwise(F.col("__p2")).alias("problem"))


def to_revert(log: DataFrame) -> DataFrame:
    """What a revert has to take back, last change first: set_name, index, for changes that a run since the last down made."""
    return made(log).where("made").select("set_name", "index", F.rank().over(Window.partitionBy("set_name").orderBy(F.col("index").desc())).alias("position"))


def covered_gone(directory: DataFrame, covered: DataFrame) -> DataFrame:
    """Sets that a recorded state covers and the directory no longer holds: name."""
    return covered.select("name").distinct().join(directory.select("name"), "name", "left_anti")
