"""Change sets that arrive as a stream.

The engine compares states; it has no event-time operators. follow() applies batches of changes as they
arrive, each with the same guards as a set applied by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.apply import apply_changes


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose state is complete, oldest first: each is a folder that Spark has marked as done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    marked = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in marked if n.startswith("batch="))


def state_before(spark: SparkSession, folder: str, start: DataFrame, batch: int) -> DataFrame:
    """The state that a batch starts from: what the newest earlier batch left, or the start."""
    done = [v for v in _versions(spark, folder) if v < batch]
    return spark.read.schema(start.schema).parquet(f"{folder}/batch={done[-1]}") if done else start


def follow(changes: DataFrame, start: DataFrame, key: list[str], folder: str, done: Callable[[DataFrame, DataFrame, int], None] | None = None, keep: int = 3):
    """A stream writer that applies each micro-batch to the state; done(state, outcomes, batch) is called after each.

    The state after each batch is a table in `folder`, named by the batch's number. A batch that runs again
    after a failure starts from the batch before it and replaces its own table, so no change is lost or made
    twice. The newest `keep` states stay.
    """

    def batch(part: DataFrame, number: int) -> None:
        spark = part.sparkSession
        state, outcomes = apply_changes(state_before(spark, folder, start, number), part, key)
        state.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if done is not None:
            done(spark.read.schema(start.schema).parquet(f"{folder}/batch={number}"), outcomes, number)
        for old in _versions(spark, folder)[: -max(2, keep)]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return changes.writeStream.foreachBatch(batch)
