"""What the training-data operators share: the shared folder, staged tables and corpus text helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []

#: The ASCII letters that the contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one if unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_statewright_dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="statewright-")
    spark.sparkContext.setCheckpointDir(folder)
    spark._statewright_dir = folder
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def taken(spark: SparkSession) -> list[str]:
    """The paths of a session's staged tables."""
    return [path for owner, path in _SCRATCH if owner is spark]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables; results that still read them must have been written before."""
    gone = set(paths)
    for owner, path in list(_SCRATCH):
        if owner is spark and path in gone:
            _SCRATCH.remove((owner, path))
            try:
                target = owner._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(owner._jsc.hadoopConfiguration()).delete(target, True)
            except Exception:  # noqa: BLE001  the session may have ended already
                pass


def release(spark: SparkSession | None = None) -> None:
    """Delete the staged tables (of one session)."""
    for owner in list({id(o): o for o, _ in _SCRATCH}.values()):
        if spark is None or owner is spark:
            drop(owner, taken(owner))


atexit.register(release)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing refers to any more; its driver finds out by collecting garbage."""
    gc.collect()
    spark._jvm.System.gc()


def staged(df: DataFrame, label: str, *, order: list[str] | None = None, bloom: str | None = None, partition: str | None = None, codec: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = (df.sortWithinPartitions(*order) if order else df).write
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    if codec:
        writer = writer.option("compression", codec)
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
    sweep(spark)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let fewer documents at a time go to a Python worker, unless the session says otherwise: they can be long, and
    executors hold a whole batch on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its columns are called (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def single(docs: DataFrame, repeated: DataFrame, digest: Column, mark: str, best: Column | None = None) -> DataFrame:
    """docs with one row of those that share a digest; repeated has the digests that several rows have, in column mark.

    The row with the greatest `best` stays, if that is given, else any. mark is no column of docs. Rows of other digests
    are not touched; mostly there are none but those.
    """
    many = staged(repeated, "repeated-rows")
    if many.isEmpty():
        return docs
    rest = docs.join(many, digest == F.col(mark), "left_anti")
    again = docs.join(many, digest == F.col(mark))
    if best is None:
        return rest.unionByName(again.dropDuplicates([mark]).select(*docs.columns))
    return rest.unionByName(again.groupBy(mark).agg(F.max_by(F.struct(*docs.columns), best).alias(mark + "_row")).select(mark + "_row.*"))


_KEPT: dict[object, object] = {}
_LIBC = ctypes.CDLL(None)


def kept(name: object, make):
    """What a Python worker keeps from task to task: one thing at a time, so that no operator's caches outlive its turn."""
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)
        _KEPT[name] = make()
    return _KEPT[name]
