"""Change sets as artifacts: canonical JSON lines with a header and a digest."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut

FORMAT = 1
CHANGE = "seq long, model string, kind string, key map<string,string>, old map<string,string>, new map<string,string>"


class SetError(ValueError):
    """A change set that cannot be right."""


def as_changes(diff: DataFrame, model: str, key: list[str]) -> DataFrame:
    """A diff's rows in the common schema of all models: model, kind, key, old, new."""
    from ..functions.values import text_of

    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), text_of(diff, k).alias("v")) for k in key]))
    return diff.select(F.lit(model).alias("model"), "kind", pairs.alias("key"), "old", "new")


def validate(header: dict, changes: list[dict]) -> None:
    """Shape and values: known kinds, a key, the sides a kind has, no NUL in any value."""
    if header.get("format", 0) > FORMAT:
        raise SetError(f"format {header['format']} is newer than this version reads")
    for c in changes:
        if c["kind"] not in ("insert", "update", "delete"):
            raise SetError(f"unknown kind {c['kind']}")
        if not c.get("key"):
            raise SetError("a change without a key")
        if (c["kind"] == "insert") != (not c.get("old")) and c["kind"] != "update":
            raise SetError(f"{c['kind']} with the wrong sides")
        if c["kind"] == "update" and not c.get("new"):
            raise SetError("an update that writes nothing")
        for side in ("key", "old", "new"):
            for name, v in (c.get(side) or {}).items():
                if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                    raise SetError(f"{name} is no plain column name")
                if v is not None and "\0" in v:
                    raise SetError(f"{name} holds a NUL")


def canonical(header: dict, changes: list[dict]) -> str:
    """One spelling of a set: sorted keys, nothing empty."""
    slim = lambda d: {k: v for k, v in d.items() if v not in (None, {}, [])}
    dump = lambda d: json.dumps(d, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return "\n".join([dump(slim(header)), *(dump(slim(c)) for c in changes)]) + "\n"


def sha256(header: dict, changes: list[dict]) -> str:
    return hashlib.sha256(canonical({k: v for k, v in header.items() if k != "sha256"}, changes).encode()).hexdigest()


def numbered(changes: DataFrame, order: list[str]) -> DataFrame:
    """changes with seq from 0 in the order of some columns, numbered where they lie: ranges are sorted by the
    executors, and only the count of each range comes to the driver."""
    ranged = cut(changes.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__own": F.monotonically_increasing_id() % (1 << 33)}))
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, at = [], 0
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    starts = changes.sparkSession.createDataFrame(before, "__part int, __before long")
    return ranged.join(F.broadcast(starts), "__part").select((F.col("__before") + F.col("__own")).alias("seq"), *changes.columns)


#: A set of more changes is written in parts, by the executors.
LARGE = 1000
ROW = ["seq", "model", "kind", "key", "old", "new"]


def _row_hash() -> Column:
    """One long for a change, maps in the order of their keys."""
    flat = lambda c: F.sort_array(F.map_entries(c))
    return F.xxhash64("seq", "model", "kind", F.to_json(F.array(flat("key")), {"ignoreNullFields": "false"}), F.to_json(F.array(flat("old")), {"ignoreNullFields": "false"}), F.to_json(F.array(flat("new")), {"ignoreNullFields": "false"}))


def seal(changes: DataFrame) -> str:
    """A digest of a set that is too large to be spelled out on the driver."""
    h = _row_hash()
    n, x, total = changes.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}:{x}:{total}".encode()).hexdigest()


def faults(changes: DataFrame) -> DataFrame:
    """Rows of a large set that cannot be right: seq and fault."""
    none = F.create_map().cast("map<string,string>")
    side = lambda c: F.size(F.coalesce(F.col(c), none)) > 0
    texts = F.concat(*[F.map_values(F.coalesce(F.col(c), none)) for c in ("key", "old", "new")])
    names = F.concat(*[F.map_keys(F.coalesce(F.col(c), none)) for c in ("key", "old", "new")])
    fault = (
        F.when(~F.coalesce(F.col("kind").isin("insert", "update", "delete"), F.lit(False)), "unknown kind")
        .when(~side("key"), "no key")
        .when((F.col("kind") == "insert") & side("old") | (F.col("kind") == "delete") & (side("new") | ~side("old")), "wrong sides")
        .when((F.col("kind") == "update") & ~side("new"), "an update that writes nothing")
        .when(F.exists(names, lambda n: ~n.rlike("^[A-Za-z_][A-Za-z0-9_]*$")), "no plain column name")
        .when(F.exists(texts, lambda v: F.coalesce(v.contains("\0"), F.lit(False))), "a NUL in a value")
    )
    return changes.select("seq", fault.alias("fault")).where("fault is not null")


def write(path: str, name: str, changes: DataFrame, large: int = LARGE) -> str:
    """Write the set (seq, model, kind, key, old, new) and return its digest.

    Up to `large` changes are lines of the file itself, which people review; more are numbered parts beside
    it, written by the executors, and the file holds the header alone.
    """
    rows = changes.select(*ROW)
    if len(rows.limit(large + 1).select("seq").collect()) > large:
        if bad := faults(rows).limit(1).collect():
            raise SetError(f"change {bad[0]['seq']}: {bad[0]['fault']}")
        parts = f"{path}.parts"
        rows.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").option("ignoreNullFields", "false").json(parts)
        made = {"format": FORMAT, "name": name, "parts": os.path.basename(parts), "sha256": seal(rows)}
        write_atomic(path, canonical(made, []))
        return made["sha256"]
    lines = [{k: v for k, v in r.asDict(recursive=True).items() if k != "seq"} for r in rows.orderBy("seq").collect()]
    made = {"format": FORMAT, "name": name}
    validate(made, lines)
    made["sha256"] = sha256(made, lines)
    write_atomic(path, canonical(made, lines))
    return made["sha256"]


def header(path: str) -> dict:
    """A set's header alone."""
    with open(path, encoding="utf-8") as f:
        return json.loads(f.readline())


def read(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, changes); the digest must be the content's, and the name the file's."""
    with open(path, encoding="utf-8") as f:
        said, *rows = [json.loads(line) for line in f]
    stem = os.path.basename(path).removesuffix(".jsonl")
    if said.get("name") != stem:
        raise SetError(f"{path} holds the set {said.get('name')}")
    validate(said, rows)
    if "parts" in said:
        changes = spark.read.schema(CHANGE).json(os.path.join(os.path.dirname(path), said["parts"]))
        if said.get("sha256") != seal(changes):
            raise SetError(f"{path} was edited after it was written")
        if bad := faults(changes).limit(1).collect():
            raise SetError(f"change {bad[0]['seq']}: {bad[0]['fault']}")
        return said, changes
    if said.get("sha256") != sha256(said, rows):
        raise SetError(f"{path} was edited after it was written")
    filled = [(i, r["model"], r["kind"], r.get("key"), r.get("old"), r.get("new")) for i, r in enumerate(rows)]
    return said, spark.createDataFrame(filled, CHANGE)


def write_atomic(path: str, text: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def next_stamp(now: str, existing: list[str]) -> str:
    """A stamp (a time of 14 digits) that sorts after every existing one: now, or a second after the newest."""
    newest = max((e[:14] for e in existing if re.match(r"\d{14}", e)), default="")
    if now > newest:
        return now
    try:
        return (datetime.datetime.strptime(newest, "%Y%m%d%H%M%S") + datetime.timedelta(seconds=1)).strftime("%Y%m%d%H%M%S")
    except ValueError:  # a stamp that is no time
        return str(int(newest) + 1)
