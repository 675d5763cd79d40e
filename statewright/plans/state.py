"""Recorded state: the tables as the applied sets leave them, with a manifest of digests and lineage."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import text_of
from .changeset import write_atomic


class StateError(ValueError):
    """A recorded state that is not what it says."""


def digest(df: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows: counts and sums of row hashes."""
    row = F.to_json(F.struct(*[text_of(df, c).alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    h = F.xxhash64(row)
    n, x, s = df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}:{x}:{s}".encode()).hexdigest()


def record(folder: str, tables: dict[str, DataFrame], covers: str, base: str | None = None) -> dict:
    """Write the tables as Parquet beside a manifest; covers is the newest set they include."""
    manifest = {"format": 1, "covers": covers, "base": base, "tables": {}}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        manifest["tables"][name] = digest(df)
    write_atomic(f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def load(spark: SparkSession, folder: str, verify: bool = True) -> tuple[dict, dict[str, DataFrame]]:
    with open(f"{folder}/manifest.json", encoding="utf-8") as f:
        text = f.read()
    if "<<<<<<<" in text:
        raise StateError("the manifest holds an unresolved merge")
    manifest = json.loads(text)
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}
    for name, df in tables.items():
        if verify and digest(df) != manifest["tables"][name]:
            raise StateError(f"{name} is not what the manifest says")
    return manifest, tables


def unaccounted(manifest: dict, names: list[str]) -> list[str]:
    """Sets of the directory that the recorded state neither covers nor was based on."""
    covers, base = manifest["covers"], manifest.get("base") or ""
    return [n for n in sorted(names) if n > covers or base < n < covers and n not in manifest.get("includes", [covers])]


def lineage_sentence(name: str, manifest: dict) -> str:
    """Why a set is not accounted for by a recorded state."""
    covers, base = manifest.get("covers") or "", manifest.get("base") or ""
    if name > covers:
        return f"{name} is newer than the recorded state, which covers sets up to {covers or 'none'}"
    if base and name > base:
        return f"{name} lies between {base} and {covers}, and the recorded state was made without it"
    return f"{name} is older than the recorded state and not among the sets it covers"
