"""The corpus pipeline: toxicity, exact dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's docs. All stages but the last return the columns of documents. When a stage begins, the
rows of the one before are written, so what that one staged is deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from statewright.llm import common, decontam, exact_lsm, pack_ss, queries, simhash, toxicity


_STAGED: dict[int, list[str]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop(spark, _STAGED.pop(id(spark), []))
        common.sweep(spark)
        common.short_batches(spark)
        before = set(common.taken(spark))
        out = f(spark, docs, sf_dir)
        _STAGED[id(spark)] = [p for p in common.taken(spark) if p not in before]
        return out

    return run


@_stage
def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity score rejects."""
    return toxicity.civil(docs, common.table(spark, sf_dir, "labels"))


@_stage
def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_lsm.deduplicated(docs)


@_stage
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


@_stage
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of any benchmark item."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that all remaining documents fill."""
    return pack_ss.pack(docs, queries.vocabulary("word_bpe_49k.json"), cache=80_000)


STAGES = [("toxicity", civil), ("exact_dedup", unique), ("near_dedup", distinct), ("decontamination", uncontaminated), ("packing", packed)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
