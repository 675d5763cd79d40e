"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows of a fixed number of words (a shorter item is one window). A window is
contained in a document only if all its shingles are, so its rarest shingle alone is a necessary prefix.
Shingles are ordered by their count over the whole corpus, the documents' positions are joined with the
windows on that one shingle, start and end must lie inside the document (length and positional bounds),
and the candidate is verified word by word over a slice of the window's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, staged, unused

#: What lies between words once A-Z are folded: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, lower-cased in ASCII; null has none."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _windows(items: DataFrame, size: int) -> DataFrame:
    """window (its words), n, items (sorted distinct identifiers): one row for each distinct window."""
    of = items.select("item_id", words(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = of.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, size).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("n", F.size("window"))


def _occurrences(docs: DataFrame, windows: DataFrame, counts: DataFrame) -> DataFrame:
    """key columns, n_words and found (start, end, items; null once for each document)."""
    single = windows.select(F.xxhash64("window").alias("wid"), "window", "items", "n", F.posexplode("window").alias("offset", "shingle"))
    rare = single.withColumn("h", F.xxhash64("shingle")).join(counts, "h", "left")
    prefix = rare.groupBy("wid", "window", "items", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset", "h")).alias("least"))
    prefix = prefix.select(F.col("least.h").alias("h"), F.col("least.offset").alias("offset"), "window", "n", "items")
    # A mark after the last word keeps documents without any candidate in the result.
    mark = prefix.sparkSession.range(1).select(F.xxhash64(F.lit(" ")).alias("h"), F.lit(0).alias("offset"), F.lit(None).cast("array<string>").alias("window"), F.lit(0).alias("n"), F.lit(None).cast(prefix.schema["items"].dataType).alias("items"))
    at = docs.select("doc_id", "row", "w", F.posexplode(F.concat("w", F.array(F.lit(" ")))).alias("pos", "shingle")).withColumn("h", F.xxhash64("shingle"))
    start = F.col("pos") - F.col("offset")
    met = at.join(F.broadcast(prefix.unionByName(mark)), "h")
    inside = (start >= 0) & (start + F.col("n") <= F.size("w"))
    same = F.col("window").isNull() & (F.col("shingle") == " ") | F.when(inside, F.slice("w", start + 1, F.col("n")) == F.col("window"))
    return met.where(same).select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.when(F.col("window").isNotNull(), F.struct(start.alias("start"), (start + F.col("n")).alias("end"))).alias("span"), "items")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 8, min_items: int = 2, block: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs has doc_id and text, items has item_id and text; other columns are not read. A null or empty
    text has no words and no hits. Items without words or without an identifier match nothing; rows
    that repeat an item_id are one item with the windows of all of them. Rows of docs that are wholly
    equal get equal results. Empty tables give empty or hit-free results.

    Windows go to the tasks in blocks of at most `block`, with one pass over docs for each block, so
    what is broadcast has a bound whatever the benchmark's size.
    """
    windows = staged(_windows(items.select("item_id", "text"), window), "decon-windows")
    n_blocks = max(1, -(-windows.count() // block))
    base = docs.select("doc_id", F.col("text"), F.monotonically_increasing_id().alias("row"))
    if n_blocks > 1:  # rows keep their numbers from one pass to the next
        base = staged(base, "decon-rows", codec="zstd")
    parsed = base.select("doc_id", "row", words(F.col("text")).alias("w"))
    blocked = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(n_blocks)))
    found = None
    for b in range(n_blocks):
        part = blocked.where(F.col("block") == b).drop("block")
        vocabulary = part.select(F.explode("window").alias("s")).select(F.xxhash64("s").alias("h")).distinct()
        counts = parsed.select(F.explode("w").alias("s")).select(F.xxhash64("s").alias("h")).join(F.broadcast(vocabulary), "h").groupBy("h").agg(F.count("*").alias("count"))
        one = _occurrences(parsed, part, staged(counts, "decon-counts"))
        found = one if found is None else found.unionByName(one)
    grouped = found.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("hit"), F.greatest(a["upto"], s["end"]).alias("upto")),
    )["hit"]
    listed = F.concat_ws(",", F.array_sort(F.transform("ids", lambda x: x.cast("string"))))
    return grouped.select("doc_id", "n_words", covered.cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("ids") >= min_items).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows in which any window of any item occurs, all columns kept.

    A row is judged by its own text, never by its identifier: rows that share an identifier, or have none,
    keep their own fate, and rows of equal text go together. Null and empty texts have no words and stay.
    Items without words or without an identifier match nothing, so an empty benchmark drops nothing; an
    empty table gives an empty result. Columns of any other name may stand beside text.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    mark = unused(docs, "hit_text")
    hit = contamination(docs.select(digest.alias("doc_id"), "text"), items, **options).where("n_hit > 0")
    return docs.join(hit.select(F.col("doc_id").alias(mark)).distinct(), digest == F.col(mark), "left_anti")
