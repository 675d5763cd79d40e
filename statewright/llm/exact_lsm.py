"""Exact deduplication over a log-structured merge index, in DataFrame operations only.

Memtables: rows are dealt into runs; each run is aggregated by digest and flushed in sorted order, and each
run has a filter, a bitmap of the places its digests hash to. Lookup: every entry of a run asks the filters of
all other runs; what no filter knows and its own run holds once is unique and goes no further. Compaction:
the entries that remain are merged by digest, the smallest identifier and the best row survive. Digests that
occur more than once form a bitmap of their own, so that only the rows it lets through move with their
texts; those hits are verified by their bytes, by grouping on digest and whole normalised text (equal
texts collapse before they are shuffled, so a group of copies costs one text a task). Texts that share a
digest by accident become groups of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import single, staged, unused

#: Bits of one bitmap block of Spark's bitmap functions.
BLOCK = 32_768


def normalised(text: Column) -> Column:
    """The text without its ASCII white space (space and 0x09 to 0x0D); null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _best(rows: DataFrame, *keys: str) -> DataFrame:
    """By key: the row that stays (most code points, then smallest identifier), the smallest identifier, the count."""
    return rows.groupBy(*keys).agg(
        F.min(F.struct(F.col("short"), F.col("keep_id").isNull().alias("none"), F.col("keep_id"))).alias("best"),
        F.min("min_id").alias("min_id"),
        F.sum("n").alias("n"),
    ).select(*keys, F.col("best.short").alias("short"), F.col("best.keep_id").alias("keep_id"), "min_id", "n")


def _bits(n: int, most: int) -> int:
    """The size of a filter for n digests, 16 bits each, at most `most`: a power of two."""
    bits = BLOCK
    while bits < min(most, 16 * n):
        bits *= 2
    return bits


def _set(bitmap: Column, place: Column) -> Column:
    """Whether a bitmap block has the bit of a place."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor((place % BLOCK) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def _blocks(digests: DataFrame, bits: int, *keys: str) -> DataFrame:
    """keys, block, bitmap: the filter of the digests, in blocks of BLOCK bits."""
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    placed = digests.select(*keys, place.alias("p"))
    return placed.groupBy(*keys, F.floor(F.col("p") / BLOCK).cast("int").alias("block")).agg(F.expr(f"bitmap_construct_agg(p % {BLOCK})").alias("bitmap"))


def filtered(texts: DataFrame, repeated: DataFrame, n: int, filter_bits: int, *, others: bool = False) -> DataFrame:
    """The rows whose digest may be repeated, or all others. The filter has at most filter_bits bits, so it is always small;
    with more digests than it can tell apart it lets more rows through, and never holds one back."""
    bits = _bits(n, filter_bits)
    marked = texts.withColumn("p", F.pmod(F.xxhash64("digest"), F.lit(bits))).withColumn("block", F.floor(F.col("p") / BLOCK).cast("int"))
    known = _set(F.col("bitmap"), F.col("p"))
    asked = marked.join(F.broadcast(_blocks(repeated, bits)), "block", "left" if others else "inner")
    return asked.where(~F.coalesce(known, F.lit(False)) if others else known).drop("p", "block", "bitmap")


def elsewhere(entries: DataFrame, n: int, runs: int, filter_bits: int) -> DataFrame:
    """entries (run, digest, ...) with seen: whether the filter of another run may hold the digest.

    All runs' filters together have at most filter_bits bits and go to every task.
    """
    bits = _bits(-(-n // runs), max(BLOCK, filter_bits // runs))
    filters = _blocks(entries, bits, "run").groupBy("block").agg(F.collect_list(F.struct("run", "bitmap")).alias("filters"))
    marked = entries.withColumn("p", F.pmod(F.xxhash64("digest"), F.lit(bits))).withColumn("block", F.floor(F.col("p") / BLOCK).cast("int"))
    seen = F.exists("filters", lambda f: (f["run"] != F.col("run")) & _set(f["bitmap"], F.col("p")))
    return marked.join(F.broadcast(filters), "block").withColumn("seen", seen).drop("p", "block", "filters")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_runs: int = 8, run_rows: int = 20_000_000, filter_bits: int = 1 << 27, digest_chars: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, first_id.

    Rows whose texts are equal after deleting ASCII white space form a group; null texts and texts of
    white space only are the group of the empty text. The row with the most code points stays, on a tie
    the one with the smallest identifier; null identifiers lose every tie. first_id is the smallest identifier
    of the group, null if none has one. Rows that repeat identifier
    and group of the row that stays share its fate. An empty table gives an empty result. Only id_col
    and text_col are read, whatever the other columns are called.

    digest_chars shortens the index's digest (tests use it to make digests collide).
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.select(F.col(id_col).alias("doc_id"), F.char_length(raw).alias("len"), normalised(raw).alias("norm"))
    full = full.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("digest", F.substring("text_sha256", 1, digest_chars))
    rows = staged(full.select("doc_id", (-F.col("len")).alias("short"), "text_sha256", "digest"), "lsm-rows")
    count = rows.count()
    runs = max(least_runs, -(-count // run_rows))
    entry = rows.withColumn("keep_id", F.col("doc_id")).withColumn("min_id", F.col("doc_id")).withColumn("n", F.lit(1).cast("long"))
    # Rows reach a run in any order, as they would a memtable that is flushed when it is full.
    memtables = _best(entry.withColumn("run", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(runs)).cast("int")), "run", "digest")
    flushed = staged(memtables, "lsm-runs", order=["run", "digest"])
    looked = elsewhere(flushed, count, runs, filter_bits)
    alone = looked.where("not seen").drop("seen", "run")
    index = staged(alone.unionByName(_best(looked.where("seen"), "digest")), "lsm-index")

    repeated = index.where("n > 1").select("digest")
    n = repeated.count()
    hits = filtered(full.select("digest", "norm"), repeated, n, filter_bits).groupBy("digest", "norm").agg(F.count("*").alias("copies"))
    verified = staged(hits.select("digest", F.sha2("norm", 256).alias("text_sha256"), "copies", F.xxhash64("norm").alias("second")), "lsm-verified")
    clashes = verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    found = index.select("digest", "keep_id", F.col("n").alias("group_size"), F.col("min_id").alias("first_id"))
    plain = rows
    if not clashes.isEmpty():
        apart = staged(clashes, "lsm-clashes")
        plain = rows.join(apart, "digest", "left_anti")
        torn = full.join(apart, "digest", "left_semi").withColumn("short", -F.col("len"))
        own = torn.withColumn("keep_id", F.col("doc_id")).withColumn("min_id", F.col("doc_id")).withColumn("n", F.lit(1).cast("long"))
        exact = _best(own, "norm").select("norm", "keep_id", F.col("n").alias("group_size"), F.col("min_id").alias("first_id"))
        rest = torn.join(exact, "norm").select("doc_id", "keep_id", "group_size", "text_sha256", "first_id")
    joined = plain.join(found, "digest").select("doc_id", "keep_id", "group_size", "text_sha256", "first_id")
    if plain is not rows:
        joined = joined.unionByName(rest)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "first_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that lose: all columns, in any number and of any names, one row for each group of equal texts.

    Joins on the identifier and the text's digest, so rows that share an identifier keep their own fate; of
    rows that repeat both, the one with the most code points stays (then the greatest text). Null texts and texts
    of white space are one group. An empty table gives an empty result.
    """
    won = staged(classes(docs, id_col=id_col, text_col=text_col, **options).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")), "lsm-kept")
    keep, digest, mark = unused(docs, "keep_id"), unused(docs, "keep_digest"), unused(docs, "row_digest")
    named = won.select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(digest))
    normal = F.sha2(normalised(F.col(text_col)), 256)
    left = docs.join(named, F.col(id_col).eqNullSafe(F.col(keep)) & (normal == F.col(digest)), "left_semi")
    return single(left, won.where("n > 1").select(F.col("text_sha256").alias(mark)), normal, mark, F.struct(F.char_length(F.col(text_col)), F.col(text_col)))
