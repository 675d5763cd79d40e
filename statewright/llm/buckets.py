"""Links inside candidate groups: every pair that matters is tried, and no group is expanded into its pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components
from .exact_lsm import filtered

#: The most bits of a filter that goes to every task.
FILTER_BITS = 1 << 26

ENDS = "a long, b long"


def bucket_links(keys: DataFrame, verify: Callable[[DataFrame, str], DataFrame], *, known: DataFrame | None = None, fits: Callable[[Column, Column], Column] | None = None, marks: DataFrame | None = None, near: Callable[[Column, Column], Column] | None = None, few: int = 2) -> DataFrame:
    """Links whose closure joins all rows of one bucket that verify accepts; keys has rid, size, at and key, once each.

    verify(pairs, label) keeps the pairs (a, b) that are links, and may add columns; known are links that hold
    already, of the same columns, and part of the result. at is the key's place in an order of all keys that every
    row lists its own in, counted in the row (any one number where there is no order). fits(x, y) says whether rows
    with these sizes and places can be linked at all, when this is the first key that they share; near(x, y) says
    the same of what marks (rid, mark) has of two rows, and is asked in larger buckets before a pair becomes a row.

    In buckets of up to `few` rows all pairs are tried. In larger ones heads are tried with all rows of the
    bucket that are not yet in their component; then they leave it. A linked row stays until it has been a
    head or all rows left are of one component, so no pair goes untried unless it is joined already. Rows
    that share most with others are heads first: the original of many copies comes before them.
    """
    counts = staged(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-counts")
    met = staged(filtered(keys.withColumn("digest", F.col("key")), counts.select(F.col("key").alias("digest")), counts.count(), FILTER_BITS).hint("merge").join(counts, "key").select("key", "rid", "size", "at", "n"), "near-met")
    # Buckets of the same rows are one, the one whose key comes first: all of its rows list these keys in the same order.
    alike = met.groupBy("key", "n").agg(F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y"), F.min("at").alias("at"))
    once = staged(alike.groupBy("n", "x", "y").agg(F.min(F.struct("at", "key")).alias("first")).select("first.key"), "near-buckets")
    weight = met.groupBy("rid").agg(F.sum("n").alias("weight"))
    rows = staged(met.join(once, "key").join(weight, "rid").select("key", "rid", F.struct("size", "at").alias("own"), "n", "weight"), "near-members")
    fit = (F.col("p") != F.col("q")) & (fits(F.col("x"), F.col("y")) if fits else F.lit(True))
    ends = [F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")]
    small = rows.where(F.col("n") <= few)
    other = small.select("key", F.col("rid").alias("q"), F.col("own").alias("y"))
    pairs = small.select("key", F.col("rid").alias("p"), F.col("own").alias("x")).join(other, "key").where("p < q").where(fit).select(ends).distinct()
    spark = keys.sparkSession
    joined = staged(components(known), "near-known") if known is not None else spark.createDataFrame([], "node long, root long")
    left = rows.where(F.col("n") > few).select("key", "rid", "own", "weight").join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    found, tried, slots = known, None, 1
    if rows.where(F.col("n") > few).isEmpty():
        links = verify(pairs, "near-links")
        return links if found is None else found.unionByName(links)
    while True:
        heads = left.groupBy("key", F.pmod(F.xxhash64("rid"), F.lit(slots)).alias("slot")).agg(F.max(F.struct("weight", "rid", "own", "root")).alias("head"))
        heads = heads.select("key", F.col("head.rid").alias("p"), F.col("head.own").alias("x"), F.col("head.root").alias("of"))
        others, alike = left.select("key", F.col("rid").alias("q"), F.col("own").alias("y"), "root"), fit
        if marks is not None:
            heads = heads.join(marks.select(F.col("rid").alias("p"), F.col("mark").alias("u")), "p")
            others = others.join(marks.select(F.col("rid").alias("q"), F.col("mark").alias("v")), "q")
            alike = fit & near(F.struct("x.size", F.col("u").alias("mark")), F.struct("y.size", F.col("v").alias("mark")))
        heads = staged(heads, "near-heads")
        apart = others.join(heads, "key").where("root <> of").where(alike)
        pairs = pairs.unionByName(apart.select(ends)).distinct()
        pairs = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = verify(pairs, "near-links")
        found = links if found is None else found.unionByName(links)
        left = left.join(heads.select("key", F.col("p").alias("rid")), ["key", "rid"], "left_anti")
        root = staged(components(found), "near-roots").withColumnRenamed("node", "rid")
        left = left.drop("root").join(root, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        open_ = left.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
        left = staged(left.join(open_, "key"), "near-left")
        if left.isEmpty():
            return found
        pairs, slots = pairs.limit(0), slots * 64
