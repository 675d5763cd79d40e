"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at most two bits, one half
differs in at most one, so the pair shares a half with the same one bit wiped out. Every distinct
fingerprint is indexed under these 64 one-wildcard variants; an equality join on them gives the
candidates, which are verified by their distance. A variant that two or three fingerprints share gives its
candidate pairs straight from the aggregate. Where more meet, the fingerprints are joined on whole signatures
with at most one bit flipped instead: all fingerprints under one such signature (65 at most) lie within two
bits of each other, so each is linked to the smallest, and no group is expanded into its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .buckets import FILTER_BITS, bucket_links
from .common import kept, single, staged, sweep, unused
from .components import components
from .exact_lsm import filtered
from .para_minhash import shingle_hashes, words_of

BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text's word shingles, repeats included; 0 without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    w = w if len(w) >= words else [b" ".join(w)]
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else w
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8", count=n)
    return majority(hashes)


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return narrow.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) such that their closure joins all at most two bits apart."""
    half = "if(i < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))"
    variant = f"transform(sequence(0, 63), i -> shiftleft(cast(i as bigint), 32) | ({half} & ~shiftleft(1L, i % 32)))"
    met = distinct.select("fp", F.explode(F.expr(variant)).alias("variant")).groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x")).where("n > 1")
    met = staged(met, "simhash-variants")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    # Two in a bucket are one pair; of three the exclusive or of all tells the third.
    third = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
    ends = F.when(F.col("n") == 2, F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("a"), third.alias("b")), F.struct(third.alias("a"), F.col("b"))))
    pairs = met.where("n <= 3").select(F.explode(ends).alias("p")).select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).where(near)
    # The bitmap lets some of the others through, which among 64 variants is one of almost every fingerprint, so a join
    # follows (no semi-join, which Spark would do before the bitmap).
    crowded = met.where("n > 3").select(F.col("variant").alias("digest"))
    again = filtered(distinct.select("fp", F.explode(F.expr(variant)).alias("digest")), crowded, crowded.count(), FILTER_BITS).join(crowded, "digest").select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    signed = staged(again, "simhash-crowded").select("fp", F.explode(flips).alias("signature"))
    least = signed.groupBy("signature").agg(F.count("*").alias("n"), F.min("fp").alias("a")).where("n > 1")
    # Spark takes an exploded table for as small as its file; a merge join keeps it from being broadcast.
    stars = signed.hint("merge").join(least, "signature").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Texts are lower-cased in ASCII and cut at ASCII white space; null, empty and blank texts have the
    fingerprint zero and are linked like any other. Fingerprints link at two or fewer differing bits.
    Null identifiers never name a component unless all of its rows lack one. An empty table gives an
    empty result. Only id_col and text_col are read.
    """
    marked = staged(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "simhash-rows")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = staged(components(links(distinct.select("fp"))), "simhash-components")
    member = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a document's shingle hashes: bits that more than half of them have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > len(hashes), np.uint64(1) << BITS, np.uint64(0))))


#: Longs of a document's parity sketch, and of the wider one of documents with more than LONG shingles.
SKETCH, WIDE, LONG = 8, 256, 800


def parities(h: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Whether an odd number of the shingles falls on each of 64 * longs places, as signed longs.

    Two sketches differ in no more bits than the sets differ in shingles, so they can rule a pair out for certain.
    """
    odd = np.bincount((h >> np.uint64(20)) % np.uint64(64 * longs), minlength=64 * longs).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _shingled(words: int, id_type: pa.DataType):
    """digest, doc_id, fp (fingerprint), sketch, wide (the sketch of a long document) and h (the different shingles' hashes in order) of every row."""
    schema = pa.schema([("digest", pa.binary()), ("doc_id", id_type), ("fp", pa.int64()), ("sketch", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("shingles", object)  # the caches of an operator before are no longer wanted
        for batch in batches:
            fps, sketches, wide, hashes = np.zeros(batch.num_rows, dtype=np.uint64), [], [], []
            for i, t in enumerate(batch.column(2)):
                h = shingle_hashes(words_of(t.as_py()), words)
                if len(h):
                    fps[i] = majority(h)
                h = np.unique(h)
                sketches.append(parities(h))
                wide.append(parities(h, WIDE) if len(h) > LONG else None)
                hashes.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64)), pa.array(sketches, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))], schema=schema)

    return run


def prefix_length(size: int, similarity: float) -> int:
    """How many first shingles of a document one of that similarity must meet: all but ceil(similarity * size), and one."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def _prefixed(similarity: float, common: np.ndarray):
    """rid, size (different shingles) and the document's first shingles in the order of all: by hash, common ones last.

    Documents of that similarity have ceil(similarity * size) shingles in common, so one at least is among the
    first of either. Documents without words have the shingle zero.
    """
    order = np.argsort(common)
    listed = common[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, chosen = [], []
            for x in batch.column(1):
                h = x.values.to_numpy(zero_copy_only=False)
                sizes.append(len(h))
                if len(listed) and len(h):
                    at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
                    known = listed[at] == h
                    h = np.concatenate([h[~known], common[np.sort(order[at[known]])]])
                chosen.append(h[: prefix_length(len(h), similarity)] if len(h) else np.zeros(1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(chosen, pa.list_(pa.int64()))], names=["rid", "size", "first"])

    return run


def common_shingles(rows: DataFrame, similarity: float, crowd: int, rounds: int = 2, most: int = 50_000) -> np.ndarray:
    """The shingles that crowd the documents' prefixes, rarest first; counted over all documents.

    They come last in the order of shingles, which lets others into the prefixes, so a few rounds find those
    too. The order may be any; this one has few candidates.
    """
    counts: dict[int, int] = {}
    for _ in range(rounds):
        listed = np.array(sorted(counts, key=lambda k: (counts[k], k))[-most:], dtype=np.int64)
        keys = rows.select("rid", "h").mapInArrow(_prefixed(similarity, listed), "rid long, size int, first array<long>").select(F.explode("first").alias("key"))
        often = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).orderBy(F.desc("n"), "key").limit(most)
        fresh = {r["key"]: r["n"] for r in often.collect()}
        sweep(rows.sparkSession)
        if fresh.keys() <= counts.keys():
            break
        counts |= {k: max(n, counts.get(k, 0)) for k, n in fresh.items()}
    return np.array(sorted(counts, key=lambda k: (counts[k], k))[-most:], dtype=np.int64)


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(one, two, assume_unique=True))
                near[i] = both >= similarity * (len(one) + len(two) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return run


def positioned(similarity: float):
    """fits of bucket_links: whether two documents can be that similar that share one shingle, the at-th of either's
    prefix, and none before: the shingles left must hold all that they need in common, and sizes must suit."""

    def fits(x: Column, y: Column) -> Column:
        least = (x["size"] + y["size"]) * (similarity / (1 + similarity)) - 1e-6
        sizes = F.least(x["size"], y["size"]) >= similarity * F.greatest(x["size"], y["size"])
        return sizes & (x["size"] - x["at"] >= least) & (y["size"] - y["at"] >= least)

    return fits


def sketched(similarity: float, longs: int = SKETCH):
    """near of bucket_links: whether sketches (mark) allow two documents to be that similar."""

    def near(x: Column, y: Column) -> Column:
        most = (x["size"] + y["size"]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        return reduce(lambda a, b: a + b, [F.bit_count(x["mark"][i].bitwiseXOR(y["mark"][i])) for i in range(longs)]) <= most

    return near


def plausible(rows: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b of rids) that sizes and sketches do not rule out: sets of m and n shingles that are that
    similar differ in (m + n) * (1 - similarity) / (1 + similarity) of them at most."""
    side = rows.select("rid", "sketch", F.size("h").alias("size"))
    one = pairs.join(side.select(F.col("rid").alias("a"), F.col("sketch").alias("s"), F.col("size").alias("m")), "a")
    two = one.join(side.select(F.col("rid").alias("b"), F.col("sketch").alias("t"), F.col("size").alias("n")), "b")
    most = (F.col("m") + F.col("n")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("s")[i].bitwiseXOR(F.col("t")[i])) for i in range(SKETCH)])
    likely = staged(two.where(apart <= most).select("a", "b", "m", "n"), "near-likely")
    # Long documents fill a sketch; theirs is looked at once more in a wider one before their shingles move.
    long = likely.where((F.col("m") > LONG) & (F.col("n") > LONG))
    ends = long.select(F.col("a").alias("digest")).unionByName(long.select(F.col("b").alias("digest"))).distinct()
    broad = filtered(rows.where("wide is not null").select("rid", "wide", F.col("rid").alias("digest")), ends, 2 * long.count(), FILTER_BITS)
    first = long.join(broad.select(F.col("rid").alias("a"), F.col("wide").alias("s")), "a")
    both = first.join(broad.select(F.col("rid").alias("b"), F.col("wide").alias("t")), "b")
    bits = F.aggregate(F.zip_with("s", "t", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return likely.where((F.col("m") <= LONG) | (F.col("n") <= LONG)).select("a", "b").unionByName(both.where(bits <= most).select("a", "b"))


def _verified(rows: DataFrame, pairs: DataFrame, similarity: float, label: str) -> DataFrame:
    """The pairs (a, b of rids) whose whole sets of shingles are that similar."""
    likely = staged(plausible(rows, pairs, similarity), "near-plausible")
    ends = likely.select(F.col("a").alias("digest")).unionByName(likely.select(F.col("b").alias("digest"))).distinct()
    side = filtered(rows.select("rid", "h", F.col("rid").alias("digest")), ends, 2 * likely.count(), FILTER_BITS)
    one = likely.join(side.select(F.col("rid").alias("a"), F.col("h").alias("x")), "a")
    two = one.join(side.select(F.col("rid").alias("b"), F.col("h").alias("y")), "b").select("a", "b", "x", "y")
    return staged(two.mapInArrow(_similar(similarity), "a long, b long"), label)


def fingerprint_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b of rids) of documents whose fingerprints are equal or meet in the index, verified on their shingles."""
    first = staged(rows.groupBy("fp").agg(F.min("rid").alias("least")), "near-fingerprints")
    same = rows.join(first, "fp").where("rid <> least").select(F.col("least").alias("a"), F.col("rid").alias("b"))
    near = links(first.select("fp"))
    ends = [first.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_rid")) for c in ("a", "b")]
    across = near.join(ends[0], "a").join(ends[1], "b").select(F.least("a_rid", "b_rid").alias("a"), F.greatest("a_rid", "b_rid").alias("b"))
    return _verified(rows, same.unionByName(across), similarity, "near-by-fingerprint")


def _digest(id_col: str, text_col: str) -> Column:
    """128 bits of a row's identifier and text, nulls told from empty texts of identifiers."""
    said = F.to_json(F.struct(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), {"ignoreNullFields": "false"})
    return F.unhex(F.substring(F.sha2(said, 256), 1, 32))


def similar_pairs(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, crowd: int = 32, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows has rid (a number), digest and doc_id of every row; links joins rids of near copies.

    Documents whose fingerprints are at most two bits apart are candidates by the index of deletion variants.
    Fingerprints of documents at that similarity mostly differ in more bits, so the others come from an exact
    prefix filter: documents that share one of their first shingles in an order of all shingles, which every
    pair of the similarity does, short texts as well. In a group of candidates every pair is tried that is not
    joined already (bucket_links); pairs whose sizes, places of the shared shingle or sketches rule out the similarity
    are left out before they become rows; the rest is verified on all shingles.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(_digest(id_col, text_col).alias("digest"), F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = narrow.schema["doc_id"].dataType
    shingled = narrow.mapInArrow(_shingled(words, to_arrow_type(kind)), f"digest binary, doc_id {kind.simpleString()}, fp long, sketch array<long>, wide array<long>, h array<long>")
    rows = staged(shingled.withColumn("rid", F.monotonically_increasing_id()), "near-rows")
    prefixes = rows.select("rid", "h").mapInArrow(_prefixed(similarity, common_shingles(rows, similarity, crowd)), "rid long, size int, first array<long>")
    keys = staged(prefixes, "near-prefixes").select("rid", "size", F.posexplode("first").alias("at", "key"))
    known = fingerprint_links(rows, similarity)
    verify = lambda pairs, label: _verified(rows, pairs, similarity, label)
    marks = rows.select("rid", F.col("sketch").alias("mark"))
    return rows.select("rid", "digest", "doc_id"), bucket_links(keys, verify, known=known, fits=positioned(similarity), marks=marks, near=sketched(similarity))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest identifier; all columns kept.

    Null and empty texts are near copies of each other. Null identifiers lose every tie. Of rows that repeat
    identifier and text one stays at most. An empty table gives an empty result.
    """
    rows, near = similar_pairs(docs, id_col=id_col, text_col=text_col, **options)
    member = components(near).withColumnRenamed("node", "rid")
    grouped = staged(rows.join(member, "rid"), "near-members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    stays = grouped.groupBy("root").agg(F.min(order).alias("s"))
    mark, digest = unused(docs, "row_digest"), _digest(id_col, text_col)
    gone = staged(grouped.join(stays, "root").where(F.col("digest") != F.col("s.digest")).select("digest").distinct(), "near-gone")
    # Most documents stay, and the filter knows that of them; only the others are shuffled with their texts.
    whole, n = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest")), gone.count()
    asked = filtered(whole, gone, n, FILTER_BITS).join(F.broadcast(gone) if n < 1000 else gone, "digest", "left_anti")
    left = filtered(whole, gone, n, FILTER_BITS, others=True).unionByName(asked).select("row.*")
    return single(left, rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias(mark)), digest, mark)
