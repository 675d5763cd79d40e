r"""Secret scans in DataFrame operations only: fixed patterns, and character Markov models for the rest.

Matches of the patterns are placed by splitting the text at them: a match starts after all gaps and
matches before it. Long unbroken strings that no pattern covers are compared under two first-order
Markov models of characters, one of random strings and one of ordinary identifiers; those whose
log-likelihood ratio is high enough are added. The models are trained from labelled samples: random
strings are digests in several alphabets and the values that the patterns found, ordinary ones are
identifiers made of the words of a bounded sample of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: The base kinds and their patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
#: What the models may add: unbroken strings of this alphabet and at least this length, holding a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ADDED = "markov"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _part(kind: int, pattern: str, group: int) -> Column:
    """For a text that holds the pattern: its gaps, matches and values."""
    text = F.col("text")
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.lit(kind).alias("kind"),
            F.split(text, pattern, -1).alias("gaps"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
        ),
    )


def _spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, value: every match, and one row without a kind for each document.

    One pass gives both, so a document's number is the same in all its rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    nothing = F.array().cast("array<string>")
    mark = F.struct(F.lit(-1).alias("kind"), nothing.alias("gaps"), nothing.alias("matches"), nothing.alias("values"))
    parts = F.array(mark, _part(0, ASSIGN, 1), _part(1, ACCESS, 0), _part(2, HEX, 0), _part(3, CANDIDATE, 0))
    found = rows.select("row", "doc_id", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"))
    each = found.select("row", "doc_id", "p.kind", F.posexplode_outer(F.arrays_zip("p.gaps", "p.matches", "p.values")).alias("i", "m"))
    each = each.select("row", "doc_id", "kind", "i", F.char_length("m.gaps").alias("gap"), F.col("m.matches").alias("match"), F.col("m.values").alias("value"))
    long = F.coalesce(F.char_length("match"), F.lit(0))
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + long).over(before).cast("long"))
    placed = placed.withColumn("start", F.col("end") - long)
    holds = F.when(F.col("kind") == 0, F.char_length("value") >= 6).when(F.col("kind") == 3, F.col("value").rlike("[0-9]")).otherwise(True)
    kept = placed.where((F.col("kind") < 0) | (F.col("match").isNotNull() & holds))
    return kept.select("row", "doc_id", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"), "start", "end", "value")


def _uncovered(spans: DataFrame) -> DataFrame:
    """Candidates that no base span of their document overlaps."""
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    left = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = spans.where("kind is not null").withColumn("left", left).withColumn("right", right)
    free = (F.coalesce(F.col("left"), F.lit(0)) <= F.col("start")) & (F.coalesce("right", "end") >= F.col("end"))
    return near.where((F.col("kind") == 3) & free).select("row", "doc_id", "start", "end", "value")


def _bigrams(strings: DataFrame) -> DataFrame:
    """g: each two neighbouring characters of column s."""
    letters = F.split("s", "")
    pairs = F.arrays_zip(letters.alias("x"), F.slice(letters, 2, 1 << 30).alias("y"))
    each = strings.where(F.char_length("s") > 1).select(F.explode(pairs).alias("p"), *[c for c in strings.columns if c != "s"])
    return each.where("p.y is not null").select(F.concat("p.x", "p.y").alias("g"), *[c for c in strings.columns if c != "s"])


def model(docs: DataFrame, spans: DataFrame, *, sample_docs: int = 500, samples: int = 2000) -> DataFrame:
    """g (two characters), ratio: the log-likelihood ratio of random against ordinary, for every pair of the alphabet.

    Ordinary identifiers come from the sample_docs documents of smallest hash, random
    strings from `samples` digests for each alphabet and from all values that the patterns found.
    """
    spark = docs.sparkSession
    # Hashes alone are ranked, so no task gathers texts to choose from; at most sample_docs hashes are broadcast.
    hashed = docs.where("text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample_docs)
    sample = hashed.join(F.broadcast(chosen), "h", "left_semi")
    words = F.filter(F.split(F.col("text"), r"[^A-Za-z0-9]+"), lambda w: w.rlike("^[A-Za-z]{2,}$"))
    word = sample.select(F.posexplode(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b"))).alias("i", "p")).select("p.a", F.lower("p.b").alias("b"), "i")
    ordinary = word.where("b is not null").select(F.when(F.col("i") % 4 == 0, F.concat_ws("_", F.upper("a"), F.upper("b"))).when(F.col("i") % 4 == 1, F.concat("a", F.initcap("b"))).when(F.col("i") % 4 == 2, F.concat_ws("-", "a", "b", (F.col("i") % 100).cast("string"))).otherwise(F.concat_ws("_", "a", "b")).alias("s"))
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    forms = F.array(F.base64(digest), F.substring(F.hex(digest), 1, 40), F.lower(F.hex(digest)), F.translate(F.base64(digest), "+/=abcdefghijklmnopqrstuvwxyz", "789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.translate(F.base64(digest), "+/=", "-__"))
    random = spark.range(samples).select(F.explode(forms).alias("s")).unionByName(spans.where("kind < 3").select(F.col("value").alias("s")))
    counts = _bigrams(ordinary.withColumn("label", F.lit(0)).unionByName(random.withColumn("label", F.lit(1)))).groupBy("g").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    letters = F.lit([*ALPHABET])
    grid = spark.range(1).select(F.explode(letters).alias("x")).select("x", F.explode(letters).alias("y")).select(F.concat("x", "y").alias("g"), "x")
    both = grid.join(counts, "g", "left").select("g", "x", F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n1"))
    start = Window.partitionBy("x")
    v = len(ALPHABET)
    given = lambda n: F.log((F.col(n) + 0.5) / (F.sum(n).over(start) + 0.5 * v))
    return staged(both.select("g", (given("n1") - given("n0")).alias("ratio")), "secret-model")


def secrets(docs: DataFrame, *, margin: float = 10.0, sample_docs: int = 500) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows that repeat an
    identifier, or have none, are scanned each for itself. An empty table gives an empty result. Only
    doc_id and text are read. A string is added as `markov` if it is likelier under the random model by
    more than `margin` (natural logarithm), and no base span overlaps it.
    """
    docs = docs.select("doc_id", "text")
    spans = staged(_spans(docs), "secret-spans")
    free = staged(_uncovered(spans), "secret-candidates")
    ratios = model(docs, spans, sample_docs=sample_docs)  # len(ALPHABET) squared rows
    scored = _bigrams(free.select(F.col("value").alias("s"), F.col("value").alias("of")).distinct()).join(F.broadcast(ratios), "g").groupBy("of").agg(F.sum("ratio").alias("score")).where(F.col("score") > margin)
    added = free.join(scored, free["value"] == scored["of"]).select("row", "doc_id", F.lit(3).alias("kind"), "start", "end")
    every = spans.where("kind is null or kind < 3").select("row", "doc_id", "kind", "start", "end").unionByName(added)
    name = F.element_at(F.lit([*KINDS, ADDED]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("said"))
    grouped = every.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("s"), *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)])
    base = F.filter("s", lambda x: x["kind"] < 3)
    return grouped.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.concat_ws(",", base["said"]), 256).alias("base_sha256"), F.concat_ws(",", F.col("s")["said"]).alias("spans"))
