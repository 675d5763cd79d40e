"""Toxicity: noisy-channel deobfuscation by Viterbi decoding, then a linear score of the restored words.

A character trigram model is counted over all documents. Tokens that look disguised (digits or signs
among letters, drawn-out or doubled letters, letters set apart) become a lattice: each character stands for
itself or for the letters it may replace, repeated letters may be fewer, separators may vanish, and what
sets single letters apart vanishes or ends a word. The path that costs least under channel and language
model is the restored token, or the restored words. Words and word beginnings of the
restored text are the features of a logistic regression on the labelled rows; identifiers, labels,
languages and sources are never features.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import kept, staged
from .tokens import _Generations

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = "._-*~'`"
#: Symbols of the character model: 0 is a word's edge, 1 to 26 a to z, then U+00DF to U+00FF, last any other letter.
FIRST_LATIN, LAST_LATIN = 0xDF, 0xFF
N = 27 + LAST_LATIN - FIRST_LATIN + 1 + 1
OTHER = N - 1

#: What the channel charges: a sign for a letter, a repeated letter left out, a separator, any other sign left out.
SUBSTITUTE, COLLAPSE, SEPARATE, DROP = 1.0, 1.2, 0.3, 8.0
#: Longer tokens are decoded each time they are met, so that the cache's size has a bound in bytes too.
CACHED = 256

_SIGN = re.compile(r"[0-9@$!|+€._*~'`-]")
#: Drawn out: a letter three times in a row, or two doubled letters.
_DRAWN = re.compile(r"([^\W\d_])\1(?:\1|.*([^\W\d_])\2)", re.S)
_APART = re.compile(r"(?<![^\W_])(?:[^\W_][ ._*-]){3,}[^\W_](?![^\W_])")
EDGES = "\"#%&()*,-./:;<=>?[\\]^_`{}~'…“”„«»¡¿"
PREFIXES = (4, 5, 6)


def _lut() -> np.ndarray:
    table = np.zeros(0x250, dtype=np.int64)
    for c in range(0x250):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = c - 96
        elif FIRST_LATIN <= c <= LAST_LATIN and ch.isalpha():
            table[c] = 27 + c - FIRST_LATIN
        elif ch.isalpha():
            table[c] = OTHER
    return table


def _symbol(ch: str) -> int:
    c = ord(ch)
    if "a" <= ch <= "z":
        return c - 96
    if FIRST_LATIN <= c <= LAST_LATIN and ch.isalpha():
        return 27 + c - FIRST_LATIN
    return OTHER if ch.isalpha() else 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of one task's texts: at most N^3 rows."""
    kept("language", object)  # the caches of an operator before are no longer wanted
    lut, total = _lut(), np.zeros(N**3, dtype=np.int64)

    def add(parts: list[str]) -> None:
        codes = np.frombuffer("\n\n".join(["", *parts, ""]).lower().encode("utf-32-le", "replace"), dtype="<u4")
        s = lut[np.minimum(codes, 0x24F)]
        tri = (s[:-2] * N + s[1:-1]) * N + s[2:]
        total[:] += np.bincount(tri[(s[1:-1] > 0) | (s[2:] > 0)], minlength=N**3)

    parts, size = [], 0
    for batch in batches:
        for t in batch.column(0):
            text = t.as_py() or ""
            parts.append(text)
            size += len(text)
            if size > 1 << 20:
                add(parts)
                parts, size = [], 0
    add(parts)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Natural logarithms of p(third | first two), N x N x N, from all texts."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    table = np.zeros(N**3)
    for r in counts.collect():  # at most N^3 (about 226,000) rows, whatever the corpus
        table[r["g"]] = r["n"]
    tri = table.reshape(N, N, N)
    two = tri.sum(axis=0) + 0.1
    back = two / two.sum(axis=1, keepdims=True)
    weight = 5.0
    return np.log((tri + weight * back[None]) / (tri.sum(axis=2, keepdims=True) + weight)).astype(np.float32)


class Decoder:
    """Restores disguised tokens under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def suspicious(self, token: str) -> bool:
        return " " in token or bool(_DRAWN.search(token)) or bool(_SIGN.search(token)) and any(c.isalpha() for c in token)

    def options(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character: what it may stand for, and at what cost. A space stands for a word's end.

        At a token's edge separators and plain punctuation vanish at no cost, an exclamation mark only at
        the end; digits and other signs cost the same there as anywhere.
        """
        runs = [(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", token, re.S)]
        apart = " " in token
        out = []
        for i, (ch, n) in enumerate(runs):
            last = i == len(runs) - 1
            if ch.isalpha():
                choices = [(ch * n, 0.0)] + [(ch * k, COLLAPSE * (1 + 0.1 * (n - k))) for k in (1, 2) if k < n]
            else:
                plain = ch in SEPARATORS or ch not in SIGNS
                if (plain and (i == 0 or last)) or (last and ch == "!"):
                    choices = [("", 0.0)]
                else:
                    choices = [("", SEPARATE if ch in SEPARATORS or ch == " " else DROP)]
                if apart and (ch == " " or ch in SEPARATORS):
                    choices.append((" ", 0.0))
                choices += [(x * k, SUBSTITUTE * k + COLLAPSE * (n > k)) for x in SIGNS.get(ch, "") for k in sorted({1, n}) if k <= 3]
            out.append(choices)
        return out

    def cost(self, said: str) -> float:
        """What the language model charges for a reading, its last word's end included."""
        codes = [0, 0, *map(_symbol, said), 0]
        return -sum(float(self.model[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    def restore(self, token: str) -> str:
        """The least-cost reading of a lower-case token: Viterbi over states of the last two symbols."""
        model = self.model
        # Each state: its cost, and the chain of choices that led there.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for choices in self.options(token):
            coded = [(letters, [_symbol(ch) for ch in letters], extra) for letters, extra in choices]
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, chain) in states.items():
                for letters, codes, extra in coded:
                    x, y, c = a, b, cost + extra
                    for z in codes:
                        c -= float(model[x, y, z])
                        x, y = y, z
                    if (x, y) not in new or c < new[x, y][0]:
                        new[x, y] = (c, (chain, letters))
            states = new
        (a, b), (_, chain) = min(states.items(), key=lambda s: s[1][0] - float(model[(*s[0], 0)]))
        parts = []
        while chain is not None:
            chain, letters = chain
            parts.append(letters)
        return "".join(reversed(parts))


class Reader:
    """Turns a text into tokens and a token into features, with bounded caches."""

    def __init__(self, model: np.ndarray, weights: dict[str, float] | None = None, limit: int = 100_000):
        self.decoder, self.weights = Decoder(model), weights or {}
        self.score_of = _Generations(self._weight, limit)

    @staticmethod
    def tokens(text: str | None) -> set[str]:
        """The text's tokens, and each run of single letters set apart as one token with spaces in it."""
        low = (text or "").lower()
        return {*low.split(), *(m.group() for m in _APART.finditer(low) if " " in m.group())}

    def features(self, token: str) -> list[str]:
        word = token.strip(EDGES)
        if self.decoder.suspicious(word):
            word = self.decoder.restore(word)
        found = []
        for part in word.split():
            part = part.strip("!" + EDGES)
            if part:
                found += [f"w:{part}", *(f"{k}:{part[:k]}" for k in PREFIXES if len(part) > k)]
        return found

    def _weight(self, token: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in self.features(token))

    def score(self, text: str | None, bias: float) -> float:
        z = bias + sum(self.score_of[t] if len(t) <= CACHED else self._weight(t) for t in self.tokens(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, y of at most `most` labelled rows whose identifier's checksum allows learning."""
    may = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & may).groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id")).limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")  # at most `most` pairs of integers


def _feature_counts(model_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model_b.value)
        counts = (defaultdict(int), defaultdict(int))
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for f in {f for t in reader.tokens(text.as_py()) for f in reader.features(t)}:
                    counts[y][f] += 1
        for y in (0, 1):
            names = list(counts[y])
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([y] * len(part), pa.int32()), pa.array([counts[y][f] for f in part], pa.int64())], names=["f", "y", "n"])

    return run


def _designed(model_b, index_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, index = Reader(model_b.value), index_b.value
        for batch in batches:
            rows = []
            for text in batch.column(0):
                own: dict[int, int] = defaultdict(int)
                for t in reader.tokens(text.as_py()):
                    for f in reader.features(t):
                        if f in index:
                            own[index[f]] += 1
                rows.append(([*own], [*map(float, own.values())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["at", "x", "y"])

    return run


def _regression(rows: list[tuple[list[int], list[float], int]], n: int, l2: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over sparse rows."""
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at = np.array([i for r in rows for i in r[0]], dtype=np.int64)
    x = np.minimum(np.array([v for r in rows for v in r[1]], dtype=np.float64), 5.0)
    y = np.array([r[2] for r in rows], dtype=np.float64)
    w, b = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    gw, gb = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(row, weights=x * w[at], minlength=len(rows))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(at, weights=x * e[row], minlength=n) + l2 * w
        h = e.sum()
        gw += g * g
        gb += h * h
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.5 * h / math.sqrt(gb)
    return w, b


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 8000, min_z: float = 3.5) -> tuple[np.ndarray, dict[str, float], float]:
    """Character model, feature weights and bias.

    The regression is fitted on at most max_labelled labelled rows (those of smallest hashed identifier), on
    every feature of theirs that tells the labels apart by min_z standard errors, so what reaches the driver
    has a bound; the character model counts every text.
    """
    context = docs.sparkSession.sparkContext
    model = language_model(docs)
    model_b = context.broadcast(model)
    sample = staged(_labelled(docs, labels, max_labelled), "tox-labelled")
    pos, neg = (sample.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first())
    if not pos or not neg:
        return model, {}, -30.0 if not pos else 30.0
    p, q = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
    counts = sample.mapInArrow(_feature_counts(model_b), "f string, y int, n long").groupBy("f").agg(p.alias("p"), q.alias("q"))
    cells = [F.col("p") + 0.5, F.lit(pos) - F.col("p") + 0.5, F.col("q") + 0.5, F.lit(neg) - F.col("q") + 0.5]
    z = (F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])) / F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3])
    best = counts.select("f", z.alias("z")).where(F.abs("z") > min_z).orderBy("f").collect()
    index = {r["f"]: i for i, r in enumerate(best)}
    designed = sample.mapInArrow(_designed(model_b, context.broadcast(index)), "at array<int>, x array<double>, y int").collect()
    w, b = _regression([(r["at"], r["x"], r["y"]) for r in designed], len(index))
    return model, {f: float(w[i]) for f, i in index.items()}, b


def _scored(model_b, weights_b, bias: float, name: str, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(name, lambda: Reader(model_b.value, weights_b.value))
        for batch in batches:
            scores = [reader.score(t.as_py(), bias) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    return run


def scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    docs has doc_id and text, labels doc_id and toxic (0, 1 or null); other columns are not read. Null
    and empty texts get the score of a text without features. Labels without a document, null labels
    and null identifiers are not learnt from; of repeated labels the larger counts. Without any toxic
    label every score is near 0, with toxic ones only near 1. An empty table gives an empty result.
    """
    context = docs.sparkSession.sparkContext
    model, weights, bias = train(docs, labels, **options)
    kind = docs.schema["doc_id"].dataType
    name = uuid.uuid4().hex
    run = _scored(context.broadcast(model), context.broadcast(weights), bias, name, to_arrow_type(kind))
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def civil(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without its rows predicted toxic, all columns kept, in any number and of any other names.

    A row is judged by its own text: null and empty texts get the score of a text without features, rows
    that share an identifier keep their own fate, repeated rows go together. An empty table gives an
    empty result; without toxic labels every row stays.
    """
    context = docs.sparkSession.sparkContext
    model, weights, bias = train(docs, labels, **options)
    model_b, weights_b = context.broadcast(model), context.broadcast(weights)
    name = uuid.uuid4().hex
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(name, lambda: Reader(model_b.value, weights_b.value))
        for batch in batches:
            yield batch.filter(pa.array([reader.score(t.as_py(), bias) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)
