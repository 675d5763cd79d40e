r"""Personal data by weak supervision on top of fixed patterns.

The base patterns mark what they mark. Looser candidates (spelled-out addresses, numbers without a
country code, numbers that fail a checksum, long network addresses) are put to labelers, each of which
says yes, no or nothing: a strict pattern, a gazetteer and the words around. Expectation-maximisation
estimates every labeler's reliability from how they agree over all documents, and its posteriors train a
logistic span classifier; candidates it accepts are added. Labelers and features have few values, so what
the driver fits on is a table of counts whose size does not depend on the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits whose start failed, so the look-behind only saves time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Looser candidates by kind.
LOOSE = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,4}"), re.compile(r"[\[(](?:at|dot)[\])]|\x20dot\x20")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")),
    (3, re.compile(r"(?<![\w+])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w])"), re.compile(r"[0-9][\x20.-][0-9]{4}")),
)
#: Gazetteers: endings of domains, first digits of card issuers by scheme, area codes that exist in form (first digit 2 to 9).
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app de fr es it uk us ca au jp cn nl ch at be se no fi dk pl pt ie eu".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|3(?:0[0-5]|[689])|35")
#: Words that speak for a kind, or against it.
CONTEXT = (
    re.compile(r"(?i)\b(?:e-?mail|mailto|contact|write|correo|courriel)\b"),
    re.compile(r"(?i)\b(?:ip|host|server|address|adresse|dirección)\b"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|iban)\b"),
    re.compile(r"(?i)\b(?:call|phone|tel|mobile|fax|telefon|téléphone|teléfono|whatsapp)\b"),
)
AGAINST = re.compile(r"(?i)\b(?:isbn|issn|doi|order|invoice|version|serial|sku|id|nr|page|build|release)\b")
NEAR = 40
LABELERS, SHAPES = 3, 6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """For each @, the longest local part before it that no earlier match holds, and the domain after it."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > taken and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at + 1)):
            out.append((lo, m.end()))
            taken = m.end()
        at = text.find("@", max(at + 1, taken))
    return out


def base(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end of what the base patterns mark, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _votes(kind: int, said: str, before: str, after: str) -> tuple[int, int, int]:
    """Of the strict pattern, the gazetteer and the context: 0 nothing, 1 no, 2 yes."""
    digits = re.sub(r"[^0-9]", "", said)
    if kind == 0:
        strict = 2 if re.search(r"[\[(](?:at|@)[\])]", said) else 0
        gazetteer = 2 if re.split(r"[^A-Za-z0-9-]+", said)[-1].lower() in ENDINGS else 1
    elif kind == 1:
        strict = 2 if len(set(said.lower()) - {":"}) > 4 else 1
        gazetteer = 2 if re.match(r"(?i)2[0-9a-f]{3}:|fe80:|f[cd][0-9a-f]{2}:", said) else 1
    elif kind == 2:
        strict = 2 if 15 <= len(digits) <= 16 and re.search(r"[\x20-]", said) else 0
        gazetteer = 2 if ISSUERS.match(digits) else 1
    else:
        strict = 2 if re.fullmatch(r"(?:00\d{1,3}[\x20.-]?)?(?:\(\d{3}\)\x20|\d{3}[.-])\d{3}[\x20.-]\d{4}", said) else 1
        gazetteer = 2 if digits[-10] in "23456789" and digits[-7] in "23456789" else 1
    context = 2 if CONTEXT[kind].search(before) or CONTEXT[kind].search(after) else 1 if AGAINST.search(before) else 0
    return strict, gazetteer, context


def candidates(text: str, marked: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """kind, start, end and code (votes and shape) of looser spans that no base span overlaps."""
    found = []
    for kind, pattern, hint in LOOSE:
        if hint.search(text):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= sum(c.isdigit() for c in m.group()) <= 19:
            found.append((2, m.start(), m.end()))
    out, taken = [], sorted((a, b) for _, a, b in marked)
    at, upto = 0, 0
    for a, b, kind in sorted((a, b, k) for k, a, b in found):
        while at < len(taken) and taken[at][0] < b:
            upto = max(upto, taken[at][1])
            at += 1
        if a < upto:
            continue
        upto = max(upto, b)
        said = text[a:b]
        votes = _votes(kind, said, text[max(0, a - NEAR) : a], text[b : b + NEAR])
        shape = min(SHAPES - 1, (b - a) // 6)
        code = kind
        for v in votes:
            code = code * 3 + v
        out.append((kind, a, b, code * SHAPES + shape))
    return out


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scanned(id_type: pa.DataType):
    cand = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32())]))
    schema = pa.schema([("doc_id", id_type), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("base", pa.list_(cand.value_type)), ("candidates", cand)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                marked = base(text)
                n = [0] * len(KINDS)
                for k, _, _ in marked:
                    n[k] += 1
                loose = candidates(text, marked)
                rows.append((*n, hashlib.sha256(_named(marked).encode()).hexdigest(), [{"kind": k, "start": a, "end": b, "code": -1} for k, a, b in marked], [{"kind": k, "start": a, "end": b, "code": c} for k, a, b, c in loose]))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return run, cand


def _decoded(code: int) -> tuple[int, list[int], int]:
    code, shape = divmod(code, SHAPES)
    votes = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v)
    return code, votes[::-1], shape


def reliabilities(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Posterior of being personal data for each code, by expectation-maximisation for each kind.

    Each labeler has a distribution over its votes given the truth; the start trusts every labeler a little.
    """
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        own = [(c, n, _decoded(c)[1]) for c, n in counts.items() if _decoded(c)[0] == kind]
        prior = 0.3
        given = np.array([[[0.4, 0.4, 0.2], [0.3, 0.15, 0.55]]] * LABELERS)  # labeler, truth, vote
        post = np.zeros(0)
        for _ in range(rounds if own else 0):
            like = np.array([[p * math.prod(given[j, y, v[j]] for j in range(LABELERS)) for y, p in ((0, 1 - prior), (1, prior))] for _, _, v in own])
            post = like[:, 1] / like.sum(axis=1)
            n = np.array([x[1] for x in own], dtype=float)
            prior = float((post @ n + 1) / (n.sum() + 3))
            # Pseudo-counts keep a labeler's meaning when few spans speak for it.
            total = np.array([[[8.0, 8.0, 4.0], [6.0, 3.0, 11.0]]] * LABELERS)
            for (_, m, v), p in zip(own, post, strict=True):
                for j in range(LABELERS):
                    total[j, 0, v[j]] += m * (1 - p)
                    total[j, 1, v[j]] += m * p
            given = total / total.sum(axis=2, keepdims=True)
        out |= {c: float(p) for (c, _, _), p in zip(own, post, strict=True)}
    return out


def _features(code: int) -> np.ndarray:
    kind, votes, shape = _decoded(code)
    x = np.zeros(len(KINDS) * (1 + 3 * LABELERS) + SHAPES)
    at = kind * (1 + 3 * LABELERS)
    x[at] = 1
    for j, v in enumerate(votes):
        x[at + 1 + 3 * j + v] = 1
    x[len(KINDS) * (1 + 3 * LABELERS) + shape] = 1
    return x


def classifier(counts: dict[int, int], rounds: int = 300) -> dict[int, float]:
    """Probability for each code from a logistic regression trained on the posteriors, weighted by counts."""
    if not counts:
        return {}
    post = reliabilities(counts)
    codes = sorted(counts)
    x = np.array([_features(c) for c in codes])
    n = np.array([counts[c] for c in codes], dtype=float)
    y = np.array([post[c] for c in codes])
    w, g2 = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(rounds):
        g = x.T @ ((1 / (1 + np.exp(-(x @ w))) - y) * n) / n.sum() + 1e-4 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return dict(zip(codes, (1 / (1 + np.exp(-(x @ w)))).tolist(), strict=True))


def scan(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Offsets are code points, ends exclusive; spans are listed by kind, then start. Null and empty texts
    have none. Rows that repeat an identifier, or lack one, are scanned each for itself. An empty table
    gives an empty result. Only doc_id and text are read.
    """
    kind = docs.schema["doc_id"].dataType
    run, _ = _scanned(to_arrow_type(kind))
    span = "array<struct<kind:int,start:bigint,end:bigint,code:int>>"
    schema = f"doc_id {kind.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {span}, candidates {span}"
    found = staged(docs.select("doc_id", "text").mapInArrow(run, schema), "pii-spans")
    # At most len(KINDS) * 3^LABELERS * SHAPES codes.
    codes = found.select(F.explode("candidates.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()
    accepted = [c for c, p in classifier({r["code"]: r["n"] for r in codes}).items() if p >= threshold]
    added = F.filter("candidates", lambda c: c["code"].isin(accepted)) if accepted else F.slice("candidates", 1, 0)
    every = F.transform(F.array_sort(F.concat("base", added)), lambda s: F.concat_ws(":", F.element_at(F.lit([*KINDS]), s["kind"] + 1), s["start"], s["end"]))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.concat_ws(",", every).alias("spans"))
