"""Intervals: the usual spellings and ISO 8601, kept as months, days and microseconds apart."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit names by what they count, in (months, days, microseconds).
UNITS = {
    "microsecond": (0, 0, 1), "us": (0, 0, 1), "usec": (0, 0, 1), "millisecond": (0, 0, 1000), "ms": (0, 0, 1000), "msec": (0, 0, 1000),
    "second": (0, 0, 10**6), "sec": (0, 0, 10**6), "s": (0, 0, 10**6), "minute": (0, 0, 60 * 10**6), "min": (0, 0, 60 * 10**6), "m": (0, 0, 60 * 10**6),
    "hour": (0, 0, 3600 * 10**6), "hr": (0, 0, 3600 * 10**6), "h": (0, 0, 3600 * 10**6), "day": (0, 1, 0), "d": (0, 1, 0), "week": (0, 7, 0), "w": (0, 7, 0),
    "month": (1, 0, 0), "mon": (1, 0, 0), "year": (12, 0, 0), "yr": (12, 0, 0), "y": (12, 0, 0), "decade": (120, 0, 0), "century": (1200, 0, 0), "centurie": (1200, 0, 0), "millennium": (12000, 0, 0),
}

_FIELD = re.compile(r"([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)\s*([a-z]+)")
_CLOCK = re.compile(r"([+-]?)(\d+):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?")
_ISO = re.compile(r"P(?:(-?[\d.]+)Y)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)W)?(?:(-?[\d.]+)D)?(?:T(?:(-?[\d.]+)H)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)S)?)?", re.I)


def _spread(amount: str, unit: tuple[int, int, int]) -> tuple[int, int, int]:
    """A possibly fractional amount of a unit: months spill into days of 30 a month, days into 24 hours."""
    from fractions import Fraction

    n = Fraction(amount)
    months, days, usec = (n * u for u in unit)
    whole_months, whole_days = int(months), 0
    days += (months - whole_months) * 30
    whole_days = int(days)
    usec += (days - whole_days) * 24 * 3600 * 10**6
    return whole_months, whole_days, round(usec)


def parse(text: str | None) -> tuple[int, int, int] | None:
    """months, days, microseconds; None where the text is no interval."""
    if text is None:
        return None
    said = text.strip()
    if said[:1] in "Pp" and len(said) > 1 and (m := _ISO.fullmatch(said)):
        names = ("year", "month", "week", "day", "hour", "minute", "second")
        parts = [_spread(v, UNITS[n]) for n, v in zip(names, m.groups(), strict=True) if v]
        return tuple(map(sum, zip(*parts, strict=True))) if parts else None
    low, ago = said.lower().lstrip("@ "), False
    if low.endswith(" ago"):
        low, ago = low[:-4], True
    total, rest = [0, 0, 0], low
    if m := _CLOCK.search(rest):
        sign = -1 if m[1] == "-" else 1
        seconds = _spread(m[4] or "0", UNITS["second"])[2]
        total[2] += sign * (int(m[2]) * 3600 * 10**6 + int(m[3]) * 60 * 10**6 + seconds)
        rest = rest[: m.start()] + " " + rest[m.end() :]
    seen = m is not None
    for f in _FIELD.finditer(rest):
        name = f[2] if f[2] in UNITS else f[2].removesuffix("s")
        if name not in UNITS:
            return None
        total = [a + b for a, b in zip(total, _spread(f[1], UNITS[name]), strict=True)]
        seen = True
    if not seen or _FIELD.sub("", rest).strip():
        return None
    return tuple(-x for x in total) if ago else tuple(total)


def show(value: tuple[int, int, int] | None) -> str | None:
    """The one spelling: years, months, days, then a clock."""
    if value is None:
        return None
    months, days, usec = value
    parts = []
    for n, unit in ((int(months / 12), "year"), (months - 12 * int(months / 12), "mon"), (days, "day")):
        if n:
            parts.append(f"{n} {unit}{'' if n == 1 else 's'}")
    if usec or not parts:
        s, part = divmod(abs(usec), 10**6)
        clock = f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}" + (f".{part:06}".rstrip("0") if part else "")
        parts.append(("-" if usec < 0 else "") + clock)
    return " ".join(parts)


def interval_text(column: Column) -> Column:
    """Canonical interval text, in Arrow batches; null where the text is no interval."""

    @F.pandas_udf("string")
    def spelled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: show(parse(t)), na_action="ignore")

    return spelled(column)
