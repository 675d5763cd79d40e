"""One spelling for every value, by its type, as column expressions (intervals apart).

Two values are equal if their canonical texts are. None of the functions but sorted_json needs Python on
the executors; what only text can say (numbers of more than 38 digits) is canonicalised by regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a date parser reads as a moment that moves.
MOVING = ("now", "today", "tomorrow", "yesterday", "epoch", "infinity", "-infinity", "allballs")
NIL_UUID = "00000000-0000-0000-0000-000000000000"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decimal_text(text: Column) -> Column:
    """A plain decimal numeral in its one spelling: no sign on zero, no zeros that say nothing. Null if it is none."""
    said = F.trim(text)
    sign = F.when(said.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(said, r"^[+-]", "")
    whole = F.regexp_replace(F.regexp_extract(digits, r"^([0-9]*)", 1), r"^0+", "")
    part = F.regexp_replace(F.regexp_extract(digits, r"\.([0-9]*)$", 1), r"0+$", "")
    shown = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(said.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.concat(F.when(shown == "0", "").otherwise(sign), shown))


def expanded(text: Column) -> Column:
    """A numeral without its exponent: 1.5e3 as 1500, 1E-9 as 0.000000001. Null where it is no numeral."""
    return _let(_let(F.trim(text), _without_exponent), decimal_text)


def _without_exponent(said: Column) -> Column:
    sign = F.when(said.startswith("-"), "-").otherwise("")
    whole, part = F.regexp_extract(said, r"^[+-]?([0-9]*)", 1), F.regexp_extract(said, r"\.([0-9]*)", 1)
    power = F.coalesce(F.regexp_extract(said, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.concat(whole, part)
    point, n = F.length(whole) + power, F.length(digits)
    low = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    high = F.concat(digits, F.repeat(F.lit("0"), point - n))
    inside = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))
    plain = F.when(point <= 0, low).when(point >= n, high).otherwise(inside)
    return F.when(said.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?$"), F.concat(sign, plain))


def number_text(column: Column, double: bool = True) -> Column:
    """A binary number as exact decimal text, the shortest that reads back as it; NaN and infinities keep their names.

    The JVM's own text of a double may have a digit more than it needs, so 15 and 16 digits are tried first.
    """
    said = column.cast("string")
    if double:
        short = [F.format_string(f"%.{n}e", column) for n in (14, 15)]
        fits = [F.when(s.try_cast("double") == column, s) for s in short]
        said = F.when(said.rlike("^-?[0-9]"), F.coalesce(*fits, said)).otherwise(said)
    return _let(said, lambda t: F.coalesce(expanded(t), t))


def instant_text(column: Column, zoned: bool = True) -> Column:
    """A timestamp as RFC 3339 in UTC, with a fraction only where there is one, whatever the session's zone."""
    if zoned:
        seconds = F.unix_micros(column).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")
        column = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.concat(F.translate(column.cast("string"), " ", "T"), F.lit("Z"))


def json_text(text: Column) -> Column:
    """JSON with sorted keys, no spaces and canonical numbers; null where the text is no JSON."""
    return F.try_parse_json(text).cast("string")


def uuid_text(text: Column) -> Column:
    """A UUID in lower case with hyphens; null where the text is none."""
    bare = F.lower(F.regexp_replace(text, r"[{}\-]", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def bytes_text(sequence: Column) -> Column:
    r"""An array of integers 0 to 255 as \x and hexadecimal digits; null if one is out of range."""
    fine = F.forall(sequence, lambda b: b.between(0, 255) & b.isNotNull())
    return F.when(fine, F.concat(F.lit("\\x"), F.lower(F.array_join(F.transform(sequence, lambda b: F.lpad(F.hex(b), 2, "0")), ""))))


def text_of(df: DataFrame, name: str) -> Column:
    """The canonical text of a column by its type; null stays null."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return c.cast("string")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("string")
    if isinstance(kind, T.DecimalType):
        return decimal_text(c.cast("string"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return number_text(c, isinstance(kind, T.DoubleType))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return instant_text(c, isinstance(kind, T.TimestampType))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    return F.to_json(c, {"ignoreNullFields": "false"})


def value_of(text: Column, kind: T.DataType) -> Column:
    """The inverse of text_of: a canonical text as a value of a type."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.TimestampNTZType):
        return F.regexp_replace(text, "Z$", "").cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.substring(text, F.lit(3), F.length(text)))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind)
    return text.cast(kind)


def comparable(kind: T.DataType) -> bool:
    """Whether <=> decides equality of two values of the type as their canonical texts do."""
    if isinstance(kind, T.ArrayType):
        return comparable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(comparable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def is_zero(df: DataFrame, name: str) -> Column:
    """Null, empty text, zero number or false: what a loader takes for "not set"."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, T.BooleanType):
        return c.isNull() | ~c
    if isinstance(kind, T.NumericType):
        return c.isNull() | (c == 0)
    return c.isNull()


def first_set(df: DataFrame, names: list[str]) -> Column:
    """struct(name, value): the first of the columns that is not zero, or null; the "any of" part of a key."""
    picks = [F.when(~is_zero(df, n), F.struct(F.lit(n).alias("name"), text_of(df, n).alias("value"))) for n in names]
    return F.coalesce(*picks)


def key_json(df: DataFrame, names: list[str]) -> Column:
    """An injective key: quoted names and canonical values, nulls kept apart from the word null."""
    return F.to_json(F.struct(*[text_of(df, n).alias(n) for n in names]), {"ignoreNullFields": "false"})


def label(df: DataFrame, model: str, names: list[str]) -> Column:
    """Model/col=value/... over the sorted key columns, for reports."""
    return F.concat_ws("/", F.lit(model), *[F.concat(F.lit(f"{n}="), F.coalesce(text_of(df, n), F.lit("NULL"))) for n in sorted(names)])


def slug(text: Column) -> Column:
    """Lower-case letters, digits and single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fold(text: Column) -> Column:
    return F.lower(text)


def too_long(text: Column, kind: str, n: int) -> Column:
    """Whether a value does not fit: varchar and char ignore trailing blanks, bit is exact, varbit has a most."""
    if kind in ("varchar", "char"):
        return F.char_length(F.rtrim(text)) > n
    return F.char_length(text) != n if kind == "bit" else F.char_length(text) > n


def holds_fraction(text: Column) -> Column:
    """A numeral with a fraction, which a cast to an integer would lose without a word."""
    return F.coalesce(decimal_text(text), F.lit("")).contains(".")


def session_dependent(text: Column) -> Column:
    """Texts whose moment depends on the session: moving words, slashed dates, times without an offset."""
    t = F.lower(F.trim(text))
    no_offset = t.rlike(r"^\d{4}-\d\d-\d\d[ t]\d\d:\d\d") & ~t.rlike(r"(z|[+-]\d\d(:?\d\d)?)$")
    return t.isin(*MOVING) | t.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}") | no_offset


def float_reading_differs(text: Column) -> Column:
    """Whether a numeral read as a 64-bit float is another number."""
    pair = F.struct(expanded(text).alias("exact"), number_text(text.try_cast("double")).alias("back"))
    return _let(pair, lambda p: p["exact"].isNotNull() & ~p["exact"].eqNullSafe(p["back"]))


#: A moment as text: a date, or date and clock with or without an offset.
MOMENT = r"^\d{4}-\d\d?-\d\d?([Tt ]+\d\d?:\d\d:\d\d(\.\d*)?\s*([Zz]|[+-]\d\d?(:?\d\d)?)?)?$"


def moment_text(text: Column) -> Column:
    """A text that names a moment as RFC 3339 in UTC; one without an offset is meant in UTC. Null where it names none."""
    said = F.trim(text)
    shaped = said.rlike(MOMENT)
    day = F.regexp_extract(said, r"^(\d{4}-\d\d?-\d\d?)", 1)
    clock = F.regexp_extract(said, r"[Tt ]+(\d\d?:\d\d:\d\d(\.\d*)?)", 1)
    offset = F.regexp_replace(F.upper(F.regexp_extract(said, r":\d\d(?:\.\d*)?\s*([Zz]|[+-]\d\d?(?::?\d\d)?)$", 1)), r"^([+-])(\d\d):?(\d\d)$", "$1$2:$3")
    zone = F.when(offset == "", "Z").when(offset.rlike(r"^[+-]\d\d?$"), F.concat(offset, F.lit(":00"))).otherwise(offset)
    full = F.concat(day, F.lit("T"), F.when(clock == "", "00:00:00").otherwise(F.regexp_replace(clock, r"\.$", "")), zone)
    return F.when(shaped, instant_text(full.try_cast("timestamp")))


def clock_reading_differs(text: Column) -> Column:
    """Whether a text read as a moment is stored as something else than the text says: more than six digits of a fraction."""
    return moment_text(text).isNotNull() & F.rtrim(F.regexp_extract(text, r"\.(\d+)", 1), F.lit("0")).rlike(r"^\d{7,}$")


def printed_copy(text: Column, kind: str) -> Column:
    """What a copied value is printed as by its source's type: booleans and UUIDs have a spelling of their own."""
    if kind == "boolean":
        return F.when(F.lower(text).isin("t", "true", "yes", "on", "1"), "true").when(F.lower(text).isin("f", "false", "no", "off", "0"), "false")
    return uuid_text(text) if kind == "uuid" else text


def instants_in_json(json: Column) -> Column:
    """A JSON array of scalars with its moments in one spelling; other elements keep theirs."""
    parts = F.from_json(json, "array<string>")
    return F.to_json(F.transform(parts, lambda v: F.coalesce(moment_text(v), v)), {"ignoreNullFields": "false"})


def quoted_json(text: Column) -> Column:
    """A text as a JSON string; what is no UTF-8 becomes the replacement character."""
    return F.regexp_replace(F.to_json(F.array(F.make_valid_utf8(text))), r"(?s)^\[(.*)\]$", "$1")


def holds_null(json: Column) -> Column:
    """Whether a JSON array has a null among its elements."""
    return F.coalesce(F.exists(F.from_json(json, "array<string>"), lambda v: v.isNull()), F.lit(False))


def beyond_float(json: Column) -> Column:
    """The numbers in a JSON text that a 64-bit float cannot hold, as written."""
    bare = F.regexp_replace(json, r'"(\\.|[^"\\])*"', '""')
    numerals = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"), F.lit(0))
    return F.filter(numerals, lambda n: float_reading_differs(n))


def sorted_json(column: Column) -> Column:
    """JSON with the keys of every object by length, then by bytes, and one blank after commas and colons (Arrow batches)."""

    @F.pandas_udf("string")
    def spelled(texts: pd.Series) -> pd.Series:
        return texts.map(_sorted_json, na_action="ignore")

    return spelled(column)


def _sorted_json(text: str) -> str | None:
    import json
    from decimal import Decimal

    def shown(v) -> str:
        if isinstance(v, dict):
            names = sorted(v, key=lambda k: (len(k.encode()), k.encode()))
            return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {shown(v[k])}" for k in names) + "}"
        if isinstance(v, list):
            return "[" + ", ".join(map(shown, v)) + "]"
        return format(v, "f") if isinstance(v, Decimal) else json.dumps(v, ensure_ascii=False)

    try:
        return shown(json.loads(text, parse_float=Decimal, parse_int=Decimal))
    except ValueError:
        return None


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs], F.lit(True))


def zero_text(kind: T.DataType) -> str | None:
    """The text of a type's zero; None where it has none."""
    if isinstance(kind, T.NumericType):
        return "0"
    return {T.BooleanType: "false", T.StringType: ""}.get(type(kind))


def array_literal(json: Column) -> Column:
    """A JSON array of scalars as a literal {a,"b c",NULL}; null where it is no flat array."""
    parts = F.from_json(json, "array<string>")
    bare = lambda v: v.rlike('^[^\\s{},"\\\\]+$') & (F.lower(v) != "null")
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, '(["\\\\])', "\\\\$1"), F.lit('"'))
    shown = F.transform(parts, lambda v: F.when(v.isNull(), "NULL").when(bare(v), v).otherwise(quoted(v)))
    nested = json.rlike(r"^\s*\[\s*[\[{]")
    return F.when(parts.isNotNull() & ~nested, F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}")))


def nested_array_literal(json: Column) -> Column:
    """A JSON array of arrays of scalars as a literal {{a,b},{c,d}}; null where the rows differ in length or it is none."""
    rows = F.from_json(json, "array<array<string>>")
    each = F.transform(rows, lambda r: array_literal(F.to_json(r, {"ignoreNullFields": "false"})))
    even = F.array_size(F.array_distinct(F.transform(rows, lambda r: F.array_size(r)))) == 1
    whole = F.forall(each, lambda t: t.isNotNull()) & even
    return F.when(rows.isNotNull() & whole, F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}")))


def natural_key(df: DataFrame, key: list[str], any_of: list[list[str]] = ()) -> Column:
    """A row's natural key as a map: its key columns, and of each "any of" group the first column that is set."""
    own = [F.struct(F.lit(k).alias("k"), text_of(df, k).alias("v")) for k in key]
    picked = [F.struct(p["name"].alias("k"), p["value"].alias("v")) for p in (first_set(df, list(g)) for g in any_of)]
    return F.map_from_entries(F.filter(F.array(*own, *picked), lambda e: e["k"].isNotNull()))


def full_row(df: DataFrame, columns: list[str], id_col: str | None = None) -> Column:
    """A row as a map of its columns' texts, with the id where the files own it."""
    names = [*([id_col] if id_col else []), *columns]
    return F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), text_of(df, c).alias("v")) for c in names]))


def deleted_in_files(df: DataFrame, column: str) -> Column:
    """Whether a file's row says that it is deleted: the soft-delete column is set, and not to the zero time."""
    return F.col(column).isNotNull() & (F.year(column) > 1)


def snake(name: str) -> str:
    """A field name as a column name: words in lower case, joined by underscores."""
    import re

    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
