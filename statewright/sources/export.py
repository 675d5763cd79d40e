"""Rows back into row files: dependency order, references as templates, every value read back and compared."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import beyond_float, is_zero, json_text, null_safe, text_of
from ..operators.ordering import topological
from ..plans.config import Config, Model
from .rowfiles import Row, parse, resolve, scalar


class ExportError(ValueError):
    """A value that a row file cannot carry."""


def anchor_of(model: Model, values: dict[str, str | None], taken: set[str]) -> str:
    base = re.sub("[^a-z0-9]+", "_", "_".join(values.get(k) or "null" for k in model.key).lower()).strip("_") or "row"
    base = base if base[0].isalpha() else f"r_{base}"
    name, n = base, 2
    while name in taken:
        name, n = f"{base}_{n}", n + 1
    taken.add(name)
    return name


def spelled(text: str | None) -> str:
    """A YAML spelling that reads back as the same text."""
    import yaml

    if text is None:
        return "null"
    if "\0" in text:
        raise ExportError("a value holds a NUL")
    if "{{" in text:
        text = "{{ " + json.dumps(text, ensure_ascii=True) + " }}"
    plain = re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_ .+-]*", text) and not text.endswith(" ")
    if plain and scalar(yaml.ScalarNode("tag:yaml.org,2002:str", text)) == text:
        return text
    return json.dumps(text, ensure_ascii=True)


def load_order(rows: list[dict], id_col: str, parent: str) -> list[dict]:
    """Rows of a tree with parents first, otherwise as they come; a circle is an error."""
    at = {r[id_col]: i for i, r in enumerate(rows)}
    after: list[list[int]] = [[] for _ in rows]
    for i, r in enumerate(rows):
        if r[parent] is not None and r[parent] in at and r[parent] != r[id_col]:
            after[at[r[parent]]].append(i)
    order, forced = topological(len(rows), after)
    if forced:
        raise ExportError("parents form a circle")
    return [rows[i] for i in order]


def export(config: Config, tables: dict[str, DataFrame], header: list[str] = ()) -> str:
    """The text of one row file with all models. What it writes is meant to be read by people, so it fits the driver."""
    out, names, kept = [f"# {h}" for h in header], {}, []
    for name in config.order():
        if name not in tables:
            continue
        model, df = config.models[name], tables[name]
        rows = [r.asDict() for r in df.select(*[text_of(df, c).alias(c) for c in df.columns]).orderBy(*[F.col(k) for k in ([model.id] if model.id in df.columns else []) + list(model.key)]).collect()]
        for column, target in model.refs.items():
            if target == name and model.id in df.columns:
                rows = load_order(rows, model.id, column)
        taken: set[str] = set()
        out += [f"- model: {name}", "  rows:"] if rows else [f"- model: {name}", "  rows: []"]
        for r in rows:
            anchor = anchor_of(model, r, taken)
            named = r.get(model.ref or (model.id or model.key[0]))
            names[name, named] = anchor
            if model.id in r:
                names[name, r[model.id]] = anchor
            lines, want = [f"_id: {anchor}"], {}
            for c, v in r.items():
                target = model.refs.get(c)
                if c in model.ignore or c in model.derived or c == model.soft_delete:
                    continue
                if target and v is not None:
                    if (target, v) not in names:
                        raise ExportError(f"{name}.{c} refers to {target} {v}, which is not exported above")
                    key = config.models[target].id
                    lines.append(f"{c}: {json.dumps('{{ ' + target + '.' + names[target, v] + '.' + key + ' }}')}")
                else:
                    lines.append(f"{c}: {spelled(v)}")
                want[c] = v
            out += [("    - " if i == 0 else "      ") + line for i, line in enumerate(lines)]
            kept.append((name, want))
    text = "\n".join(out) + "\n"
    verify(text, config, kept)
    return text


def keep_owned(live: DataFrame, files: DataFrame, model: Model) -> DataFrame:
    """What an export may write of a model's live rows, by its mode.

    sync owns all of them. upsert owns the rows that the files hold; insert owns those too, and the files'
    values stand, since the files own no column once a row is there. Values of insert-only columns are the
    files' as well. Ids that the files do not own are left out.
    """
    key = list(model.key)
    out = live
    if model.mode != "sync":
        out = live.join(files.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct(), null_safe([(F.col(k), F.col(f"__{k}")) for k in key]), "left_semi")
    kept = [c for c in files.columns if c in live.columns and c not in key and (model.mode == "insert" or c in model.insert_only)]
    if kept:
        said = files.select(*[F.col(k).alias(f"__{k}") for k in key], *[F.col(c).alias(f"__f_{c}") for c in kept], F.lit(True).alias("__there"))
        met = out.join(said, null_safe([(F.col(k), F.col(f"__{k}")) for k in key]), "left")
        out = met.select(*[F.when(F.col("__there"), F.col(f"__f_{c}").cast(live.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in live.columns])
    return out if model.ids == "files" or not model.id else out.drop(model.id)


def hazards(df: DataFrame, key: list[str], defaults: dict[str, str]) -> DataFrame:
    """Values that a load would replace by a column's default: key, column, hazard."""
    each = F.array(*[F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column"), F.lit(f"null, a load writes {d}").alias("hazard"))).when(is_zero(df, c) & F.lit(d not in ("", "0", "false")), F.struct(F.lit(c).alias("column"), F.lit(f"zero, a load writes {d}").alias("hazard"))) for c, d in defaults.items()])
    return df.select(*key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("h")).select(*key, "h.*")


def json_problem(text: Column) -> Column:
    """Why a JSON value cannot be written into a row file; null where it can."""
    said = F.trim(text)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(said == "null", "JSON null reads back as no value")
        .when(json_text(text).isNull(), "no JSON")
        .when(said.startswith('"'), "a JSON string reads back as a text")
        .when(F.size(beyond_float(text)) > 0, F.concat(F.lit("beyond a 64-bit float: "), F.array_join(beyond_float(text), ", ")))
    )


def export_files(config: Config, tables: dict[str, DataFrame], files: dict[str, list[str]], header: list[str] = ()) -> dict[str, str]:
    """file to text, each model in the file that owns it; files are read in the order given.

    A model that refers to one in a later file would name rows which are not there yet: that is refused. A
    model that no file owns goes to the last one.
    """
    owner = {m: f for f, models in files.items() for m in models}
    last = [*files][-1]
    order = config.order()
    rank = {f: i for i, f in enumerate(files)}
    for m in order:
        for column, target in config.models[m].refs.items():
            if target != m and rank[owner.get(target, last)] > rank[owner.get(m, last)]:
                raise ExportError(f"{m}.{column} refers to {target}, which {owner.get(target, last)} holds, a later file")
    whole = export(config, tables, header)
    text: dict[str, list[str]] = {f: [f"# {h}" for h in header] for f in files}
    for block in re.split(r"(?m)^(?=- model: )", whole)[1:]:
        model = block.split("\n", 1)[0].removeprefix("- model: ")
        text[owner.get(model, last)].append(block.rstrip("\n"))
    return {f: "\n".join(lines) + "\n" for f, lines in text.items()}


def verify(text: str, config: Config, rows: list[tuple[str, dict]]) -> None:
    """Read the text back; every value must be the one that was written."""
    back: list[Row] = resolve(parse(text), config)
    if len(back) != len(rows):
        raise ExportError("the file does not hold the rows written")
    for r, (name, want) in zip(back, rows, strict=True):
        for c, v in want.items():
            if r.model != name or r.cells.get(c) != v:
                raise ExportError(f"{name}.{c}: {v!r} reads back as {r.cells.get(c)!r}")
