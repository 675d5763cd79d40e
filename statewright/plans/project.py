"""The composite commands: check, generate, plan, apply, revert, sync, status, baseline, export."""

from __future__ import annotations

import datetime
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..functions.values import key_json, null_safe
from ..operators import apply as run
from ..operators import audit, constraints, diff, groups, lints, ordering, references
from ..sources import export, history, rowfiles, tables
from . import changeset, state
from .config import Config, Model
from .state import lineage_sentence

FINDING = "kind string, model string, row string, detail string, unsure boolean"
OUTCOME = "seq long, model string, key string, kind string, status string, problem string, mode string"


class Refused(RuntimeError):
    """What cannot be done safely; findings holds the rows that say why, all of them."""

    def __init__(self, said: str, findings: DataFrame | None = None):
        super().__init__(said)
        self.findings = findings


@dataclass
class Report:
    """The difference of a database and its files: changes by model, and a frame of findings."""

    changes: dict[str, DataFrame]
    findings: DataFrame

    def agree(self) -> bool:
        return self.findings.isEmpty() and all(c.isEmpty() for c in self.changes.values())

    def counts(self) -> list[tuple[str, str, bool, int]]:
        """kind, model, unsure, n: no more rows than kinds and models."""
        return sorted((r["kind"], r["model"], r["unsure"], r["count"]) for r in self.findings.groupBy("kind", "model", "unsure").count().collect())

    def summary(self) -> dict[str, dict[str, int]]:
        """Changes by model and kind, models without changes left out."""
        parts = [c.select(F.lit(m).alias("model"), "kind") for m, c in self.changes.items()]
        out: dict[str, dict[str, int]] = {}
        for r in tables.union(parts).groupBy("model", "kind").count().orderBy("model", "kind").collect() if parts else ():
            out.setdefault(r["model"], {})[r["kind"]] = r["count"]
        return out

    def lines(self) -> list[str]:
        """Every finding, then the numbers of changes. Rows are fetched a partition at a time."""
        out = [f"{r['kind']}: {r['model']} {r['row']}" + (f" ({r['detail']})" if r["detail"] else "") for r in self.findings.orderBy("model", "kind", "row").toLocalIterator()]
        order = list(self.changes)
        for model, kinds in sorted(self.summary().items(), key=lambda x: order.index(x[0])):
            out += [f"{model}: {n} {kind}{'' if n == 1 else 's'}" for kind, n in sorted(kinds.items())]
        return out


class Project:
    """A configuration, the folder of its change sets, what is declared of its tables, and how to read and write them."""

    def __init__(self, spark: SparkSession, config: Config, folder: str, declared: dict[str, dict] | None = None):
        self.spark, self.config, self.folder, self.declared = spark, config, folder, declared or {}

    def head(self, *texts: str) -> dict[str, DataFrame]:
        """The files' rows, in order, with templates resolved. One scope of anchors spans all files."""
        rows = rowfiles.resolve([r for t in texts for r in rowfiles.parse(t)], self.config)
        for i, r in enumerate(rows):
            r.ord = i
        return rowfiles.frames(self.spark, rows, self.config)

    def table(self, name: str, df: DataFrame) -> constraints.Table:
        return constraints.declared(self.config.models[name].table, df, self.declared.get(name))

    def _sides(self, name: str, base: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        model = self.config.models[name]
        files = rowfiles.typed(head, base.schema, model)
        if unknown := [c for c in files.columns if c not in base.columns and not c.startswith("__")]:
            raise Refused(f"{name}: no column {', '.join(unknown)}")
        live = tables.scan(base, model, [c for c in files.columns if not c.startswith("__")])
        if "__present" in files.columns:
            files = rowfiles.as_owned(files, live, list(model.key))
        files = files.drop("__ord", "__present")
        return live, files, model.owned(files.columns)

    def check(self, database: dict[str, DataFrame], head: dict[str, DataFrame]) -> Report:
        """Drift of the database against the files, and everything that the lints find."""
        changes, found = {}, [self.spark.createDataFrame([], FINDING)]
        for name in self.config.order():
            if name not in head:
                continue
            model, policy = self.config.models[name], self.config.policy_of(name)
            key = list(model.key)
            live, files, columns = self._sides(name, database[name], head[name])
            found += self._lints(name, database[name], live, files, head[name])
            for column, target in model.refs.items():
                if column in files.columns:
                    lost = references.dangling(files, column, self._id_frame(database, head, target), "id")
                    found.append(self._finding(name, "dangling_reference", key_json(lost, key), lost, F.concat(F.lit(f"{column}="), F.col(column).cast("string"))))
            ids = [model.id] if model.ids == "files" and model.id in files.columns else []
            kept = model.insert_only
            if ids:
                part, refused = diff.renamed_diff(live, files, key, model.id, columns + ids, model.mode, kept, policy["renames"])
                spot = F.concat_ws(" -> ", *[F.col(f"{side}_{k}").cast("string") for k in key for side in ("old", "new")])
                found.append(self._finding(name, "rename", spot, refused, F.when(F.col("occupied"), "the new key is taken").otherwise("renames are refused")))
                drift = diff.drifted(live, files, model.id, key)
                if policy["id_drift"] != "ignore":
                    found.append(self._finding(name, "id_drift", key_json(drift, key), drift, F.concat_ws(" -> ", F.col("base_id").cast("string"), F.col("head_id").cast("string"))))
            else:
                part = diff.state_diff(live, files, key, columns, model.mode, kept)
            changes[name] = part
        return Report(changes, reduce(DataFrame.unionByName, found))

    @staticmethod
    def _finding(model: str, kind: str, row: Column, df: DataFrame, detail: Column | None = None, unsure: bool = False) -> DataFrame:
        said = F.lit(None).cast("string") if detail is None else detail.cast("string")
        return df.select(F.lit(kind).alias("kind"), F.lit(model).alias("model"), row.cast("string").alias("row"), said.alias("detail"), F.lit(unsure).alias("unsure"))

    def _lints(self, name: str, base: DataFrame, live: DataFrame, files: DataFrame, raw: DataFrame) -> list[DataFrame]:
        """The findings of one model, each as a frame."""
        model, table = self.config.models[name], self.table(name, base)
        key = list(model.key)
        out = []
        for where, side in (("database", live), ("files", files)):
            held = groups.duplicates(side, key)
            out.append(self._finding(name, "duplicate_key", key_json(held, key), held, F.lit(where)))
        if model.ids == "files" and model.id in files.columns:
            held = groups.duplicates(files.where(F.col(model.id).isNotNull()), [model.id])
            out.append(self._finding(name, "duplicate_id", F.col(model.id), held))
        spot = F.concat_ws(",", *[F.col(k).cast("string") for k in key if k in raw.columns])
        said = lambda frame: frame.select("kind", F.lit(name).alias("model"), "row", "detail", "unsure")
        for c in raw.columns:
            if c not in base.columns:
                continue
            kind = base.schema[c].dataType
            if not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
                out.append(said(lints.invalid_casts(raw, spot, c, kind.simpleString())))
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                out.append(said(lints.moving_values(raw, spot, c)))
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                out.append(said(lints.float_readings(raw, spot, c)))
        literal = {c.name: d[0] for c in table.columns.values() if (d := constraints.non_null_default(c.default)) and c.name in files.columns}
        if literal:
            out.append(said(lints.zero_defaults(files, key_json(files, key), literal)))
            out.append(said(lints.null_defaults(files, key_json(files, key), list(literal))))
        if model.soft_delete:
            if problem := lints.soft_delete_problem(base.schema, model.soft_delete, table.columns[model.soft_delete].nullable if model.soft_delete in table.columns else True, literal.get(model.soft_delete)):
                raise Refused(f"{name}.{model.soft_delete}: {problem}")
            out.append(said(lints.zero_times(base, key_json(base, key), model.soft_delete)))
        if name in self.declared:
            nullable = {c.name for c in table.columns.values() if c.nullable}
            for one in lints.effective_keys(key, [list(g) for g in model.key_any_of]):
                verdict = lints.verdict(one, list(table.indexes), nullable, model.where)
                if verdict != "backed":
                    row = self.spark.range(1)
                    out.append(self._finding(name, "key_index", F.lit(", ".join(one)), row, F.lit(constraints.advice(table, one, verdict, model.where)), verdict == "unsure"))
        return out

    def _id_frame(self, database: dict[str, DataFrame], head: dict[str, DataFrame], target: str) -> DataFrame:
        model = self.config.models[target]
        base = tables.scan(database[target], model).select(F.col(model.id).cast("string").alias("id"))
        return base.unionByName(head[target].select(F.col(model.id).alias("id"))) if target in head and model.id in head[target].columns else base

    def _stop(self, report: Report) -> None:
        """Refuse if a finding is an error under the policies."""
        bad = [(kind, model, n) for kind, model, unsure, n in report.counts() if self.config.mode_of(kind, model, unsure) == "error"]
        if bad:
            at = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("model") == m) for k, m, _ in bad])
            raise Refused("; ".join(f"{model}: {n} {kind}" for kind, model, n in bad), report.findings.where(at))
        for name, part in report.changes.items():
            if self.config.policy_of(name)["deletes"] == "refuse":
                gone = part.where("kind = 'delete'")
                if not gone.isEmpty():
                    raise Refused(f"{name}: the files no longer hold rows, and deletes are refused", gone)

    def _ordered(self, report: Report, base: dict[str, DataFrame]) -> DataFrame:
        """All changes with seq: deletes against the models' order, then updates, then inserts; a change that takes
        a unique value comes after the one that frees it, and circles of such waits are refused."""
        parts = []
        for rank, (model, part) in enumerate(report.changes.items()):
            parts.append(changeset.as_changes(part, model, list(self.config.models[model].key)).withColumn("__model", F.lit(rank)))
        first = F.when(F.col("kind") == "delete", 0).when(F.col("kind") == "update", 1).otherwise(2)
        then = F.when(F.col("kind") == "delete", -F.col("__model")).otherwise(F.col("__model"))
        every = tables.union(parts).withColumns({"__first": first, "__then": then, "__at": F.to_json("key")})
        numbered = changeset.numbered(every, ["__first", "__then", "__at"]).drop("__first", "__then", "__at", "__model")
        edges = [e for name in report.changes for e in self._waits(numbered.where(F.col("model") == name), self.table(name, base[name]))]
        if not edges:
            return numbered
        waits = cut(reduce(DataFrame.unionByName, edges).distinct())
        if waits.isEmpty():
            return numbered
        around = ordering.circles(waits)
        if not around.isEmpty():
            raise Refused("changes take each other's unique values", numbered.join(around, "seq"))
        placed, _ = ordering.order_changes(numbered, waits)
        return cut(placed.withColumn("seq", F.col("position").cast("long")).drop("position").select(*numbered.columns))

    @staticmethod
    def _waits(own: DataFrame, table: constraints.Table) -> list[DataFrame]:
        """from_seq, to_seq for each declared unique index: whoever frees a value comes before whoever takes it."""
        out = []
        for i in table.indexes:
            if i.valid and not i.expressions:
                none = F.create_map().cast("map<string,string>")
                old = ordering.unique_tuple(F.map_concat(F.map_filter("key", lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("old", none)), k)), F.coalesce("old", none)), i.columns, i.nulls_equal)
                new = ordering.unique_tuple(F.map_concat(F.map_filter("key", lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("new", none)), k)), F.coalesce("new", none)), i.columns, i.nulls_equal)
                held = own.select("seq", "kind", F.when(F.col("kind") != "insert", old).alias("o"), F.when(F.col("kind") != "delete", new).alias("n"))
                exact = lambda side: F.when(F.col(f"{side}.exact"), F.col(f"{side}.tuple"))
                moved = held.select("seq", exact("o").alias("frees"), exact("n").alias("takes")).where("not (frees <=> takes)")
                out.append(ordering.unique_edges(moved, "seq", "frees", "takes").select("from_seq", "to_seq"))
        return out

    def generate(self, name: str, base: dict[str, DataFrame], head: dict[str, DataFrame]) -> str | None:
        """Write the change set that leads from base to head; its path, or None if there is nothing to do."""
        report = self.check(base, head)
        self._stop(report)
        numbered = cut(self._ordered(report, base))
        if numbered.isEmpty():
            return None
        stamp = changeset.next_stamp(datetime.datetime.now(datetime.UTC).strftime("%Y%m%d%H%M%S"), self.names())
        path = os.path.join(self.folder, f"{stamp}_{changeset.slug(name)}.jsonl")
        changeset.write(path, os.path.basename(path)[:-6], numbered)
        return path

    def names(self) -> list[str]:
        return sorted(f[:-6] for f in os.listdir(self.folder) if f.endswith(".jsonl"))

    def _wide(self, changes: DataFrame, name: str, live: DataFrame) -> DataFrame:
        own = changes.where(F.col("model") == name)
        return own.select("seq", "kind", "old", "new", *[F.try_element_at("key", F.lit(k)).cast(live.schema[k].dataType).alias(k) for k in self.config.models[name].key])

    def _applied(self, wide: dict[str, DataFrame], database: dict[str, DataFrame], revert: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
        """(states, outcomes) of changes by model. A problem whose mode is error, or a reference left without its row, refuses all."""
        now = F.lit(datetime.datetime.now(datetime.UTC))
        states, outcomes = dict(database), [self.spark.createDataFrame([], OUTCOME)]
        order = [n for n in self.config.order() if n in wide]
        for name in reversed(order) if revert else order:
            model, policy = self.config.models[name], self.config.policy_of(name)
            key = list(model.key)
            live = states[name]
            id_col = model.id if model.id in live.columns else None
            after, out = run.apply_scoped(live, wide[name], key, now, id_col=id_col, where=model.where, soft_delete=model.soft_delete)
            judged = cut(run.judged(out, {"missing": policy["missing_row"], "changed": policy["changed_row"], "id_drift": policy["id_drift"], "duplicate": policy["duplicate_key"]}))
            bad = judged.where("mode = 'error'")
            if not bad.isEmpty():
                counts = bad.groupBy("problem").count().orderBy("problem").collect()
                raise Refused(f"{name}: " + ", ".join(f"{r['count']} {r['problem']}" for r in counts), bad)
            outcomes.append(judged.select("seq", F.lit(name).alias("model"), key_json(judged, key).alias("key"), "kind", "status", "problem", "mode"))
            states[name] = cut(after)
        self._pointing(database, states)
        return states, reduce(DataFrame.unionByName, outcomes)

    def _pointing(self, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> None:
        """References whose row went away: rows go with it where deletes cascade, else the set is refused."""
        again = True
        while again:
            again = False
            for name, model in self.config.models.items():
                for column, target in model.refs.items():
                    if name not in after or target not in after or column not in after[name].columns:
                        continue
                    to = self.config.models[target]
                    if (after[name] is before[name] and after[target] is before[target]) or to.id not in after[target].columns:
                        continue
                    held = tables.scan(after[target], to, [to.id])
                    lost = references.dangling(tables.scan(after[name], model), column, held, to.id)
                    old = tables.scan(before[name], model).join(tables.scan(before[target], to, [to.id]).select(F.col(to.id).alias("__id")), F.col(column) == F.col("__id"), "left_anti")
                    fresh = lost.join(old.select(*[F.col(k).alias(f"__{k}") for k in model.key]).distinct(), null_safe([(F.col(k), F.col(f"__{k}")) for k in model.key]), "left_anti")
                    if fresh.isEmpty():
                        continue
                    if self.config.policy_of(target)["deletes"] != "cascade":
                        raise Refused(f"{name}.{column}: rows are left that refer to no {target}", fresh)
                    gone = fresh.select(*[F.col(k).alias(f"__{k}") for k in model.key])
                    after[name] = cut(after[name].join(gone, null_safe([(F.col(k), F.col(f"__{k}")) for k in model.key]), "left_anti"))
                    again = True

    def plan(self, path: str, database: dict[str, DataFrame], revert: bool = False, log: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
        """(states after the set, outcomes as a frame); nothing is written. A problem whose mode is error refuses the set.

        A revert takes back, last first, the changes that a run since the last revert made, where a log says so.
        """
        header, changes = changeset.read(self.spark, path)
        if revert and log is not None:
            own = log.where(F.col("set_name") == header["name"])
            if not own.isEmpty():
                done = audit.made(own).where("made").select(F.col("index").cast("long").alias("seq"))
                changes = changes.join(done, "seq", "left_semi")
        if revert:
            changes = cut(ordering.backwards(diff.inverted(changes)))
        named = {r[0] for r in changes.select("model").distinct().collect()}
        if unknown := named - set(self.config.models):
            raise Refused(f"{path} changes {', '.join(sorted(unknown))}, which is no model")
        return self._applied({n: self._wide(changes, n, database[n]) for n in named}, database, revert)

    def apply(self, path: str, database: dict[str, DataFrame], log: DataFrame | None = None, revert: bool = False, by: str = "statewright") -> tuple[dict[str, DataFrame], DataFrame]:
        """(states, audit log with this run)."""
        header = changeset.header(path)
        states, outcomes = self.plan(path, database, revert, log)
        number = 1 if log is None or log.isEmpty() else log.agg(F.max("id")).first()[0] + 1
        each = F.struct(F.col("seq").cast("int").alias("index"), "model", "key", "kind", "status", "problem")
        entry = outcomes.agg(F.sort_array(F.collect_list(each)).alias("outcomes")).select(
            F.lit(number).cast("long").alias("id"), F.lit(header["name"]).alias("set_name"), F.lit("down" if revert else "up").alias("direction"),
            F.lit(header["sha256"]).alias("set_sha256"), F.lit(datetime.datetime.now(datetime.UTC)).alias("applied_at"), F.lit(by).alias("applied_by"), "outcomes",
        )
        entry = cut(entry).to(T.StructType.fromDDL(audit.SCHEMA))
        return states, entry if log is None else log.unionByName(entry)

    def sync(self, database: dict[str, DataFrame], head: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
        """(states, outcomes) of applying the difference at once, without a change set; what generate or apply refuse is refused."""
        report = self.check(database, head)
        self._stop(report)
        numbered = cut(self._ordered(report, database))
        named = {r[0] for r in numbered.select("model").distinct().collect()}
        return self._applied({n: self._wide(numbered, n, database[n]) for n in named}, database)

    def status(self, log: DataFrame) -> DataFrame:
        """name, in_directory, applied, out_of_order, edited for every set."""
        rows = [(n, changeset.header(os.path.join(self.folder, f"{n}.jsonl"))["sha256"]) for n in self.names()]
        directory = self.spark.createDataFrame(rows, "name string, sha256 string")
        up = audit.latest(log).where("direction = 'up'").select(F.col("set_name").alias("name"))
        changed = audit.edited(directory.withColumnRenamed("name", "set_name"), log).select(F.col("set_name").alias("name"), F.lit(True).alias("edited"))
        return audit.applied_and_pending(directory, up).join(changed, "name", "left").withColumn("edited", F.coalesce("edited", F.lit(False)))

    def export(self, database: dict[str, DataFrame], head: dict[str, DataFrame] | None = None) -> str:
        """The database's live rows as the text of a row file, read back and compared before it is returned.

        With the files' rows at hand, what the database owns by a model's mode stays out of the export.
        """
        live = {n: tables.scan(database[n], m) for n, m in self.config.models.items() if n in database}
        if head is not None:
            live = {n: self._owned(n, database[n], df, head) for n, df in live.items()}
        return export.export(self.config, live)

    def _owned(self, name: str, base: DataFrame, live: DataFrame, head: dict[str, DataFrame]) -> DataFrame:
        model: Model = self.config.models[name]
        if name not in head:
            return live if model.mode == "sync" else live.limit(0)
        return export.keep_owned(live, rowfiles.typed(head[name].drop("__ord", "__present"), base.schema, model), model)

    def baseline(self, folder: str, database: dict[str, DataFrame]) -> dict:
        """Record the database as the state that later sets start from."""
        return state.record(folder, database, covers=self.names()[-1] if self.names() else "")

    def uncovered(self, recorded: dict[str, DataFrame], head: dict[str, DataFrame]) -> Report:
        """What the files hold beyond the recorded state, and no change set brings yet."""
        return self.check(recorded, head)

    def violations(self, states: dict[str, DataFrame]) -> DataFrame:
        """model, constraint, row, n of every declared constraint that the states break, as one check at the end of a set."""
        out = [self.spark.createDataFrame([], "model string, constraint string, row string, n long")]
        for name, df in states.items():
            others = {self.config.models[n].table: d for n, d in states.items()}
            out.append(constraints.violations(self.table(name, df), df, list(self.config.models[name].key), others).select(F.lit(name).alias("model"), "constraint", "row", "n"))
        return reduce(DataFrame.unionByName, out)

    def key_notes(self, path: str, database: dict[str, DataFrame]) -> DataFrame:
        """Keys of the models that a set changes which no declared index backs, as findings."""
        _, changes = changeset.read(self.spark, path)
        named = [r[0] for r in changes.select("model").distinct().orderBy("model").collect()]
        out = [self.spark.createDataFrame([], FINDING)]
        for name in named:
            live = tables.scan(database[name], self.config.models[name])
            out += [f.where("kind = 'key_index'") for f in self._lints(name, database[name], live, live, live)]
        return reduce(DataFrame.unionByName, out)

    def base(self, recorded: str, files: list[str], revision: str = "HEAD") -> dict[str, DataFrame]:
        """What a status compares the files with: the recorded state if there is one, else the files at a revision."""
        if os.path.isfile(os.path.join(recorded, "manifest.json")):
            return state.load(self.spark, recorded)[1]
        return self.head(*[history.at(revision, f) for f in files])

    def lineage(self, recorded: str) -> list[str]:
        """Why sets of the folder are not accounted for by the recorded state, a sentence each."""
        manifest, _ = state.load(self.spark, recorded, verify=False)
        return [lineage_sentence(n, manifest) for n in state.unaccounted(manifest, self.names())]
