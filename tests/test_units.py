"""Driver-side logic and the composite commands on small inputs."""

import datetime
import decimal
import itertools
import random
import subprocess

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from statewright.functions import interval, values
from statewright.operators import apply as run
from statewright.operators import constraints, diff, lints, ordering
from statewright.plans import changeset, cli, config, reports, scaffold, state
from statewright.plans.project import Project, Refused
from statewright.sources import export, rowfiles


@pytest.mark.parametrize(
    ("text", "want"),
    [("1 year 2 mons -3 days 04:05:06.5", "1 year 2 mons -3 days 04:05:06.5"), ("P1Y2M3DT4H5M6S", "1 year 2 mons 3 days 04:05:06"), ("1.5 days", "1 day 12:00:00"), ("2 weeks ago", "-14 days"), ("0", None), ("1 fortnight", None), ("00:00:00", "00:00:00")],
)
def test_intervals(text, want):
    assert interval.show(interval.parse(text)) == want


def test_interval_column(spark):
    df = spark.createDataFrame([("1 day",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(interval.interval_text(F.col("t"))).collect()] == ["1 day", None, None]


def test_decimal_text(spark):
    cases = {"100": "100", "1.50": "1.5", "-0.0": "0", ".5": "0.5", "007.": "7", "1e5": None, "": None, "9" * 60 + ".10": "9" * 60 + ".1"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", values.decimal_text(F.col("t"))).collect()} == cases


def test_key_json_tells_null_from_text(spark):
    df = spark.createDataFrame([("null", 1), (None, 2)], "a string, b int")
    assert df.select(values.key_json(df, ["a"])).distinct().count() == 2


def test_topological_is_smallest_and_breaks_circles():
    assert ordering.topological(4, [[1], [], [1], []]) == ([0, 2, 1, 3], [])
    order, forced = ordering.topological(4, [[1], [0, 2], [], [0]])
    assert forced == [0] and sorted(order) == [0, 1, 2, 3] and order[0] == 3
    assert ordering.topological(0, []) == ([], [])
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        after = [[b for b in range(n) if b != a and rng.random() < 0.2] for a in range(n)]
        order, forced = ordering.topological(n, after)
        assert sorted(order) == list(range(n))
        fits = [p for p in itertools.permutations(range(n)) if all(p.index(a) < p.index(b) for a in range(n) for b in after[a])]
        assert bool(forced) == (not fits)
        if fits:
            assert tuple(order) == min(fits)
        # Only edges into a forced member are broken, and only from its own circle.
        own = ordering.components_of(n, after)
        assert all(order.index(a) < order.index(b) or (b in forced and own[a] == own[b]) for a in range(n) for b in after[a])


def test_model_order_breaks_circles_by_file_order():
    refs = {"A": {"b": "B"}, "B": {"a": "A"}, "C": {"a": "A"}}
    assert ordering.model_order(["A", "B", "C"], refs, ["B", "C", "A"]) == ["B", "A", "C"]


def test_tree_depth_takes_long_chains_and_refuses_circles(spark):
    chain = spark.range(10_000).selectExpr("id", "nullif(id - 1, -1) as parent")
    assert ordering.tree_depth(chain, "id", "parent").where("depth <> id").count() == 0
    odd = spark.createDataFrame([(1, 1), (2, 99), (3, 2)], "id long, parent long")
    assert rows(ordering.tree_depth(odd, "id", "parent")) == [(1, 0), (2, 0), (3, 1)]
    with pytest.raises(ValueError, match="circle"):
        ordering.tree_depth(spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, parent long"), "id", "parent")


def test_refusals_run_down_chains_and_joins(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(500, 100), (301, 400), (300, 400), (400, 401), (600, 601), (601, 600)]
    edges = spark.createDataFrame(pairs, "from_seq long, to_seq long")
    got = {r[0] for r in ordering.refused_with(edges, spark.createDataFrame([(150,), (601,)], "seq long")).collect()}
    assert got == {*range(150, 301), 400, 401, 600, 601}


def test_refusals_spread(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "from_seq long, to_seq long")
    got = ordering.refused_with(edges, spark.createDataFrame([(1,)], "seq long"))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3]


def test_verdicts():
    i = lints.Index
    assert lints.verdict(("a", "b"), [i(("a",))], set()) == "backed"
    assert lints.verdict(("a",), [i(("a", "b"))], set()) == "superset"
    assert lints.verdict(("a",), [i(("a",), where="x is null")], set()) == "partial"
    assert lints.verdict(("a",), [i(("a",), where="X IS NULL")], set(), "x is null AND y = 'A'") == "backed"
    assert lints.verdict(("a",), [i(("a",))], {"a"}) == "nullable"
    assert lints.verdict(("a",), [i(("a",), valid=False)], set()) == "invalid"
    assert lints.verdict(("a",), [], set()) == "none"
    assert lints.effective_keys(["k"], [["a", "b"], ["c"]]) == [("k", "a", "c"), ("k", "b", "c")]


def test_config_is_strict():
    with pytest.raises(config.ConfigError):
        config.from_dict({"models": {"A": {"key": ["k"], "colour": 1}}})
    with pytest.raises(config.ConfigError):
        config.from_dict({"models": {"A": {"key": ["k"], "policy": {"deletes": "maybe"}}}})
    with pytest.raises(config.ConfigError):
        config.from_dict({"models": {"A": {"key": ["k"], "refs": {"b": "B"}}}})
    c = config.from_dict({"models": {"B": {"key": ["k"], "refs": {"a": "A"}}, "A": {"key": ["k"]}}, "policy": {"missing_row": "warn"}})
    assert c.order() == ["A", "B"] and c.policy_of("B")["missing_row"] == "warn" and c.mode_of("anything", "A") == "error"


FILES = """
- model: Depot
  rows:
    - {_id: north, id: 11, site: N1, label: "Nörd"}
    - {_id: south, id: 13, site: S1, label: "Süd"}
- model: Route
  rows:
    - {id: 1, line: alpha, depot_id: "{{ Depot.north.id }}", length: 0, remark: ~}
    - {id: 2, line: beta, depot_id: "{{ Depot.south.id }}", length: 0x10, remark: '{{ "a {{b}}" }}'}
"""
CONFIG = {"models": {"Depot": {"key": ["site"]}, "Route": {"key": ["line"], "refs": {"depot_id": "Depot"}}}}


@pytest.fixture
def project(spark, tmp_path):
    return Project(spark, config.from_dict(CONFIG), str(tmp_path))


@pytest.fixture
def database(spark):
    return {
        "Depot": spark.createDataFrame([(11, "N1", "N"), (12, "W1", "West")], "id long, site string, label string"),
        "Route": spark.createDataFrame([(1, "alpha", 11, 5, "x"), (4, "omega", 12, 1, None)], "id long, line string, depot_id long, length long, remark string"),
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_generate_apply_revert(spark, project, database):
    head = project.head(FILES)
    assert project.check(database, head).lines() == ["Depot: 1 delete", "Depot: 1 insert", "Depot: 1 update", "Route: 1 delete", "Route: 1 insert", "Route: 1 update"]
    path = project.generate("first set", database, head)
    after, log = project.apply(path, database)
    assert {r[1] for r in rows(after["Depot"])} == {"N1", "S1"}
    assert {r[:2] + r[3:] for r in rows(after["Route"])} == {(1, "alpha", 0, None), (2, "beta", 16, "a {{b}}")}
    again, outcomes = project.plan(path, after)
    assert rows(again["Route"]) == rows(after["Route"])
    assert {r["status"] for r in outcomes.collect()} == {"unchanged"}
    status = project.status(log).collect()[0]
    assert status["applied"] and not status["edited"]
    entry = log.collect()[0]
    assert len(entry["outcomes"]) == 6 and all(o["key"].startswith("{") for o in entry["outcomes"])
    back, log = project.apply(path, after, log, revert=True)
    without_ids = lambda d: [r[1:] for r in rows(d)]
    assert sorted(without_ids(back["Depot"]), key=repr) == sorted(without_ids(database["Depot"]), key=repr)
    assert log.count() == 2


def test_set_is_sealed(spark, project, database):
    path = project.generate("x", database, project.head(FILES))
    text = open(path).read()
    with open(path, "w") as f:
        f.write(text.replace("S1", "S9"))
    with pytest.raises(changeset.SetError):
        changeset.read(spark, path)


def test_missing_row_refuses(spark, project, database):
    path = project.generate("x", database, project.head(FILES))
    gone = database | {"Route": database["Route"].where("line <> 'alpha'")}
    with pytest.raises(Refused):
        project.plan(path, gone)


def test_state_round_trip(spark, project, database, tmp_path):
    folder = tmp_path / "state"
    folder.mkdir()
    project.baseline(str(folder), database)
    manifest, tables = state.load(spark, str(folder))
    assert rows(tables["Route"]) == rows(database["Route"])
    tables["Route"].limit(1).write.mode("overwrite").parquet(str(folder / "Depot"))
    with pytest.raises(state.StateError):
        state.load(spark, str(folder))


def test_export_reads_back(spark, project, database):
    bare = {k: v.drop("remark") if k == "Route" else v for k, v in database.items()}
    text = export.export(project.config, bare)
    assert "{{ Depot.n1.id }}" in text
    assert project.check(database, project.head(text)).agree()
    assert "beta" not in project.export(bare)
    files = export.export_files(project.config, bare, {"sites.yml": ["Depot"], "lines.yml": ["Route"]})
    assert "Route" not in files["sites.yml"] and project.check(database, project.head(*files.values())).agree()
    with pytest.raises(export.ExportError):
        export.export_files(project.config, bare, {"lines.yml": ["Route"], "sites.yml": ["Depot"]})


def test_row_files():
    got = rowfiles.parse("- model: A\n  rows:\n    - {a: 0x1F, b: 1_000.50, c: yes, d: ~, e: 'no', f: [1, {k: 2}], g: 1e3, h: 010, i: .inf}\n")
    assert got[0].cells == {"a": "31", "b": "1000.5", "c": "yes", "d": None, "e": "no", "f": '[1,{"k":2}]', "g": "1000", "h": "8", "i": "Infinity"}
    with pytest.raises(rowfiles.RowFileError):
        rowfiles.parse("- model: A\n")


def test_row_file_source(spark, tmp_path):
    (tmp_path / "a.yml").write_text(FILES)
    spark.dataSource.register(rowfiles.RowFileSource)
    df = spark.read.format("rowfile").load(str(tmp_path / "*.yml"))
    assert df.count() == 4 and df.where("model = 'Route'").count() == 2


def test_diff_apply_inverse_property(spark):
    rng = random.Random(7)
    for _ in range(3):
        side = lambda: [(k, rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for k in range(12) if rng.random() < 0.7]
        a, b = (spark.createDataFrame(side(), "k long, s string, n int") for _ in range(2))
        changes = diff.state_diff(a, b, ["k"])
        from statewright.operators.apply import apply_changes

        assert rows(apply_changes(a, changes, ["k"])[0]) == rows(b)
        assert rows(apply_changes(b, diff.inverted(changes), ["k"])[0]) == rows(a)


def test_scaffold_guesses_keys_and_references(spark):
    sf = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("region", "nation")}
    made = scaffold.scaffold(tables)
    assert made["models"]["nation"]["key"] == ["n_name"] and made["models"]["nation"]["refs"] == {"n_regionkey": "region"}
    assert config.from_dict(made).order() == ["region", "nation"]


def test_small_functions(spark):
    assert values.snake("HTTPServerId") == "http_server_id"
    df = spark.createDataFrame([('["a","b c",null]',), ('[["a"]]',), ("x",)], "j string")
    assert [r[0] for r in df.select(values.array_literal(F.col("j"))).collect()] == ['{a,"b c",NULL}', None, None]
    assert lints.soft_delete_problem(spark.range(1).selectExpr("current_timestamp() t", "id").schema, "id") == "long is no timestamp"
    assert lints.soft_delete_problem(spark.range(1).selectExpr("current_timestamp() t", "id").schema, "t") is None


def test_stream_of_changes(spark, tmp_path):
    from statewright.streaming import follow, state_before

    start = spark.createDataFrame([(1, "a")], "k long, v string")
    first = diff.state_diff(start, spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"), ["k"])
    second = diff.state_diff(spark.createDataFrame([(2, "c")], "k long, v string"), spark.createDataFrame([(2, "d")], "k long, v string"), ["k"])
    seen = []
    folder = str(tmp_path / "state")

    def go():
        stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
        q = follow(stream, start, ["k"], folder, lambda state, outcomes, n: seen.append(rows(state)))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)

    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    go()
    assert seen[-1] == [(1, "b"), (2, "c")]
    # A stream that starts again goes on from the recorded state, not from the start.
    second.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert seen[-1] == [(1, "b"), (2, "d")]
    assert rows(state_before(spark, folder, start, 1)) == [(1, "b"), (2, "c")] and rows(state_before(spark, folder, start, 0)) == [(1, "a")]


KINDS = [
    (T.StringType(), ["", "a", "null"]), (T.BooleanType(), [True, False]), (T.ByteType(), [-1, 5]), (T.IntegerType(), [0, -7]), (T.LongType(), [2**62, -1]),
    (T.DecimalType(38, 10), [decimal.Decimal("0.0000000001"), decimal.Decimal("-12.5")]), (T.FloatType(), [0.5, 1.5e-5]),
    (T.DoubleType(), [1e-9, 0.1234567, 0.1234568, 1e40, float("inf"), -0.0]), (T.DateType(), [datetime.date(2024, 2, 29)]),
    (T.TimestampType(), [datetime.datetime(2024, 3, 10, 2, 30, 0, 120000), datetime.datetime(1969, 12, 31, 23, 59, 59)]),
    (T.TimestampNTZType(), [datetime.datetime(2024, 3, 10, 2, 30)]), (T.BinaryType(), [bytearray(b"\xcd"), bytearray(b"")]),
    (T.ArrayType(T.LongType()), [[1, None], []]), (T.MapType(T.StringType(), T.LongType()), [{"a": 1}, {}]), (T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())]), [(1, None)]),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_every_type_through_diff_and_apply(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rng = random.Random(5)
        schema = T.StructType([T.StructField("k", T.LongType()), *[T.StructField(f"c{i}", kind) for i, (kind, _) in enumerate(KINDS)]])
        side = lambda: spark.createDataFrame([(k, *[rng.choice([*v, None]) for _, v in KINDS]) for k in range(25) if rng.random() < 0.8], schema)
        a, b = side(), side()
        changes = diff.state_diff(a, b, ["k"])
        for live, want, how in ((a, b, changes), (b, a, diff.inverted(changes))):
            after, outcomes = run.apply_changes(live, how, ["k"])
            assert diff.state_diff(after, want, ["k"]).count() == 0 and after.schema == live.schema
            assert outcomes.where("status <> 'applied'").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_instants_do_not_depend_on_the_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp'2024-01-01 00:00:00Z' as t, timestamp'2024-03-10 02:30:00.5Z' as u")
        assert df.select(values.text_of(df, "t"), values.text_of(df, "u")).first()[:] == ("2024-01-01T00:00:00Z", "2024-03-10T02:30:00.5Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_doubles_are_exact(spark):
    df = spark.createDataFrame([(x,) for x in (0.1234567, 1e-9, 1e40, 5e-324, 123456.75, -0.0, float("nan"), float("-inf"))], "d double")
    got = [r[0] for r in df.select(values.number_text(F.col("d"))).collect()]
    assert got[:3] == ["0.1234567", "0.000000001", "1" + "0" * 40] and got[4:] == ["123456.75", "0", "NaN", "-Infinity"]
    assert float(got[3]) == 5e-324
    texts = spark.createDataFrame([("0.0000001", False), ("1e-7", False), ("9007199254740993", True), ("0.1", False), ("x", False)], "t string, want boolean")
    assert all(r[0] == r[1] for r in texts.select(F.coalesce(values.float_reading_differs(F.col("t")), F.lit(False)), "want").collect())


def test_set_in_parts(spark, tmp_path):
    wide = spark.range(1500).selectExpr("id seq", "'M' model", "'update' kind", "map('k', cast(id as string)) key", "map('v', cast(null as string)) old", "map('v', 'x') new")
    path = str(tmp_path / "s.jsonl")
    changeset.write(path, "s", wide)
    said, back = changeset.read(spark, path)
    assert said["parts"] == "s.jsonl.parts" and back.count() == 1500 and back.where("old['v'] is null and size(old) = 1").count() == 1500
    back.limit(1400).coalesce(1).write.mode("overwrite").json(str(tmp_path / "t"))
    import shutil

    shutil.rmtree(path + ".parts")
    shutil.copytree(tmp_path / "t", path + ".parts")
    with pytest.raises(changeset.SetError, match="edited"):
        changeset.read(spark, path)
    with pytest.raises(changeset.SetError, match="no key"):
        changeset.write(path, "s", wide.withColumn("key", F.create_map().cast("map<string,string>")))


def test_numbers_follow_the_order(spark):
    got = changeset.numbered(spark.range(5000).selectExpr("5000 - id as a", "id"), ["a"])
    assert got.where("seq <> a - 1").count() == 0 and got.count() == 5000


def one(spark, text, models, tmp_path, database, declared=None):
    project = Project(spark, config.from_dict({"models": models}), str(tmp_path), declared)
    return project, project.head(text), database


SHELF = {"Shelf": {"key": ["code"]}}


def test_renames_are_told_by_id(spark, tmp_path):
    database = {"Shelf": spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, code string, note string")}
    text = "- model: Shelf\n  rows:\n    - {id: 1, code: a2, note: x}\n    - {id: 2, code: c, note: y}\n    - {id: 3, code: c3, note: z}\n"
    project, head, _ = one(spark, text, SHELF, tmp_path, database)
    report = project.check(database, head)
    assert {(r["kind"], r["row"]) for r in report.findings.collect()} == {("rename", "a -> a2"), ("rename", "b -> c"), ("rename", "c -> c3")} and report.changes["Shelf"].count() == 0
    with pytest.raises(Refused) as refused:
        project.generate("x", database, head)
    assert refused.value.findings.count() == 3
    project, head, _ = one(spark, text.replace("code: c, ", "code: b, ").replace("c3", "c"), {"Shelf": {"key": ["code"], "policy": {"renames": "update"}}}, tmp_path, database)
    path = project.generate("x", database, head)
    after, _ = project.apply(path, database)
    assert rows(after["Shelf"]) == [(1, "a2", "x"), (2, "b", "y"), (3, "c", "z")]
    again, outcomes = project.plan(path, after)
    assert [r["problem"] for r in outcomes.collect()] == ["benign"]
    back, _ = project.apply(path, after, revert=True)
    assert rows(back["Shelf"]) == rows(database["Shelf"])


def test_id_drift_follows_its_policy(spark, tmp_path):
    database = {"Shelf": spark.createDataFrame([(1, "a")], "id long, code string")}
    text = "- model: Shelf\n  rows:\n    - {id: 5, code: a}\n"
    for policy, kinds in (("error", ["id_drift"]), ("warn", ["id_drift"]), ("ignore", [])):
        project, head, _ = one(spark, text, {"Shelf": {"key": ["code"], "policy": {"id_drift": policy}}}, tmp_path, database)
        assert [r["kind"] for r in project.check(database, head).findings.collect()] == kinds
        if policy == "error":
            with pytest.raises(Refused):
                project.sync(database, head)
        else:
            assert rows(project.sync(database, head)[0]["Shelf"]) == [(1, "a")]


def test_findings_are_all_told(spark, tmp_path):
    database = {"Shelf": spark.range(60).selectExpr("id", "concat('c', id % 30) as code")}
    project, head, _ = one(spark, "- model: Shelf\n  rows:\n    - {id: 1, code: q}\n", SHELF, tmp_path, database)
    report = project.check(database, head)
    assert sum(line.startswith("duplicate_key") for line in report.lines()) == 30
    assert ("duplicate_key", "Shelf", False, 30) in report.counts()


def test_soft_delete_and_condition(spark, tmp_path):
    when = datetime.datetime(2024, 1, 1)
    rows_ = [(1, "a", "x", None, "own"), (2, "b", "y", None, "own"), (3, "c", "z", when, "own"), (4, "a", "q", None, "other"), (5, "d", "old", when, "own"), (6, "d", "new", datetime.datetime(2024, 2, 1), "own")]
    database = {"Shelf": spark.createDataFrame(rows_, "id long, code string, note string, gone timestamp, side string")}
    models = {"Shelf": {"key": ["code"], "ids": "database", "soft_delete": "gone", "where": "side = 'own'"}}
    text = "- model: Shelf\n  rows:\n    - {code: a, note: x2, side: own}\n    - {code: c, note: z, side: own}\n    - {code: d, note: new, side: own}\n    - {code: e, note: e, side: own}\n"
    project, head, _ = one(spark, text, models, tmp_path, database)
    path = project.generate("x", database, head)
    after, log = project.apply(path, database)
    got = {r["id"]: r for r in after["Shelf"].collect()}
    assert got[1]["note"] == "x2" and got[4]["note"] == "q"  # the other side's row of the same key is not touched
    assert got[2]["gone"] is not None and got[2]["note"] == "y"
    assert got[3]["gone"] is None and got[6]["gone"] is None and got[5]["gone"] == when  # brought back: the newest of equals in values
    assert got[None]["code"] == "e" and len(got) == 7
    stray = text.replace("{code: e, note: e, side: own}", "{code: e, note: e, side: else}")
    with pytest.raises(Refused, match="outside"):
        project.sync(database, project.head(stray))


def test_two_equally_new_deleted_rows_are_a_duplicate(spark, tmp_path):
    when = datetime.datetime(2024, 1, 1)
    database = {"Shelf": spark.createDataFrame([(1, "a", when), (2, "a", when)], "id long, code string, gone timestamp")}
    project, head, _ = one(spark, "- model: Shelf\n  rows:\n    - {code: a}\n", {"Shelf": {"key": ["code"], "ids": "database", "soft_delete": "gone"}}, tmp_path, database)
    with pytest.raises(Refused, match="duplicate"):
        project.sync(database, head)


def test_values_change_places_in_order_and_circles_are_refused(spark, tmp_path):
    database = {"Shelf": spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "code string, rank long")}
    declared = {"Shelf": {"unique": [{"columns": ["code"]}, {"columns": ["rank"]}], "not_null": ["code", "rank"]}}
    models = {"Shelf": {"key": ["code"], "id": None}}
    lines = lambda *r: "- model: Shelf\n  rows:\n" + "".join(f"    - {{code: {c}, rank: {n}}}\n" for c, n in r)
    project, head, _ = one(spark, lines(("a", 2), ("b", 3), ("c", 4)), models, tmp_path, database, declared)
    _, changes = changeset.read(spark, project.generate("x", database, head))
    assert [r["key"]["code"] for r in changes.orderBy("seq").collect()] == ["c", "b", "a"]
    with pytest.raises(Refused, match="unique"):
        project.generate("y", database, project.head(lines(("a", 2), ("b", 1), ("c", 3))))
    assert project.violations({"Shelf": database["Shelf"].withColumn("rank", F.lit(1))}).collect()[0]["constraint"] == "unique rank"


def test_references_hold_after_a_set(spark, tmp_path):
    database = {"Depot": spark.createDataFrame([(1, "n"), (2, "s")], "id long, site string"), "Route": spark.createDataFrame([(7, "x", 2)], "id long, line string, depot_id long")}
    models = {"Depot": {"key": ["site"]}, "Route": {"key": ["line"], "refs": {"depot_id": "Depot"}}}
    text = "- model: Depot\n  rows:\n    - {id: 1, site: n}\n"
    project, head, _ = one(spark, text, models, tmp_path, database)
    with pytest.raises(Refused, match="Route.depot_id"):
        project.sync(database, head)
    models["Depot"]["policy"] = {"deletes": "cascade"}
    project, head, _ = one(spark, text, models, tmp_path, database)
    states, _ = project.sync(database, head)
    assert rows(states["Route"]) == [] and rows(states["Depot"]) == [(1, "n")]


def test_absent_is_not_null(spark, tmp_path):
    database = {"Shelf": spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 2)], "id long, code string, note string, n long")}
    project, head, _ = one(spark, "- model: Shelf\n  rows:\n    - {id: 1, code: a, note: new}\n    - {id: 2, code: b, n: 9}\n", SHELF, tmp_path, database)
    assert rows(project.sync(database, head)[0]["Shelf"]) == [(1, "a", "new", 1), (2, "b", "y", 9)]


def test_check_reports_readings(spark, tmp_path):
    database = {"Shelf": spark.createDataFrame([(1, "a", 1, datetime.datetime(2024, 1, 1))], "id long, code string, n long, t timestamp")}
    declared = {"Shelf": {"defaults": {"n": "7::int"}, "unique": [{"columns": ["id"]}], "not_null": ["id"]}}
    project, head, _ = one(spark, "- model: Shelf\n  rows:\n    - {id: 1, code: a, n: 0, t: now}\n    - {id: 2, code: b, n: many, t: 2024-01-01T00:00:00Z}\n", SHELF, tmp_path, database, declared)
    kinds = {r["kind"] for r in project.check(database, head).findings.collect()}
    assert {"zero_default", "invalid_value", "session_dependent", "key_index"} <= kinds


def test_command_line(spark, tmp_path, capsys, database):
    import yaml

    (tmp_path / "c.yml").write_text(yaml.safe_dump(CONFIG))
    (tmp_path / "f.yml").write_text(FILES)
    for n, df in database.items():
        df.write.parquet(str(tmp_path / "db" / n))
    sets = tmp_path / "sets"
    sets.mkdir()
    base = ["--config", str(tmp_path / "c.yml"), "--database", str(tmp_path / "db"), "--sets", str(sets)]
    assert cli.run(["check", *base, "--files", str(tmp_path / "f.yml"), "--json"], spark) == reports.DIFFERS
    assert '"agree": false' in capsys.readouterr().out
    assert cli.run(["generate", *base, "--files", str(tmp_path / "f.yml"), "--name", "first"], spark) == reports.AGREES
    made = capsys.readouterr().out.strip()
    assert cli.run(["plan", *base, "--set", made], spark) == reports.AGREES
    assert "Depot: 1 delete applied" in capsys.readouterr().out
    assert cli.run(["apply", *base, "--set", made, "--out", str(tmp_path / "new"), "--log", str(tmp_path / "log")], spark) == reports.AGREES
    after = [*base[:2], "--database", str(tmp_path / "new"), "--sets", str(sets)]
    assert cli.run(["check", *after, "--files", str(tmp_path / "f.yml")], spark) == reports.AGREES
    assert cli.run(["status", *after, "--log", str(tmp_path / "log")], spark) == reports.AGREES
    assert "6 changes" in capsys.readouterr().out
    assert cli.run(["revert", *after, "--set", made, "--out", str(tmp_path / "back"), "--log", str(tmp_path / "log")], spark) == reports.AGREES
    assert cli.run(["plan", *base, "--set", str(sets / "none.jsonl")], spark) == reports.MISUSED
    assert cli.run(["check"], spark) == reports.MISUSED and cli.run(["dance"], spark) == reports.MISUSED
    database["Route"].where("line <> 'alpha'").write.mode("overwrite").parquet(str(tmp_path / "db" / "Route"))
    assert cli.run(["plan", *base, "--set", made], spark) == reports.REFUSED


def test_files_of_a_revision(tmp_path):
    from statewright.sources import history

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.yml").write_text("one")
    git("add", "a.yml")
    git("commit", "-qm", "x")
    (tmp_path / "a.yml").write_text("two")
    assert history.at("HEAD", str(tmp_path / "a.yml")) == "one" and history.at("HEAD", str(tmp_path / "b.yml")) == ""
    with pytest.raises(history.HistoryError):
        history.at("nowhere", str(tmp_path / "a.yml"))


def test_declared_constraints(spark):
    assert constraints.literal_default("'it''s'::text") == "it's" and constraints.literal_default("(0)::numeric(3, 2)") == "0" and constraints.literal_default("now()") is None
    assert constraints.non_null_default("NULL::text") is None and constraints.non_null_default("now()") == ("now()", False)
    assert constraints.bare("((a) and (b))") == "(a) and (b)"
    df = spark.createDataFrame([(1, "a", None)], "id long, code string, n long")
    assert constraints.mentions(df, "code = 'id' and n > 1", "n") and not constraints.mentions(df, "code = 'id'", "id")
    assert constraints.reads_only(df, "lower(code)", ["code"]) and not constraints.reads_only(df, "lower(code) || n", ["code"])
    assert constraints.null_over(df, "lower(code)", ["code"]) and not constraints.null_over(df, "coalesce(code, '')", ["code"])
    table = constraints.declared("t", df, {"unique": [{"columns": ["code"]}], "references": [{"column": "n", "table": "o", "on_delete": "cascade"}]})
    assert [t for t, k in constraints.incoming({"t": table}, "o")] == ["t"]
    assert "coalesce(code, '')" in constraints.advice(table, ("code",), "nullable") and "CREATE UNIQUE INDEX" in constraints.advice(table, ("n",), "none")
    with pytest.raises(ValueError):
        constraints.declared("t", df, {"unique": [{"columns": ["nope"]}]})


def test_scaffold_names():
    assert [scaffold.singular(t) for t in ("order_lines", "categories", "boxes", "status", "news_items", "glass")] == ["OrderLine", "Category", "Box", "Status", "NewsItem", "Glass"]
    assert scaffold.listed(["a", "a_p1", "schema_migrations", "b"]) == ["a", "b"]
    assert scaffold.guess_guard({"x": {"c": "m"}, "y": {"d": "m", "e": "n"}}, ["n", "m"]) == "m" and scaffold.guess_guard({}, ["n"]) is None
    assert scaffold.owner_of("a", {"a": "b", "b": "c"}) == "c"


def test_base_and_lineage(spark, project, database, tmp_path):
    (tmp_path / "state").mkdir()
    project.baseline(str(tmp_path / "state"), database)
    assert set(project.base(str(tmp_path / "state"), [])) == set(database)
    project.generate("later", database, project.head(FILES))
    assert len(project.lineage(str(tmp_path / "state"))) == 1
    project.declared = {"Depot": {"unique": [{"columns": ["id"]}]}}
    path = f"{tmp_path}/{project.names()[-1]}.jsonl"
    assert [r["model"] for r in project.key_notes(path, database).collect()] == ["Depot"]


def test_nested_arrays(spark):
    df = spark.createDataFrame([('[["a","b"],["c",null]]',), ('[["a"],["b","c"]]',), ('["a"]',)], "j string")
    assert [r[0] for r in df.select(values.nested_array_literal(F.col("j"))).collect()] == ["{{a,b},{c,NULL}}", None, None]


def test_stamps_are_times():
    assert changeset.next_stamp("20240101000000", ["20240101235959_x"]) == "20240102000000"


def test_where_things_come_from(spark):
    made = config.from_dict({"models": {"A": {"key": ["k"], "policy": {"renames": "update"}}}, "policy": {"missing_row": "warn"}})
    assert [reports.origin(made, "A", p) for p in ("renames", "missing_row", "deletes")] == ["policy of A", "policy of the project", "default"]
    assert "newer" in state.lineage_sentence("3", {"covers": "2"}) and "without" in state.lineage_sentence("15", {"covers": "2", "base": "1"})


def test_rows_as_written():
    import yaml

    node = yaml.compose("[007, 1e400, ~, 2024-01-02, {a: 1.10}]")
    assert rowfiles.as_written(node) == '["007","1e400","~","2024-01-02",{"a":1.1}]'
    assert rowfiles.parse("- model: A\n  rows:\n    - {a: {b: 0.1234567890123456789012}}\n")[0].cells["a"] == '{"b":0.1234567890123456789012}'
