"""Queries of the value layer: canonical texts, readings, row files and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import interval, values
from ..operators import diff
from ..operators import apply as run
from ..sources import export, rowfiles
from .catalogue import query, table
from .config import from_dict
from .derived import cte, state


@query(cte("doubles") + "SELECT id, CASE WHEN id = 0 THEN '0' WHEN id % 2 = 0 THEN '0.' || rtrim(lpad(CAST(id AS VARCHAR), 9, '0'), '0') ELSE CAST(id AS VARCHAR) || repeat('0', 20) END AS text FROM doubles")
def f21_double_text(spark, sf_dir):
    d = state(spark, sf_dir, "doubles")
    return d.select("id", values.text_of(d, "d").alias("text"))


@query(cte("moments") + "SELECT id, CASE id % 6 WHEN 0 THEN day || 'T00:00:00Z' WHEN 1 THEN day || 'T03:04:05Z' WHEN 2 THEN day || 'T03:04:05Z' WHEN 3 THEN day || 'T01:04:05.5Z' WHEN 4 THEN day || 'T04:34:05Z' END AS text FROM moments")
def f22_moment_text(spark, sf_dir):
    return state(spark, sf_dir, "moments").select("id", values.moment_text(F.col("said")).alias("text"))


@query(cte("moments") + "SELECT id, id % 2 = 1 AS differs FROM moments")
def f08_clock_reading(spark, sf_dir):
    said = F.concat("day", F.when(F.col("id") % 2 == 1, " 03:04:05.1234567").otherwise(" 03:04:05.1230000"))
    return state(spark, sf_dir, "moments").select("id", values.clock_reading_differs(said).alias("differs"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS text FROM events")
def f11_printed_copy(spark, sf_dir):
    said = F.when(F.col("event_id") % 4 == 0, "Yes").when(F.col("event_id") % 4 == 2, "t").when(F.col("event_id") % 4 == 1, "OFF").otherwise("0")
    return table(spark, sf_dir, "events").select("event_id", values.printed_copy(said, "boolean").alias("text"))


@query(cte("moments") + """SELECT id, '["' || day || 'T03:04:05Z","x",null]' AS text FROM moments""")
def f23_instants_in_json(spark, sf_dir):
    said = F.concat(F.lit('["'), "day", F.lit(' 03:04:05+00", "x", null]'))
    return state(spark, sf_dir, "moments").select("id", values.instants_in_json(said).alias("text"))


@query("""SELECT event_id, '{"a": [1, 2.50], "c": "x", "bb": ' || CAST(event_id AS VARCHAR) || '}' AS text FROM events""")
def f26_jsonb_text(spark, sf_dir):
    said = F.concat(F.lit('{"bb":'), F.col("event_id").cast("string"), F.lit(',"c":"x","a":[1,2.50]}'))
    return table(spark, sf_dir, "events").select("event_id", values.sorted_json(said).alias("text"))


@query("""SELECT event_id, '"' || event_type || '\\"\\\\"' AS text FROM events""")
def f29_quoted_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.quoted_json(F.concat("event_type", F.lit('"\\'))).alias("text"))


@query("SELECT event_id, event_id % 3 = 0 AS holds FROM events")
def f37_holds_null(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, '[1, null, "null"]').otherwise('[1, "null"]')
    return table(spark, sf_dir, "events").select("event_id", values.holds_null(said).alias("holds"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN CAST(9007199254740992 + event_id AS VARCHAR) ELSE '' END AS numbers FROM events")
def f39_beyond_float(spark, sf_dir):
    said = F.concat(F.lit('{"a":'), (F.col("event_id") + 9007199254740992).cast("string"), F.lit(',"b":[1.5e3,0.1],"c":"9007199254740993"}'))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(values.beyond_float(said), ",").alias("numbers"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'beyond a 64-bit float: ' || CAST(9007199254740992 + event_id AS VARCHAR) WHEN event_id % 4 = 0 THEN 'JSON null reads back as no value' END AS problem FROM events")
def k06_json_problem(spark, sf_dir):
    number = F.concat(F.lit("["), (F.col("event_id") + 9007199254740992).cast("string"), F.lit("]"))
    said = F.when(F.col("event_id") % 2 == 1, number).when(F.col("event_id") % 4 == 0, " null ").otherwise('{"a":1}')
    return table(spark, sf_dir, "events").select("event_id", export.json_problem(said).alias("problem"))


SPAN = "CASE WHEN {0} = 0 THEN '' WHEN {0} = 1 THEN '1 {1}' ELSE CAST({0} AS VARCHAR) || ' {1}s' END"
CLOCK = "CASE WHEN h > 0 OR {0} THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':00:00' ELSE '' END"


@query(cte("spans") + f"SELECT id, trim({SPAN.format('d', 'day')} || ' ' || {CLOCK.format('d = 0')}) AS text FROM spans")
def f31_interval_text(spark, sf_dir):
    said = F.concat(F.col("d").cast("string"), F.lit(" days "), F.col("h").cast("string"), F.lit(" hours"))
    return state(spark, sf_dir, "spans").select("id", interval.interval_text(said).alias("text"))


@query(cte("spans") + f"SELECT id, trim(regexp_replace({SPAN.format('((12 * y + m) // 12)', 'year')} || ' ' || {SPAN.format('((12 * y + m) % 12)', 'mon')} || ' ' || {SPAN.format('d', 'day')} || ' ' || {CLOCK.format('d + y + m = 0')}, ' +', ' ', 'g')) AS text FROM spans")
def f33_iso_interval(spark, sf_dir):
    said = F.concat(F.lit("P"), F.col("y").cast("string"), F.lit("Y"), F.col("m").cast("string"), F.lit("M"), F.col("d").cast("string"), F.lit("DT"), F.col("h").cast("string"), F.lit("H"))
    return state(spark, sf_dir, "spans").select("id", interval.interval_text(said).alias("text"))


@query(cte("spans") + "SELECT id, CAST(h AS VARCHAR) || ' hours' AS old, 'PT' || CAST(h AS VARCHAR) || 'H' AS new FROM spans WHERE id % 3 = 0")
def d08_respelled_interval(spark, sf_dir):
    s = state(spark, sf_dir, "spans")
    old = s.select("id", F.concat(F.col("h").cast("string"), F.lit(" hours")).alias("span"))
    new = s.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("PT"), F.col("h").cast("string"), F.lit("H"))).when(F.col("id") % 3 == 1, F.concat((F.col("h") + 1).cast("string"), F.lit(" hours"))).otherwise(F.concat(F.col("h").cast("string"), F.lit(" hours"))).alias("span"))
    return diff.respelled_intervals(old, new, ["id"], "span")


@query(
    cte("typed_base", "typed_head")
    + """SELECT COALESCE(b.event_id, h.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'insert' WHEN h.event_id IS NULL THEN 'delete' ELSE 'update' END AS kind,
CASE WHEN b.event_id IS NOT NULL AND h.event_id IS NOT NULL THEN concat_ws(',', CASE WHEN b.d IS DISTINCT FROM h.d THEN 'd' END, CASE WHEN b.ts IS DISTINCT FROM h.ts THEN 'ts' END) END AS changed
FROM typed_base b FULL OUTER JOIN typed_head h ON b.event_id = h.event_id WHERE b.event_id IS NULL OR h.event_id IS NULL OR b.d IS DISTINCT FROM h.d OR b.ts IS DISTINCT FROM h.ts"""
)
def d01_typed_diff(spark, sf_dir):
    changes = diff.state_diff(state(spark, sf_dir, "typed_base"), state(spark, sf_dir, "typed_head"), ["event_id"])
    return changes.select("event_id", "kind", F.when(F.col("kind") == "update", F.array_join(F.sort_array(F.map_keys("new")), ",")).alias("changed"))


@query("SELECT event_id, lower(hex(encode(event_type || CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END))) AS bytes, list_aggregate([event_id, user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END], 'string_agg', '/') AS pair FROM events")
def r07_apply_binary(spark, sf_dir):
    """Binary and nested columns through a change's text and back."""
    e = table(spark, sf_dir, "events")
    third = F.col("event_id") % 3 == 0
    side = lambda text, plus: e.select("event_id", text.cast("binary").alias("bytes"), F.array("event_id", F.col("user_id") + plus).alias("pair"))
    live, head = side(F.col("event_type"), F.lit(0)), side(F.when(third, F.concat("event_type", F.lit("x"))).otherwise(F.col("event_type")), F.when(third, 1).otherwise(0))
    after, _ = run.apply_changes(live, diff.state_diff(live, head, ["event_id"]), ["event_id"])
    return after.select("event_id", F.lower(F.hex("bytes")).alias("bytes"), F.array_join("pair", "/").alias("pair"))


WORLD = {"models": {"region": {"key": ["r_name"], "id": "r_regionkey"}, "nation": {"key": ["n_name"], "id": "n_nationkey", "refs": {"n_regionkey": "region"}}, "supplier": {"key": ["s_name"], "id": "s_suppkey", "refs": {"s_nationkey": "nation"}}}}


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def k01_export_roundtrip(spark, sf_dir):
    """Three tables exported as a row file, with references as templates, and read back into their types."""
    config = from_dict(WORLD)
    tables = {n: table(spark, sf_dir, n) for n in WORLD["models"]}
    rows = rowfiles.resolve(rowfiles.parse(export.export(config, tables)), config)
    back = rowfiles.frames(spark, rows, config)["supplier"].drop("__ord", "__present")
    return rowfiles.typed(back, tables["supplier"].schema, config.models["supplier"]).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(cte("base_customer", "head_customer") + "SELECT b.c_custkey, h.c_name, b.c_mktsegment FROM base_customer b JOIN head_customer h ON b.c_custkey = h.c_custkey")
def k10_keep_owned(spark, sf_dir):
    """What an export of an upsert model with an insert-only name writes."""
    model = from_dict({"models": {"customer": {"key": ["c_custkey"], "id": None, "mode": "upsert", "insert_only": ["c_name"]}}}).models["customer"]
    return export.keep_owned(state(spark, sf_dir, "base_customer"), state(spark, sf_dir, "head_customer"), model).select("c_custkey", "c_name", "c_mktsegment")


@query(cte("head_part") + "SELECT p_partkey, 'p_size' AS \"column\", 'null, a load writes 7' AS hazard FROM head_part WHERE p_size IS NULL")
def k09_hazards(spark, sf_dir):
    return export.hazards(state(spark, sf_dir, "head_part"), ["p_partkey"], {"p_size": "7"})


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{{' || event_type || ',"b c"},{' || CAST(event_id AS VARCHAR) || ',NULL}}' END AS text FROM events""")
def h12_nested_array(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    second = F.when(F.col("event_id") % 3 == 0, F.array(F.col("event_id").cast("string"))).otherwise(F.array(F.col("event_id").cast("string"), F.lit(None).cast("string")))
    return e.select("event_id", values.nested_array_literal(F.to_json(F.array(F.array(F.col("event_type"), F.lit("b c")), second))).alias("text"))


@query(cte("keyed_events") + """SELECT id, '{"id":"' || CAST(id AS VARCHAR) || '"' || CASE WHEN a IS NOT NULL AND a <> '' THEN ',"a":"' || a || '"' WHEN b IS NOT NULL AND b <> 0 THEN ',"b":"' || CAST(b AS VARCHAR) || '"' ELSE '' END || '}' AS key FROM keyed_events""")
def h02_natural_key(spark, sf_dir):
    e = state(spark, sf_dir, "keyed_events")
    return e.select("id", F.to_json(values.natural_key(e, ["id"], [["a", "b"]])).alias("key"))


@query("""SELECT c_custkey, '{"c_custkey":"' || CAST(c_custkey AS VARCHAR) || '","c_name":"' || c_name || '"}' AS row FROM customer""")
def p20_full_row(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.to_json(values.full_row(c, ["c_name"], "c_custkey")).alias("row"))


@query("SELECT event_id FROM events WHERE event_id % 6 = 1")
def p05_deleted_in_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("gone", F.when(F.col("event_id") % 6 == 0, F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))).when(F.col("event_id") % 6 == 1, F.col("ts")))
    return e.where(values.deleted_in_files(e, "gone")).select("event_id")
