"""The queries: every operator on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import apply as run
from ..operators import audit, diff, groups, lints, ordering, references
from .derived import cte, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART = ["p_partkey"]
DIFF_PART = """SELECT COALESCE(b.p_partkey, h.p_partkey) AS p_partkey,
       CASE WHEN b.p_partkey IS NULL THEN 'insert' WHEN h.p_partkey IS NULL THEN 'delete' ELSE 'update' END AS kind,
       CAST(b.p_size AS VARCHAR) AS old_size, CAST(h.p_size AS VARCHAR) AS new_size
FROM base_part b FULL OUTER JOIN head_part h ON b.p_partkey = h.p_partkey
WHERE b.p_partkey IS NULL OR h.p_partkey IS NULL OR b.p_size IS DISTINCT FROM h.p_size OR b.price IS DISTINCT FROM h.price OR b.p_name IS DISTINCT FROM h.p_name OR b.p_brand IS DISTINCT FROM h.p_brand"""


def part_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.state_diff(state(spark, sf_dir, "base_part"), state(spark, sf_dir, "head_part"), PART)


def sizes(changes: DataFrame) -> DataFrame:
    at = lambda m: F.try_element_at(m, F.lit("p_size"))
    return changes.select("p_partkey", "kind", at("old").alias("old_size"), at("new").alias("new_size"))


@query(cte("base_part", "head_part") + DIFF_PART)
def d01_state_diff_part(spark, sf_dir):
    return sizes(part_changes(spark, sf_dir))


@query(
    cte("base_orders", "head_orders")
    + """SELECT COALESCE(b.o_orderkey, h.o_orderkey) AS o_orderkey,
       CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN h.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS kind,
       b.o_orderstatus IS DISTINCT FROM h.o_orderstatus AS status_changed, b.o_totalprice IS DISTINCT FROM h.o_totalprice AS price_changed
FROM base_orders b FULL OUTER JOIN head_orders h ON b.o_orderkey = h.o_orderkey
WHERE b.o_orderkey IS NULL OR h.o_orderkey IS NULL OR b.o_orderstatus IS DISTINCT FROM h.o_orderstatus OR b.o_totalprice IS DISTINCT FROM h.o_totalprice"""
)
def d01_state_diff_orders(spark, sf_dir):
    changes = diff.state_diff(state(spark, sf_dir, "base_orders"), state(spark, sf_dir, "head_orders"), ["o_orderkey"])
    held = lambda c: F.coalesce(F.array_contains(F.map_keys("old"), c), F.lit(False)) | F.coalesce(F.array_contains(F.map_keys("new"), c), F.lit(False))
    # A null price inserted or deleted is no difference of prices.
    price = held("o_totalprice") & ~F.try_element_at("old", F.lit("o_totalprice")).eqNullSafe(F.try_element_at("new", F.lit("o_totalprice")))
    return changes.select("o_orderkey", "kind", held("o_orderstatus").alias("status_changed"), price.alias("price_changed"))


@query(
    cte("base_turns", "head_turns")
    + """SELECT COALESCE(b.conv_id, h.conv_id) AS conv_id, COALESCE(b.turn, h.turn) AS turn,
       CASE WHEN b.conv_id IS NULL THEN 'insert' WHEN h.conv_id IS NULL THEN 'delete' ELSE 'update' END AS kind
FROM base_turns b FULL OUTER JOIN head_turns h ON b.conv_id = h.conv_id AND b.turn = h.turn
WHERE b.conv_id IS NULL OR h.conv_id IS NULL OR b.role IS DISTINCT FROM h.role OR b.text IS DISTINCT FROM h.text"""
)
def d01_composite_key_diff(spark, sf_dir):
    return diff.state_diff(state(spark, sf_dir, "base_turns"), state(spark, sf_dir, "head_turns"), ["conv_id", "turn"]).select("conv_id", "turn", "kind")


LONG_CUSTOMER = """SELECT b.c_custkey, 'update' AS kind, 'c_name' AS "column", b.c_name AS old, h.c_name AS new FROM base_customer b JOIN head_customer h ON b.c_custkey = h.c_custkey WHERE b.c_name IS DISTINCT FROM h.c_name
UNION ALL SELECT b.c_custkey, 'update', 'c_nationkey', CAST(b.c_nationkey AS VARCHAR), CAST(h.c_nationkey AS VARCHAR) FROM base_customer b JOIN head_customer h ON b.c_custkey = h.c_custkey WHERE b.c_nationkey IS DISTINCT FROM h.c_nationkey
UNION ALL SELECT b.c_custkey, 'update', 'c_mktsegment', b.c_mktsegment, h.c_mktsegment FROM base_customer b JOIN head_customer h ON b.c_custkey = h.c_custkey WHERE b.c_mktsegment IS DISTINCT FROM h.c_mktsegment"""


def customer_changes(spark, sf_dir, **options):
    return diff.state_diff(state(spark, sf_dir, "base_customer"), state(spark, sf_dir, "head_customer"), ["c_custkey"], **options)


@query(cte("base_customer", "head_customer") + LONG_CUSTOMER)
def d02_changed_columns_long(spark, sf_dir):
    return diff.long_form(customer_changes(spark, sf_dir).where("kind = 'update'"), ["c_custkey"])


@query(cte("base_part", "head_part") + "SELECT b.p_partkey, 'p_brand' AS lone FROM base_part b JOIN head_part h ON b.p_partkey = h.p_partkey")
def d02_presence_refusal(spark, sf_dir):
    base, head = state(spark, sf_dir, "base_part"), state(spark, sf_dir, "head_part").drop("p_brand")
    changes = diff.state_diff(base, head, PART, ["p_name", "p_brand", "p_size", "price"])
    return diff.one_sided(changes).select("p_partkey", F.array_join("lone", ",").alias("lone"))


@query(cte("base_customer", "head_customer") + "SELECT b.c_custkey, b.c_name AS old_c_name, h.c_name AS new_c_name, EXISTS (SELECT 1 FROM base_customer o WHERE o.c_name = h.c_name) AS occupied FROM base_customer b JOIN head_customer h ON b.c_custkey = h.c_custkey WHERE b.c_name IS DISTINCT FROM h.c_name")
def d03_rename_by_id(spark, sf_dir):
    return diff.renames(state(spark, sf_dir, "base_customer"), state(spark, sf_dir, "head_customer"), "c_custkey", ["c_name"])


@query(cte("named_base", "drifted") + "SELECT b.c_name, b.c_custkey AS base_id, h.c_custkey AS head_id FROM named_base b JOIN drifted h ON b.c_name = h.c_name WHERE b.c_custkey <> h.c_custkey")
def d04_id_drift(spark, sf_dir):
    return diff.id_drift(state(spark, sf_dir, "named_base"), state(spark, sf_dir, "drifted"), "c_custkey", ["c_name"])


@query(cte("base_supplier", "moved_supplier") + "SELECT b.s_suppkey, b.s_name AS old_s_name, h.s_name AS new_s_name FROM base_supplier b JOIN moved_supplier h ON b.s_suppkey = h.s_suppkey WHERE b.s_name <> h.s_name AND EXISTS (SELECT 1 FROM base_supplier o WHERE o.s_name = h.s_name)")
def d04_occupied_rename(spark, sf_dir):
    return diff.renames(state(spark, sf_dir, "base_supplier"), state(spark, sf_dir, "moved_supplier"), "s_suppkey", ["s_name"]).where("occupied").drop("occupied")


@query(
    cte("base_supplier", "head_supplier")
    + """, gone AS (SELECT s_name FROM base_supplier b WHERE NOT EXISTS (SELECT 1 FROM head_supplier h WHERE h.s_name = b.s_name)),
come AS (SELECT s_name FROM head_supplier h WHERE NOT EXISTS (SELECT 1 FROM base_supplier b WHERE h.s_name = b.s_name)),
g1 AS (SELECT lower(s_name) f, min(s_name) s FROM gone GROUP BY 1 HAVING count(*) = 1), c1 AS (SELECT lower(s_name) f, min(s_name) s FROM come GROUP BY 1 HAVING count(*) = 1)
SELECT g1.s AS old_key, c1.s AS new_key FROM g1 JOIN c1 ON g1.f = c1.f"""
)
def j03_folded_key_pairs(spark, sf_dir):
    return diff.fold_pairs(state(spark, sf_dir, "base_supplier"), state(spark, sf_dir, "head_supplier"), "s_name")


def _mode(name: str, mode: str, kinds: str):
    sql = cte("base_customer", "head_customer") + f"""SELECT c_custkey, kind FROM (SELECT COALESCE(b.c_custkey, h.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'insert' WHEN h.c_custkey IS NULL THEN 'delete' WHEN b.c_name IS DISTINCT FROM h.c_name OR b.c_nationkey IS DISTINCT FROM h.c_nationkey OR b.c_mktsegment IS DISTINCT FROM h.c_mktsegment THEN 'update' END AS kind
FROM base_customer b FULL OUTER JOIN head_customer h ON b.c_custkey = h.c_custkey) WHERE kind IN ({kinds})"""

    def f(spark, sf_dir):
        return customer_changes(spark, sf_dir, mode=mode).select("c_custkey", "kind")

    f.__name__ = name
    query(sql)(f)


_mode("d_mode_sync", "sync", "'insert','update','delete'")
_mode("d_mode_upsert", "upsert", "'insert','update'")
_mode("d_mode_insert", "insert", "'insert'")


@query(cte("base_part", "head_part") + "SELECT count(*) FILTER (h.p_partkey IS NULL) AS rows, CAST(0 AS BIGINT) AS changed, count(*) FILTER (b.p_partkey IS NOT NULL AND h.p_partkey IS NOT NULL AND b.p_size IS DISTINCT FROM h.p_size) AS changed_p_size FROM base_part b FULL OUTER JOIN head_part h ON b.p_partkey = h.p_partkey")
def d_insert_only_left_alone(spark, sf_dir):
    return diff.left_alone(state(spark, sf_dir, "base_part"), state(spark, sf_dir, "head_part"), PART, "upsert", ("p_size",))


@query(cte("base_part", "head_part") + "SELECT h.p_partkey, 'p_size' AS \"column\" FROM head_part h WHERE NOT EXISTS (SELECT 1 FROM base_part b WHERE b.p_partkey = h.p_partkey) AND h.p_partkey % 2 = 0")
def d09_left_out(spark, sf_dir):
    changes = part_changes(spark, sf_dir)
    some = F.when((F.col("kind") == "insert") & (F.col("p_partkey") % 2 == 0), F.map_filter("new", lambda k, v: k != "p_size")).otherwise(F.col("new"))
    return diff.left_out(changes.withColumn("new", some), PART)


@query("SELECT l_orderkey, l_linenumber, count(*) AS lines FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) GROUP BY 1, 2")
def d12_shared_ref_refusal(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    held = references.shared((part, "p_name"))
    return references.pointing_at(named, "p_name", held, "value").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("lines"))


@query(cte("shared_ids") + "SELECT event_id, id FROM shared_ids WHERE id IN (SELECT id FROM shared_ids GROUP BY id HAVING count(*) > 1)")
def d13_shared_id_refusal(spark, sf_dir):
    """Rows that a shared id keeps from being told apart."""
    e = state(spark, sf_dir, "shared_ids")
    return references.pointing_at(e, "id", groups.duplicates(e, ["id"]), "id")


@query(cte("base_part", "head_part") + "SELECT b.p_partkey, 'p_size' AS \"column\", 'null against default' AS hint FROM base_part b JOIN head_part h ON b.p_partkey = h.p_partkey WHERE b.p_size = 1 AND h.p_size IS NULL")
def d17_default_hint(spark, sf_dir):
    return diff.default_hints(part_changes(spark, sf_dir), PART, {"p_size": "1"})


@query(cte("base_part", "head_part") + f"SELECT p_partkey, CASE kind WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' ELSE kind END AS kind, new_size AS old_size, old_size AS new_size FROM ({DIFF_PART})")
def d20_invert_changes(spark, sf_dir):
    return sizes(diff.inverted(part_changes(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS ids FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a02_duplicate_keys(spark, sf_dir):
    return groups.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("SELECT id, count(*) AS n FROM (SELECT event_id AS id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 19 = 0) GROUP BY 1 HAVING count(*) > 1")
def a03_duplicate_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return groups.duplicates(e.unionByName(e.where("id % 19 = 0")), ["id"])


@query(cte("mixed_part") + "SELECT lower(p_name) AS folded, count(DISTINCT p_name) AS n, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS spellings FROM mixed_part GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def a05_type_equal_keys(spark, sf_dir):
    return groups.equal_keys(state(spark, sf_dir, "mixed_part"), "p_name", values.fold(F.col("p_name")))


@query("SELECT sha256(lower(trim(text))) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a07_stricter_index(spark, sf_dir):
    return groups.index_clashes(table(spark, sf_dir, "documents"), [F.lower(F.trim("text"))])


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, count(*) n, string_agg(CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_partkey, l_suppkey) s FROM lineitem GROUP BY 1, 2),
h AS (SELECT l_orderkey, l_linenumber, count(*) n, string_agg(CAST(p AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR), ',' ORDER BY p, l_suppkey) s FROM (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_orderkey % 9 = 0 THEN l_partkey + 1 ELSE l_partkey END AS p FROM lineitem) GROUP BY 1, 2)
SELECT b.l_orderkey, b.l_linenumber, CAST(b.n AS BIGINT) AS base_rows, CAST(h.n AS BIGINT) AS head_rows, b.s = h.s AS same FROM b JOIN h ON b.l_orderkey = h.l_orderkey AND b.l_linenumber = h.l_linenumber WHERE b.n > 1"""
)
def a09_row_set_equal(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    head = base.withColumn("l_partkey", F.when(F.col("l_orderkey") % 9 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")))
    return groups.row_sets(base, head, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(
    cte("base_part", "head_part", "base_customer", "head_customer")
    + f""", p AS ({DIFF_PART}), c AS (SELECT CASE WHEN b.c_custkey IS NULL THEN 'insert' WHEN h.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS kind FROM base_customer b FULL OUTER JOIN head_customer h ON b.c_custkey = h.c_custkey WHERE b.c_custkey IS NULL OR h.c_custkey IS NULL OR b.c_name IS DISTINCT FROM h.c_name OR b.c_nationkey IS DISTINCT FROM h.c_nationkey OR b.c_mktsegment IS DISTINCT FROM h.c_mktsegment)
SELECT model, count(*) FILTER (kind = 'insert') AS inserts, count(*) FILTER (kind = 'update') AS updates, count(*) FILTER (kind = 'delete') AS deletes FROM (SELECT 'part' AS model, kind FROM p UNION ALL SELECT 'customer', kind FROM c) GROUP BY model"""
)
def a11_summary_by_model(spark, sf_dir):
    parts = [part_changes(spark, sf_dir).select(F.lit("part").alias("model"), "kind"), customer_changes(spark, sf_dir).select(F.lit("customer").alias("model"), "kind")]
    return diff.summary(parts[0].unionByName(parts[1]))


@query("""SELECT 'c_custkey' AS "column", count(*) AS rows, count(DISTINCT c_custkey) AS different, count(*) = count(DISTINCT c_custkey) AS is_key FROM customer
UNION ALL SELECT 'c_name', count(*), count(DISTINCT c_name), count(*) = count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment), count(*) = count(DISTINCT c_mktsegment) FROM customer""")
def a20_guess_unique_columns(spark, sf_dir):
    return groups.key_candidates(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query(cte("base_customer") + "SELECT o_orderkey, o_custkey, c_name AS o_custkey_ref FROM orders LEFT JOIN base_customer ON o_custkey = c_custkey")
def j04_resolve_refs(spark, sf_dir):
    return references.resolved(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", state(spark, sf_dir, "base_customer"), "c_custkey", "c_name")


@query(cte("base_customer") + "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM base_customer WHERE c_custkey = o_custkey) AND o_custkey IS NOT NULL")
def j04_dangling_refs(spark, sf_dir):
    return references.dangling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", state(spark, sf_dir, "base_customer"), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0)")
def j04_points_at_deleted(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 11 = 0")
    return references.pointing_at(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@query("SELECT event_id, CAST(last_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) AS above FROM events")
def j06_anchor_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return references.anchored(e, ["user_id"], "event_type", "event_id", "event_id").select("event_id", F.col("above").cast("string").alias("above"))


@query(cte("named_part") + """, w AS (SELECT DISTINCT name FROM named_part UNION ALL SELECT 'no such part'), t AS (SELECT name, count(*) AS n, min(p_partkey) AS k FROM named_part GROUP BY 1)
SELECT w.name, COALESCE(n, 0) AS found, CASE WHEN n = 1 THEN CAST(k AS VARCHAR) END AS target_id, CASE WHEN COALESCE(n, 0) = 0 THEN 'missing' WHEN n = 1 THEN 'one' ELSE 'many' END AS verdict FROM w LEFT JOIN t ON w.name = t.name""")
def j08_cardinality_resolve(spark, sf_dir):
    part = state(spark, sf_dir, "named_part")
    wanted = part.select("name").distinct().unionByName(spark.range(1).select(F.lit("no such part").alias("name")))
    return references.cardinality(wanted, "name", part, "name", "p_partkey").withColumn("target_id", F.col("target_id").cast("string"))


@query("SELECT c_custkey, least(count(o_orderkey), 10) AS referring FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j14_referencing_counts(spark, sf_dir):
    return references.referring(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", cap=10)


@query(cte("base_nation", "renamed_nation") + "SELECT c.c_custkey, h.n_name AS nation FROM customer c JOIN base_nation b ON c.c_nationkey = b.n_nationkey JOIN renamed_nation h ON h.n_nationkey = b.n_nationkey")
def j22_moved_refs(spark, sf_dir):
    base, head = state(spark, sf_dir, "base_nation"), state(spark, sf_dir, "renamed_nation")
    named = references.resolved(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", base, "n_nationkey", "n_name").select("c_custkey", F.col("c_nationkey_ref").alias("nation"))
    moves = references.moved(base, head, ["n_nationkey"], "n_name").select("from", "to")
    return references.cascaded({"nation": base, "customer": named}, ["nation", "customer"], {"customer": {"nation": "nation"}}, {"nation": moves})["customer"]


@query(cte("customer_history") + "SELECT code, max(deleted) AS deleted_at FROM customer_history WHERE deleted IS NOT NULL GROUP BY 1")
def s05_soft_deleted_latest(spark, sf_dir):
    return references.newest_deleted(state(spark, sf_dir, "customer_history"), ["code"], "deleted")


@query(cte("keyed_events") + "SELECT id, CASE WHEN a IS NOT NULL AND a <> '' THEN 'a' WHEN b IS NOT NULL AND b <> 0 THEN 'b' END AS name, CASE WHEN a IS NOT NULL AND a <> '' THEN a WHEN b IS NOT NULL AND b <> 0 THEN CAST(b AS VARCHAR) END AS value FROM keyed_events")
def p15_key_any_of(spark, sf_dir):
    e = state(spark, sf_dir, "keyed_events")
    return e.select("id", values.first_set(e, ["a", "b"]).alias("k")).select("id", F.col("k.name").alias("name"), F.col("k.value").alias("value"))


@query("SELECT conv_id, turn, '{\"conv_id\":\"' || conv_id || '\",\"turn\":\"' || turn || '\"}' AS key, 'Turn/conv_id=' || conv_id || '/turn=' || turn AS label FROM conversations")
def p16_key_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", values.key_json(c, ["conv_id", "turn"]).alias("key"), values.label(c, "Turn", ["turn", "conv_id"]).alias("label"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS anchor FROM part")
def p24_anchor_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("anchor"))


@query(cte("numerals") + """SELECT id, CASE WHEN regexp_full_match(said, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN
CASE WHEN v = '0' THEN '0' WHEN starts_with(said, '-') THEN '-' || v ELSE v END END AS text FROM (SELECT *, CASE WHEN contains(d, '.') THEN rtrim(rtrim(CASE WHEN starts_with(d, '.') THEN '0' || d ELSE d END, '0'), '.') WHEN d = '' THEN '0' ELSE d END AS v FROM (SELECT *, ltrim(ltrim(said, '+-'), '0') AS d FROM numerals))""")
def f20_canonical_decimal(spark, sf_dir):
    return state(spark, sf_dir, "numerals").select("id", values.decimal_text(F.col("said")).alias("text"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS text FROM events")
def f22_instant_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", values.text_of(e, "ts").alias("text"))


@query("""SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS text FROM events""")
def f25_canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.json_text(F.col("props")).alias("text"))


@query(cte("uuids") + "SELECT id, CASE WHEN regexp_full_match(b, '[0-9a-f]{32}') THEN regexp_replace(b, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS text FROM (SELECT id, lower(regexp_replace(said, '[{}-]', '', 'g')) AS b FROM uuids)")
def f12_uuid_text(spark, sf_dir):
    return state(spark, sf_dir, "uuids").select("id", values.uuid_text(F.col("said")).alias("text"))


@query("SELECT event_id, '\\x' || lower(lpad(printf('%x', CAST(event_id % 256 AS INT)), 2, '0')) || lower(lpad(printf('%x', CAST(user_id % 256 AS INT)), 2, '0')) AS text FROM events")
def f15_bytes_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.bytes_text(F.array(F.col("event_id") % 256, F.col("user_id") % 256)).alias("text"))


FINDING = "'{0}' AS kind, CAST({1} AS VARCHAR) AS \"row\", {2} AS detail, {3} AS unsure"


@query("SELECT " + FINDING.format("too_long", "p_partkey", "CAST(length(p_type) AS VARCHAR)", "false") + " FROM part WHERE length(rtrim(p_type)) > 6")
def f06_length_lint(spark, sf_dir):
    return lints.long_values(table(spark, sf_dir, "part"), F.col("p_partkey"), "p_type", "varchar", 6)


@query("SELECT " + FINDING.format("invalid_value", "p_partkey", "p_brand", "false") + " FROM part WHERE try_cast(p_brand AS INT) IS NULL AND p_brand IS NOT NULL")
def f04_try_cast_lint(spark, sf_dir):
    return lints.invalid_casts(table(spark, sf_dir, "part"), F.col("p_partkey"), "p_brand", "int")


@query(cte("numerals") + "SELECT " + FINDING.format("float_reading", "id", "said", "true") + " FROM numerals WHERE regexp_full_match(said, '[0-9]+') AND CAST(CAST(said AS DOUBLE) AS HUGEINT) <> CAST(said AS HUGEINT)")
def f30_float_reading(spark, sf_dir):
    return lints.float_readings(state(spark, sf_dir, "numerals"), F.col("id"), "said")


@query(cte("texts") + "SELECT " + FINDING.format("session_dependent", "id", "said", "false") + " FROM texts WHERE said IN ('now', '01/02/2024', '2024-01-02 03:04:05')")
def f07_session_dependent(spark, sf_dir):
    return lints.moving_values(state(spark, sf_dir, "texts"), F.col("id"), "said")


@query("SELECT " + FINDING.format("zero_default", "p_partkey", "'p_size'", "false") + " FROM part WHERE p_partkey % 9 = 0")
def l01_zero_default(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(F.col("p_size")))
    return lints.zero_defaults(part, F.col("p_partkey"), {"p_size": "1", "p_retailprice": "0"})


@query(cte("head_part") + "SELECT " + FINDING.format("null_default", "p_partkey", "'p_size'", "false") + " FROM head_part WHERE p_size IS NULL")
def l02_null_default(spark, sf_dir):
    return lints.null_defaults(state(spark, sf_dir, "head_part"), F.col("p_partkey"), ["p_size", "p_name"])


@query("""SELECT 'lineitem' AS name, count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, CAST(0 AS BIGINT) AS nulls, 'repeated' AS verdict FROM lineitem
UNION ALL SELECT 'part', count(*), count(DISTINCT p_partkey), 0, 'unique' FROM part""")
def l06_unbacked_key(spark, sf_dir):
    one = lints.empirical_key(table(spark, sf_dir, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])
    return one.unionByName(lints.empirical_key(table(spark, sf_dir, "part"), "part", PART))


@query(cte("swapped") + "SELECT a.seq AS from_seq, b.seq AS to_seq FROM swapped a JOIN swapped b ON a.frees = b.takes AND b.frees = a.takes WHERE a.seq < b.seq")
def o06_unique_circle(spark, sf_dir):
    return ordering.swaps(state(spark, sf_dir, "swapped"), "seq", "frees", "takes")


@query("SELECT s_suppkey AS seq, CAST((SELECT max(s_suppkey) FROM supplier) - s_suppkey AS INT) AS position FROM supplier")
def o06_ordered_changes(spark, sf_dir):
    chain = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("frees"), (F.col("s_suppkey") + 1).alias("takes"))
    return ordering.order_changes(chain, ordering.unique_edges(chain, "seq", "frees", "takes"))[0].select("seq", "position")


@query("WITH RECURSIVE " + cte("tree")[5:] + ", d AS (SELECT id, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, d.depth + 1 FROM tree t JOIN d ON t.parent = d.id AND t.id <> d.id) SELECT id, depth FROM d")
def o09_tree_depth(spark, sf_dir):
    return ordering.tree_depth(state(spark, sf_dir, "tree"), "id", "parent")


@query("SELECT s_suppkey AS id, CAST(s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS INT) AS depth FROM supplier")
def o09_long_chain(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") - 1).alias("parent"))
    return ordering.tree_depth(rows, "id", "parent")


def _applied(spark, sf_dir) -> DataFrame:
    return run.diagnose(part_changes(spark, sf_dir), state(spark, sf_dir, "live_part"), PART)


CHANGED = """(SELECT COALESCE(b.p_partkey, h.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'insert' WHEN h.p_partkey IS NULL THEN 'delete' ELSE 'update' END AS kind, b.p_size AS old_size, h.p_size AS new_size, b.p_name AS old_name, b.p_brand AS old_brand, b.price AS old_price, h.p_name AS new_name, h.p_brand AS new_brand, h.price AS new_price
FROM base_part b FULL OUTER JOIN head_part h ON b.p_partkey = h.p_partkey WHERE b.p_partkey IS NULL OR h.p_partkey IS NULL OR b.p_size IS DISTINCT FROM h.p_size)"""
PROBLEM = f"""SELECT c.p_partkey, c.kind, CASE
WHEN c.kind = 'insert' AND l.p_partkey IS NULL THEN ''
WHEN c.kind = 'insert' THEN CASE WHEN l.p_size IS NOT DISTINCT FROM c.new_size AND l.p_name IS NOT DISTINCT FROM c.new_name AND l.p_brand IS NOT DISTINCT FROM c.new_brand AND l.price IS NOT DISTINCT FROM c.new_price THEN 'benign' ELSE 'changed' END
WHEN c.kind = 'delete' AND l.p_partkey IS NULL THEN 'benign'
WHEN l.p_partkey IS NULL THEN 'missing'
WHEN c.kind = 'update' AND l.p_size IS NOT DISTINCT FROM c.new_size THEN 'benign'
WHEN c.kind = 'update' AND l.p_size IS NOT DISTINCT FROM c.old_size THEN ''
WHEN c.kind = 'delete' AND l.p_size IS NOT DISTINCT FROM c.old_size THEN ''
ELSE 'changed' END AS problem FROM {CHANGED} c LEFT JOIN live_part l ON c.p_partkey = l.p_partkey"""


@query(cte("base_part", "head_part", "live_part") + PROBLEM)
def r11_diagnose(spark, sf_dir):
    return _applied(spark, sf_dir).select("p_partkey", "kind", "problem")


def _kind(name: str, kind: str):
    def f(spark, sf_dir):
        return _applied(spark, sf_dir).where(F.col("kind") == kind).select("p_partkey", "status")

    f.__name__ = name
    query(cte("base_part", "head_part", "live_part") + f"SELECT p_partkey, CASE problem WHEN '' THEN 'applied' WHEN 'benign' THEN 'unchanged' ELSE 'problem' END AS status FROM ({PROBLEM}) WHERE kind = '{kind}'")(f)


_kind("r06_apply_insert", "insert")
_kind("r07_apply_update", "update")
_kind("r08_apply_delete", "delete")


@query(cte("base_part", "head_part", "live_part") + f"SELECT p_partkey, CASE problem WHEN 'missing' THEN 'error' WHEN 'changed' THEN 'warn' ELSE 'ignore' END AS mode FROM ({PROBLEM})")
def r17_policy_modes(spark, sf_dir):
    return run.judged(_applied(spark, sf_dir)).select("p_partkey", "mode")


@query("SELECT c_custkey, least(count(*), 1001) AS referring FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 13 = 0 GROUP BY 1")
def r10_referenced_deletes(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 13 = 0").select("c_custkey", F.lit("delete").alias("kind"))
    return run.referenced_deletes(gone, "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query(
    cte("customer_history", "customer_wanted")
    + """, m AS (SELECT w.code, w.id AS wid, h.id, h.deleted, h.id IS NOT NULL AS there, h.segment = w.segment AS same FROM customer_wanted w LEFT JOIN customer_history h ON w.code = h.code),
g AS (SELECT code, count(*) FILTER (there AND deleted IS NULL) live, count(*) FILTER (there AND deleted IS NULL AND same) live_same, max(deleted) FILTER (same) newest, count(*) FILTER (deleted IS NOT NULL AND NOT same AND id = wid) other, count(*) FILTER (deleted IS NOT NULL) gone FROM m GROUP BY 1),
t AS (SELECT g.code, count(*) ties, max(m.id) pick FROM g JOIN m ON g.code = m.code AND m.deleted = g.newest AND m.same GROUP BY 1)
SELECT code, decision, CASE WHEN decision = 'restore' THEN CAST(pick AS VARCHAR) END AS restored_id FROM (SELECT g.code, t.pick, CASE WHEN live_same > 0 THEN 'unchanged' WHEN live > 0 THEN 'changed' WHEN ties > 1 THEN 'duplicate' WHEN ties = 1 THEN 'restore' WHEN other > 0 THEN 'changed' WHEN gone > 0 THEN 'insert beside' ELSE 'insert' END AS decision FROM g LEFT JOIN t ON g.code = t.code)"""
)
def r20_insert_or_restore(spark, sf_dir):
    return run.insert_or_restore(state(spark, sf_dir, "customer_wanted"), state(spark, sf_dir, "customer_history"), ["code"], ["segment"], "id", "deleted").withColumn("restored_id", F.col("restored_id").cast("string"))


@query(cte("customer_history") + "SELECT id, CAST(CASE WHEN id % 3 = 0 AND deleted IS NULL THEN 77 ELSE deleted END AS VARCHAR) AS deleted FROM customer_history")
def r19_soft_delete(spark, sf_dir):
    h = state(spark, sf_dir, "customer_history")
    return run.soft_deleted(h, h.where("id % 3 = 0"), ["id"], "deleted", F.lit(77).cast("long")).select("id", F.col("deleted").cast("string").alias("deleted"))


@query(cte("head_part") + "SELECT p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size, price FROM head_part")
def r_apply_roundtrip(spark, sf_dir):
    return run.apply_changes(state(spark, sf_dir, "base_part"), part_changes(spark, sf_dir), PART)[0].withColumn("p_size", F.col("p_size").cast("string"))


@query(cte("base_part") + "SELECT p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size, price FROM base_part")
def r_revert_roundtrip(spark, sf_dir):
    return run.apply_changes(state(spark, sf_dir, "head_part"), diff.inverted(part_changes(spark, sf_dir)), PART)[0].withColumn("p_size", F.col("p_size").cast("string"))


@query(cte("audit_log") + "SELECT set_name, max(id) AS id, arg_max(direction, id) AS direction, arg_max(by_user, id) AS by_user FROM audit_log GROUP BY 1")
def s23_audit_latest(spark, sf_dir):
    return audit.latest(state(spark, sf_dir, "audit_log"))


@query(cte("audit_log") + "SELECT id, set_name, direction, by_user FROM audit_log a WHERE direction = 'up' AND id > (SELECT COALESCE(max(id), -1) FROM audit_log d WHERE d.set_name = a.set_name AND d.direction = 'down')")
def s24_audit_since_down(spark, sf_dir):
    return audit.since_down(state(spark, sf_dir, "audit_log"))


@query(cte("directory", "applied") + "SELECT COALESCE(d.name, a.name) AS name, d.name IS NOT NULL AS in_directory, a.name IS NOT NULL AS applied, a.name IS NULL AND d.name < (SELECT max(name) FROM applied) AS out_of_order FROM directory d FULL OUTER JOIN applied a ON d.name = a.name")
def j16_applied_pending(spark, sf_dir):
    return audit.applied_and_pending(state(spark, sf_dir, "directory"), state(spark, sf_dir, "applied"))


@query(cte("numerals") + "SELECT id, said AS first, CAST(CAST(CAST(said AS DOUBLE) AS HUGEINT) AS VARCHAR) AS second FROM numerals WHERE regexp_full_match(said, '[0-9]+') AND CAST(CAST(said AS DOUBLE) AS HUGEINT) <> CAST(said AS HUGEINT)")
def d05_undecided(spark, sf_dir):
    exact = values.decimal_text(F.col("said"))
    float_ = values.number_text(F.col("said").try_cast("double"))
    return diff.undecided(state(spark, sf_dir, "numerals"), ["id"], {"said": (exact, float_)}).select("id", "first", "second")


@query(cte("base_supplier", "head_supplier") + "SELECT b.s_suppkey, b.s_name AS old, h.s_name AS new FROM base_supplier b JOIN head_supplier h ON b.s_suppkey = h.s_suppkey WHERE b.s_name <> h.s_name AND lower(b.s_name) = lower(h.s_name)")
def d07_respelled(spark, sf_dir):
    return diff.respelled(state(spark, sf_dir, "base_supplier"), state(spark, sf_dir, "head_supplier"), ["s_suppkey"], "s_name", values.fold)


@query("SELECT " + FINDING.format("json_null", "event_id", "'props'", "false") + " FROM events WHERE event_id % 8 = 0")
def l05_json_null(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 8 != 0, F.col("props")))
    return lints.json_nulls(e, F.col("event_id"), "props")


@query("SELECT " + FINDING.format("zero_time", "event_id", "'gone'", "false") + " FROM events WHERE event_id % 6 = 0")
def l15_zero_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("gone", F.when(F.col("event_id") % 6 == 0, F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))).when(F.col("event_id") % 6 == 1, F.col("ts")))
    return lints.zero_times(e, F.col("event_id"), "gone")


def _found(spark, sf_dir):
    return lints.moving_values(state(spark, sf_dir, "texts"), F.col("id"), "said").unionByName(lints.float_readings(state(spark, sf_dir, "numerals"), F.col("id"), "said"))


FOUND = "(SELECT 'session_dependent' AS kind, false AS unsure FROM texts WHERE said IN ('now', '01/02/2024', '2024-01-02 03:04:05') UNION ALL SELECT 'float_reading', true FROM numerals WHERE regexp_full_match(said, '[0-9]+') AND CAST(CAST(said AS DOUBLE) AS HUGEINT) <> CAST(said AS HUGEINT))"


@query(cte("texts", "numerals") + f"SELECT kind, count(*) AS n, count(*) FILTER (unsure) AS unsure FROM {FOUND} GROUP BY kind")
def a18_findings_by_kind(spark, sf_dir):
    return lints.by_kind(_found(spark, sf_dir))


@query(cte("texts", "numerals") + f"SELECT grp, CASE WHEN bool_or(kind = 'session_dependent') THEN 'warn' ELSE 'ignore' END AS mode FROM (SELECT kind, id % 50 AS grp FROM {FOUND.replace('AS unsure FROM', 'AS unsure, id FROM').replace('true FROM', 'true, id FROM')}) GROUP BY grp")
def a17_worst_mode(spark, sf_dir):
    found = _found(spark, sf_dir).withColumn("grp", F.col("row").cast("long") % 50)
    return lints.worst(found, {"session_dependent": "warn", "float_reading": "ignore"}, "grp")


@query("SELECT c_name, c_custkey FROM (SELECT c_custkey + 1 AS c_custkey, c_name FROM customer) w WHERE EXISTS (SELECT 1 FROM customer l WHERE l.c_custkey = w.c_custkey AND l.c_name <> w.c_name)")
def j15_ids_taken(spark, sf_dir):
    live = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return run.ids_taken(live.withColumn("c_custkey", F.col("c_custkey") + 1), live, "c_custkey", ["c_name"])


@query(cte("customer_history", "customer_wanted") + "SELECT w.code, CAST(max(h.deleted) AS VARCHAR) AS deleted_at FROM (SELECT DISTINCT code FROM customer_wanted) w LEFT JOIN customer_history h ON w.code = h.code GROUP BY 1")
def a14_noted_deletions(spark, sf_dir):
    wanted = state(spark, sf_dir, "customer_wanted").select("code").distinct()
    deleted = references.newest_deleted(state(spark, sf_dir, "customer_history"), ["code"], "deleted")
    return run.noted(wanted, deleted, ["code"]).withColumn("deleted_at", F.col("deleted_at").cast("string"))


@query("SELECT o_orderkey, 'set null' AS effect FROM orders WHERE o_custkey % 13 = 0")
def r10_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 13 = 0").select("c_custkey", F.lit("delete").alias("kind"))
    return run.cascade(gone, "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "set null")


@query("SELECT event_id, '{' || event_type || ',\"' || event_type || ' x\",NULL}' AS text FROM events")
def f13_array_literal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = F.array(F.col("event_type"), F.concat("event_type", F.lit(" x")), F.lit(None).cast("string"))
    return e.select("event_id", values.array_literal(F.to_json(parts)).alias("text"))


from . import catalogue_changes, catalogue_values  # noqa: E402, F401  they register their queries here
