"""Queries of identity, references, order, constraints and guarded application."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apply as run
from ..operators import audit, constraints, diff, lints, ordering, references
from .catalogue import _found, part_changes, query, table
from .config import from_dict
from .derived import cte, state
from .project import Project

CUSTOMER = ["c_name"]
RENAMED = """SELECT COALESCE(b.c_name, h.c_name) AS c_name, CASE WHEN b.c_custkey IS NULL THEN 'insert' WHEN h.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS kind,
CASE WHEN b.c_name <> h.c_name THEN h.c_name END AS new_name, b.c_name <> h.c_name AS renamed FROM base_customer b FULL OUTER JOIN head_customer h ON b.c_custkey = h.c_custkey
WHERE b.c_custkey IS NULL OR h.c_custkey IS NULL OR b.c_name IS DISTINCT FROM h.c_name OR b.c_nationkey IS DISTINCT FROM h.c_nationkey OR b.c_mktsegment IS DISTINCT FROM h.c_mktsegment"""


def _renamed(spark, sf_dir, policy: str):
    columns = ["c_nationkey", "c_mktsegment"]
    return diff.renamed_diff(state(spark, sf_dir, "base_customer"), state(spark, sf_dir, "head_customer"), CUSTOMER, "c_custkey", columns, policy=policy)


@query(cte("base_customer", "head_customer") + f"SELECT c_name, kind, CASE WHEN kind = 'update' THEN new_name END AS new_name FROM ({RENAMED})")
def d03_rename_change(spark, sf_dir):
    changes, _ = _renamed(spark, sf_dir, "update")
    return changes.select("c_name", "kind", F.when(F.col("kind") == "update", F.try_element_at("new", F.lit("c_name"))).alias("new_name"))


@query(cte("base_customer", "head_customer") + f"SELECT c_name, kind FROM ({RENAMED}) WHERE renamed IS DISTINCT FROM true")
def d04_identity_refused(spark, sf_dir):
    """Where renames are refused, neither key of a renamed row changes."""
    return _renamed(spark, sf_dir, "refuse")[0].select("c_name", "kind")


def _order_refs(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey").join(named, F.col("o_custkey") == F.col("c_custkey")).select("seq", F.lit("customer").alias("model"), "name")


@query(cte("named_base", "named_head") + "SELECT o_orderkey AS seq FROM orders JOIN named_base b ON o_custkey = b.c_custkey JOIN named_head h ON h.c_custkey = b.c_custkey WHERE b.c_name <> h.c_name")
def d10_refused_by_rename(spark, sf_dir):
    refused = diff.renamed_diff(state(spark, sf_dir, "named_base"), state(spark, sf_dir, "named_head"), CUSTOMER, "c_custkey", [])[1]
    refs = _order_refs(spark, sf_dir)
    return references.refused_by(refs.select("seq").distinct(), refs, refused.select(F.lit("customer").alias("model"), F.col("old_c_name").alias("name")))


@query(cte("named_base", "named_head") + "SELECT o_orderkey AS seq FROM orders JOIN named_base b ON o_custkey = b.c_custkey JOIN named_head h ON h.c_custkey = b.c_custkey WHERE b.c_name <> h.c_name")
def d11_refused_by_kept_ref(spark, sf_dir):
    """Orders that name a customer as the files do, where the base keeps another name."""
    kept = references.kept_names(state(spark, sf_dir, "named_base"), state(spark, sf_dir, "named_head"), ["c_custkey"], "c_name")
    named = state(spark, sf_dir, "named_head").select("c_custkey", F.col("c_name").alias("name"))
    refs = table(spark, sf_dir, "orders").join(named, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("seq"), F.lit("customer").alias("model"), "name")
    return references.refused_by(refs.select("seq"), refs, kept.select(F.lit("customer").alias("model"), "name"))


@query("SELECT 'customer' AS model, CAST(o_custkey AS VARCHAR) AS name, 'o_custkey' AS \"column\", o_orderkey FROM orders WHERE o_custkey IS NOT NULL")
def j20_reference_index(spark, sf_dir):
    return references.index_of(table(spark, sf_dir, "orders"), ["o_orderkey"], {"o_custkey": "customer"})


@query(cte("named_base", "named_head") + "SELECT o_orderkey, h.c_name AS owner, h.c_name AS payer FROM orders JOIN named_base b ON o_custkey = b.c_custkey JOIN named_head h ON h.c_custkey = b.c_custkey")
def j21_rewrite_cascade(spark, sf_dir):
    """A rename runs through accounts named after customers and on to the orders that name the accounts."""
    base, head = state(spark, sf_dir, "named_base"), state(spark, sf_dir, "named_head")
    moves = references.moved(base, head, ["c_custkey"], "c_name").select("from", "to")
    orders = table(spark, sf_dir, "orders").join(base, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("owner"), F.col("c_name").alias("payer"))
    models = {"customer": base, "account": base.select(F.col("c_name").alias("holder")), "orders": orders}
    refs = {"account": {"holder": "customer"}, "orders": {"owner": "customer", "payer": "account"}}
    return references.cascaded_names(models, ["customer", "account", "orders"], refs, {"account": "holder"}, {"customer": moves})[0]["orders"]


@query("SELECT o_orderkey AS seq, 'customer' AS model, CAST(o_custkey AS VARCHAR) AS name FROM orders WHERE o_custkey % 13 = 0 AND NOT (o_custkey % 26 = 0 AND o_custkey < o_orderkey)")
def r26_missing_refs(spark, sf_dir):
    named = lambda at, seq: table(spark, sf_dir, "customer").where(at).select(*seq, F.lit("customer").alias("model"), F.col("c_custkey").cast("string").alias("name"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("customer").alias("model"), F.col("o_custkey").cast("string").alias("name"))
    return references.missing_refs(refs, named("c_custkey % 13 <> 0", []), named("c_custkey % 26 = 0", [F.col("c_custkey").alias("seq")]))


@query("SELECT o_orderkey AS seq, 'customer' AS model, CAST(o_custkey AS VARCHAR) AS name, o_custkey AS by FROM orders WHERE o_custkey % 13 = 0 AND o_custkey < o_orderkey")
def r27_set_removes_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("customer").alias("model"), F.col("o_custkey").cast("string").alias("name"))
    lost = table(spark, sf_dir, "customer").where("c_custkey % 13 = 0").select(F.col("c_custkey").alias("seq"), F.lit("customer").alias("model"), F.col("c_custkey").cast("string").alias("name"))
    return references.removed_refs(refs, lost)


@query("SELECT o_custkey AS id, count(*) AS pointing FROM orders WHERE o_custkey % 13 = 0 AND o_orderstatus <> 'F' GROUP BY 1")
def r25_still_pointing(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 13 = 0")
    return references.still_pointing(gone, table(spark, sf_dir, "orders"), "o_custkey", "c_custkey", "o_orderstatus <> 'F'")


@query(cte("named_base", "named_head", "named_live") + "SELECT b.c_name, CASE WHEN l.c_custkey IS NULL THEN 'missing' WHEN l.c_name = h.c_name THEN 'benign' ELSE '' END AS problem FROM named_base b JOIN named_head h ON b.c_custkey = h.c_custkey LEFT JOIN named_live l ON l.c_custkey = b.c_custkey WHERE b.c_name <> h.c_name")
def r13_diagnose_moved(spark, sf_dir):
    changes, _ = diff.renamed_diff(state(spark, sf_dir, "named_base"), state(spark, sf_dir, "named_head"), CUSTOMER, "c_custkey", ["c_custkey"], insert_only=("c_custkey",), policy="update")
    return run.diagnose(changes, state(spark, sf_dir, "named_live"), CUSTOMER, id_col="c_custkey").select("c_name", "problem")


@query(cte("drifted") + "SELECT c.c_name, CASE WHEN d.c_name IS NULL THEN '' WHEN d.c_mktsegment <> c.c_mktsegment THEN 'changed' WHEN d.c_custkey <> c.c_custkey THEN 'id_drift' ELSE 'benign' END AS problem FROM customer c LEFT JOIN drifted d ON c.c_name = d.c_name")
def r14_diagnose_insert(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = diff.state_diff(wanted.limit(0), wanted, CUSTOMER)
    return run.diagnose(changes, state(spark, sf_dir, "drifted"), CUSTOMER, id_col="c_custkey").select("c_name", "problem")


@query(cte("soft") + "SELECT id, CASE WHEN deleted IS NULL AND id % 6 = 2 THEN 'NEW' ELSE segment END AS segment, CASE WHEN deleted IS NULL AND id % 6 = 0 THEN 77 ELSE deleted END AS deleted FROM soft")
def r19_scoped_soft_delete(spark, sf_dir):
    """Deletes set a time, updates see live rows alone, deleted rows stay as they are."""
    soft = state(spark, sf_dir, "soft")
    live = soft.where("deleted is null").select("id", "segment")
    head = live.where("id % 6 <> 0").withColumn("segment", F.when(F.col("id") % 6 == 2, "NEW").otherwise(F.col("segment")))
    return run.apply_scoped(soft, diff.state_diff(live, head, ["id"]), ["id"], F.lit(77).cast("long"), soft_delete="deleted")[0]


@query(cte("soft") + "SELECT id, segment, CASE WHEN id % 2 = 1 THEN NULL ELSE deleted END AS deleted FROM soft")
def r22_restored_rows(spark, sf_dir):
    """Inserts of rows that were deleted before bring them back."""
    soft = state(spark, sf_dir, "soft")
    wanted = soft.where("deleted is not null and id % 2 = 1").select("id", "segment")
    return run.apply_scoped(soft, diff.state_diff(wanted.limit(0), wanted, ["id"]), ["id"], F.lit(77).cast("long"), soft_delete="deleted")[0]


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'outside' ELSE '' END AS problem FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 10 < 6")
def r09_written_outside(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    live = rows.where("c_mktsegment <> 'BUILDING'")
    moved = F.when(F.col("c_custkey") % 5 == 0, "BUILDING").otherwise(F.col("c_mktsegment"))
    head = live.withColumns({"c_mktsegment": moved, "c_name": F.when(F.col("c_custkey") % 10 < 6, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))}).where("c_custkey % 10 < 6")
    changes = diff.state_diff(live, head, ["c_custkey"], mode="upsert")
    return run.apply_scoped(rows, changes, ["c_custkey"], F.lit(0), where="c_mktsegment <> 'BUILDING'")[1].select("c_custkey", "problem")


@query("SELECT s_suppkey AS seq FROM supplier WHERE s_suppkey >= (SELECT min(s_suppkey) + 3 FROM supplier)")
def d_refused_chain(spark, sf_dir):
    """A refusal runs down a chain of changes as long as the table."""
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    first = keys.agg(F.min("s_suppkey")).first()[0] + 3
    edges = keys.where(F.col("s_suppkey") > first - 3).select((F.col("s_suppkey") - 1).alias("from_seq"), F.col("s_suppkey").alias("to_seq"))
    return ordering.refused_with(edges, keys.where(F.col("s_suppkey") == first).select(F.col("s_suppkey").alias("seq")))


@query(cte("swapped") + "SELECT seq FROM swapped WHERE seq % 20 < 10 AND EXISTS (SELECT 1 FROM swapped o WHERE o.frees = swapped.takes)")
def o06_circles(spark, sf_dir):
    return ordering.circles(ordering.unique_edges(state(spark, sf_dir, "swapped"), "seq", "frees", "takes"))


@query("SELECT o_orderkey AS to_seq, o_custkey + 1000000000 AS from_seq FROM orders WHERE o_custkey IS NOT NULL UNION SELECT o_orderkey, o_custkey FROM orders WHERE false")
def o06_reference_edges(spark, sf_dir):
    """Orders that write a customer's name come after the change that makes the customer."""
    c = table(spark, sf_dir, "customer")
    changes = c.select((F.col("c_custkey") + 1000000000).alias("seq"), F.lit("customer").alias("model"), F.col("c_name").alias("makes"), F.lit(None).cast("string").alias("loses"))
    return ordering.reference_edges(changes, _order_refs(spark, sf_dir).withColumn("side", F.lit("new"))).select("to_seq", "from_seq")


@query(cte("head_part") + "SELECT p_partkey, CASE WHEN p_size IS NOT NULL THEN '[\"' || p_brand || '\",\"' || CAST(p_size AS VARCHAR) || '\"]' END AS tuple FROM head_part")
def o07_unique_tuple(spark, sf_dir):
    part = state(spark, sf_dir, "head_part")
    held = F.create_map(F.lit("p_brand"), F.col("p_brand"), F.lit("p_size"), F.col("p_size").cast("string"))
    return part.select("p_partkey", ordering.unique_tuple(held, ["p_brand", "p_size"])["tuple"].alias("tuple"))


@query("SELECT o_orderkey AS old_seq, (SELECT max(o_orderkey) FROM orders) - o_orderkey AS seq FROM orders")
def o13_backwards(spark, sf_dir):
    return ordering.backwards(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("old_seq"))).select("old_seq", "seq")


@query(
    """WITH v AS (SELECT 'check size' AS "constraint", CAST(1 AS BIGINT) AS n FROM part WHERE p_size <= 10
UNION ALL SELECT 'not null p_brand', 1 FROM part WHERE p_partkey % 9 = 0
UNION ALL SELECT 'unique p_name', count(*) FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'reference p_partkey', 1 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem))
SELECT "constraint", count(*) AS rows, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY 1"""
)
def r29_constraints(spark, sf_dir):
    """Every declared constraint on a whole state."""
    part = table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")))
    declared = constraints.declared("part", part, {"not_null": ["p_brand"], "checks": {"size": "p_size > 10"}, "unique": [{"columns": ["p_name"]}], "references": [{"column": "p_partkey", "table": "lineitem", "target": "l_partkey"}]})
    found = constraints.violations(declared, part, ["p_partkey"], {"lineitem": table(spark, sf_dir, "lineitem").select("l_partkey").distinct()})
    return found.groupBy("constraint").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


@query(cte("base_part", "head_part") + "SELECT model, n FROM (SELECT 'part' AS model, count(*) AS n FROM base_part b FULL OUTER JOIN head_part h ON b.p_partkey = h.p_partkey WHERE b.p_partkey IS NULL OR h.p_partkey IS NULL OR b.p_size IS DISTINCT FROM h.p_size) UNION ALL SELECT 'brand', 0")
def d15_tables_touched(spark, sf_dir):
    changes = part_changes(spark, sf_dir).withColumn("model", F.lit("part"))
    named = diff.touched(changes, {"part": {"p_brand": "brand"}, "order": {"part": "part"}})
    return named.join(changes.groupBy("model").agg(F.count("*").alias("n")), "model", "left").select("model", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'update' AS model, 'p_size' AS columns UNION ALL SELECT 'insert', 'p_brand,p_name,p_size,price' UNION ALL SELECT 'delete', 'p_brand,p_name,p_size,price'")
def a22_written_columns(spark, sf_dir):
    return diff.written_columns(part_changes(spark, sf_dir).withColumn("model", F.col("kind")))


@query(cte("texts", "numerals") + "SELECT 'session_dependent' AS model, said AS \"column\", count(*) AS n FROM texts WHERE said IN ('now', '01/02/2024', '2024-01-02 03:04:05') GROUP BY 2")
def a21_undecided_groups(spark, sf_dir):
    return diff.undecided_groups(_found(spark, sf_dir).where("kind = 'session_dependent'").select(F.col("kind").alias("model"), F.col("detail").alias("column")))


@query(cte("texts") + "SELECT 'session_dependent' AS kind, 'policy session_dependent: warn lets ' || CAST(count(*) AS VARCHAR) || ' through' AS advice FROM texts WHERE said IN ('now', '01/02/2024', '2024-01-02 03:04:05')")
def h36_warn_advice(spark, sf_dir):
    return lints.advice_to_warn(_found(spark, sf_dir), ("session_dependent",))


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 14 = 0 THEN 'applied' END ELSE 'applied' END AS status FROM orders")
def j18_outcome_of(spark, sf_dir):
    """Outcomes found by place, or by model, key and kind where a set was renumbered; twins stay without one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"))
    key = F.when(F.col("seq") % 14 == 7, F.lit("twin")).otherwise(F.col("seq").cast("string"))
    changes = o.select("seq", F.lit("m").alias("model"), key.alias("key"), F.lit("update").alias("kind"))
    log = changes.select(F.when(F.col("seq") % 7 == 0, F.col("seq") + 1000000000).otherwise(F.col("seq")).alias("index"), "model", "key", "kind", F.lit("applied").alias("status"), F.lit("").alias("problem"))
    return audit.outcome_of(log, changes).select("seq", "status")


@query(cte("audit_log") + "SELECT DISTINCT set_name, id % 100 AS index FROM audit_log a WHERE direction = 'up' AND id > (SELECT COALESCE(max(id), -1) FROM audit_log d WHERE d.set_name = a.set_name AND d.direction = 'down')")
def r36_to_revert(spark, sf_dir):
    outcome = F.struct((F.col("id") % 100).cast("int").alias("index"), F.lit("m").alias("model"), F.lit("k").alias("key"), F.lit("update").alias("kind"), F.lit("applied").alias("status"), F.lit("").alias("problem"))
    log = state(spark, sf_dir, "audit_log").withColumn("outcomes", F.array(outcome))
    return audit.to_revert(log).select("set_name", F.col("index").cast("long").alias("index"))


@query(cte("audit_log") + "SELECT id, 'applied' AS status, CAST(1 + id % 3 AS BIGINT) AS n FROM audit_log UNION ALL SELECT id, 'unchanged', 2 FROM audit_log")
def a19_outcomes_by_status(spark, sf_dir):
    one = lambda status: F.struct(F.lit(0).alias("index"), F.lit(status).alias("status"))
    log = state(spark, sf_dir, "audit_log").withColumn("outcomes", F.concat(F.array_repeat(one("applied"), (F.col("id") % 3 + 1).cast("int")), F.array_repeat(one("unchanged"), 2)))
    return audit.by_status(log)


@query(cte("directory", "applied") + "SELECT name FROM applied WHERE name NOT IN (SELECT name FROM directory)")
def d24_covered_gone(spark, sf_dir):
    return audit.covered_gone(state(spark, sf_dir, "directory"), state(spark, sf_dir, "applied"))


@query(cte("mixed_part") + "SELECT 'equal_key' AS kind, lower(p_name) AS \"row\", string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS detail, false AS unsure FROM mixed_part GROUP BY 2 HAVING count(DISTINCT p_name) > 1")
def a06_equal_key_findings(spark, sf_dir):
    return lints.equal_key_findings(state(spark, sf_dir, "mixed_part"), "p_name", F.lower("p_name"))


PROJECT = {
    "models": {
        "customer": {"key": ["c_name"], "id": "c_custkey", "policy": {"renames": "update"}},
        "orders": {"key": ["o_orderkey"], "id": "o_orderkey", "refs": {"o_custkey": "customer"}},
    }
}


def _project(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    files = customer.where("c_custkey % 50 <> 7").select("c_custkey", F.when(F.col("c_custkey") % 41 == 0, F.concat("c_name", F.lit("_r"))).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 10 == 3, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    kept = orders.where("o_custkey % 50 <> 7").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "Z").otherwise(F.col("o_orderstatus")))
    texts = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return Project(spark, from_dict(PROJECT), "."), {"customer": customer, "orders": orders}, {"customer": texts(files), "orders": texts(kept)}


@query("SELECT 'customer' AS model, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 41 = 0 THEN c_name || '_r' ELSE c_name END AS a, CASE WHEN c_custkey % 10 = 3 THEN 'NEW' ELSE c_mktsegment END AS b FROM customer WHERE c_custkey % 50 <> 7 UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 9 = 0 THEN 'Z' ELSE o_orderstatus END FROM orders WHERE o_custkey % 50 <> 7")
def c06_sync(spark, sf_dir):
    """The whole way: check, order, guarded application of two models with renames and a reference."""
    project, database, files = _project(spark, sf_dir)
    states, _ = project.sync(database, files)
    c = states["customer"].select(F.lit("customer").alias("model"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    return c.unionByName(states["orders"].select(F.lit("orders").alias("model"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("a"), F.col("o_orderstatus").alias("b")))


@query("SELECT 'customer' AS model, CASE WHEN c_custkey % 50 = 7 THEN 'delete' ELSE 'update' END AS kind, count(*) AS n FROM customer WHERE c_custkey % 50 = 7 OR c_custkey % 41 = 0 OR c_custkey % 10 = 3 GROUP BY 2 UNION ALL SELECT 'orders', CASE WHEN o_custkey % 50 = 7 THEN 'delete' ELSE 'update' END, count(*) FROM orders WHERE o_custkey % 50 = 7 OR (o_orderkey % 9 = 0 AND o_orderstatus <> 'Z') GROUP BY 2")
def c01_check(spark, sf_dir):
    """Drift of the database against the files, by model and kind."""
    project, database, files = _project(spark, sf_dir)
    report = project.check(database, files)
    parts = [c.select(F.lit(m).alias("model"), "kind") for m, c in report.changes.items()]
    return parts[0].unionByName(parts[1]).groupBy("model", "kind").agg(F.count("*").alias("n"))


@query(cte("base_customer") + "SELECT 'dangling_reference' AS kind, 'orders' AS model, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM base_customer)")
def d16_check_findings(spark, sf_dir):
    """All findings of a check whose files leave customers out."""
    project, database, files = _project(spark, sf_dir)
    held = state(spark, sf_dir, "base_customer").select("c_custkey", "c_name", "c_mktsegment")
    texts = held.select(*[F.col(c).cast("string").alias(c) for c in held.columns])
    orders = database["orders"].select(*[F.col(c).cast("string").alias(c) for c in database["orders"].columns])
    report = project.check({"customer": held, "orders": database["orders"]}, {"customer": texts, "orders": orders})
    return report.findings.groupBy("kind", "model").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS name, max(c_custkey) + 1 AS next FROM customer UNION ALL SELECT 'orders', greatest(max(o_orderkey) + 1, 2000000000) FROM orders")
def a23_sequences(spark, sf_dir):
    return run.sequences({"customer": (table(spark, sf_dir, "customer"), "c_custkey"), "orders": (table(spark, sf_dir, "orders"), "o_orderkey")}, {"orders": 2_000_000_000, "customer": 5})


@query("WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 1 ELSE c_custkey END AS badge FROM customer) SELECT c_custkey, 'changed' AS problem FROM w WHERE c_custkey % 10 = 3 AND EXISTS (SELECT 1 FROM w o WHERE o.badge = w.badge AND o.c_custkey <> w.c_custkey)")
def r24_unique_conflicts(spark, sf_dir):
    """Updates that take a unique value which another row keeps."""
    live = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("badge"))
    head = live.withColumn("badge", F.when(F.col("c_custkey") % 10 == 3, F.col("badge") + 1).otherwise(F.col("badge")))
    _, outcomes = run.apply_changes(live, diff.state_diff(live, head, ["c_custkey"]), ["c_custkey"])
    return run.unique_conflicts(live, outcomes, ["c_custkey"], ["badge"])
