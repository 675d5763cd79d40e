"""Two states of a table, derived from the driver's tables by SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: {name} stands for a table.
STATES = {
    "base_part": "SELECT p_partkey, p_name, p_brand, p_size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS price FROM {part} WHERE p_partkey % 13 <> 0",
    "head_part": "SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 10 = 3 THEN p_size + 1 WHEN p_partkey % 29 = 0 THEN NULL ELSE p_size END AS p_size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS price FROM {part} WHERE p_partkey % 17 <> 0",
    "live_part": "SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 10 = 3 AND p_partkey % 4 = 0 THEN p_size + 1 WHEN p_partkey % 23 = 0 THEN p_size + 7 ELSE p_size END AS p_size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS price FROM {part} WHERE p_partkey % 13 <> 0 AND p_partkey % 19 <> 0",
    "base_orders": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM {orders} WHERE o_orderkey % 13 <> 0",
    "head_orders": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate FROM {orders} WHERE o_orderkey % 17 <> 0",
    "base_customer": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer} WHERE c_custkey % 13 <> 0",
    "head_customer": "SELECT c_custkey, CASE WHEN c_custkey % 41 = 0 THEN CONCAT(c_name, '_r') ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 3 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM {customer} WHERE c_custkey % 17 <> 0",
    "base_turns": "SELECT conv_id, turn, role, text FROM {conversations} WHERE (conv_id + turn) % 13 <> 0",
    "head_turns": "SELECT conv_id, turn, CASE WHEN conv_id % 10 = 3 THEN 'other' ELSE role END AS role, text FROM {conversations} WHERE (conv_id + turn) % 17 <> 0",
    "base_supplier": "SELECT s_suppkey, s_name FROM {supplier}",
    "head_supplier": "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN UPPER(s_name) WHEN s_suppkey % 11 = 0 THEN CONCAT(s_name, '_r') ELSE s_name END AS s_name FROM {supplier}",
    "moved_supplier": "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 1 THEN CONCAT('Supplier#', LPAD(CAST(s_suppkey + 1 AS STRING), 9, '0')) ELSE s_name END AS s_name FROM {supplier}",
    "base_nation": "SELECT n_nationkey, n_name, n_regionkey FROM {nation}",
    "head_nation": "SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 100 ELSE n_nationkey END AS n_nationkey, n_name, n_regionkey FROM {nation}",
    "renamed_nation": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN CONCAT(n_name, '_r') ELSE n_name END AS n_name FROM {nation}",
    "customer_history": "SELECT c_custkey AS id, CONCAT('k', CAST(CAST(FLOOR(c_custkey / 7) AS BIGINT) AS STRING)) AS code, c_mktsegment AS segment, CASE WHEN c_custkey % 11 <> 1 THEN CAST(FLOOR(c_custkey / 2) AS BIGINT) END AS deleted FROM {customer}",
    "customer_wanted": "SELECT c_custkey * 7 AS id, CONCAT('k', CAST(c_custkey AS STRING)) AS code, c_mktsegment AS segment FROM {customer}",
    "swapped": "SELECT c_custkey AS seq, c_custkey AS frees, CASE WHEN c_custkey % 20 < 10 THEN c_custkey + 1 - 2 * (c_custkey % 2) ELSE c_custkey + 10000000 END AS takes FROM {customer}",
    "tree": "SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN NULL ELSE CAST(FLOOR(c_custkey / 2) AS BIGINT) END AS parent FROM {customer}",
    "audit_log": "SELECT event_id AS id, event_type AS set_name, CASE WHEN event_id % 37 = 0 THEN 'down' ELSE 'up' END AS direction, user_id AS by_user FROM {events}",
    "directory": "SELECT CONCAT('m', LPAD(CAST(c_custkey AS STRING), 9, '0')) AS name FROM {customer} WHERE c_custkey % 3 <> 0",
    "applied": "SELECT CONCAT('m', LPAD(CAST(c_custkey AS STRING), 9, '0')) AS name FROM {customer} WHERE c_custkey % 5 <> 0 AND c_custkey * 3 < (SELECT MAX(c_custkey) FROM {customer}) * 2",
    "mixed_part": "SELECT p_partkey, CASE WHEN p_partkey % 43 = 0 THEN UPPER(p_name) ELSE p_name END AS p_name, p_brand, p_size FROM {part}",
    "texts": "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'now' WHEN event_id % 7 = 1 THEN '01/02/2024' WHEN event_id % 7 = 2 THEN '2024-01-02 03:04:05' WHEN event_id % 7 = 3 THEN '2024-01-02T03:04:05Z' WHEN event_id % 7 = 4 THEN '2024-01-02' WHEN event_id % 7 = 5 THEN '2024-01-02 03:04:05+02' END AS said FROM {events}",
    "numerals": "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN CAST(9007199254740990 + event_id AS STRING) WHEN event_id % 5 = 1 THEN CONCAT('00', CAST(event_id AS STRING), '.50') WHEN event_id % 5 = 2 THEN CONCAT('-', CAST(event_id AS STRING), '.') WHEN event_id % 5 = 3 THEN CONCAT('x', CAST(event_id AS STRING)) ELSE '-0.00' END AS said FROM {events}",
    "uuids": "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN CONCAT('{{', UPPER(LPAD(CAST(event_id AS STRING), 32, 'AB')), '}}') WHEN event_id % 3 = 1 THEN LPAD(CAST(event_id AS STRING), 32, 'c') ELSE CAST(event_id AS STRING) END AS said FROM {events}",
    "keyed_events": "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS a, CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END AS b FROM {events}",
    "doubles": "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(CONCAT(CAST(event_id AS STRING), 'e-9') AS DOUBLE) ELSE CAST(CONCAT(CAST(event_id AS STRING), 'e20') AS DOUBLE) END AS d FROM {events}",
    "spans": "SELECT event_id AS id, event_id % 40 AS d, event_id % 30 AS h, event_id % 5 AS y, event_id % 14 AS m FROM {events}",
    "moments": "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN day WHEN 1 THEN CONCAT(day, ' 03:04:05') WHEN 2 THEN CONCAT(day, 'T03:04:05Z') WHEN 3 THEN CONCAT(day, ' 03:04:05.500+02') WHEN 4 THEN CONCAT(day, 'T03:04:05-01:30') ELSE 'now' END AS said, day FROM (SELECT event_id, CONCAT('2024-01-', LPAD(CAST(1 + event_id % 28 AS STRING), 2, '0')) AS day FROM {events}) x",
    "typed_base": "SELECT event_id, event_type, ts, CAST(user_id AS DOUBLE) / 8 AS d, user_id FROM {events} WHERE event_id % 13 <> 0",
    "typed_head": "SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL '1' SECOND ELSE ts END AS ts, CASE WHEN event_id % 7 = 0 THEN CAST(user_id AS DOUBLE) / 8 + 0.000000001 ELSE CAST(user_id AS DOUBLE) / 8 END AS d, user_id FROM {events} WHERE event_id % 17 <> 0",
    "named_base": "SELECT c_custkey, c_name FROM {customer}",
    "named_head": "SELECT c_custkey, CASE WHEN c_custkey % 41 = 0 THEN CONCAT(c_name, '_r') ELSE c_name END AS c_name FROM {customer}",
    "named_live": "SELECT c_custkey, CASE WHEN c_custkey % 82 = 0 THEN CONCAT(c_name, '_r') ELSE c_name END AS c_name FROM {customer} WHERE c_custkey % 123 <> 0",
    "drifted": "SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM {customer} WHERE c_custkey % 3 <> 0",
    "shared_ids": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_id + 1 ELSE event_id END AS id FROM {events}",
    "named_part": "SELECT p_partkey, CONCAT(p_name, '#', CAST(p_partkey % 500 AS STRING)) AS name FROM {part}",
    "soft": "SELECT c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_custkey % 4 = 1 THEN CAST(1 AS BIGINT) END AS deleted FROM {customer}",
}


def state(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = STATES[name]
    used = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def cte(*names: str) -> str:
    """WITH name AS (...), ... for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'(?<!{){(\w+)}(?!})', r'\1', STATES[n]).replace('{{', '{').replace('}}', '}')})" for n in names) + " "
