"""The registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators import shred
from marlstone.plans import finding_queries, source_queries
from marlstone.session import cut
from marlstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the parameter table. The table is written whole first: of a mere selection of its keys the optimiser would
    drop the pivot's values."""
    return cut(p3_params(spark, d)).select("abi_id", "item_no", "side", "param_path")


def p3_params(spark: SparkSession, d: str) -> DataFrame:
    return shred.abi_params(shred.abi_nodes(table(spark, d, "abi_docs")))


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    return shred.abi_items(shred.abi_nodes(table(spark, d, "abi_docs")))


_PARAMS = """WITH RECURSIVE J0 AS (SELECT DISTINCT ON (abi_id) abi_id, CASE WHEN json_valid(raw_json) THEN raw_json::JSON END AS j FROM abi_docs),
J1 AS (SELECT abi_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(j, '$')) THEN json_extract_string(j, '$')::JSON END ELSE j END AS j FROM J0 WHERE j IS NOT NULL),
J2 AS (SELECT abi_id, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(json_extract(j, '$.abi'), json_extract(j, '$.output.abi'), j) ELSE j END AS j FROM J1 WHERE j IS NOT NULL),
J3 AS (SELECT abi_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(j, '$')) THEN json_extract_string(j, '$')::JSON END ELSE j END AS j FROM J2),
J AS (SELECT abi_id, CASE WHEN json_type(j) = 'OBJECT' THEN json_array(j) ELSE j END AS j FROM J3 WHERE json_type(j) IN ('OBJECT', 'ARRAY')),
I AS (SELECT abi_id, k AS item_no, json_extract(j, '$[' || k || ']') AS item FROM (SELECT abi_id, j, unnest(generate_series(0, json_array_length(j)::BIGINT - 1)) AS k FROM J)),
S AS (SELECT abi_id, item_no, side, json_extract(item, '$.' || side) AS l FROM I, (VALUES ('inputs'), ('outputs')) AS x(side) WHERE json_type(item) = 'OBJECT'),
N(abi_id, item_no, side, up, l) AS (SELECT abi_id, item_no, side, '', CASE WHEN json_type(l) = 'OBJECT' THEN json_array(l) ELSE l END FROM S WHERE json_type(l) IN ('OBJECT', 'ARRAY')
UNION ALL SELECT abi_id, item_no, side, up || k || '.', CASE WHEN json_type(c) = 'OBJECT' THEN json_array(c) ELSE c END FROM (SELECT abi_id, item_no, side, up, k, json_extract(l, '$[' || k || '].components') AS c FROM (SELECT *, unnest(generate_series(0, json_array_length(l)::BIGINT - 1)) AS k FROM N)) WHERE json_type(c) IN ('OBJECT', 'ARRAY')),
P AS (SELECT abi_id, CAST(item_no AS INTEGER) AS item_no, side, up || k AS param_path, nullif(rtrim(up, '.'), '') AS parent_path, json_extract(l, '$[' || k || ']') AS p FROM (SELECT *, unnest(generate_series(0, json_array_length(l)::BIGINT - 1)) AS k FROM N)) """

QUERIES: dict[str, Query] = {"p3_found": p3_found, "p3_params": p3_params, "p3_items": p3_items} | finding_queries.QUERIES | source_queries.QUERIES
SQL: dict[str, str] = {
    "p3_found": _PARAMS + "SELECT abi_id, item_no, side, param_path FROM P WHERE json_type(p) = 'OBJECT'",
    "p3_params": _PARAMS + """SELECT abi_id, item_no, side, param_path, parent_path, CAST(len(string_split(param_path, '.')) AS INTEGER) AS depth, json_extract_string(p, '$.name') AS name, json_extract_string(p, '$.type') AS type,
json_extract_string(p, '$.internalType') AS internal_type, CAST(json_extract_string(p, '$.indexed') AS BOOLEAN) AS indexed FROM P WHERE json_type(p) = 'OBJECT'""",
    "p3_items": _PARAMS + """SELECT abi_id, CAST(item_no AS INTEGER) AS item_no, coalesce(json_extract_string(item, '$.type'), 'function') AS type, json_extract_string(item, '$.name') AS name, json_extract_string(item, '$.stateMutability') AS state_mutability,
CAST(json_extract_string(item, '$.anonymous') AS BOOLEAN) AS anonymous FROM I WHERE json_type(item) = 'OBJECT'""",
} | finding_queries.SQL | source_queries.SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Rule hits by category and rule."""
    return finding_queries.QUERIES["agg_category"](spark, d)
