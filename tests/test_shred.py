"""Problem 3 against a recursive model."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.operators import shred
from marlstone.plans import queries
from marlstone.session import work_dir

SCHEMA = "abi_id bigint, raw_json string, doc string, node int"


def model(text):
    """(item_no, side, param_path) by plain recursion."""
    try:
        v = json.loads(text)
        while isinstance(v, str):
            v = json.loads(v)
        if isinstance(v, dict):
            v = v["abi"] if "abi" in v else v["output"]["abi"] if "output" in v else [v]
        while isinstance(v, str):
            v = json.loads(v)
    except (TypeError, ValueError, KeyError):
        return []
    out = []

    def params(x, at, no, side):
        for k, p in enumerate([x] if isinstance(x, dict) else x or []):
            if isinstance(p, dict):
                path = f"{at}.{k}" if at else str(k)
                out.append((no, side, path))
                params(p.get("components"), path, no, side)

    for no, item in enumerate([v] if isinstance(v, dict) else v if isinstance(v, list) else []):
        if isinstance(item, dict):
            for side in ("inputs", "outputs"):
                params(item.get(side), "", no, side)
    return out


def found(df):
    return sorted((r.abi_id, r.item_no, r.side, r.param_path) for r in shred.abi_params(shred.abi_nodes(df)).collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_model(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/abi_docs.parquet")
    want = sorted({(r.abi_id, *x) for r in df.collect() for x in model(r.raw_json)})
    assert found(df) == want


def test_edges(spark):
    deep = {"name": "d", "type": "tuple", "components": {"name": "e", "components": [None, {"type": "uint8"}]}}
    rows = [
        (1, json.dumps([None, {"type": "event", "inputs": deep, "outputs": None}])), (2, json.dumps({"abi": json.dumps([{"inputs": [{}, None, {"name": None}]}])})), (3, None), (4, ""), (5, '[{"inputs": ['),
        (6, json.dumps({"type": "function", "inputs": [{"name": "x"}]})), (7, "[]"), (8, json.dumps("[]")), (9, "NaN"), (10, json.dumps([{"inputs": [{"name": "y" * 100_000}] * 500}])),
    ]
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in rows] * 2, SCHEMA)
    assert found(df) == sorted((k, *x) for k, t in rows for x in model(t))
    params = {(r.abi_id, r.item_no, r.param_path): r for r in shred.abi_params(shred.abi_nodes(df)).collect()}
    assert params[1, 1, "0.0.1"].parent_path == "0.0" and params[1, 1, "0.0.1"].type == "uint8" and params[1, 1, "0"].name == "d"
    items = {(r.abi_id, r.item_no): r.type for r in shred.abi_items(shred.abi_nodes(df)).collect()}
    assert items[1, 1] == "event" and items[2, 0] == "function"


@pytest.mark.parametrize("text", ["", "[", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "[]x", "[01]", '["\t"]', "NaN", "nul", ' { "a" : [ 1 , -2.5e3 , "x\\u00e9" , null , true ] , "b" : { } } ', "[]", "{}", '"x"', " 7 ", "[[],[{}]]"])
def test_deep_reader_agrees(text):
    def result(f):
        try:
            return f(text)
        except ValueError:
            return "none"

    assert result(shred._read_deep) == result(lambda t: json.loads(t, parse_constant=shred._not_json))


def test_nesting_of_any_depth(spark):
    """100,000 levels outside of the parameters, and parameters in parameters for 1,500 levels."""
    n = 100_000
    rows = [(1, '[{"x": ' + "[" * n + "]" * n + ', "inputs": [{"name": "p"}]}]'), (2, '[{"inputs": ' + '[{"components": ' * 1500 + "[]" + "}]" * 1500 + "}]"), (3, "[" * n + "]" * n), (4, "[" * n)]
    nodes = shred.abi_nodes(spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA))
    assert {r.doc: r["count"] for r in nodes.groupBy("doc").count().collect()} == {1: n + 5, 2: 3002 + 1, 3: n}
    assert {r.doc: r["count"] for r in shred.abi_params(nodes).groupBy(F.col("abi_id").alias("doc")).count().collect()} == {1: 1, 2: 1500}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and shred.abi_items(shred.abi_nodes(empty)).count() == 0


def test_found_does_the_whole_pivot(spark, tmp_path):
    """p3_found makes the parameter table with all fields and gives its keys, whatever the fields hold."""
    inputs = [{"name": "a", "type": "tuple", "internalType": "struct S", "indexed": True, "components": [{"name": "b", "type": "uint8"}]}, {"name": "c", "indexed": "neither"}, {}]
    rows = [(1, json.dumps([{"type": "event", "name": "e", "inputs": inputs}]), "clash", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/abi_docs.parquet")
    shared = Path(work_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    got = queries.p3_found(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted((1, *x) for x in model(rows[0][1]))
    (made,) = set(shared.iterdir()) - before
    assert {tuple(r) for r in spark.read.parquet(str(made)).select("param_path", "parent_path", "name", "type", "internal_type", "indexed").collect()} == {
        ("0", None, "a", "tuple", "struct S", True), ("0.0", "0", "b", "uint8", None, None), ("1", None, "c", None, None, None), ("2", None, None, None, None, None),
    }
