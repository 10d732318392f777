"""Queries over whole inputs, against models in Python."""

from __future__ import annotations

import re

import pyarrow.parquet as pq

from pyspark.sql import functions as F

from marlstone.operators import graph, structure
from marlstone.operators.lines import split_lines
from marlstone.operators.rules import NEUTRAL
from marlstone.plans import queries as core


def test_fingerprint_of_every_hit(spark, tmp_path):
    texts = ["fee 1.5% für v1.2.3\nжук.call{value: 1}\n\nrequire(x) // é", "plain.call{\nrevert(1.25 ether)"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for doc, text in enumerate(texts):
        hits = [(n, line_no, line) for n, r in enumerate(NEUTRAL) for line_no, line in enumerate(text.split("\n"), 1) if re.search(r.pattern, line)]
        for seq, (n, line_no, line) in enumerate(hits, 1):
            h = 0
            for b in line.encode():
                h = (h * 31 + b) % 2**64
            want.add((doc, seq, f"{NEUTRAL[n].category}:{NEUTRAL[n].rule_id}:{line_no}:{h:016x}"))
    assert len(want) == 7
    assert {tuple(r) for r in core.QUERIES["fingerprint"](spark, str(tmp_path)).collect()} == want


def test_multi_count_of_all_rules(spark, data):
    contents = {r["file_id"]: r["content"] for r in pq.read_table(f"{data}/source_files.parquet", columns=["file_id", "content"]).to_pylist() if r["content"] is not None}
    got = {r.file_id: tuple(r)[1:] for r in core.QUERIES["multi_count"](spark, data).collect()}
    assert got == {k: tuple(len(re.findall(r.pattern, c)) for r in NEUTRAL) for k, c in contents.items()}


def test_lines_of_a_long_text(spark):
    n = 110_000
    text = F.concat(F.repeat(F.concat(F.repeat(F.lit("x"), 99), F.lit("\n")), n), F.lit("end"))
    got = split_lines(spark.range(1).select("id", text.alias("t")), "id", "t").agg(F.count(F.lit(1)), F.max("line_no"), F.sum(F.length("line"))).first()
    assert tuple(got) == (n + 1, n + 1, 99 * n + 3)


def test_every_base_of_every_declaration(spark):
    text = "contract A is B, lib.C(1, f(2)), /* x, y */ D {\n}\ninterface E is A,\n  F {}\nabstract contract G {}\ncontract H\n is G {}"
    rows = structure.declaration_rows(spark.createDataFrame([(1, text), (2, None)], "k int, content string"), "k", "content")
    assert {tuple(r) for r in structure.base_edges(rows).collect()} == {("A", "B"), ("A", "C"), ("A", "D"), ("E", "A"), ("E", "F"), ("H", "G")}


def test_reach_without_a_limit(spark):
    edges = spark.createDataFrame([(f"f{k}", f"f{k + 1}") for k in range(13)], "a string, b string")
    assert {(r.a, r.b): r.hops for r in graph.reach(edges, None).collect()}["f0", "f13"] == 13


def test_reach_from_entry_points_over_many_hops(spark):
    edges = spark.createDataFrame([(f"f{k}", f"f{k + 1}") for k in range(75)] + [("x", "y"), ("f3", "f1"), (None, "z")], "a string, b string")
    got = {r.node for r in graph.reachable_from(edges, spark.createDataFrame([("f0",), ("f0",), (None,)], "node string")).collect()}
    assert got == {f"f{k}" for k in range(76)}
