"""Problems 4 and 5 against plain models, and SQL where there is some."""

from __future__ import annotations

import datetime as dt
import re
from collections import defaultdict

import pandas as pd
import pytest

from marlstone.llm import queries as llm
from marlstone.llm.representative import STAND_INS, best_records
from marlstone.llm.top_n import top_findings, top_n_per_group
from tests.oracle import canonical, connection


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_matches_sql(spark, data, name):
    assert canonical(llm.QUERIES[name](spark, data).toPandas()) == canonical(connection(data).sql(llm.SQL[name]).df())


def canon_path(p):
    out = []
    for x in p.strip().replace("\\", "/").split("/"):
        if x == ".." and out and out[-1] != "..":
            out.pop()
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


def bare(s):
    return re.sub(r"^(?:\s|\.{2,}|…)+|(?:\s|\.{2,}|…)+$", "", s)


def model_p4(entries, origins):
    trust = {r.origin: r.trust for r in origins}
    groups = defaultdict(dict)
    for e in entries:
        for v in e.vulnerabilities or []:
            groups[canon_path(e.file_path), v.category, re.sub(r"\s", "", v.code_snippet)][v.vuln_id] = (v, trust[e.origin], e.scan_timestamp)
    out = set()
    for g in groups.values():
        if len(g) < 2:
            continue
        row = [min(g)]
        for field in ("title", "line_number", "confidence", "recommendation"):
            best = None
            present = {k: getattr(v, field) for k, (v, _, _) in g.items() if getattr(v, field) is not None}
            if field == "line_number":
                can = {k for k, x in present.items() if x >= 1}
            else:
                can = {k for k, x in present.items() if x.strip().lower() not in STAND_INS}
            if field in ("title", "recommendation"):
                can = {k for k in can if not any(len(bare(present[o])) > len(bare(present[k])) and bare(present[o]).startswith(bare(present[k])) for o in can)}
            for k in can:
                _, t, at = g[k]
                key = (t, at, -k)
                if best is None or key > best[0]:
                    best = (key, k)
            row.append(best[1] if best else 0)
        out.add(tuple(row))
    return out


def test_p4_against_model(spark):
    d = "/root/testdata/sf0.01"
    want = model_p4(spark.read.parquet(f"{d}/cache_entries.parquet").distinct().collect(), spark.read.parquet(f"{d}/scan_origins.parquet").collect())
    assert {tuple(r) for r in llm.p4_found(spark, d).collect()} == want


V = "array<struct<vuln_id bigint, title string, description string, severity string, category string, line_number int, code_snippet string, recommendation string, confidence string>>"
ENTRIES = f"entry_id bigint, file_path string, origin string, scan_timestamp timestamp, vulnerabilities {V}, grp string, trust int"
T0 = dt.datetime(2024, 1, 1)


def entry(n, path, origin, at, *vulns):
    return (n, path, origin, at, list(vulns) if vulns else None, "clash", 0)


def vuln(n, title, line=1, rec="Fix it now", conf="High", cat="c", code="a b"):
    return (n, title, None, None, cat, line, code, rec, conf)


def test_p4_edges(spark):
    origins = spark.createDataFrame([("a", 9), ("b", 5), ("a", 9)], "origin string, trust int")
    rows = [
        entry(1, "x/f.sol", "b", T0, vuln(1, "Bad sum in foo", None, " N/A ", None), vuln(7, None, cat=None)),
        entry(2, "./x//f.sol", "a", T0, vuln(2, "Bad sum…", 0, "", "unknown", code="ab")), entry(3, "x/f.sol", "lost", None, vuln(3, "  ", 3, "Fix", "low", code="a\nb ")),
        entry(4, "x/f.sol", "a", T0), entry(5, None, "a", T0, vuln(8, "t")), entry(6, "x/g.sol", "a", T0, vuln(9, "alone")),
        entry(7, "y", "a", T0, vuln(11, "tie"), vuln(10, "tie")), entry(8, "z", "a", T0, vuln(20, "n" * 50_000), vuln(21, "n" * 60_000)), entry(9, "q", "a", T0, vuln(30, "ab"), vuln(31, "abc"), vuln(32, "abd")),
    ]
    got = {r[0]: tuple(r)[1:8:2] for r in best_records(spark.createDataFrame(rows * 2, ENTRIES), origins).collect()}
    assert got == {1: (1, 3, 3, 3), 10: (10, 10, 10, 10), 20: (21, 20, 20, 20), 30: (31, 30, 30, 30)}
    assert best_records(spark.createDataFrame([], ENTRIES), origins).count() == 0


FINDINGS = "finding_id bigint, file_path string, cvss_score double, reported_at timestamp, ingested_at timestamp, file string, _salt int"


def test_p5_edges(spark):
    day = lambda k: T0 + dt.timedelta(days=k)
    rows = [(n, "f", 5.0, day(0), day(0), "clash", 1) for n in range(1, 6)] + [
        (6, ".\\f", 9.0, day(0), day(0), None, None), (6, "f", 1.0, day(1), day(1), None, None), (7, "f", None, day(0), None, None, None), (8, "f", float("nan"), day(0), None, None, None), (9, "f", 11.0, day(0), None, None, None),
        (10, "f", -0.1, day(0), None, None, None), (None, "f", 9.9, day(0), None, None, None), (11, None, 9.9, day(0), None, None, None), (12, "g", 10.0, None, None, None, None), (13, "g", 0.0, day(0), None, None, None), (6, "f", 8.0, None, None, None, None),
    ]
    got = {(r.file, r.finding_id, r.rank_no) for r in top_findings(spark.createDataFrame(rows * 2, FINDINGS)).collect()}
    assert got == {("f", 1, 1), ("f", 2, 2), ("f", 3, 3), ("g", 12, 1), ("g", 13, 2)}
    assert top_findings(spark.createDataFrame([], FINDINGS)).count() == 0


def test_hot_group(spark):
    from pyspark.sql import functions as F

    df = spark.range(200_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") % 1000).alias("score"))
    top = top_n_per_group(df, ["g"], [F.col("score").desc(), F.col("id")], "id", 3).filter("g = 'hot'").orderBy("rank_no").collect()
    pdf = pd.DataFrame({"id": range(0, 200_000, 3)})
    pdf["score"] = pdf.id % 1000
    assert [r.id for r in top] == pdf.sort_values(["score", "id"], ascending=[False, True]).id.head(3).tolist()
