from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.paths import canonical_path
from marlstone.functions.scoring import cvss_base_score, poly_hash, priority, sanitize_name
from marlstone.operators import findings as fd
from marlstone.operators import graph, lines, pipeline, structure, taint
from marlstone.operators.components import connected_components
from marlstone.operators.predicates import Predicate
from marlstone.operators.rules import NEUTRAL, Rule, override, scan_lines, scan_pack, scan_texts
from marlstone.sources import analyzer, cache, config, files, sinks
from marlstone.streaming.watch import watch


@pytest.mark.parametrize(
    ("path", "want"),
    [("a/b.sol", "a/b.sol"), ("./a//b.sol ", "a/b.sol"), (".\\a\\b.sol", "a/b.sol"), ("a/x/../b.sol", "a/b.sol"), ("a/x/y/../../b", "a/b"), ("../a", "../a"), ("/a/./b", "/a/b"), ("", ""), (None, None)],
)
def test_canonical_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(canonical_path(F.col("p"))).first()[0] == want


@pytest.mark.parametrize(
    ("vector", "score"),
    [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:H/PR:L/UI:R/S:U/C:N/I:N/A:L", 2.6), ("CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N", None), (None, None)],
)
def test_cvss(spark, vector, score):
    assert spark.createDataFrame([(vector,)], "v string").select(cvss_base_score(F.col("v"))).first()[0] == score


@pytest.mark.parametrize("text", ["", "a", "abc", "жук", "x" * 300])
def test_poly_hash(spark, text):
    want = 0
    for b in text.encode():
        want = (want * 31 + b) % 2**64
    got = spark.createDataFrame([(text,), (None,)], "t string").select(poly_hash(F.col("t")).alias("h")).collect()
    assert got[0].h.high * 2**32 + got[0].h.low == want and got[1].h is None


def test_small_functions(spark):
    df = spark.createDataFrame([("a b--c!", 9.0, 90), ("__x", None, 50)], "n string, s double, c int")
    assert [tuple(r) for r in df.select(sanitize_name(F.col("n")), priority(F.col("s"), F.col("c"))).collect()] == [("a_b_c", "P1"), ("x", "P3")]


TEXT = "/* open\nstill */ code\n// function no() {\nfunction f(uint256 a,\n  uint256 b)\n  public {\n  x.call{value: a}(\"\");\n  total = a;\n}\r\nfunction g() private {\n  f(1, 2);\n}\n"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "one\r\ntwo")], "k int, t string")


@pytest.fixture(scope="module")
def code(texts):
    return lines.split_lines(texts, "k", "t")


def test_lines(code):
    got = {(r.k, r.line_no): r.line for r in code.collect()}
    assert [got[1, n + 1] for n in range(len(TEXT.splitlines()))] == TEXT.replace("\r\n", "\n").splitlines()
    assert (got[4, 1], got[4, 2]) == ("one", "two") and not any(k in (2, 3) for k, _ in got)


def test_windows_over_lines(code, texts):
    state = {r.line_no: r.in_block for r in lines.block_comment_state(code, "k").filter("k = 1").collect()}
    assert state[2] and not state[1] and not state[3]
    depth = [r.depth for r in lines.brace_depth(code, "k").filter("k = 1").orderBy("line_no").collect()]
    assert depth[5:9] == [2, 2, 2, 1] or depth[-1] == depth[2]
    signature = {r.line_no: r.signature for r in lines.full_signature(texts, "k", "t", graph.DECLARED).collect()}
    assert signature[4] == "function f(uint256 a, uint256 b) public {"


def test_graph_operators(spark, code, texts):
    assert [tuple(r) for r in structure.call_edges(structure.declaration_rows(texts, "k", "t"), "k").collect()] == [(1, "g", "f")]
    found = graph.call_before_write(code, "k", F.col("line").contains(".call{"), F.col("line").rlike("^ *[a-z]+ = ")).collect()
    assert [(r.fn, r.call_line, r.write_line) for r in found] == [("f", 7, 8)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", None)], "a string, b string")
    assert {(r.a, r.b): r.hops for r in graph.reach(edges).collect()}[("a", "d")] == 3
    assert graph.two_cycles(spark.createDataFrame([("p", "q"), ("q", "p"), ("q", "r")], "a string, b string")).collect()[0][:] == ("p", "q")


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame([(k,) for k in range(400)], "id bigint"), spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.id: r.component for r in got.collect()} == {k: find(k) for k in range(400)}


SOURCE = '''// contract No { function no() {} }
abstract contract A is B, lib.C(1, f(2)) {
    string s = "function x() { // not a comment";
    event E(address indexed a, uint b);
    modifier only(uint k) { require(k > 0); _; }
    constructor(address owner_) B(owner_) {}
    function f(
        uint256 amount,
        address payable to
    ) external payable only(3)
      returns (bool ok)
    {
        uint256 x = amount; /* { */
        if (x > 1 && x < 9) { g(x, 2); }
        (ok, ) = to.call{value: x}("");
    }
    function g(uint a, uint b) internal { uint c = b; h(c); selfdestruct(payable(a)); } function h(uint z) private { sink.transfer(z); }
    function open_() public view;
    function tail() public { g(1, 2);
'''


def test_declarations():
    rows = {(d.kind, d.name): d for d in structure.declarations(SOURCE)}
    assert list(rows) == [("contract", "A"), ("event", "E"), ("modifier", "only"), ("constructor", "constructor"), ("function", "f"), ("function", "g"), ("function", "h"), ("function", "open_"), ("function", "tail")]
    assert rows["contract", "A"].bases == ["B", "C"] and rows["contract", "A"].end_line is None
    f = rows["function", "f"]
    assert (f.start_line, f.end_line, f.visibility, f.modifiers, f.parameters, f.calls, f.branches, f.container) == (7, 16, "external", ["only"], ["amount", "to"], ["g"], 2, "A")
    assert [(rows["function", n].start_line, rows["function", n].end_line) for n in ("g", "h", "open_", "tail")] == [(17, 17), (17, 17), (18, 18), (19, None)]
    assert all(d.parent == 0 for d in rows.values() if d.node) and [d.node for d in rows.values()] == list(range(9))
    assert structure.declarations("") == [] and structure.declarations("}}}{{ function") == []


def test_structure_rows(spark):
    df = spark.createDataFrame([(1, SOURCE, "x"), (1, None, "x"), (2, "", "x")], "k int, t string, name string")
    rows = structure.declaration_rows(df, "k", "t")
    assert rows.count() == 9 and {r.fn for r in structure.entry_points(rows, "k").collect()} == {"constructor", "f", "open_", "tail"}
    places = spark.createDataFrame([(1, n) for n in (1, 5, 9, 16, 17, 19, 20)] + [(7, 3)], "k int, line_no int")
    got = {(r.k, r.line_no): r.fn for r in structure.enclosing(places, rows, "k").collect()}
    assert got == {(1, 1): None, (1, 5): None, (1, 9): "f", (1, 16): "f", (1, 17): "g", (1, 19): None, (1, 20): None, (7, 3): None} | {(1, 19): "tail", (1, 20): "tail"}
    bare = df.filter("t is not null").select(structure.strip_comments(F.col("t")).alias("t")).collect()[0].t
    assert "no()" not in bare and "{ */" not in bare and "// not a comment" in bare
    assert structure.strip_comments is not None and [len(r.t.splitlines()) for r in structure.blanked(df.filter("k = 1"), "k", "t").collect()] == [len(SOURCE.splitlines())]
    long = spark.createDataFrame([(1, '"' + "a\\n" * 200_000 + '" // x')], "k int, t string").select(F.length(structure.strip_comments(F.col("t")))).first()[0]
    assert long == 600_003


def test_taint(spark):
    flows, passed = taint.tainted_flows([(1, "uint256 x = amount"), (2, "y = 1"), (3, 'to.call{value: x}("")'), (4, "x = 2"), (5, "token.transfer(x)"), (6, "y += amount"), (7, "g(1, y)")], {"amount": "parameter amount"}, {"g": ["p", "q"]})
    assert flows == [(3, "external call", "x", "parameter amount")] and passed == {"g": {"q": "parameter amount"}}
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, "contract C { function f() public { require(msg.sender == o); } }")], "k int, t string")
    got = {(r.k, r.fn, r.line_no, r.sink, r.name) for r in taint.fold_taint(df, "k", "t").collect()}
    # the second argument of g is clean, so neither c nor z of h is tainted
    assert got == {(1, "f", 15, "external call", "x"), (1, "g", 17, "self-destruct", "a"), (3, "f", 1, "condition", "msg.sender")}


def test_scan(spark, texts):
    pack = [Rule("A", "x", "High", r"call", "a"), Rule("M", "x", "High", r"function [a-z]\([^)]*\)", "m", True), Rule("B", "x", "Low", r"^function", "b")]
    hits = scan_lines(texts, "k", "t", pack, (1, 1)).collect()
    assert {(r.line_no, r.rule_id, r.seq, r.rule_no) for r in hits} == {(7, "A", 1, 0), (4, "B", 2, 2), (10, "B", 3, 2)}
    assert next(r.context for r in hits if r.seq == 1).split("\n")[0] == "  public {" and next(r.context for r in hits if r.line_no == 4).count("\n") == 2
    spans = scan_texts(texts, "k", "t", [r"function [a-z]\([^)]*\)"]).collect()
    assert [(r.match_no, r.start_line, r.end_line) for r in spans] == [(1, 4, 5), (2, 10, 10)]
    assert {(r.rule_id, r.rule_no, r.start_line, r.end_line) for r in scan_pack(texts, "k", "t", pack).collect()} == {("A", 0, 7, 7), ("M", 1, 4, 5), ("M", 1, 10, 10), ("B", 2, 4, 4), ("B", 2, 10, 10)}
    assert scan_lines(texts, "k", "t", []).count() == 0 and scan_lines(texts.limit(0), "k", "t").count() == 0
    assert [r.severity for r in override(NEUTRAL, ["N01"], {"N02": "Low", "N03": "bad"})][:2] == ["Low", "Medium"]


@pytest.mark.parametrize(
    ("pattern", "text", "lines_"),
    [(r"\bfoo\b", "xfoo\nfoo\n", [2]), (r"\bfoo\b", "afoo\nb\nfoo", [3]), (r"(?m)^foo", "xfoo\nfoo", [2]), (r"(?m)foo$", "foox\nfoo\nfoo ", [2]), (r"(?s)a.*?b", "ab\na\nb b", [1, 2]), (r"x*", "\nxx\n\nx", [2, 4]), (r"é", "é\r\né", [1, 2])],
)
def test_places_of_matches(spark, pattern, text, lines_):
    assert [r.start_line for r in scan_texts(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", [pattern]).orderBy("match_no").collect()] == lines_


def test_many_matches_in_a_long_text(spark):
    """11 MB: one pass over the text, every line and match counted."""
    df = spark.range(1).select("id", F.repeat(F.lit("ab cd\n" + "x" * 94 + "\n"), 110_000).alias("t"))
    got = scan_texts(df, "id", "t", [r"\bab\b"]).agg(F.count(F.lit(1)), F.max("start_line")).first()
    assert tuple(got) == (110_000, 219_999)
    assert scan_lines(df, "id", "t", [Rule("A", "x", "Low", r"ab", "a")]).agg(F.max("line_no"), F.max("seq")).first()[:] == (219_999, 110_000)


def test_contained_names(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts, names = [(k, rng.choice("xy"), word(rng.randrange(0, 30))) for k in range(60)] + [(99, "x", None)], [(word(rng.randrange(1, 9)), rng.choice("xy")) for _ in range(40)] + [("", "x"), (None, "y")]
    t, n = spark.createDataFrame(texts, "k int, r string, t string"), spark.createDataFrame(names, "n string, r string").distinct()
    got = {(x.k, x.n) for x in fd.contained_names(t, n, "t", "n", ["r"]).collect()}
    assert got == {(k, m) for k, r, x in texts for m, q in names if x is not None and m and r == q and m in x}


def test_pipeline(spark):
    pack = [Rule("A", "x", "High", r"call", "a"), Rule("M", "x", "Low", r"start[^;]*;", "m", True), Rule("B", "y", "Info", r"v[0-9]", "b"), Rule("C", "x", "Medium", r"ca", "c")]
    df = spark.createDataFrame([(1, "s/a.sol", "call\nstart\n end;\nv1 ok call"), (2, "s/test/b.sol", "call"), (3, "s/c.sol", None), (4, "s/d.sol", "safe\ncall")], "k int, path string, t string")
    rows = lambda **kw: {(r.k, r.rule_id, r.start_line, r.end_line) for r in pipeline.scan(df, "k", "t", pack, pipeline.Options(**kw)).collect()}
    every = {(1, "A", 1, 1), (1, "A", 4, 4), (1, "M", 2, 3), (1, "B", 4, 4), (2, "A", 1, 1), (4, "A", 2, 2)}
    assert rows() == every and rows(exact_dedup=False) == every | {(1, "C", 1, 1), (1, "C", 4, 4), (2, "C", 1, 1), (4, "C", 2, 2)}
    assert rows(multiline_rules=False, min_severity="High") == {x for x in every if x[1] == "A"}
    assert rows(merge_window=30) == {(1, "A", 1, 1), (1, "B", 4, 4), (2, "A", 1, 1), (4, "A", 2, 2)}
    noise = [Predicate("safe", "text", any_of=("safe",)), Predicate("ok", "line", any_of=("ok",), categories=("x",)), Predicate("odd", "context", any_of=("nothing",), none_of=("call",))]
    options = pipeline.Options.from_settings({"exclude": ["*/test/*"], "unheard_of": 1})
    found = pipeline.scan(df, "k", "t", pack, options, noise, "path")
    assert {(r.k, r.rule_id, r.start_line) for r in found.collect()} == {(1, "A", 1), (1, "M", 2), (1, "B", 4)}
    old = found.filter("rule_id = 'A'").select("print")
    assert {r.rule_id for r in pipeline.scan(df, "k", "t", pack, options, noise, "path", old).collect()} == {"M", "B"}
    assert pipeline.scan(df.limit(0), "k", "t", pack).count() == 0 and pipeline.scan(df, "k", "t", []).count() == 0
    with pytest.raises(ValueError, match="severities"):
        pipeline.scan(df, "k", "t", pack, pipeline.Options(min_severity="Odd"))


def _findings(spark, rows):
    return spark.createDataFrame(rows, "k int, line_no int, category string, severity string, rank int, rule_id string, rule_no int, seq int")


def test_dedup(spark):
    rows = [(1, 10, "c", "High", 3, "r", 0, 1), (1, 10, "c", "Low", 1, "r", 0, 2), (1, 35, "c", "Medium", 2, "r", 0, 3), (1, 60, "c", "Critical", 4, "r", 0, 4)]
    f = _findings(spark, rows)
    assert fd.dedup_exact(f, "k").count() == 3 and fd.dedup_adjacent(f, "k").count() == 3
    assert sorted(r.seq for r in fd.dedup_greedy(f, "k").collect()) == fd.greedy_merge([(r[7], r[2], r[1], r[4]) for r in rows], 30)
    assert fd.greedy_merge([(1, "c", 10, 3), (3, "c", 35, 2), (4, "c", 60, 4)], 30) == [1, 4]
    near = fd.drop_near(_findings(spark, [(1, n, "c", "Low", 1, "r", 0, n) for n in range(1, 12)]), _findings(spark, [(1, 5, "c", "Low", 1, "r", 0, 99)]), "k")
    assert sorted(r.line_no for r in near.collect()) == [1, 9, 10, 11]
    assert fd.drop_covered(f, "k", F.col("rank") <= 1).count() == 3
    assert f.limit(0).transform(lambda x: fd.dedup_greedy(x, "k")).count() == 0


def test_confidence_and_risk(spark):
    one = spark.range(1)
    steps = [(F.lit(True), 60), (F.lit(True), -30), (F.lit(False), -100)]
    assert one.select(fd.confidence(F.lit(65), steps)).first()[0] == 70
    f = _findings(spark, [(1, 1, "c", "Critical", 4, "r", 0, 1)] * 3)
    assert fd.risk_score(f, F.lit(True)).first()[0] == pytest.approx(39.0)
    assert fd.risk_score(f.limit(0), F.lit(True)).first()[0] == 0.0


def test_best_matches(spark):
    schema = "file string, id int, category string, line_no int, title string"
    a = spark.createDataFrame([("f", 1, "c", 5, "alpha beta gamma"), ("f", 2, "c", 5, "alpha beta gamma")], schema)
    b = spark.createDataFrame([("f", 9, "c", 5, "alpha beta gamma"), ("f", 8, "d", 50, "other words")], schema)
    assert {(r.left_id, r.right_id, r.score) for r in fd.best_matches(a, b, "file").collect()} == {(1, 9, 1.0), (2, None, None), (None, 8, None)}


def test_greedy_merge_against_a_plain_scan():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(k, rng.choice("ab"), rng.randrange(150), rng.randrange(5)) for k in range(60)]
        kept: dict = {}
        for row in rows:
            own = kept.setdefault(row[1], [])
            k = next((k for k, o in enumerate(own) if abs(o[2] - row[2]) <= 30), None)
            if k is None:
                own.append(row)
            elif row[3] > own[k][3]:
                own[k] = row
        assert fd.greedy_merge(rows, 30) == sorted(r[0] for own in kept.values() for r in own)


def test_config(tmp_path):
    (tmp_path / "marlstone.toml").write_text('[[rules]]\nid="X"\npattern="a+"\nseverity="Silly"\n[[rules]]\nid="Y"\npattern="("\n[[rules]]\nid="Z"\npattern="z"\nenabled=false\n[[overrides]]\nrule_id="N01"\nenabled=false\n[settings]\nn=1\n')
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    found = config.find_config(deep)
    assert found == tmp_path / "marlstone.toml"
    with pytest.warns(UserWarning):
        c = config.load_config(found)
    rules = c.rules()
    assert rules[-1].rule_id == "X" and rules[-1].severity == "Medium" and all(r.rule_id != "N01" for r in rules) and c.settings == {"n": 1}


def test_files_and_globs(spark, tmp_path):
    (tmp_path / "s" / "sub").mkdir(parents=True)
    (tmp_path / "s" / "a.sol").write_text("x")
    (tmp_path / "s" / "sub" / "b.sol").write_text("yy")
    (tmp_path / "s" / "c.txt").write_text("z")
    assert sorted(r.content for r in files.read_sources(spark, str(tmp_path / "s")).collect()) == ["x", "yy"]
    assert sorted((r.length, r.content, r.left_out) for r in files.read_sources(spark, str(tmp_path / "s"), size_cap=1).collect()) == [(1, "x", False), (2, None, True)]
    df = spark.createDataFrame([("a/test/x.sol",), ("a/x.sol",), ("q[1].js",)], "p string")
    assert [r.p for r in df.filter(~files.excluded(F.col("p"), ["*/test/*", "*.js"])).collect()] == ["a/x.sol"]
    old, new = files.manifest(spark.createDataFrame([("f", "1"), ("g", "2")], "file string, content string")), files.manifest(spark.createDataFrame([("f", "1"), ("g", "3"), ("h", "4")], "file string, content string"))
    assert sorted(r.file for r in files.changed_since(new, old, ["file", "hash"]).collect()) == ["g", "h"]


def test_cache(spark):
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    have = spark.sql("select 'a' file, 'h' hash, timestamp'2024-01-07 00:00:00' scanned_at, 1 n union all select 'b', 'h', timestamp'2023-01-01 00:00:00', 2")
    todo, hit = cache.split_by_cache(spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h")], "file string, hash string"), have, now)
    assert sorted(r.file for r in todo.collect()) == ["b", "c"] and [r.n for r in hit.collect()] == [1]
    later = spark.sql("select 'a' file, 'i' hash, timestamp'2024-01-08 00:00:00' scanned_at, 3 n")
    assert sorted(r.n for r in cache.merge_cache(have, later).collect()) == [2, 3]


def test_sinks(spark, tmp_path):
    f = _findings(spark, [(1, 2, "c", "High", 3, "r1", 0, 1), (1, 1, "c", "Low", 1, "r2", 1, 2)])
    assert sinks.nested_results(f, "k").first().results[0].rule_id == "r2"
    sinks.write_json(f, "k", str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sinks.write_baseline(spark.createDataFrame([("a:b",), ("a:b",)], "print string"), str(tmp_path / "b"))
    assert [r.print for r in sinks.read_baseline(spark, str(tmp_path / "b")).collect()] == ["a:b"]
    results = [json.loads(r.value) for r in sinks.sarif_results(f, "k").collect()]
    assert json.loads(sinks.sarif_document([{"id": "r1"}], results))["runs"][0]["results"][0]["level"] == "error"
    assert [r.text for r in sinks.listing(f, "k").orderBy("place").collect()] == ["1: 2 findings", "  [H] line 2 r1", "  [L] line 1 r2"]
    folder = sinks.write_report(f, "k", str(tmp_path / "md"))
    text = [r.value for r in spark.read.text(folder).coalesce(1).collect()]
    assert "# Findings" in text and "| High | 1 |" in text and "- [H] line 2 r1" in text
    assert sinks.matrix(f.withColumn("p", F.lit("P1")), "p").first().asDict() == {"p": "P1", "critical": 0, "high": 1, "medium": 0, "low": 1, "info": 0}


def test_analyzer(spark, tmp_path):
    report = {"success": True, "results": {"detectors": [{"check": "c", "impact": "High", "elements": [{"source_mapping": {"filename_relative": "a.sol", "lines": [4, 3]}}]}, {"check": "d", "elements": []}]}}
    (tmp_path / "r.json").write_text(json.dumps(report))
    assert {(r.check, r.line_no) for r in analyzer.read_report(spark, str(tmp_path / "r.json")).collect()} == {("c", 3), ("d", None)}
    (tmp_path / "r.json").write_text(json.dumps({"success": False, "error": "broken"}))
    with pytest.raises(Exception, match="broken"):
        analyzer.read_report(spark, str(tmp_path / "r.json")).collect()


def test_watch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.sol").write_text("x.call{value: 1}\n")
    seen: list[str] = []
    sink = lambda batch, n: seen.extend(r.rule_id for r in batch.collect())
    for extra in (None, "b.sol"):
        if extra:
            (src / extra).write_text("require(x);\n")
        watch(spark, str(src), sink, str(tmp_path / "cp"), once=True).awaitTermination()
    assert seen == ["N06", "N08"]
