from __future__ import annotations

import ast
import json
import time
import warnings

import pandas as pd
import pytest

from marlstone.llm import syntax
from marlstone.llm.parsing.peg import compile_grammar

JS_GOOD = [
    "", "// only\n", "a\nb", "let x = 1, y", "for (const k of xs) f(k)", "for (let i = 0; i < 3; i++) {}", "for (var k in o);", "x = y => ({a: y})", "const f = async (a, {b, c = 1}, ...r) => { await a; }",
    "class A extends B { static #p = 1; get x() { return this.#p } async *g() {} static { f() } constructor(a) { super(a) } }", "`a${b + `c${d}`}e`", "x = /[/]\\//g.test(s) ? 1 : a / b / c", "label: for (;;) { break label }",
    "import a, {b as c} from 'm'; import * as n from \"n\"; export default function () {}\nexport * from 'q'; export { a as d };", "if (a) b; else c", "do x++; while (x < 5)", "switch (a) { case 1: b(); break; default: c() }", "try { a() } catch { b() } finally { c() }",
    "var {a, b: [c, , d = 2], ...e} = f", "new A.B(1).c?.d?.[e]?.(f)", "x = {a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, set e(v) {}, async f() {}, ...g, get: 1, async: 2}", "a ??= b ** c || d", "return_ = void 0, typeof x", "x = 0x1F + 1_000n + .5e-3", "#!/usr/bin/env node\nf()", "async function* g() { yield* h(); for await (const x of y) {} }",
    "let async; async = 1; of = 2; get(1)", "a = b\n++c", "({a} = b)", "f(...a, b,)", "!function(){if(1>2){a=!0}else b}();", "throw new Error(`x`)", "x = a ? b : c ? d : e", "import('m').then(a => a)", "var π = 'ü'", "f(/re/.test(b))",
]
JS_BAD = ["{", "a b", "let = ;", "function () {}", "f(", "x = {a: }", "'open", "`open ${a", "if (a", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "{\"a\": 1}", "a,b,c\n1,2,3x", "class { }", "1 = x", "for (;;", "return => 1", "<html></html>", "# heading", "a ? b", "/* open", "x = [1, 2", "}"]
SOL_GOOD = [
    "", "// SPDX\npragma solidity ^0.8.0;", "pragma solidity >=0.4.22 <0.9.0; pragma abicoder v2; pragma experimental ABIEncoderV2;", 'import "a.sol"; import "b.sol" as b; import {c as d, e} from "c.sol"; import * as f from "f.sol";',
    "abstract contract A is B, C.D(1) { using L for uint256; using {f, g as +} for T global; uint256 public constant x = 1 ether; mapping(address => mapping(uint => bool)) m; address payable immutable o; error E(uint a); event V(address indexed a, uint) anonymous; }",
    "contract A { constructor(address a) B(a) payable { } receive() external payable {} fallback() external {} function () payable {} modifier m(uint a) { require(a > 0, \"x\"); _; } enum E { A, B } struct S { uint a; bytes32[] b; } }",
    "contract A { function f(uint[] memory a, function(uint) external returns (bool) g) public view virtual override(B, C) returns (uint b, bytes memory) { (uint x, , bool y) = g(1); (x, y) = (1, true); uint[3] memory z = [uint(1), 2, 3]; return a[0] + z[1]; } }",
    "contract A { function f() external { try this.g{value: 1, gas: 2}(3) returns (uint v) { } catch Error(string memory r) { revert(r); } catch { } unchecked { i++; } assembly { let p := mload(0x40) for { let i := 0 } lt(i, 3) { i := add(i, 1) } { mstore(p, i) } switch p case 0 { } default { revert(0, 0) } } } }",
    "contract A { function f() public { for (uint i; i < 3; ) { if (a) continue; else break; } do { x -= 1; } while (x > 0); while (true) {} emit V(1, 2); revert E({a: 1}); delete x; new B{salt: s}(1); type(uint).max; payable(msg.sender).transfer(1 wei); a ? b : c; x = y = z; (bool ok, ) = a.call{value: v}(\"\"); bytes memory d = msg.data[4:]; } }",
    "function free(uint a) pure returns (uint) { return a ** 2; } type T is uint128; using F for *; library L { } interface I { function f() external; }", "contract A { bytes constant c = hex\"00ff\" hex'aa'; string s = unicode\"é\"; uint x = 1_000 days; address from; uint error; }",
]
SOL_BAD = ["contract A {", "contract { }", "contract A { function f( public {} }", "contract A { uint x }", "contract A { } }", "contract A { function f() public { x = ; } }", "{}", "def f(): pass", "const a = 1;", "contract A { string s = \"open; }", "/* open", "contract A { function f() public { if x { } } }", "<<<<<<< HEAD\ncontract A {}", "pragma solidity ^0.8.0", "contract A { function f() public { delete a }"]
PY_GOOD = ["", "x = 1\n", "def f(a, /, b: int = 1, *c, d, **e) -> int:\n  return a if b else c\n", "match x:\n  case {'a': [1, *r]} if r: pass\n  case P(a=1) | None as y: pass\n", "match = 1\nmatch[0]\n", "with (open(a) as f, g() as h):\n  pass\n", "async def f():\n  async for x in y: await z\n", "x = [a for b in c if d for e in f]\n", "lambda *a, k=1, **b: a\n", "try:\n  pass\nexcept* E as e:\n  raise X from e\nelse:\n  pass\nfinally:\n  pass\n", "@a.b(c)\nclass C(D, metaclass=E):\n  '''doc'''\n", "if a: b; c\nelif d: pass\nelse: pass", "x: int\na.b[c:d, ::2] += yield\n".replace("yield", "1"), "print(f'{a!r:>{w}}', *b, **c)\n", "a = b = *c, d\n", "del a, b[0]\n", "global_ = 1 if a else\\\n 2\n", "type X[T] = list[T]\n", "(y := 1)\n", "x = {**a, 'b': 1, **c}\n", "not a in b is not c\n"]
PY_BAD = ["x =\n", "def f(:\n  pass\n", "if a:\nb\n", "  x\n", "def f():\n\treturn 1\n  x\n", "f() = 1\n", "print 'a'\n", "'open\n", "'''open\n", "x = (1\n", "<<<<<<< HEAD\n", "a b\n", "class A\n", "for x in: pass\n", "1x\n", "else: pass\n", "import\n", "x = 012\n", "def f():\n"]


@pytest.mark.parametrize(("language", "texts", "valid"), [("javascript", JS_GOOD, True), ("javascript", JS_BAD, False), ("solidity", SOL_GOOD, True), ("solidity", SOL_BAD, False), ("python", PY_GOOD, True), ("python", PY_BAD, False)])
def test_samples(language, texts, valid):
    wrong = [t for t in texts if syntax.check_text(t, language).valid != valid]
    assert not wrong


@pytest.mark.parametrize("text", [*PY_GOOD, *PY_BAD])
def test_python_samples_agree(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            want = True
        except SyntaxError:
            want = False
    assert syntax.check_text(text, "python").valid == want


@pytest.mark.parametrize("text", ["", " ", "1", "-0.5e+3", "[1,]", "{}", '{"a":[true,false,null]}', "{'a':1}", '"\\u00e9"', '"\\x"', '"a\tb"', "01", "+1", "[1 2]", "nul", '{"a":1,}', "\ufeff{}", '{"a" 1}', "[" * 3000 + "]" * 3000, "[" * 50])
def test_json_agrees(text):
    def refuse(name):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refuse)
        want = True
    except ValueError:
        want = False
    assert syntax.check_text(text, "json").valid == want


@pytest.mark.parametrize(
    ("text", "language", "cause"),
    [("<<<<<<< HEAD\na = 1\n=======\na = 2\n>>>>>>> b\n", "python", "merge_conflict"), ('{"a": 1}', "javascript", "wrong_language"), ("contract A { function f() public {", "solidity", "truncated"), ("x = = 2;", "javascript", "syntax"), ("def f(", "python", "truncated"), ('x = "abc', "javascript", "truncated")],
)
def test_causes(text, language, cause):
    report = syntax.check_text(text, language)
    assert report.cause == cause and not report.valid


def test_furthest():
    report = syntax.check_text("let a = 1;\nlet b = ];\n", "javascript")
    assert (report.furthest, report.line) == (19, 2)


def test_engine():
    run = compile_grammar("s <- (a / b)* !'z' END\na@ <- 'x' 'y'\nb <- 'x'+ {p q}?")
    assert run(["x", "y", "x", "q", "<end>"], [False] * 5)[0] == 5 and run(["x", "z", "<end>"], [False] * 3)[0] < 0
    with pytest.raises(ValueError, match="no rule"):
        compile_grammar("s <- missing")


def test_whole_table(spark):
    files = pd.read_parquet("/root/testdata/sf0.01/source_files.parquet").drop_duplicates("file_id").dropna(subset=["content"])
    reports = {r.file_id: r for r in syntax.parse_reports(spark.read.parquet("/root/testdata/sf0.01/source_files.parquet")).collect()}
    assert set(reports) == set(files.file_id)
    for r in files.itertuples():
        if r.path.endswith((".py", ".json")):
            try:
                ast.parse(r.content) if r.path.endswith(".py") else json.loads(r.content)
                want = True
            except ValueError:
                want = False
            except SyntaxError:
                want = False
            assert reports[r.file_id].valid == want, r.path


@pytest.mark.parametrize(
    ("language", "head", "opening", "inner", "closing", "end"),
    [("javascript", "x = ", "[", "1", "]", ";"), ("javascript", "x = ", "{a: ", "1", "}", ";"), ("javascript", "x = ", "function () { return ", "1", "}", ";"), ("javascript", "", "((a = ", "1", ") => 1)", ";"), ("solidity", "contract A { function f() public { x = ", "(", "1", ")", "; } }"), ("python", "x = ", "[", "1", "]", "\n"), ("json", "", "[", "", "]", "")],
)
def test_deep_nesting_is_linear(language, head, opening, inner, closing, end):
    """Nesting of 30,000 levels is parsed, in time that grows with the length (squared growth would take half an hour)."""
    took = []
    for n in (3_000, 30_000):
        text = head + opening * n + inner + closing * n + end
        begin = time.process_time()
        assert syntax.check_text(text, language).valid
        assert not syntax.check_text(text + "]", language).valid
        took.append(time.process_time() - begin)
    assert took[1] < 40 * max(took[0], 0.05)


SCHEMA = "file_id bigint, repo string, path string, content string, language string, valid int"


def test_edges(spark):
    rows = [(1, "r", "r/a.sol", None, "x", 0), (2, None, "r/b.JSON ", "", "x", 0), (3, "r", "r/c.py", "", None, 0), (4, "r", None, "x", None, 0), (None, "r", "r/d.py", "x", None, 0), (5, "r", "r/e.txt", "(", None, 0), (6, "r", "r/f.js", "a;" * 200_000, None, 0)]
    df = spark.createDataFrame(rows * 2, SCHEMA)
    got = {r.file_id: r.valid for r in syntax.parse_reports(df).collect()}
    assert got == {2: False, 3: True, 6: True}
    rates = {(r.repo, r.language): (r.files, r.invalid, r.share) for r in syntax.invalid_rates(syntax.parse_reports(df)).collect()}
    assert rates == {(None, "json"): (1, 1, 1.0), ("r", "python"): (1, 0, 0.0), ("r", "javascript"): (1, 0, 0.0)}
    scans = spark.createDataFrame([(1, "./r//b.JSON", "2024"), (1, "./r//b.JSON", "2024"), (2, None, "2024")], "entry_id bigint, file_path string, scan_timestamp string")
    assert [(r.file_id, r.scans) for r in syntax.scans_of_invalid(syntax.parse_reports(df), scans).collect()] == [(2, 1)]
    assert syntax.parse_reports(spark.createDataFrame([], SCHEMA)).count() == 0
