from __future__ import annotations

import random

import numpy as np
import pytest

from marlstone.llm.families import class_links, file_families, file_traits, import_origins, not_hand_written, notice, traits

rng = random.Random(5)
FILES = "file_id bigint, repo string, path string, content string, family bigint, kind string"
RELEASES = "release_id bigint, package string, version string, path string, content string"


def contract(name, seed, n=8):
    r = random.Random(seed)
    kinds = ["x{0} = y{0} + {0};", "require(x{0} > {0}, \"low {0}\");", "emit Moved{0}(msg.sender, {0});", "delete z{0};", "for (uint256 i = 0; i < {0}; i++) {{ x{0} += i; }}", "if (a{0} >= b{0}) {{ a{0} = b{0}; }} else {{ c{0} = {0}; }}", "(bool ok{0}, ) = t{0}.call{{value: {0}}}(\"\");", "unchecked {{ k{0} = k{0} * {0}; }}"]
    body = "\n".join(f"  function f{r.randrange(10**6)}(uint256 a{r.randrange(99)}) public {{\n" + "\n".join("    " + r.choice(kinds).format(r.randrange(10**5)) for _ in range(r.randrange(2, 7))) + "\n  }" for _ in range(n))
    return f"pragma solidity ^0.8.0;\ncontract {name} {{\n{body}\n}}\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [("// Code generated by tool 1.2. Manual changes will be lost.\nx", True), ("/**\n * Diese Datei wurde automatisch erzeugt; nicht bearbeiten.\n */", True), ("# @generated by sigwriter 1.0\n", True), ("/* AUTO-GENERATED FILE - DO NOT EDIT */", True), ("// Do not modify by hand: regenerate with `make abi`\n", True), ("// Ne pas modifier\n", True), ("# 自动生成\n", True), ("// SPDX-License-Identifier: MIT\n// machine written (x export, build 12)\n", True),
     ("// the table of ids is generated by the indexer, see the handbook\n", False), ('HEADER = "# AUTO-GENERATED FILE - DO NOT EDIT"\n', False), ("// ids are generated off chain and only stored here\n", False), ("// written by J. Doe\n", False), ("contract A {}\n// @generated", False), ("// don't move this below the transfer\n", False), ("", False)],
)
def test_notice(text, want):
    assert notice(text) == want


def test_traits():
    table = "library T {\n" + "\n".join(f"  uint256 constant K{k} = {rng.randrange(10**70)};" for k in range(40)) + "\n}"
    rows = "[" + ", ".join(f'{{"b": {k}, "h": "{k * 7}"}}' for k in range(80)) + "]"
    small = "!function(){" + "".join(f"var a{k}=function(b){{for(var i=0;i<{k};i++)b+=i;return b}};" for k in range(40)) + "}();"
    lock = '{"packages": {' + ", ".join(f'"p{k}": {{"version": "1.{k}", "hash": "abc{k}"}}' for k in range(60)) + "}}"
    config = '{"name": "x", "version": "1.0", "networks": {"a": {"chain": 1, "gas": 2, "url": "u"}}, "limits": [1, 2, 3]}'
    for text, language, want in ((table, "sol", "table"), (rows, "js", "blob"), (rows, "py", "blob"), ("a,b\n" + "\n".join(f"{k},0x{k:040x}" for k in range(60)), "js", "blob"), (small, "js", "minified"), (" ".join(contract("A", 1, 12).split()), "sol", "minified"), (lock, "json", "generated"), (config, "json", ""), (contract("A", 1), "sol", ""), ("", "sol", ""), ("\n".join(f"// File: a{k}.sol\ncontract A{k} {{ }}" for k in range(3)), "sol", "generated")):
        assert traits(text, language)[1] == want, (language, want, text[:40])


def test_copies_and_families(spark):
    release = contract("Lib", 100, 12)
    altered = "// copied\n" + release.replace("Lib", "Mine").replace("\n  function", "\n\n\n   function", 2)
    rows = [(1, "a", "a/x.sol", release), (2, "b", "b/y.sol", altered), (3, "a", "a/z.sol", contract("Own", 7, 12)), (4, "a", "a/n.sol", None), (5, "a", None, "x = 1"), (6, "a", "a/e.sol", ""), (7, "c", "c/long.sol", contract("Big", 8, 3000))]
    rows += [(20 + k, "g", f"g/m{k}.py", ("# @generated by t 1.0\n" if k < 4 else "") + "\n".join(f"class M{k}_{j}:\n    def get(self, a, b):\n        return self.call(a, b) if a else other(b)" for j in range(3))) for k in range(6)]
    files = spark.createDataFrame([(*r, 0, "clash") for r in rows] * 2, FILES)
    releases = spark.createDataFrame([(1, "lib", "1.0", "Lib.sol", release), (2, "lib", "2.0", "Other.sol", contract("Other", 55, 12)), (3, "lib", "0", "n", None)], RELEASES)
    families = file_families(files, releases)
    kinds = {r.file_id: r.kind for r in not_hand_written(families).collect()}
    assert kinds == {1: "vendored", 2: "vendored"} | {20 + k: "generated" for k in range(6)}
    assert {r.file_id for r in families.collect()} == {1, 2, 3, 5, 6, 7, *range(20, 26)}
    imports = spark.createDataFrame([(1, 3, "./y.sol", False), (2, 3, "./x.sol", None), (2, 3, "./x.sol", None)], "import_id bigint, file_id bigint, path string, is_openzeppelin boolean")
    got = {r.stated: (r.imports, r.resolved, r.not_hand_written) for r in import_origins(imports, files, not_hand_written(families)).collect()}
    assert got == {False: (1, 0, 0), None: (1, 1, 1)}
    assert file_families(files.limit(0), releases.limit(0)).count() == 0


def test_links_span_similar_classes(spark):
    """Against all pairs: classes of similarity 0.8 or more end in one family; recall at least 0.9."""
    base = [contract("A", s, 10) for s in range(12)]
    texts = [t if k == 0 else t.replace("delete", "drop", k) + f"\ncontract E{k} {{ }}" for t in base for k in range(4)]
    df = spark.createDataFrame([(k, False, "r", f"{k}.sol", t) for k, t in enumerate(texts)], "id bigint, released boolean, repo string, path string, content string")
    rows = file_traits(df).collect()
    links = {(r.a, r.b) for r in class_links(file_traits(df).dropDuplicates(["class"])).collect()}
    parent = {r["class"]: r["class"] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    pairs = joined = 0
    for i, x in enumerate(rows):
        for y in rows[:i]:
            s, t = (set(np.frombuffer(z.shingles, np.uint32).tolist()) for z in (x, y))
            if len(s & t) >= 0.8 * len(s | t):
                pairs += 1
                joined += find(x["class"]) == find(y["class"])
    assert pairs > 20 and joined >= 0.9 * pairs
