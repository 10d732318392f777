"""Declarations of curly-brace sources as a flat syntax tree, and what follows from them.

Comments are told from strings first. A declaration is a node with a number, its parent, a name and its lines; bodies end at
their own brace, so signatures over several lines, several declarations on one line and one-line bodies come out alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Strings are kept (group 1), comments are not; the same pattern serves the JVM.
COMMENTS = r"""("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"""
_COMMENTS = re.compile(COMMENTS.replace(r"\z", r"\Z"))
_HEAD = re.compile(
    r"\b(?:(?P<container>contract|interface|library)\s+(?P<cname>[A-Za-z_$][\w$]*)|function\s+(?P<fn>[A-Za-z_$][\w$]*)|(?P<special>constructor|receive|fallback)(?=\s*\()|(?P<small>modifier|event|error|struct|enum)\s+(?P<sname>[A-Za-z_$][\w$]*))|(?P<mark>[{};])"
)
_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\(")
_BRANCH = re.compile(r"\b(?:if|for|while|catch)\b|&&|\|\||\?")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
# Words of the language that stand before a bracket without being calls, and those of a signature.
_NOT_CALLS = frozenset("if for while catch return returns function modifier constructor mapping require assert revert emit new type assembly unchecked try using error event".split())
_VISIBILITY = ("public", "external", "internal", "private")
_ATTRIBUTES = frozenset([*_VISIBILITY, "view", "pure", "payable", "virtual", "override", "returns", "memory", "calldata", "storage"])


def strip_comments(text: Column) -> Column:
    """The text without its comments; what looks like one inside a string stays."""
    return F.regexp_replace(text, COMMENTS, "$1")


class Declaration(NamedTuple):
    """node, parent (null at the top), kind, name, container (of the nearest contract), lines of the head and of the end (null
    if the text ends before), visibility, modifiers, parameters, bases, calls, branches, and the statements of the body as
    (line, text) for those who fold over them."""

    node: int
    parent: int | None
    kind: str
    name: str
    container: str | None
    start_line: int
    end_line: int | None
    visibility: str | None
    modifiers: list[str]
    parameters: list[str]
    bases: list[str]
    calls: list[str]
    branches: int
    body: str | None
    body_line: int | None


def blank_comments(text: str, strings: bool = False) -> str:
    """The text with blanks in place of comments (and of strings), every character and line break in its place."""

    def blank(m: re.Match) -> str:
        if m[1] is not None and not strings:
            return m[0]
        return re.sub(r"[^\n]", " ", m[0])

    return _COMMENTS.sub(blank, text)


def _split(inner: str) -> list[str]:
    """The parts between commas outside of brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(inner):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(inner[at:k])
            at = k + 1
    return [p.strip() for p in (*out, inner[at:]) if p.strip()]


def _bracketed(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if depth == 0:
            return k + 1
    return len(text)


def declarations(text: str) -> list[Declaration]:
    """The declarations of a text in order. An unclosed one has no end line; a head without body or semicolon is none."""
    clean = blank_comments(text, strings=True)
    out: list[Declaration] = []
    open_: list[tuple[int, int, int]] = []  # (node, depth at its brace, place behind it)
    head: tuple[str, str, int] | None = None  # kind, name and place of a head whose body has not begun
    depth, line, at = 0, 1, 0

    def container() -> str | None:
        return next((out[n].name for n, _, _ in reversed(open_) if out[n].kind in ("contract", "interface", "library")), None)

    def add(kind: str, name: str, begin: int, behind: int, line_now: int, closed: bool) -> None:
        own = clean[begin:behind]
        first = line_now - own.count("\n")
        parameters, bases, modifiers, visibility = [], [], [], None
        if kind in ("contract", "interface", "library"):
            m = re.search(r"\bis\b", own)
            bases = [_NAME.findall(p.partition("(")[0])[-1] for p in _split(own[m.end() :].rstrip("{; \t\r\n")) if _NAME.search(p.partition("(")[0])] if m else []
        elif "(" in own:
            opening = own.index("(")
            close = _bracketed(own, opening)
            parameters = [w[-1] for p in _split(own[opening + 1 : close - 1]) if len(w := _NAME.findall(p)) > 1 and w[-1] not in _ATTRIBUTES]
            tail = own[close:].rstrip("{;")
            result = re.search(r"\breturns\b", tail)
            tail = tail[: result.start()] if result else tail
            words = [m[0] for m in _NAME.finditer(re.sub(r"\([^()]*\)", " ", tail))]
            visibility = next((w for w in words if w in _VISIBILITY), None)
            modifiers = [w for w in words if w not in _ATTRIBUTES]
        parent = open_[-1][0] if open_ else None
        out.append(Declaration(len(out), parent, kind, name, container(), first, line_now if closed else None, visibility, modifiers, parameters, bases, [], 0, None, None))

    for m in _HEAD.finditer(clean):
        line += clean.count("\n", at, m.start())
        at = m.start()
        mark = m["mark"]
        if mark is None:
            if m["container"]:
                head = (m["container"], m["cname"], at)
            elif m["fn"] or m["special"]:
                head = ("function" if m["fn"] else m["special"], m["fn"] or m["special"], at)
            else:
                head = (m["small"], m["sname"], at)
        elif mark == ";":
            if head:
                add(*head, at + 1, line, True)
                head = None
        elif mark == "{":
            if head:
                add(*head, at + 1, line, False)
                open_.append((len(out) - 1, depth, at + 1))
                head = None
            depth += 1
        elif depth:
            depth -= 1
            head = None
            if open_ and open_[-1][1] == depth:
                node, _, behind = open_.pop()
                d = out[node]
                if d.kind in ("function", "constructor", "receive", "fallback", "modifier"):
                    body = clean[behind:at]
                    calls = list(dict.fromkeys(x for x in _CALL.findall(body) if x not in _NOT_CALLS))
                    d = d._replace(calls=calls, branches=len(_BRANCH.findall(body)), body=body, body_line=line - body.count("\n"))
                out[node] = d._replace(end_line=line)
    return out


def blanked(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``text`` with blanks in place of comments and strings; every line keeps its number."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([blank_comments(t, strings=True) for t in batch.column(1).to_pylist()], pa.string())], names=[key, text])

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, `{text}` string")


_SCHEMA = pa.schema([("node", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("container", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("visibility", pa.string()), ("modifiers", pa.list_(pa.string())), ("parameters", pa.list_(pa.string())), ("bases", pa.list_(pa.string())), ("calls", pa.list_(pa.string())), ("branches", pa.int32())])
_DDL = "node int, parent int, kind string, name string, container string, start_line int, end_line int, visibility string, modifiers array<string>, parameters array<string>, bases array<string>, calls array<string>, branches int"


def declaration_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the columns of ``Declaration`` up to branches: one row for each contract, interface, library, function,
    constructor, receive, fallback, modifier, event, error, struct and enum of each text.

    Null and empty texts have no rows. Each text is read where it lies and nothing is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = declarations(t)
                at += [k] * len(own)
                rows += [d[: len(_SCHEMA)] for d in own]
            columns = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True))], names=[key, *_SCHEMA.names])

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, {_DDL}")


def functions_of(rows: DataFrame) -> DataFrame:
    """The rows that have code of their own."""
    return rows.filter(F.col("kind").isin("function", "constructor", "receive", "fallback"))


def call_edges(rows: DataFrame, key: str) -> DataFrame:
    """``key, caller, callee``: calls between functions that the same text declares; a function that calls itself is none."""
    fns = functions_of(rows)
    calls = fns.select(key, F.col("name").alias("caller"), F.explode("calls").alias("callee")).distinct()
    declared = fns.select(key, F.col("name").alias("callee")).distinct()
    return calls.join(declared, [key, "callee"], "left_semi").filter("caller <> callee").select(key, "caller", "callee")


def base_edges(rows: DataFrame) -> DataFrame:
    """``a, b``: contracts and interfaces with each of their bases."""
    return rows.select(F.col("name").alias("a"), F.explode("bases").alias("b")).distinct()


def entry_points(rows: DataFrame, key: str) -> DataFrame:
    """``key, fn``: functions that can be called from outside."""
    open_ = F.col("visibility").isin("public", "external") | F.col("kind").isin("constructor", "receive", "fallback")
    return functions_of(rows).filter(open_).select(key, F.col("name").alias("fn")).distinct()


def enclosing(places: DataFrame, rows: DataFrame, key: str, line: str = "line_no") -> DataFrame:
    """``places`` with ``fn`` and ``fn_start``: the function whose lines hold the place, or null. Functions do not nest, so the
    last one that begins at or above the place decides (of several on one line the first), by one ordered pass over places and
    functions of a text."""
    fns = functions_of(rows).select(key, F.col("start_line").alias("_at"), "node", F.struct("start_line", "end_line", "name").alias("_f"))
    own = F.struct(*places.columns)
    both = places.select(key, F.col(line).alias("_at"), own.alias("_p")).unionByName(fns.groupBy(key, "_at").agg(F.min_by("_f", "node").alias("_f")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_l", F.last("_f", ignorenulls=True).over(order)).filter("_p is not null")
    inside = F.col("_l.end_line").isNull() | (F.col("_l.end_line") >= F.col("_at"))
    return last.select("_p.*", F.when(inside, F.col("_l.name")).alias("fn"), F.when(inside, F.col("_l.start_line")).alias("fn_start"))


_IMPORT = re.compile(r"""\bimport\s+(?:\{(?P<symbols>[^{}]*)\}\s*from\s*|\*\s*as\s+(?P<star>[A-Za-z_$][\w$]*)\s+from\s*)?(?P<quote>["'])(?P<path>[^"'\n]+)(?P=quote)(?:\s+as\s+(?P<alias>[A-Za-z_$][\w$]*))?\s*;""")
_VERSION = re.compile(r"@(\d+\.\d+\.\d+)")
_IMPORTS = pa.schema([("path", pa.string()), ("alias", pa.string()), ("symbols", pa.list_(pa.string())), ("line", pa.int32()), ("is_local", pa.bool_()), ("version", pa.string())])


def imports(text: str) -> list[tuple]:
    """(path, alias, symbols, line, is_local, version) of the import statements of a text, over several lines if need be;
    those in comments are none. A symbol that gets another name is listed with it (``A as B``)."""
    clean = blank_comments(text)
    out, line, at = [], 1, 0
    for m in _IMPORT.finditer(clean):
        line += clean.count("\n", at, m.start())
        at = m.start()
        symbols = [" ".join(p.split()) for p in (m["symbols"] or "").split(",") if p.strip()]
        version = _VERSION.search(m["path"])
        out.append((m["path"], m["star"] or m["alias"], symbols, line, m["path"].startswith("."), version[1] if version else None))
    return out


def import_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, alias, symbols, line, is_local, version``: one row for each import statement of each text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = imports(t)
                at += [k] * len(own)
                rows += own
            columns = list(zip(*rows, strict=True)) or [[]] * len(_IMPORTS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, _IMPORTS, strict=True))], names=[key, *_IMPORTS.names])

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, path string, alias string, symbols array<string>, line int, is_local boolean, version string")
