"""Taint of names within functions and across the calls of one text, as a fold over statements in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.structure import Declaration, declarations

_ASSIGN = re.compile(r"^\s*(?:[A-Za-z_][\w\[\]. ]*\s)?([A-Za-z_]\w*)\s*((?:[-+*/%|&^]|<<|>>)?=)(?!=)\s*(.*)$", re.DOTALL)
_NAME = re.compile(r"[A-Za-z_]\w*")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(")
# Expressions of the language that an outsider sets, and those that act on the world with the value they get.
SOURCES = ("msg.sender", "msg.value", "msg.data", "tx.origin", "block.timestamp", "block.number", "calldataload")
_ARGUMENTS = r"[^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*"
SINKS = (
    ("external call", re.compile(rf"\.call\s*(?:\{{[^{{}}]*?value\s*:\s*(?P<a>[^{{}},]*)[^{{}}]*\}})?\s*\((?P<b>{_ARGUMENTS})\)")),
    ("delegate call", re.compile(rf"\.delegatecall\s*\((?P<a>{_ARGUMENTS})\)")),
    ("transfer", re.compile(rf"\.(?:transfer|send)\s*\((?P<a>{_ARGUMENTS})\)")),
    ("self-destruct", re.compile(rf"\bselfdestruct\s*\((?P<a>{_ARGUMENTS})\)")),
    ("condition", re.compile(rf"\b(?:require|assert)\s*\((?P<a>{_ARGUMENTS})\)")),
    ("creation", re.compile(rf"\bcreate2?\s*\((?P<a>{_ARGUMENTS})\)|\bnew\s+\w+\s*(?:\{{[^{{}}]*\}})?\s*\((?P<b>{_ARGUMENTS})\)")),
    ("code", re.compile(rf"\b(?:sstore|mstore)\s*\((?P<a>{_ARGUMENTS})\)")),
)
Flow = tuple[int, str, str, str]


def _statements(body: str, line: int) -> Iterator[tuple[int, str]]:
    """(line of the first character that is not blank, text) between semicolons and braces; call options stay whole."""
    at = 0
    for m in re.finditer(r"[;{}]", body):
        if m[0] == "{" and re.search(r"\.\w+\s*$", body[max(at, m.start() - 40) : m.start()]) or m[0] == "}" and "{" in body[at : m.start()]:
            continue
        text = body[at : m.start()]
        if text.strip():
            yield line + body.count("\n", 0, at + len(text) - len(text.lstrip())), text
        at = m.end()
    if body[at:].strip():
        yield line + body.count("\n", 0, at), body[at:]


def tainted_flows(statements: list[tuple[int, str]], origin: dict[str, str], called: dict[str, list[str]] | None = None) -> tuple[list[Flow], dict[str, dict[str, str]]]:
    """(line, sink, name, source) of the flows from the tainted names ``origin``, and for each of the functions ``called``
    (name -> parameters) which parameters get a tainted value.

    What is assigned from a tainted or outside value is tainted; an assignment from clean values cleans the name, one that
    adds to it does not.
    """
    origin = dict(origin)
    flows: list[Flow] = []
    passed: dict[str, dict[str, str]] = {}

    def source(value: str) -> str | None:
        return next((s for s in SOURCES if s in value), None) or next((origin[n] for n in _NAME.findall(value) if n in origin), None)

    for line, text in statements:
        for sink, pattern in SINKS:
            for m in pattern.finditer(text):
                for part in (g for g in m.groups() if g):
                    flows += [(line, sink, s, s) for s in SOURCES if s in part]
                    flows += [(line, sink, n, origin[n]) for n in dict.fromkeys(_NAME.findall(part)) if n in origin]
        for m in _CALL.finditer(text) if called else ():
            if m[1] in called:
                depth, at, arguments = 0, m.end(), []
                for k in range(m.end(), len(text)):
                    c = text[k]
                    if depth == 0 and c in ",)":
                        arguments.append(text[at:k])
                        at = k + 1
                        if c == ")":
                            break
                    depth += (c in "([{") - (c in ")]}")
                for name, value in zip(called[m[1]], arguments, strict=False):
                    if found := source(value):
                        passed.setdefault(m[1], {}).setdefault(name, found)
        if m := _ASSIGN.match(text):
            target, operator, value = m[1], m[2], m[3]
            if found := source(value):
                origin[target] = found
            elif operator == "=":
                origin.pop(target, None)
    return flows, passed


def text_flows(decls: list[Declaration]) -> list[tuple[str, Flow]]:
    """(function, flow) of a text. Parameters of functions that can be called from outside are tainted, those of others as far
    as a call passes them something tainted; rounds go on until no parameter is added."""
    fns = [d for d in decls if d.body is not None and d.kind != "modifier"]
    called = {d.name: d.parameters for d in fns}
    inside = {d.name for d in fns if d.visibility in ("internal", "private")}
    given: dict[str, dict[str, str]] = {d.name: {} if d.name in inside else {p: f"parameter {p}" for p in d.parameters} for d in fns}
    steps = [(d, list(_statements(d.body, d.body_line))) for d in fns]
    while True:
        out, grown = [], False
        for d, statements in steps:
            flows, passed = tainted_flows(statements, given[d.name], called)
            out += [(d.name, f) for f in dict.fromkeys(flows)]
            for name, more in passed.items():
                for p, s in more.items():
                    if name in inside and p not in given[name]:
                        given[name][p] = s
                        grown = True
        if not grown:
            return out


_ARROW = (("fn", pa.string()), ("line_no", pa.int32()), ("sink", pa.string()), ("name", pa.string()), ("source", pa.string()))


def fold_taint(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, fn, line_no, sink, name, source``: flows within each text, each once. The text is read where it lies: nothing is
    grouped or shuffled. Null texts have no rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = list(dict.fromkeys((fn, *flow) for fn, flow in text_flows(declarations(t))))
                at += [k] * len(own)
                rows += own
            columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, _ARROW, strict=True))], names=[key, *(n for n, _ in _ARROW)])

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, fn string, line_no int, sink string, name string, source string")
