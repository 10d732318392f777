"""Parsing-expression grammars over token streams, compiled to packrat recognisers.

Notation, one rule after the other: ``name <- a b / c``. Terminals are 'text' (a token of that kind), UPPER names (token
classes) and {a b c} (one of several kinds, where RB is the closing brace). Operators: sequence, ordered choice ``/``, ``?``, ``*``, ``+``, ``&e``, ``!e`` and
parentheses. ``#nl`` holds if a line break precedes the token. A rule whose name is followed by ``@`` is memoised, so that no
position is parsed twice under it. Choices skip alternatives whose first tokens exclude the next one.

A recogniser takes the token kinds and the flags for line breaks and returns (end, furthest): the position behind the match,
or -1, and the furthest position at which any terminal failed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Recogniser = Callable[[list[str], list[bool]], tuple[int, int]]
END = "<end>"
_LEX = re.compile(r"\s+|(?P<rule>[a-z_]\w*)(?P<memo>@)?\s*<-|(?P<name>[a-z_]\w*)|(?P<kind>[A-Z_]+)|'(?P<text>[^']+)'|\{(?P<set>[^}]*)\}|(?P<op>[/?*+&!()])|(?P<nl>#nl)")


def _read(grammar: str) -> tuple[dict[str, tuple], set[str], str]:
    """The rules as nested tuples, the memoised ones, the first rule."""
    items: list[tuple[str, str, str | None]] = []
    at = 0
    while at < len(grammar):
        m = _LEX.match(grammar, at)
        if not m:
            raise ValueError(f"grammar: {grammar[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            kind = "rule" if m["rule"] else m.lastgroup
            items.append((kind, m["rule"] or m[m.lastgroup], m["memo"]))
    rules: dict[str, tuple] = {}
    memo: set[str] = set()
    k = 0

    def choice() -> tuple:
        nonlocal k
        alternatives = [sequence()]
        while k < len(items) and items[k][:2] == ("op", "/"):
            k += 1
            alternatives.append(sequence())
        return alternatives[0] if len(alternatives) == 1 else ("choice", alternatives)

    def sequence() -> tuple:
        nonlocal k
        parts = []
        while k < len(items) and items[k][0] != "rule" and items[k][:2] not in (("op", "/"), ("op", ")")):
            parts.append(prefixed())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefixed() -> tuple:
        nonlocal k
        kind, value, _ = items[k]
        if kind == "op" and value in "&!":
            k += 1
            return ("and" if value == "&" else "not", prefixed())
        k += 1
        if kind == "op" and value == "(":
            e = choice()
            k += 1
        elif kind == "name":
            e = ("call", value)
        elif kind == "nl":
            e = ("nl",)
        elif kind == "set":
            e = ("one", frozenset("}" if x == "RB" else x for x in value.split()))
        else:
            e = ("one", frozenset([END if value == "END" else value]))
        while k < len(items) and items[k][0] == "op" and items[k][1] in "?*+":
            e = ({"?": "opt", "*": "many", "+": "some"}[items[k][1]], e)
            k += 1
        return e

    start = items[0][1]
    while k < len(items):
        _, name, marked = items[k]
        k += 1
        if marked:
            memo.add(name)
        rules[name] = choice()
    return rules, memo, start


def _firsts(rules: dict[str, tuple]) -> tuple[Callable[[tuple], set[str] | None], Callable[[tuple], bool]]:
    """For an expression: the kinds it can begin with (None: any), and whether it can match nothing."""
    empty = {n: False for n in rules}
    first: dict[str, set[str] | None] = {n: set() for n in rules}

    def nullable(e: tuple) -> bool:
        op = e[0]
        if op in ("and", "not", "nl", "opt", "many"):
            return True
        if op == "one":
            return False
        if op == "call":
            return empty[e[1]]
        if op == "seq":
            return all(map(nullable, e[1]))
        if op == "choice":
            return any(map(nullable, e[1]))
        return nullable(e[1])

    def begins(e: tuple) -> set[str] | None:
        op = e[0]
        if op == "one":
            return set(e[1])
        if op == "call":
            return first[e[1]]
        if op in ("and", "not", "nl"):
            return set()
        if op in ("opt", "many", "some"):
            return begins(e[1])
        total: set[str] = set()
        for x in e[1]:
            b = begins(x)
            if b is None:
                return None
            total |= b
            if op == "seq" and not nullable(x):
                break
        return total

    changed = True
    while changed:
        changed = False
        for n, e in rules.items():
            now = (nullable(e), begins(e))
            if now != (empty[n], first[n]):
                empty[n], first[n] = now
                changed = True
    return begins, nullable


class _Writer:
    def __init__(self, rules: dict[str, tuple], memo: set[str]) -> None:
        self.rules, self.memo = rules, memo
        self.begins, self.nullable = _firsts(rules)
        self.sets: dict[frozenset[str], str] = {}
        self.functions: list[str] = []
        self.n = 0

    def new(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def set(self, kinds: frozenset[str]) -> str:
        return self.sets.setdefault(kinds, f"S{len(self.sets)}")

    def test(self, kinds: frozenset[str], at: str) -> str:
        return f"T[{at}] == {next(iter(kinds))!r}" if len(kinds) == 1 else f"T[{at}] in {self.set(kinds)}"

    def code(self, e: tuple, at: str, out: str, pad: str, depth: int) -> list[str]:
        """Statements that set ``out`` to the position behind e from ``at``, or to -1."""
        op = e[0]
        if op == "one":
            return [f"{pad}if {self.test(e[1], at)}: {out} = {at} + 1", f"{pad}else:", f"{pad} {out} = -1", f"{pad} if {at} > far: far = {at}"]
        if op == "call":
            return [f"{pad}{out} = r_{e[1]}({at})"]
        if op == "nl":
            return [f"{pad}{out} = {at} if N[{at}] else -1"]
        if depth > 5:
            name = f"x{len(self.functions)}"
            self.functions.append("")
            self.functions[int(name[1:])] = self.function(name, e)
            return [f"{pad}{out} = {name}({at})"]
        if op == "seq":
            lines, here = [f"{pad}{out} = -1", f"{pad}while True:"], at
            for x in e[1]:
                v = self.new()
                lines += [*self.code(x, here, v, pad + " ", depth + 1), f"{pad} if {v} < 0: break"]
                here = v
            return [*lines, f"{pad} {out} = {here}; break"]
        if op == "choice":
            lines = [f"{pad}{out} = -1", f"{pad}while True:"]
            for x in e[1]:
                kinds = None if self.nullable(x) else self.begins(x)
                if kinds and x[0] != "one":
                    lines += [f"{pad} if {self.test(frozenset(kinds), at)}:", *self.code(x, at, out, pad + "  ", depth + 1), f"{pad}  if {out} >= 0: break", f"{pad} elif {at} > far: far = {at}"]
                else:
                    lines += [*self.code(x, at, out, pad + " ", depth + 1), f"{pad} if {out} >= 0: break"]
            return [*lines, f"{pad} break"]
        v = self.new()
        if op == "opt":
            return [*self.code(e[1], at, v, pad, depth), f"{pad}{out} = {v} if {v} >= 0 else {at}"]
        if op in ("many", "some"):
            here = self.new()
            begin = [f"{pad}{here} = {at}", f"{pad}while True:"]
            if op == "some":
                begin = [*self.code(e[1], at, here, pad, depth), f"{pad}while {here} >= 0:"]
            kinds = None if self.nullable(e[1]) else self.begins(e[1])
            skip = [f"{pad} if not ({self.test(frozenset(kinds), here)}):", f"{pad}  if {here} > far: far = {here}", f"{pad}  break"] if kinds else []
            return [*begin, *skip, *self.code(e[1], here, v, pad + " ", depth + 1), f"{pad} if {v} < 0 or {v} == {here}: break", f"{pad} {here} = {v}", f"{pad}{out} = {here}"]
        keep = self.new()
        lines = [f"{pad}{keep} = far", *self.code(e[1], at, v, pad, depth), f"{pad}far = {keep}"]
        return [*lines, f"{pad}{out} = {at} if {v} {'>=' if op == 'and' else '<'} 0 else -1"]

    def function(self, name: str, e: tuple, memo: bool = False) -> str:
        body = self.code(e, "p", "out", "  ", 0)
        head = [f" def {name}(p):", "  nonlocal far"]
        if memo:
            head += [f"  out = m_{name}.get(p)", "  if out is not None: return out"]
            body.append(f"  m_{name}[p] = out")
        return "\n".join([*head, *body, "  return out"])


def compile_grammar(grammar: str) -> Recogniser:
    """The recogniser of the first rule of ``grammar``."""
    rules, memo, start = _read(grammar)
    unknown = {x for e in rules.values() for x in _calls(e)} - rules.keys()
    if unknown:
        raise ValueError(f"no rule for {sorted(unknown)}")
    w = _Writer(rules, memo)
    named = [w.function(f"r_{n}", e, n in memo) for n, e in rules.items()]
    source = "\n".join(["def run(T, N):", " far = 0", *(f" m_r_{n} = {{}}" for n in memo), *w.functions, *named, f" end = r_{start}(0)", " return end, far"])
    scope = {name: kinds for kinds, name in w.sets.items()}
    exec(compile(source, "<grammar>", "exec"), scope)  # noqa: S102 (own grammars only)
    return scope["run"]


def _calls(e: tuple) -> set[str]:
    if e[0] == "call":
        return {e[1]}
    return {c for x in e[1:] if isinstance(x, (list, tuple)) for y in (x if isinstance(x, list) else [x]) for c in _calls(y)}
