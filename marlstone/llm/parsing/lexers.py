"""Tokens of the languages: kinds, start offsets and line-break flags, closed by an end token.

A text that has no tokens at some place (an open string or comment, a character outside the language, conflict markers of a
merge) gets the token ``<bad>``, ``<open>`` or ``<conflict>`` there, which no grammar accepts.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from marlstone.llm.parsing.peg import END

BAD, OPEN, CONFLICT = "<bad>", "<open>", "<conflict>"
_CONFLICT = r"(?P<conflict>(?m:^)(?:<{7}|>{7}|\|{7})(?=[ \t\r\n]|\Z)[^\n]*|(?m:^)={7}(?=\r?\n|\Z))"


class Tokens(NamedTuple):
    kinds: list[str]
    starts: list[int]
    breaks: list[bool]


# Words that each language reserves.
SOLIDITY_WORDS = frozenset(
    "abstract address anonymous as assembly bool break byte bytes calldata catch constant constructor continue contract delete do else emit enum event external fallback false final fixed for function hex if immutable import indexed interface internal is let library mapping memory modifier new override payable pragma private public pure receive return returns storage string struct throw true try type ufixed unchecked unicode using var view virtual while error from global revert leave case switch default wei gwei ether szabo finney seconds minutes hours days weeks years inline static typeof".split()
)
_ELEMENTARY = re.compile(r"u?int(?:8|16|24|32|40|48|56|64|72|80|88|96|104|112|120|128|136|144|152|160|168|176|184|192|200|208|216|224|232|240|248|256)?|bytes(?:[1-9]|[12]\d|3[0-2])|u?fixed(?:\d{1,3}x\d{1,2})?")
JS_WORDS = frozenset("await async break case catch class const continue debugger default delete do else enum export extends false finally for function get if import in instanceof let new null of return set static super switch this throw true try typeof var void while with yield from as".split())
PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _".split())

_SOL = re.compile(
    r"(?P<skip>[ \t\f\u00a0]+)|(?P<nl>\r\n?|\n|\u2028|\u2029)|(?P<line>//[^\r\n\u2028\u2029]*)|(?P<block>/\*(?:[^*]|\*(?!/))*\*/)|" + _CONFLICT +
    r"|(?P<hex>hex(?:\"(?:[0-9a-fA-F]{2}(?:_?[0-9a-fA-F]{2})*)?\"|'(?:[0-9a-fA-F]{2}(?:_?[0-9a-fA-F]{2})*)?'))|(?P<ustr>unicode(?:\"(?:[^\"\\\r\n]|\\(?:[^\r]|\r\n?))*\"|'(?:[^'\\\r\n]|\\(?:[^\r]|\r\n?))*'))"
    r"|(?P<str>\"(?:[^\"\\\r\n]|\\(?:[^\r]|\r\n?))*\"|'(?:[^'\\\r\n]|\\(?:[^\r]|\r\n?))*')|(?P<open>/\*|[\"'])"
    r"|(?P<num>0x[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*(?![\w$])|(?:\d+(?:_\d+)*(?:\.\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE]-?\d+(?:_\d+)*)?(?![\w$]))|(?P<id>[A-Za-z_$][\w$]*)"
    r"|(?P<op>>>>=|>>>|<<=|>>=|=>|->|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|\|=|&=|\^=|\*\*|<<|>>|[-+*/%<>=!&|^~?:;,.(){}\[\]])", re.ASCII,
)


def _plain(pattern: re.Pattern, text: str, word) -> Tokens:  # noqa: ANN001
    kinds: list[str] = []
    starts: list[int] = []
    breaks: list[bool] = []
    at, size, fresh = 0, len(text), False
    match = pattern.match
    while at < size:
        m = match(text, at)
        if m is None:
            kinds.append(BAD)
            starts.append(at)
            breaks.append(fresh)
            at += 1
            fresh = False
            continue
        group = m.lastgroup
        if group == "skip" or group == "line":
            pass
        elif group == "nl":
            fresh = True
        elif group == "block":
            fresh = fresh or "\n" in m[0]
        else:
            if group == "op":
                kind = m[0]
            elif group == "id":
                kind = word(m[0])
            elif group == "open":
                kind = OPEN
            elif group == "conflict":
                kind = CONFLICT
            else:
                kind = group.upper()
            kinds.append(kind)
            starts.append(at)
            breaks.append(fresh)
            fresh = False
        at = m.end()
    kinds.append(END)
    starts.append(size)
    breaks.append(True)
    return Tokens(kinds, starts, breaks)


def _solidity_word(word: str) -> str:
    if word in SOLIDITY_WORDS:
        return word
    return "ELEMENTARY" if word[0] in "uibf" and _ELEMENTARY.fullmatch(word) else "ID"


def solidity(text: str) -> Tokens:
    return _plain(_SOL, text.removeprefix("\ufeff"), _solidity_word)


_JSON = re.compile(r"(?P<skip>[ \t\r\n]+)|" + _CONFLICT + r"|(?P<str>\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<id>[A-Za-z_]\w*)|(?P<open>\")|(?P<op>[{}\[\],:])", re.ASCII)


def json_tokens(text: str) -> Tokens:
    return _plain(_JSON, text, lambda w: w if w in ("true", "false", "null") else BAD)


_JS = re.compile(
    r"(?P<skip>[ \t\f\v\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<nl>[\r\n\u2028\u2029]+)|(?P<line>//[^\r\n\u2028\u2029]*)|(?P<block>/\*(?:[^*]|\*(?!/))*\*/)|" + _CONFLICT +
    r"|(?P<str>\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')|(?P<open>/\*|[\"'])"
    r"|(?P<num>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[oO][0-7]+(?:_[0-7]+)*|0[bB][01]+(?:_[01]+)*|\d+(?:_\d+)*)n(?![\w$])|(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[oO][0-7]+(?:_[0-7]+)*|0[bB][01]+(?:_[01]+)*|(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][-+]?\d+(?:_\d+)*)?)(?![\w$]))"
    r"|(?P<private>\#(?:[^\W\d]|[$])[\w$\u200c\u200d]*)|(?P<id>(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%<>=!&|^~?:;,.(){}\[\]@])"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029]|\[(?:[^\]\\\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029])*\])+/[\w$]*")
_JS_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_AFTER_VALUE = frozenset(["ID", "NUM", "STR", "PRIVATE", "REGEX", "TEMPLATE", "TAIL", ")", "]", "}", "this", "super", "true", "false", "null", "++", "--", "get", "set", "of", "async", "static", "from", "as", "let"])


def javascript(text: str) -> Tokens:
    """Regular expressions are told from divisions by the token before; template literals come as a whole or as HEAD, MIDDLE
    and TAIL around their expressions."""
    kinds: list[str] = []
    starts: list[int] = []
    breaks: list[bool] = []
    at, size, fresh = 0, len(text), False
    if text.startswith("\ufeff"):
        at = 1
    if text.startswith("#!", at):
        at = next((k for k in (text.find("\n", at),) if k >= 0), size)
    braces: list[bool] = []  # for each open brace, whether it belongs to a template

    def add(kind: str, start: int) -> None:
        nonlocal fresh
        kinds.append(kind)
        starts.append(start)
        breaks.append(fresh)
        fresh = False

    def template(start: int, whole: str, part: str) -> int:
        end = _JS_CHUNK.match(text, start + 1).end()
        if end >= size:
            add(OPEN, start)
            return size
        if text[end] == "`":
            add(whole, start)
            return end + 1
        add(part, start)
        braces.append(True)
        return end + 2

    match = _JS.match
    while at < size:
        c = text[at]
        if c == "`":
            at = template(at, "TEMPLATE", "HEAD")
            continue
        if c == "}" and braces:
            if braces.pop():
                at = template(at, "TAIL", "MIDDLE")
                continue
        elif c == "{":
            braces.append(False)
        elif c == "/" and (not kinds or kinds[-1] not in _AFTER_VALUE) and (m := _JS_REGEX.match(text, at)):
            add("REGEX", at)
            at = m.end()
            continue
        m = match(text, at)
        if m is None:
            add(BAD, at)
            at += 1
            continue
        group = m.lastgroup
        if group == "nl":
            fresh = True
        elif group == "block":
            fresh = fresh or "\n" in m[0]
        elif group == "op":
            add(m[0], at)
        elif group == "id":
            add(m[0] if m[0] in JS_WORDS else "ID", at)
        elif group == "open":
            add(OPEN, at)
        elif group == "conflict":
            add(CONFLICT, at)
        elif group not in ("skip", "line"):
            add(group.upper(), at)
        at = m.end()
    fresh = True
    add(END, size)
    return Tokens(kinds, starts, breaks)


_PY_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
_PY = re.compile(
    r"(?P<skip>[ \t\f]+|\\\r?\n)|(?P<line>\#[^\r\n]*)|(?P<nl>\r\n?|\n)|(?m:^)" + r"(?P<conflict>(?:<{7}|>{7}|\|{7})(?=[ \t\r\n]|\Z)[^\n]*|={7}(?=\r?\n|\Z))" +
    rf"|(?P<str>{_PY_PREFIX}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'))|(?P<open>{_PY_PREFIX}[\"'])"
    r"|(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?![\d.eEjJ])|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?))(?!\w))"
    r"|(?P<id>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>=.,:;(){}\[\]])"
)
_PY_START = re.compile(r"[ \t\f]*")


def python(text: str) -> Tokens:
    """With NEWLINE, INDENT and DEDENT as the language defines them; a dedent to no open level is bad."""
    if text.startswith("\ufeff"):
        text = text[1:]
    kinds: list[str] = []
    starts: list[int] = []
    at, size, depth = 0, len(text), 0
    levels, line_start, pending = [(0, 0)], True, False
    match = _PY.match
    while at < size:
        if line_start and depth == 0:
            blank = _PY_START.match(text, at)
            end = blank.end()
            if end < size and text[end] in "#\r\n":
                m = match(text, end)
                at = m.end()
                if m.lastgroup == "line" and at < size:
                    at = match(text, at).end() if text[at] in "\r\n" else at
                continue
            if end >= size:
                break
            lead = blank[0].rpartition("\f")[2]
            level = (len(lead.expandtabs(8)), len(lead.expandtabs(1)))
            line_start = False
            if text[end] == "\\" and match(text, end) is not None and match(text, end).lastgroup == "skip":
                pass
            if level[0] > levels[-1][0]:
                kinds.append("INDENT" if level[1] > levels[-1][1] else BAD)
                starts.append(end)
                levels.append(level)
            else:
                while level[0] < levels[-1][0]:
                    levels.pop()
                    kinds.append("DEDENT")
                    starts.append(end)
                if level != levels[-1]:
                    kinds.append(BAD)
                    starts.append(end)
            at = end
        m = match(text, at)
        if m is None:
            kinds.append(BAD)
            starts.append(at)
            pending = True
            at += 1
            continue
        group = m.lastgroup
        if group == "nl":
            if depth == 0:
                if pending:
                    kinds.append("NEWLINE")
                    starts.append(at)
                pending, line_start = False, True
        elif group not in ("skip", "line"):
            if group == "op":
                kind = m[0]
                if kind in "([{":
                    depth += 1
                elif kind in ")]}" and depth:
                    depth -= 1
            elif group == "id":
                kind = m[0] if m[0] in PY_WORDS else "ID"
            else:
                kind = {"open": OPEN, "conflict": CONFLICT}.get(group) or group.upper()
            kinds.append(kind)
            starts.append(at)
            pending = True
        at = m.end()
    if pending:
        kinds.append("NEWLINE")
        starts.append(size)
    for _ in levels[1:]:
        kinds.append("DEDENT")
        starts.append(size)
    kinds.append(END)
    starts.append(size)
    return Tokens(kinds, starts, [False] * len(kinds))
