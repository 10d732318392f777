"""Problem 1: source files that do not parse, by packrat grammars that must consume the whole text."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.paths import canonical_path
from marlstone.llm.parsing import grammars, lexers
from marlstone.llm.parsing.peg import Recogniser, compile_grammar

#: Extension -> language.
EXTENSIONS = {"sol": "solidity", "js": "javascript", "json": "json", "py": "python"}
_LEXERS = {"solidity": lexers.solidity, "javascript": lexers.javascript, "json": lexers.json_tokens, "python": lexers.python}
_GRAMMARS = {"solidity": grammars.SOLIDITY, "javascript": grammars.JAVASCRIPT, "json": grammars.JSON, "python": grammars.PYTHON}
#: Rules that one token can open at most, one within the other.
_RULES_A_TOKEN = 40


class Report(NamedTuple):
    """valid; furthest: code points up to the token at which the parse stuck (null if valid); line of it, from 1; cause."""

    valid: bool
    furthest: int | None
    line: int | None
    cause: str | None


@lru_cache
def _recogniser(language: str) -> Recogniser:
    return compile_grammar(_GRAMMARS[language])


def _parse(text: str, language: str) -> tuple[bool, int, lexers.Tokens]:
    tokens = _LEXERS[language](text)
    # frames of the recogniser lie on the heap and their number follows the nesting, which the number of tokens bounds
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + _RULES_A_TOKEN * len(tokens.kinds)))
    end, far = _recogniser(language)(tokens.kinds, tokens.breaks)
    return end >= 0, far, tokens


def check_text(text: str, language: str) -> Report:
    """Parse ``text``. An empty or blank text is valid except as JSON.

    Causes: merge_conflict (markers outside of strings and comments), wrong_language (another grammar takes the whole text),
    truncated (all that was read is fine, but the text ends too early, or a string or comment never closes) and syntax.
    Nesting of any depth is parsed.
    """
    if language != "json" and not text.strip("﻿ \t\r\n\f\v"):
        return Report(True, None, None, None)
    valid, far, tokens = _parse(text, language)
    if valid:
        return Report(True, None, None, None)
    at = tokens.starts[far]
    if lexers.CONFLICT in tokens.kinds:
        cause = "merge_conflict"
    elif any(_parse(text, x)[0] for x in _LEXERS if x != language and text.strip()):
        cause = "wrong_language"
    elif tokens.kinds[far] in (lexers.END, lexers.OPEN) or (language == "python" and tokens.kinds[far] in ("NEWLINE", "DEDENT") and far >= len(tokens.kinds) - 4):
        cause = "truncated"
    else:
        cause = "syntax"
    return Report(False, at, text.count("\n", 0, at) + 1, cause)


_SCHEMA = "file_id bigint, repo string, path string, language string, valid boolean, furthest int, line int, cause string"
_ARROW = pa.schema([("file_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("furthest", pa.int32()), ("line", pa.int32()), ("cause", pa.string())])


def parse_reports(files: DataFrame) -> DataFrame:
    """One row for each file with a text and an extension of ``EXTENSIONS``: file_id, repo, path, language (of the extension),
    valid, furthest, line, cause. Rows without an id, path or text give none; repeated rows count once. Each file is parsed
    where it is read; only the narrow reports are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, repo, path, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                language = EXTENSIONS.get(path.strip().rpartition(".")[2].lower())
                if language:
                    rows.append((key, repo, path, language, *check_text(text, language)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    rows = files.select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", "content").filter("file_id is not null and path is not null and content is not null")
    return rows.mapInArrow(run, _SCHEMA).dropDuplicates(["file_id"])


def invalid_rates(reports: DataFrame) -> DataFrame:
    """``repo, language, files, invalid, share``: the share of files that do not parse, per repository and language."""
    grouped = reports.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return grouped.withColumn("share", F.col("invalid") / F.col("files"))


def scans_of_invalid(reports: DataFrame, entries: DataFrame) -> DataFrame:
    """``file_id, path, cause, scans, last_scan``: how often each file that does not parse was scanned all the same; 0 if never.

    Scans are counted per path before the join, so a path that holds most of the scans stays one row.
    """
    scans = entries.select("entry_id", canonical_path(F.col("file_path")).alias("file"), "scan_timestamp").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("scans"), F.max("scan_timestamp").alias("last_scan"))
    bad = reports.filter(~F.col("valid")).withColumn("file", canonical_path(F.col("path")))
    return bad.join(scans, "file", "left").select("file_id", "path", "cause", F.coalesce("scans", F.lit(0)).alias("scans"), "last_scan")
