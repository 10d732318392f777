"""Rule packs, and the scan of lines and of whole texts by them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.scoring import severity_rank
from marlstone.operators.lines import line_array

SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    pattern: str
    title: str
    multiline: bool = False


#: A neutral pack over the project's own texts; patterns use ASCII classes only, so every regex dialect agrees on them.
NEUTRAL = (
    Rule("N01", "Amounts", "Medium", r"[0-9]+\.[0-9]+%", "Share in percent"),
    Rule("N02", "Calls", "High", r"[a-z]+[A-Z][A-Za-z]*\(\)", "Named call"),
    Rule("N03", "Files", "Low", r"[A-Z][A-Za-z]+\.sol", "Named file"),
    Rule("N04", "Versions", "Info", r"v[0-9]+\.[0-9]+\.[0-9]+", "Named version"),
    Rule("N05", "Amounts", "Critical", r"[0-9]+\.[0-9]+ ether", "Amount in ether"),
    Rule("N06", "Calls", "Critical", r"\.call\{", "Low-level call"),
    Rule("N07", "Guards", "Info", r"revert\(", "Revert"),
    Rule("N08", "Guards", "Low", r"require\(", "Requirement"),
)
#: category, weakness id, CVSS vector, references in order, template of the narrative.
CATEGORIES = (
    ("Amounts", "W-682", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:H/A:L", ("ledger drift", "fee skew"), "An amount in {title} can be misread"),
    ("Calls", "W-841", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:N/I:H/A:H", ("reentry", "stale call", "front run"), "A call named by {title} can be replayed"),
    ("Files", None, "CVSS:3.1/AV:L/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N", (), "A file named by {title} may have moved"),
    ("Guards", "W-754", "CVSS:3.1/AV:N/AC:H/PR:L/UI:N/S:U/C:N/I:L/A:L", ("missing guard",), "The guard of {title} can be passed"),
)


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = NEUTRAL) -> DataFrame:
    """``rule_id, category, severity, pattern, title, multiline`` of a pack (the pack is a literal of the program)."""
    return spark.createDataFrame([(r.rule_id, r.category, r.severity, r.pattern, r.title, r.multiline) for r in rules], "rule_id string, category string, severity string, pattern string, title string, multiline boolean")


def categories_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, w, v, list(x), t) for c, w, v, x, t in CATEGORIES], "category string, weakness_id string, cvss_vector string, exploits array<string>, template string")


def override(rules: Sequence[Rule], disabled: Sequence[str] = (), severities: dict[str, str] | None = None) -> list[Rule]:
    """The pack without the disabled ids and with the given severities; an unknown severity becomes Medium."""
    wanted = severities or {}
    return [replace(r, severity=s if (s := wanted.get(r.rule_id, r.severity)) in SEVERITIES else "Medium") for r in rules if r.rule_id not in set(disabled)]


def scan_lines(df: DataFrame, key: str, text: str, rules: Sequence[Rule] = NEUTRAL, around: tuple[int, int] | None = None, carry: Sequence[Column] = ()) -> DataFrame:
    """``key, line_no, line, rule_id, rule_no, category, severity, rank, seq``: one row for each rule that a line matches.

    seq is the ordinal of emission in the text: rule by rule, line by line. ``around`` adds ``context``, the lines from so many
    above to so many below; ``carry`` are columns of the text that come along. The lines of a text stay in its row until they match: all patterns are literals in one projection,
    each compiled once a task, and neighbours and ordinals are read off the arrays, so nothing is joined or shuffled.
    Multi-line rules are left to ``scan_texts``. Null texts have no rows.
    """
    lines = df.filter(F.col(text).isNotNull()).select(key, line_array(F.col(text)).alias("_a"), *carry)
    along = lines.columns[2:]
    lines = lines.select(key, "_a", F.transform("_a", lambda x, k: F.struct((k + 1).alias("line_no"), x.alias("line"))).alias("_l"), *along)

    def hit(n: int, r: Rule) -> Column:
        def row(x: Column) -> Column:
            own = [x["line_no"].alias("line_no"), x["line"].alias("line"), F.lit(r.rule_id).alias("rule_id"), F.lit(n).alias("rule_no"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity")]
            if around:
                first = F.greatest(F.lit(1), x["line_no"] - around[0])
                own.append(F.array_join(F.slice("_a", first, x["line_no"] + around[1] - first + 1), "\n").alias("context"))
            return F.struct(*own)

        return F.transform(F.filter("_l", lambda x: x["line"].rlike(r.pattern)), row)

    by_line = [hit(n, r) for n, r in enumerate(rules) if not r.multiline]
    if not by_line:
        by_line = [F.transform(F.slice("_l", 1, 0), lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), *(F.lit("").alias(c) if c != "rule_no" else F.lit(0).alias(c) for c in ("rule_id", "rule_no", "category", "severity"))))]
    rows = lines.select(key, *along, F.posexplode(F.flatten(F.array(*by_line))).alias("_at", "h"))
    return rows.select(key, "h.*", *along, (F.col("_at") + 1).alias("seq")).withColumn("rank", severity_rank(F.col("severity")))


_PLACES = "match_no int, start_line int, end_line int, n_chars int"


def scan_texts(df: DataFrame, key: str, text: str, rules: Sequence[Rule | str]) -> DataFrame:
    """``key, rule_id, rule_no, category, severity, rank, match_no, start_line, end_line, n_chars``: one row for each
    non-overlapping match of a pattern over the whole text, wherever it lies; a match that holds no character gives none.

    The patterns run over Arrow batches with the offsets of each match; line breaks (LF) are counted once, from match to
    match. A bare pattern is a rule of its own name. Null texts have no rows.
    """
    pack = [r if isinstance(r, Rule) else Rule(r, "", "Info", r, r, True) for r in rules]
    kind = df.schema[key].dataType.simpleString()
    columns = ("rule_no", *(c.split()[0] for c in _PLACES.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern) for r in pack]
        for batch in batches:
            at, out = [], [[] for _ in columns]
            for k, t in enumerate(batch.column(1).to_pylist()):
                for n, p in enumerate(patterns):
                    place, line, number = 0, 1, 0
                    for m in p.finditer(t):
                        if m.end() == m.start():
                            continue
                        line += t.count("\n", place, m.start())
                        place, number = m.start(), number + 1
                        at.append(k)
                        for column, value in zip(out, (n, number, line, line + t.count("\n", m.start(), m.end()), m.end() - m.start()), strict=True):
                            column.append(value)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int32()) for c in out)], names=[key, *columns])

    rows = df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, rule_no int, {_PLACES}")
    of_rule = lambda f: F.element_at(F.array(*(F.lit(f(r)) for r in pack)), F.col("rule_no") + 1)
    named = rows.select(key, of_rule(lambda r: r.rule_id).alias("rule_id"), "rule_no", of_rule(lambda r: r.category).alias("category"), of_rule(lambda r: r.severity).alias("severity"), *columns[1:])
    return named.withColumn("rank", severity_rank(F.col("severity")))


def scan_pack(df: DataFrame, key: str, text: str, rules: Sequence[Rule] = NEUTRAL) -> DataFrame:
    """``key, rule_id, rule_no, category, severity, rank, start_line, end_line``: all rules of a pack, those for one line and
    those that span lines. rule_no counts within the whole pack."""
    place = {r.rule_id: n for n, r in enumerate(rules)}
    by_line, spanning = [r for r in rules if not r.multiline], [r for r in rules if r.multiline]
    columns = [key, "rule_id", "category", "severity", "rank", "start_line", "end_line"]
    found = scan_lines(df, key, text, by_line).withColumn("start_line", F.col("line_no")).withColumn("end_line", F.col("line_no")).select(*columns)
    if spanning:
        found = found.unionByName(scan_texts(df, key, text, spanning).select(*columns))
    numbers = F.create_map(*(F.lit(x) for pair in place.items() for x in pair)) if place else F.lit(None).cast("map<string,int>")
    return found.withColumn("rule_no", F.try_element_at(numbers, F.col("rule_id")))
