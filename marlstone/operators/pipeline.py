"""One scan from texts to findings, with its switches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.findings import dedup_exact, dedup_greedy, fingerprint
from marlstone.operators.predicates import Predicate, text_flags, without_noise
from marlstone.operators.rules import SEVERITIES, Rule, scan_lines, scan_texts
from marlstone.sources.files import excluded


@dataclass(frozen=True)
class Options:
    """Which steps run. ``exclude`` are globs over ``path``; ``min_severity`` is the lowest that stays; ``merge_window`` is the
    reach of the greedy merge in lines (0: no merge)."""

    line_rules: bool = True
    multiline_rules: bool = True
    predicates: bool = True
    exact_dedup: bool = True
    merge_window: int = 0
    min_severity: str = "Info"
    exclude: tuple[str, ...] = ()

    @classmethod
    def from_settings(cls, settings: dict) -> Options:
        """Options from the ``[settings]`` of a configuration; names it does not know are left alone."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items() if k in known})


def scan(texts: DataFrame, key: str, text: str, rules: Sequence[Rule], options: Options = Options(), predicates: Sequence[Predicate] = (), path: str | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """``key, rule_id, category, severity, rank, start_line, end_line, line, seq, print``: the findings of a pack under the
    options. seq orders them by rule, then by line; line is the first line of the match (null for rules that span lines) and
    print the fingerprint, whose rows in ``baseline`` (``print``) are left out. Null texts have none."""
    if options.min_severity not in SEVERITIES:
        raise ValueError(f"severities are {SEVERITIES}, not {options.min_severity}")
    rows = texts if path is None or not options.exclude else texts.filter(~F.coalesce(excluded(F.col(path), options.exclude), F.lit(False)))
    order = {r.rule_id: n for n, r in enumerate(rules)}
    by_line = [r for r in rules if not r.multiline and options.line_rules]
    spanning = [r for r in rules if r.multiline and options.multiline_rules]
    active = list(predicates) if options.predicates else []
    columns = [key, "rule_id", "category", "severity", "rank", "start_line", "end_line", "line"]
    found = scan_lines(rows, key, text, by_line, (5, 1), text_flags(active, text)).withColumn("start_line", F.col("line_no")).withColumn("end_line", F.col("line_no"))
    found = without_noise(found, active).select(*columns)
    if spanning:
        found = found.unionByName(scan_texts(rows, key, text, spanning).withColumn("line", F.lit(None).cast("string")).select(*columns))
    found = found.filter(F.col("rank") >= SEVERITIES.index(options.min_severity))
    if order:
        numbers = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
        found = found.withColumn("seq", F.try_element_at(numbers, F.col("rule_id")).cast("long") * 2**32 + F.col("start_line"))
    else:
        found = found.withColumn("seq", F.lit(0).cast("long"))
    found = found.withColumn("line_no", F.col("start_line"))
    if options.exact_dedup:
        found = dedup_exact(found, key)
    if options.merge_window:
        found = found.join(dedup_greedy(found, key, options.merge_window).select(key, "seq"), [key, "seq"], "left_semi")
    found = found.withColumn("print", fingerprint(F.col("category"), F.col("rule_id"), F.col("start_line"), F.coalesce("line", F.lit(""))))
    if baseline is not None:
        found = found.join(baseline.select("print").distinct(), "print", "left_anti")
    return found.select(*columns, "seq", "print")
