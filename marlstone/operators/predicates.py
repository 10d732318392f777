"""Context predicates as data: a table of what makes a finding noise, compiled to columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPES = ("line", "context", "text")


@dataclass(frozen=True)
class Predicate:
    """Findings of ``categories`` (all if empty) are noise where the scope matches one of ``any_of`` (or where that is empty)
    and none of ``none_of``. The scope is the line itself, the lines around it or the whole text; patterns are regular
    expressions."""

    name: str
    scope: str
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()


def _holds(p: Predicate, value: Column) -> Column:
    """Whether a predicate's patterns hold for the value; a null matches nothing."""
    matches = lambda patterns: reduce(lambda a, b: a | b, (F.coalesce(value.rlike(x), F.lit(False)) for x in patterns), F.lit(False))
    return (matches(p.any_of) if p.any_of else F.lit(True)) & ~matches(p.none_of)


def text_flags(predicates: Sequence[Predicate], text: str) -> list[Column]:
    """For every predicate on the whole text a column ``_p_<name>``, so that texts need not travel with their findings."""
    return [_holds(p, F.col(text)).alias(f"_p_{p.name}") for p in predicates if p.scope == "text"]


def noise(predicates: Sequence[Predicate]) -> Column:
    """The name of the first predicate that makes the finding noise, else null. Findings have category, line, context and the
    flags of ``text_flags``."""
    unknown = [p.scope for p in predicates if p.scope not in SCOPES]
    if unknown:
        raise ValueError(f"scopes are {SCOPES}, not {unknown}")

    def hit(p: Predicate) -> Column:
        holds = F.col(f"_p_{p.name}") if p.scope == "text" else _holds(p, F.col(p.scope))
        return F.when((F.col("category").isin(*p.categories) if p.categories else F.lit(True)) & holds, F.lit(p.name))

    return F.coalesce(*map(hit, predicates), F.lit(None).cast("string"))


def without_noise(findings: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    flags = [c for c in findings.columns if c.startswith("_p_")]
    return findings.filter(noise(predicates).isNull()).drop(*flags)


def features(df: DataFrame, key: str, text: str, flags: dict[str, str], values: dict[str, tuple[str, int]]) -> DataFrame:
    """``key`` with a BOOLEAN for each of ``flags`` (name -> pattern) and a STRING for each of ``values`` (name -> pattern and
    group; null where nothing matches), in one projection. A null text has no flag and no value."""
    c = F.col(text)
    found = [F.coalesce(c.rlike(p), F.lit(False)).alias(n) for n, p in flags.items()]
    return df.select(key, *found, *(F.when(c.rlike(p), F.regexp_extract(c, p, g)).alias(n) for n, (p, g) in values.items()))
