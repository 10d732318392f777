"""Scores and hashes as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the CVSS 3.1 specification.
_AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
_AC = {"L": 0.77, "H": 0.44}
_PR = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
_UI = {"N": 0.85, "R": 0.62}
_CIA = {"H": 0.56, "L": 0.22, "N": 0.0}


def _metric(vector: Column, name: str, weights: dict[str, float]) -> Column:
    """The weight of the letter that the vector gives the metric; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.regexp_extract(vector, rf"(?:^|/){name}:([A-Z])", 1))


def cvss_base_score(vector: Column) -> Column:
    """Base score of a CVSS 3.1 vector string; null if the vector is null or a metric is missing or unknown."""
    changed = F.regexp_extract(vector, r"(?:^|/)S:([UC])", 1) == "C"
    iss = 1 - (1 - _metric(vector, "C", _CIA)) * (1 - _metric(vector, "I", _CIA)) * (1 - _metric(vector, "A", _CIA))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    privileges = F.when(changed, _metric(vector, "PR", _PR["C"])).otherwise(_metric(vector, "PR", _PR["U"]))
    exploitability = 8.22 * _metric(vector, "AV", _AV) * _metric(vector, "AC", _AC) * privileges * _metric(vector, "UI", _UI)
    total = F.when(changed, 1.08 * (impact + exploitability)).otherwise(impact + exploitability)
    raw = F.least(F.lit(10.0), total)
    # round up to one decimal, in whole steps of 1e-5 so that binary fractions do not tip it
    steps = F.round(raw * 100000).cast("long")
    up = F.when(steps % 10000 == 0, steps / 100000.0).otherwise((F.floor(steps / 10000) + 1) / 10.0)
    return F.when(total.isNull(), None).when(impact <= 0, F.lit(0.0)).otherwise(up)


def poly_hash(text: Column) -> Column:
    """h = 31 h + byte over the UTF-8 bytes, modulo 2^64, as STRUCT<high, low> of two BIGINT halves of 32 bits; low alone is the
    hash modulo 2^32. Null for null."""
    mask = F.lit(0xFFFFFFFF)
    # one character for each byte, so that its code is the byte
    octets = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    zero = F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))

    def step(h: Column, c: Column) -> Column:
        low = h["low"] * 31 + F.ascii(c)
        return F.struct((h["high"] * 31 + F.shiftright(low, 32)).bitwiseAND(mask).alias("high"), low.bitwiseAND(mask).alias("low"))

    return F.when(text == "", zero).when(text.isNotNull(), F.aggregate(octets, zero, step))


def severity_rank(severity: Column) -> Column:
    """Critical 4 down to Info 0; null for other names."""
    return F.when(severity == "Critical", 4).when(severity == "High", 3).when(severity == "Medium", 2).when(severity == "Low", 1).when(severity == "Info", 0)


def severity_weight(severity: Column) -> Column:
    """Weights 10, 7, 4, 2 and 1 of the hotspot and risk sums."""
    return F.when(severity == "Critical", 10).when(severity == "High", 7).when(severity == "Medium", 4).when(severity == "Low", 2).when(severity == "Info", 1).otherwise(0)


def priority(cvss: Column, confidence_percent: Column) -> Column:
    """P1, P2 or P3 from the score weighted by confidence; null counts as P3."""
    value = cvss * confidence_percent / 100
    return F.when(value >= 7, "P1").when(value >= 4, "P2").otherwise("P3")


def sanitize_name(name: Column) -> Column:
    """Letters, digits and underscores only, runs of others as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
