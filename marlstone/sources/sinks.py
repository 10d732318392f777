"""Report sinks: nested JSON, SARIF parts, baselines and Markdown."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note", "Info": "note"}


def nested_results(findings: DataFrame, key: str) -> DataFrame:
    """``key, total, results``: one row a file, its findings as an array in the order of lines. A document of one file holds
    all of its findings, which is the format; ``listing`` and ``sarif_results`` give one row a finding instead."""
    rows = findings.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct("line_no", "seq", "rule_id", "severity"))).alias("x"))
    return rows.select(key, "total", F.transform("x", lambda x: F.struct(x["rule_id"].alias("rule_id"), x["line_no"].alias("line_no"), x["severity"].alias("severity"))).alias("results"))


def write_json(findings: DataFrame, key: str, path: str) -> None:
    """One JSON document a file below ``path``."""
    nested_results(findings, key).write.mode("overwrite").json(path)


_BADGES = {"Critical": "[C]", "High": "[H]", "Medium": "[M]", "Low": "[L]"}


def _badge(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == s, b) for s, b in _BADGES.items()), F.lit("[I]"))


def listing(findings: DataFrame, key: str) -> DataFrame:
    """``key, place, text``: the lines of a terminal listing: of each file a head (place 0) and its findings, worst first.
    Ordered by key and place they can be written as text; no file is brought together in one row."""
    heads = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit(0).alias("place"), F.concat(F.col(key).cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" findings")).alias("text"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("rank").desc(), "line_no", "seq"))
    rows = findings.select(key, place.alias("place"), F.concat(F.lit("  "), _badge(F.col("severity")), F.lit(" line "), F.col("line_no").cast("string"), F.lit(" "), F.col("rule_id")).alias("text"))
    return heads.unionByName(rows)


def markdown_tables(findings: DataFrame) -> DataFrame:
    """``part, place, text``: the rows of the tables by severity (part 1) and by category (part 2) of a Markdown report."""

    def part(number: int, column: str) -> DataFrame:
        counts = findings.groupBy(column).agg(F.count(F.lit(1)).alias("n"))  # a handful of rows
        place = F.row_number().over(Window.orderBy(F.col("n").desc(), column))
        return counts.select(F.lit(number).alias("part"), place.alias("place"), F.concat(F.lit("| "), F.col(column), F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("text"))

    return part(1, "severity").unionByName(part(2, "category"))


def matrix(findings: DataFrame, by: str) -> DataFrame:
    """``by`` and the number of findings of each severity."""
    return findings.groupBy(by).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low", "Info")))


def write_report(findings: DataFrame, key: str, path: str, title: str = "Findings") -> str:
    """A Markdown report as text files below ``path/<time>``, in order: title, tables, then the findings of each file. Returns
    that folder. The parts are sorted in the cluster; nothing is collected."""
    folder = f"{path.rstrip('/')}/{datetime.now(timezone.utc):%Y%m%d-%H%M%S}"
    spark = findings.sparkSession
    none = lambda n, text: (n, "", 0, text)
    heads = spark.createDataFrame([none(0, f"# {title}"), none(1, "| name | findings |\n| --- | --- |"), none(3, "## Files")], "part int, name string, place int, text string")
    tables = markdown_tables(findings).select(F.lit(2).alias("part"), F.lit("").alias("name"), (F.col("part") * 1000 + F.col("place")).cast("int").alias("place"), "text")
    files = listing(findings, key).select(F.lit(4).alias("part"), F.lpad(F.col(key).cast("string"), 20, "0").alias("name"), "place", F.when(F.col("place") == 0, F.concat(F.lit("### "), F.col("text"))).otherwise(F.concat(F.lit("- "), F.trim("text"))).alias("text"))
    heads.unionByName(tables).unionByName(files).orderBy("part", "name", "place").select("text").write.text(folder)
    return folder


def sarif_rules(findings: DataFrame, key: str) -> DataFrame:
    """``rule_id, first_doc, first_line, level``: the rules of a SARIF report, each described by its first finding."""
    first = findings.groupBy("rule_id").agg(F.min(F.struct(key, "seq", "line_no", "severity")).alias("f"))
    level = F.when(F.col("f.severity").isin("Critical", "High"), "error").when(F.col("f.severity") == "Medium", "warning").otherwise("note")
    return first.select("rule_id", F.col(f"f.{key}").alias("first_doc"), F.col("f.line_no").alias("first_line"), level.alias("level"))


def sarif_results(findings: DataFrame, key: str) -> DataFrame:
    """``value``: one SARIF result object a row, for a text sink that an assembler wraps."""
    level = F.when(F.col("severity").isin("Critical", "High"), "error").when(F.col("severity") == "Medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col(key).cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.array(place).alias("locations"))).alias("value"))


def write_baseline(prints: DataFrame, path: str) -> None:
    """The fingerprints, one a line."""
    prints.select("print").distinct().write.mode("overwrite").text(path)


def read_baseline(spark, path: str) -> DataFrame:  # noqa: ANN001
    return spark.read.text(path).withColumnRenamed("value", "print")


def sarif_document(rules: Sequence[dict], results: Sequence[dict], tool: str = "marlstone", version: str = "0.1.0") -> str:
    """A SARIF 2.1.0 document around collected rules and results of a bounded report."""
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": sorted(rules, key=lambda r: r["id"])}}, "results": list(results)}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)
