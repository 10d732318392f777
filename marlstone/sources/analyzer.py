"""Reports of an external analyser: nested JSON with detectors and their elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "success boolean, error string, results struct<detectors: array<struct<check: string, impact: string, confidence: string, description: string, "
    "elements: array<struct<type: string, name: string, source_mapping: struct<start: bigint, length: bigint, filename_relative: string, lines: array<int>>>>>>>"
)


def read_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``check, impact, confidence, description, file, line_no``: one row for each element; a report that says it failed is an
    error. With ``lines`` every line is a report of its own, which splits large files."""
    raw = spark.read.schema(SCHEMA).option("multiLine", str(not lines).lower()).json(path)
    return flatten_report(raw)


def flatten_report(raw: DataFrame) -> DataFrame:
    checked = raw.withColumn("results", F.when(F.coalesce("success", F.lit(True)), F.col("results")).otherwise(F.raise_error(F.coalesce("error", F.lit("the analyser failed"))).cast(raw.schema["results"].dataType)))
    d = checked.select(F.explode("results.detectors").alias("d"))
    e = d.select("d.check", "d.impact", "d.confidence", "d.description", F.explode_outer("d.elements").alias("e"))
    return e.select("check", "impact", "confidence", "description", F.col("e.source_mapping.filename_relative").alias("file"), F.array_min("e.source_mapping.lines").alias("line_no"))
