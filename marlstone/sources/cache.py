"""Scan cache: a table of whole findings by file, content hash and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL_SECONDS = 168 * 3600


def split_by_cache(files: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(files that must be scanned, cached findings that still hold). Files have file and hash, the cache file, hash and
    scanned_at (TIMESTAMP) besides the findings; an entry holds if path and hash agree and it is no older than the TTL."""
    fresh = cache.filter(F.unix_timestamp(now) - F.unix_timestamp("scanned_at") <= ttl_seconds)
    keys = fresh.select("file", "hash").distinct()
    return files.join(keys, ["file", "hash"], "left_anti"), fresh.join(files.select("file", "hash").distinct(), ["file", "hash"], "left_semi")


def merge_cache(cache: DataFrame, update: DataFrame) -> DataFrame:
    """The rows of the latest scan of each file."""
    both = cache.unionByName(update)
    newest = F.max("scanned_at").over(Window.partitionBy("file"))
    return both.withColumn("_at", newest).filter(F.col("scanned_at") == F.col("_at")).drop("_at")


def save_cache(cache: DataFrame, update: DataFrame, path: str) -> None:
    """Writes the merged cache as a new table; the old one may lie anywhere but there."""
    merge_cache(cache, update).write.mode("errorifexists").parquet(path)
