"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name``; one file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores where the files have fewer pieces than there are cores (few row groups), by a hash of the key.
    Large tables have more pieces than cores and stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
