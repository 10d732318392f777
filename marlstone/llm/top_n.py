"""Problem 5: the N best items of every group, by two-stage salted ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.paths import canonical_path


def latest_version(df: DataFrame, key: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the given order. The per-task group limit keeps a repeated key from piling up."""
    return df.withColumn("_v", F.row_number().over(Window.partitionBy(*key).orderBy(*newest_first))).filter("_v = 1").drop("_v")


def top_n_per_group(df: DataFrame, group: Sequence[str], best_first: Sequence[Column], identifier: str, n: int, salts: int = 32, rank_name: str = "rank_no") -> DataFrame:
    """The ``n`` first rows of every group in the order ``best_first``, numbered from 1 in ``rank_name``.

    Each group is hashed into ``salts`` subgroups by ``identifier``; every subgroup keeps its n first rows (and before the
    shuffle every task keeps its own n first of each subgroup), so the second ranking sees at most n * salts rows of a group
    whatever its size. ``best_first`` must end in a key that is unique within the group for a reproducible order.
    An empty input gives an empty result; a null group is a group of its own; the other columns pass through.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(identifier)), F.lit(salts)))
    first = Window.partitionBy(*group, "_salt").orderBy(*best_first)
    survivors = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_r", "_salt")
    second = Window.partitionBy(*group).orderBy(*best_first)
    return survivors.withColumn(rank_name, F.row_number().over(second)).filter(F.col(rank_name) <= n)


def top_findings(findings: DataFrame, n: int = 3, salts: int = 32) -> DataFrame:
    """``finding_id, rank_no`` and file and score of the n highest-scoring current findings of every file.

    The current version of a finding has the latest reported_at (then the latest ingested_at, then the higher score and the
    smaller path, so that the choice is defined). A current score that is null, NaN or outside 0 to 10 takes the finding
    out. Findings of a null path are left out, as no file is named. Equal scores go by finding_id. Repeated rows count once.
    """
    rows = findings.select("finding_id", "file_path", "cvss_score", "reported_at", "ingested_at").filter("finding_id is not null")
    order = [F.col("reported_at").desc_nulls_last(), F.col("ingested_at").desc_nulls_last(), F.col("cvss_score").desc_nulls_last(), F.col("file_path").asc_nulls_last()]
    current = (
        latest_version(rows, ["finding_id"], order)
        .filter(F.col("cvss_score").between(0.0, 10.0) & F.col("file_path").isNotNull())
        .select("finding_id", canonical_path(F.col("file_path")).alias("file"), "cvss_score")
    )
    return top_n_per_group(current, ["file"], [F.col("cvss_score").desc(), F.col("finding_id").asc()], "finding_id", n, salts)
