"""Source files and snapshots of them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read_sources(spark: SparkSession, directory: str, glob: str = "*.sol", size_cap: int | None = None) -> DataFrame:
    """``file, content, length, left_out``: every file below the directory whose name fits the glob. With a ``size_cap``, the
    content of larger files is null and left_out says so; without, no file is left out. Bytes that are not UTF-8 become
    replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(directory)
    text, over = F.decode("content", "UTF-8"), F.lit(False) if size_cap is None else F.col("length") > size_cap
    return raw.select(F.col("path").alias("file"), F.when(~over, text).alias("content"), "length", over.alias("left_out"))


def glob_pattern(glob: str) -> str:
    """The glob as an anchored regular expression: ``*`` and ``**`` take any characters, ``?`` one, ``[...]`` a set."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            while glob[k + 1 : k + 2] == "*":
                k += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = glob[k + 1 : close].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            k = close
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """Whether any of the globs fits the path."""
    return reduce(lambda a, g: a | path.rlike(glob_pattern(g)), globs, F.lit(False))


def changed_since(new: DataFrame, old: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``new`` that the older manifest does not hold."""
    return new.join(old.select(*on).distinct(), list(on), "left_anti")


def manifest(files: DataFrame) -> DataFrame:
    """``file, hash`` of a snapshot."""
    return files.select("file", F.sha2("content", 256).alias("hash"))
