"""Call and inheritance graphs of sources."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.lines import in_order
from marlstone.session import cut

#: Rounds after which what is known is written as one table, so that plans stay short.
_FOLD = 8
DECLARED = r"function\s+([A-Za-z_$][A-Za-z0-9_$]*)"


def declared_function(line: Column) -> Column:
    """The name of the function that the line declares, else null."""
    name = F.regexp_extract(line, DECLARED, 1)
    return F.when(name != "", name)


def function_lines(lines: DataFrame, key: str) -> DataFrame:
    """Adds ``fn``, the nearest function declared at or above the line."""
    return lines.withColumn("fn", F.last(declared_function(F.col("line")), ignorenulls=True).over(in_order(key).rowsBetween(Window.unboundedPreceding, 0)))


def reach(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``a, b, hops``: for edges (a, b) all pairs with the fewest hops, up to ``depth`` unless it is None. Rounds stop when none
    is new."""
    step = cut(edges.select("a", "b").filter("a is not null and b is not null").distinct())
    known = step.withColumn("hops", F.lit(1))
    fresh = known
    for n in count(2) if depth is None else range(2, depth + 1):
        further = fresh.select("a", F.col("b").alias("m")).join(step.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        fresh = cut(further.join(known, ["a", "b"], "left_anti").withColumn("hops", F.lit(n)))
        if fresh.limit(1).count() == 0:
            break
        known = known.unionByName(fresh) if n % _FOLD else cut(known.unionByName(fresh))
    return known


def reachable_from(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node``: the start nodes and all that edges (a, b) lead to from them. Only the newest nodes go on in each round, so the
    work follows the reached edges and no pairs are made; rounds end when none is new, however long the paths."""
    step = cut(edges.select("a", "b").filter("a is not null and b is not null").distinct())
    fresh = known = cut(start.select("node").filter("node is not null").distinct())
    for n in count(1):
        if fresh.isEmpty():
            return known
        further = step.join(fresh.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        fresh = cut(further.join(known, "node", "left_anti"))
        known = known.unionByName(fresh) if n % _FOLD else cut(known.unionByName(fresh))
    raise AssertionError


def two_cycles(edges: DataFrame, *by: str) -> DataFrame:
    """``a, b`` with a < b where both directions are edges, within each value of the columns ``by``. Both directions meet as one
    pair, so a single aggregation decides."""
    e = edges.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") < F.col("b")).alias("_up")).filter("a <> b")
    return e.groupBy(*by, "a", "b").agg(F.min("_up").alias("_all"), F.max("_up").alias("_any")).filter("_any and not _all").select(*by, "a", "b")


def call_before_write(lines: DataFrame, key: str, call: Column, write: Column) -> DataFrame:
    """``key, fn, call_line, write_line``: writes below the latest external call of the same function."""
    w = Window.partitionBy(key, "fn").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = function_lines(lines, key).filter("fn is not null").withColumn("call_line", F.last(F.when(call, F.col("line_no")), ignorenulls=True).over(w))
    return rows.filter(write & F.col("call_line").isNotNull()).select(key, "fn", "call_line", F.col("line_no").alias("write_line"))
