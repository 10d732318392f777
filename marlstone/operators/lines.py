"""Lines of texts and what ordered windows over them carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def line_array(text: Column) -> Column:
    """The lines of a text: they end at LF or CRLF, and a final line break opens no further line."""
    whole = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.split(whole, "\n", -1))


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no`` (from 1), ``line`` as ``line_array`` has them.

    Null and empty texts have no lines; a text of any length has all of its own.
    """
    rows = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(line_array(F.col(text))).alias("pos", "line"))
    return rows.select(key, (F.col("pos") + 1).alias("line_no"), "line")


def in_order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("line_no")


def block_comment_state(lines: DataFrame, key: str, opening: str = "/*", closing: str = "*/") -> DataFrame:
    """Adds ``in_block``: whether a block comment is open at the start of the line."""
    event = F.when(F.col("line").contains(closing), F.lit(False)).when(F.col("line").contains(opening), F.lit(True))
    before = in_order(key).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("in_block", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False)))


def brace_depth(lines: DataFrame, key: str) -> DataFrame:
    """Adds ``depth``: open braces behind the line."""
    delta = F.length("line") - F.length(F.replace("line", F.lit("{"), F.lit(""))) - (F.length("line") - F.length(F.replace("line", F.lit("}"), F.lit(""))))
    return lines.withColumn("depth", F.sum(delta).over(in_order(key).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def carry_last(lines: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null at or above the line."""
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(in_order(key).rowsBetween(Window.unboundedPreceding, 0)))


def full_signature(df: DataFrame, key: str, text: str, starts: str, most: int = 15) -> DataFrame:
    """``key, line_no, signature``: for each line that matches ``starts``, the lines up to the first with an open brace, at
    most ``most``, joined by spaces. They are taken from the line array of the text, so nothing is shuffled."""
    numbered = df.filter(F.col(text).isNotNull()).select(key, line_array(F.col(text)).alias("_a"))
    numbered = numbered.select(key, "_a", F.transform("_a", lambda x, k: F.struct((k + 1).alias("line_no"), x.alias("line"))).alias("_l"))

    def joined(x: Column) -> Column:
        ahead = F.slice("_a", x["line_no"], F.lit(most))
        stop = F.coalesce(F.array_position(F.transform(ahead, lambda y: F.contains(y, F.lit("{"))), F.lit(True)), F.lit(0)).cast("int")
        upto = F.when(stop > 0, F.slice("_a", x["line_no"], stop)).otherwise(ahead)
        return F.struct(x["line_no"].alias("line_no"), F.array_join(F.transform(upto, lambda y: F.trim(y)), " ").alias("signature"))

    found = F.transform(F.filter("_l", lambda x: x["line"].rlike(starts)), joined)
    return numbered.select(key, F.explode(found).alias("s")).select(key, "s.*")
