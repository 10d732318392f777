"""Problem 4: the best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.paths import canonical_path
from marlstone.session import cut

# What stands in for a missing value (compared without case and outer white space).
STAND_INS = ("", "-", "--", "---", ".", "..", "...", "…", "?", "??", "???", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "undefined", "unspecified", "not available", "not applicable", "not set", "tbd", "tba", "todo", "to do", "fixme", "see above", "see below", "as above", "same as above", "same", "ditto", "placeholder", "empty", "missing", "<none>", "<null>", "<empty>", "(none)", "(null)", "(empty)", "[none]", "xxx", "x")
_EDGE = 8
FIELDS = ("title", "line", "confidence", "recommendation")


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def usable_text(value: Column) -> Column:
    """Present and not a mere stand-in."""
    return value.isNotNull() & ~F.lower(_trimmed(value)).isin(*STAND_INS)


def bare(value: Column) -> Column:
    """The value without outer white space and marks of omission."""
    return F.regexp_replace(value, r"^(?:[\s\p{Z}]|\.{2,}|…)+|(?:[\s\p{Z}]|\.{2,}|…|\[…\]|\[\.{3}\])+$", "")


def without_cut_off(values: DataFrame) -> DataFrame:
    """Of distinct ``(grp, field, bare)`` rows (other columns stay), those that are not the beginning of a longer value of the
    same grp and field.

    In code-unit order the values that begin with v follow v directly, so one look at the next value decides. The order runs
    within rows that share the first letters, which splits a large group. A shorter value is looked up among the beginnings
    of the others, which are made only where a grp and field have such a value.
    """
    keys = ["grp", "field"]
    w = Window.partitionBy(*keys, F.substring("bare", 1, _EDGE)).orderBy("bare")
    is_short = F.length("bare") < _EDGE
    marked = values.withColumn("_next", F.lead("bare").over(w)).filter(is_short | ~F.coalesce(F.expr("startswith(_next, bare)"), F.lit(False))).drop("_next")
    short = values.filter(is_short).select(*keys, "bare")
    beside = values.select(*keys, "bare").filter(F.length("bare") > 1).join(short.select(*keys).distinct(), keys, "left_semi")
    starts = beside.select(*keys, F.explode(F.expr(f"transform(sequence(1, least({_EDGE - 1}, length(bare) - 1)), k -> substring(bare, 1, k))")).alias("bare")).distinct()
    return marked.join(starts.join(short, [*keys, "bare"], "left_semi"), [*keys, "bare"], "left_anti")


def cached_records(entries: DataFrame, origins: DataFrame) -> DataFrame:
    """One row for each cached finding, with the key of its group, its trust and its scan time.

    Rows without a path, category, snippet or vuln_id name no finding and are left out; an origin that is not in ``origins``
    has the lowest trust. Repeated rows stay, as all that follows takes the largest of them.
    """
    trust = origins.groupBy("origin").agg(F.max("trust").alias("trust"))
    v = entries.select("file_path", "origin", "scan_timestamp", F.explode("vulnerabilities").alias("v")).filter("v is not null")
    flat = v.select(
        F.unhex(F.md5(F.to_json(F.array(canonical_path(F.col("file_path")), F.col("v.category"), F.regexp_replace("v.code_snippet", r"[\s\p{Z}]+", ""))).cast("binary"))).alias("grp"),
        "origin", "scan_timestamp", F.col("v.vuln_id").alias("vuln_id"), F.col("v.title").alias("title"), F.col("v.line_number").alias("line"), F.col("v.confidence").alias("confidence"), F.col("v.recommendation").alias("recommendation"),
    ).filter(F.col("vuln_id").isNotNull() & F.col("v.category").isNotNull() & F.col("v.code_snippet").isNotNull() & F.col("file_path").isNotNull())
    return flat.join(trust, "origin", "left").withColumn("trust", F.coalesce("trust", F.lit(-2147483648)))


def best_records(entries: DataFrame, origins: DataFrame, values: bool = True) -> DataFrame:
    """For each finding with two or more records: the record that supplies each field, and the value (if ``values``).

    Columns: group_vuln_id, then for title, line, confidence and recommendation ``<field>_vuln_id`` (0 if none can) and
    ``<field>``. Completeness decides first (a value that is absent, a stand-in or cut off cannot supply), then trust, then
    the latest scan, then the smallest vuln_id. Each record becomes three rows: its title, its recommendation and the rest.
    Equal values are brought together with their best record before and after the first shuffle of the texts, the cut-off ones
    are dropped in a window, and the best of each field is the largest (trust, scan, vuln_id) of the group; every step is
    split below the group or combined on the map side, so a hot group stays spread.
    """
    records = cached_records(entries, origins)

    def ranked(field: str, usable: Column) -> Column:
        parts = [F.col("trust"), F.col("scan_timestamp").alias("at"), (-F.col("vuln_id")).alias("less"), *([F.col(field).cast("string").alias("value")] if values else [])]
        return F.when(usable, F.struct(*parts))

    best = {f: ranked(f, usable_text(F.col(f))) for f in ("title", "confidence", "recommendation")} | {"line": ranked("line", F.col("line") >= 1)}
    none = F.lit(None)
    row = lambda field, bare_value, own, rest: F.struct(F.lit(field).alias("field"), bare_value.alias("bare"), own.alias("best"), *((x if rest else none.cast(t)).alias(n) for n, x, t in (("line", best["line"], kind), ("confidence", best["confidence"], kind), ("id", F.col("vuln_id"), "bigint"))))
    kind = records.select(best["title"].alias("b")).schema["b"].dataType
    rows = F.array_compact(F.array(*(F.when(best[f].isNotNull(), row(f, bare(F.col(f)), best[f], False)) for f in ("title", "recommendation")), row("", none.cast("string"), none.cast(kind), True)))
    long = records.select("grp", F.explode(rows).alias("r")).select("grp", "r.*")
    texts = cut(long.groupBy("grp", "field", "bare").agg(F.max("best").alias("best"), F.max("line").alias("line"), F.max("confidence").alias("confidence"), F.min("id").alias("first"), F.max("id").alias("last")))
    whole = without_cut_off(texts.filter("field <> ''").select("grp", "field", "bare", "best")).select("grp", "field", "best", *(none.cast(t).alias(n) for n, t in (("line", kind), ("confidence", kind), ("first", "bigint"), ("last", "bigint"))))
    both = whole.unionByName(texts.filter("field = ''").drop("bare"))
    wide = both.groupBy("grp").agg(*(F.max(F.when(F.col("field") == f, F.col("best"))).alias(f) for f in ("title", "recommendation")), F.max("line").alias("line"), F.max("confidence").alias("confidence"), F.min("first").alias("group_vuln_id"), F.max("last").alias("_last")).filter("group_vuln_id < _last")
    supplied = lambda f: [F.coalesce(-F.col(f)["less"], F.lit(0)).alias(f"{f}_vuln_id"), *([F.col(f)["value"].alias(f)] if values else [])]
    return wide.select("group_vuln_id", *(c for f in FIELDS for c in supplied(f)))
