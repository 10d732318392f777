"""Filters, joins, de-duplication and roll-ups of findings.

A finding has at least key, line_no, category, severity, rank and seq, the place in which it was emitted: order is data here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.scoring import poly_hash, severity_weight


def fingerprint(category: Column, title: Column, line_no: Column, snippet: Column) -> Column:
    """category:title:line:hash of the snippet, hexadecimal."""
    half = lambda h, part: F.lower(F.lpad(F.hex(h[part]), 8, "0"))
    # over an array of one, so that both halves come from one fold
    digits = F.transform(F.array(poly_hash(snippet)), lambda h: F.concat(half(h, "high"), half(h, "low")))
    return F.concat_ws(":", category, title, line_no.cast("string"), F.element_at(digits, 1))


def drop_near(new: DataFrame, base: DataFrame, key: str, band: int = 3) -> DataFrame:
    """``new`` without the rows that have a ``base`` row of the same key and category within ``band`` lines.

    The band becomes an equality: each row of base is put into its own and the neighbouring buckets of band + 1 lines, so
    that the anti join has keys to shuffle by.
    """
    width = band + 1
    b = base.select(F.col(key).alias("_k"), F.col("category").alias("_c"), F.col("line_no").alias("_l"), F.explode(F.array(*(F.floor(F.col("line_no") / width) + d for d in (-1, 0, 1)))).alias("_b"))
    a = new.withColumn("_bucket", F.floor(F.col("line_no") / width))
    on = (F.col(key) == F.col("_k")) & (F.col("category") == F.col("_c")) & (F.col("_bucket") == F.col("_b")) & (F.abs(F.col("line_no") - F.col("_l")) <= band)
    return a.join(b, on, "left_anti").drop("_bucket")


def dedup_exact(findings: DataFrame, key: str) -> DataFrame:
    """The first finding of each line and category."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(key, "line_no", "category").orderBy("seq"))).filter("_n = 1").drop("_n")


def dedup_adjacent(findings: DataFrame, key: str) -> DataFrame:
    """Without the rows whose predecessor by line and seq has the same line and category; only neighbours are compared."""
    w = Window.partitionBy(key).orderBy("line_no", "seq")
    same = (F.lag("line_no").over(w) == F.col("line_no")) & (F.lag("category").over(w) == F.col("category"))
    return findings.withColumn("_same", F.coalesce(same, F.lit(False))).filter(~F.col("_same")).drop("_same")


def greedy_merge(rows: Sequence[tuple[int, str, int, int]], window: int) -> list[int]:
    """The seq of the rows (seq, group, line, rank) that stay: a row within ``window`` lines of a kept one of its group goes
    unless it ranks higher, in which case it takes that one's place. Of several kept ones the first kept decides.

    Kept rows lie in buckets of window + 1 lines, so a row looks at three buckets, however many are kept.
    """
    width = window + 1
    kept: list[tuple[int, str, int, int]] = []
    buckets: dict[tuple[str, int], list[int]] = {}
    for row in sorted(rows):
        _, group, line, rank = row
        home = line // width
        near = [k for d in (-1, 0, 1) for k in buckets.get((group, home + d), ()) if abs(kept[k][2] - line) <= window]
        if not near:
            buckets.setdefault((group, home), []).append(len(kept))
            kept.append(row)
        elif rank > kept[first := min(near)][3]:
            buckets[group, kept[first][2] // width].remove(first)
            buckets.setdefault((group, home), []).append(first)
            kept[first] = row
    return sorted(r[0] for r in kept)


def dedup_greedy(findings: DataFrame, key: str, window: int = 30, group: Column | None = None) -> DataFrame:
    """``key, seq, category, line_no, rank`` after the order-dependent merge of findings of one group within ``window`` lines.
    The group of a finding is its category, or ``group``, which maps several categories to one.

    The merge is not transitive, so it is a fold in order of seq. Groups do not meet in it: rows are brought together by key
    and group and sorted, and the fold runs over whole partitions with one open (key, group) at a time.
    """
    rows = findings.select(key, (F.col("category") if group is None else group).alias("_group"), "seq", "category", "line_no", "rank")
    out = rows.drop("_group").schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, schema = None, [], None

        def close() -> list[tuple]:
            stay = set(greedy_merge([(r[2], "", r[4], r[5]) for r in held], window))
            return [(r[0], *r[2:]) for r in held if r[2] in stay]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            schema, done = pa.schema([f for f in batch.schema if f.name != "_group"]), []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != open_key:
                    done += close()
                    open_key, held = row[:2], []
                held.append(row)
            yield batch_of(done)
        if schema is not None:
            yield batch_of(close())

    return rows.repartition(key, "_group").sortWithinPartitions(key, "_group", "seq").mapInArrow(fold, out)


def drop_covered(findings: DataFrame, key: str, general: Column) -> DataFrame:
    """Without the general rows whose key and category also have a specific one."""
    specific = findings.filter(~general).select(key, "category").distinct()
    return findings.filter(general).join(specific, [key, "category"], "left_anti").unionByName(findings.filter(~general))


def best_matches(left: DataFrame, right: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """``key, left_id, right_id, score``: greedy one-to-one choice: left rows in order of id each take the best free right row
    above ``least``; ties go to the smaller right id. Rows of either side without a partner come with nulls.

    The choice of one left row changes what is left for the next, so it is a fold over the candidates of one key in order; only
    candidates above ``least`` take part, one key is open at a time, and of it the taken right ids are held.
    """
    scored = match_scores(left, right, key).filter(F.col("score") > least)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, taken, placed = None, set(), None
        for batch in batches:
            keep = []
            for n, (k, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if k != open_key:
                    open_key, taken, placed = k, set(), None
                if a != placed and b not in taken:
                    taken.add(b)
                    placed = a
                    keep.append(n)
            yield batch.take(pa.array(keep, pa.int64()))

    pairs = scored.repartition(key).sortWithinPartitions(key, "left_id", F.col("score").desc(), "right_id").mapInArrow(pick, scored.schema)
    ours = left.select(key, F.col("id").alias("left_id")).distinct().join(pairs, [key, "left_id"], "left")
    theirs = right.select(key, F.col("id").alias("right_id")).distinct().join(pairs.select(key, "right_id"), [key, "right_id"], "left_anti")
    return ours.select(key, "left_id", "right_id", "score").unionByName(theirs.select(key, F.lit(None).cast(dict(pairs.dtypes)["left_id"]).alias("left_id"), "right_id", F.lit(None).cast("double").alias("score")))


def match_scores(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, left_id, right_id, score``: 0.4 for the same category, 0.3 for the same line, 0.2 up to 5 and 0.1 up to 20 lines
    apart, and 0.3 times the Jaccard similarity of the title words (parted by blanks) of more than three bytes. Both sides have
    key, id, category, line_no and title; a null category equals none, a null line is near none.

    Only pairs of one category within 20 lines are made, by an equality on buckets of lines: without the category no pair
    scores more than 0.6, without a near line none more than 0.7, so every pair above 0.7 is among them.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: F.octet_length(x) > 3))
    side = lambda df, p: df.select(key, F.col("category").alias("_c"), *(F.col(c).alias(f"{p}_{c}") for c in ("id", "line_no")), words(F.coalesce("title", F.lit(""))).alias(f"{p}_words"))
    home = F.floor(F.col("left_line_no") / 21)
    near = F.explode(F.array(*(F.floor(F.col("right_line_no") / 21) + d for d in (-1, 0, 1))))
    j = side(left, "left").withColumn("_b", home).join(side(right, "right").withColumn("_b", near), [key, "_c", "_b"])
    common, total = F.size(F.array_intersect("left_words", "right_words")), F.size(F.array_union("left_words", "right_words"))
    gap = F.abs(F.col("left_line_no") - F.col("right_line_no"))
    close = F.when(gap == 0, 0.3).when(gap <= 5, 0.2).otherwise(0.1)
    score = 0.4 + close + F.when(total > 0, 0.3 * common / total).otherwise(0.0)
    return j.filter(gap <= 20).select(key, "left_id", "right_id", F.round(score, 6).alias("score"))


def contained_names(texts: DataFrame, names: DataFrame, text: str, name: str, by: Sequence[str] = (), gram: int = 6) -> DataFrame:
    """The rows of ``texts`` with each name (other columns of ``names`` come along) that the text contains, within equal ``by``.

    A name goes to its first ``gram`` characters, a text to all its runs of that many, so the join is an equality, and the
    test for the whole name follows. Shorter names are matched by runs of their own length, which are made only for the
    lengths that occur (fewer than ``gram``).
    """
    head = F.substring(name, 1, gram)
    wanted = names.filter(F.length(name) > 0).withColumn("_g", head)
    short = [r[0] for r in wanted.filter(F.length(name) < gram).select(F.length(name)).distinct().collect()]
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(F.col(text), k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = texts.withColumn("_g", F.explode(F.array_distinct(F.concat(*(runs(n) for n in sorted({gram, *short}))))))
    return grams.join(wanted, [*by, "_g"]).filter(F.contains(F.col(text), F.col(name))).drop("_g")


def paired_names(names: DataFrame, key: str, name: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``key, one, other``: names of a key that contain the two words of a pair, without regard to case. The pairs are an
    argument of the caller; a name takes part under every pair it contains."""
    side = lambda k: F.explode(F.array_compact(F.array(*(F.when(F.contains(F.lower(name), F.lit(p[k])), F.lit(n)) for n, p in enumerate(pairs)))))
    one = names.select(key, F.col(name).alias("one"), side(0).alias("_p"))
    other = names.select(key, F.col(name).alias("other"), side(1).alias("_p"))
    return one.join(other, [key, "_p"]).select(key, "one", "other")


def confidence(start: Column, adjustments: Sequence[tuple[Column, int]]) -> Column:
    """Adds each adjustment whose condition holds, clamped to 0..100 after every step."""
    value = start
    for condition, delta in adjustments:
        value = F.when(condition, F.greatest(F.lit(0), F.least(F.lit(100), value + delta))).otherwise(value)
    return value


def hotspots(findings: DataFrame, key: str) -> DataFrame:
    """``key, findings, weight`` per file."""
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("findings"), F.sum(severity_weight(F.col("severity"))).alias("weight"))


def risk_score(findings: DataFrame, crossing: Column) -> DataFrame:
    """One row: min(100, sum of weights * (1 + 0.1 * rows with an effect on other files))."""
    total = F.coalesce(F.sum(severity_weight(F.col("severity"))), F.lit(0)) * (1 + 0.1 * F.count_if(crossing))
    return findings.agg(F.least(F.lit(100.0), total).alias("risk"))
