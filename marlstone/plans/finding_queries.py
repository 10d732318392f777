"""Queries over the rule hits of the documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.scoring import cvss_base_score, poly_hash, priority, severity_weight
from marlstone.operators import findings as fd
from marlstone.operators.lines import split_lines
from marlstone.operators.predicates import Predicate, text_flags, without_noise
from marlstone.operators.rules import CATEGORIES, NEUTRAL, categories_frame, override, rules_frame, scan_lines, scan_texts
from marlstone.session import scratch
from marlstone.sources import sinks
from marlstone.sources.files import changed_since
from marlstone.sources.sinks import read_baseline, write_baseline
from marlstone.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
CUTOFF = "2024-01-01 00:00:00"


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a function of (spark, directory) under its name, with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return split_lines(documents(spark, d), "doc_id", "text")


def hits(spark: SparkSession, d: str, around: tuple[int, int] | None = None) -> DataFrame:
    return scan_lines(documents(spark, d), "doc_id", "text", around=around)


_RANK = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
_WEIGHT = "CASE severity WHEN 'Critical' THEN 10 WHEN 'High' THEN 7 WHEN 'Medium' THEN 4 WHEN 'Low' THEN 2 ELSE 1 END"
_RULES = ", ".join(f"({n}, '{r.rule_id}', '{r.category}', '{r.severity}', '{r.pattern}', '{r.title}')" for n, r in enumerate(NEUTRAL))
LINES = r"""A AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL),
B AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM A),
L AS (SELECT doc_id, CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS line_no, unnest(a) AS line FROM B)"""
HITS = f"""{LINES}, R(rule_no, rule_id, category, severity, pattern, title) AS (VALUES {_RULES}),
H AS MATERIALIZED (SELECT doc_id, line_no, line, rule_id, rule_no, category, severity, title, {_RANK} AS rank,
  row_number() OVER (PARTITION BY doc_id ORDER BY rule_no, line_no) AS seq FROM L JOIN R ON regexp_matches(line, pattern))"""
_DIM = ", ".join(f"('{c}', {repr(w) if w else 'NULL'}, '{v}', [{', '.join(map(repr, x))}]::VARCHAR[], '{t}')" for c, w, v, x, t in CATEGORIES)
DIM = f"D(category, weakness_id, cvss_vector, exploits, template) AS (VALUES {_DIM})"
# The scores of the vectors above under the published formula.
_SCORES = {"Amounts": 8.2, "Calls": 10.0, "Files": 2.2, "Guards": 4.2}
SCORES = "S(category, score) AS (VALUES " + ", ".join(f"('{c}', {s}::DOUBLE)" for c, s in _SCORES.items()) + ")"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their category's dimension, which is a literal of the program with a handful of rows."""
    dim = categories_frame(spark).withColumn("score", cvss_base_score(F.col("cvss_vector")))
    return hits(spark, d).join(F.broadcast(dim), "category", "left")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM L GROUP BY doc_id")
def src_doc_lines(spark, d):  # noqa: ANN001, ANN201
    return lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"WITH R(rule_no, rule_id, category, severity, pattern, title) AS (VALUES {_RULES}) SELECT rule_id, category, severity, pattern, title FROM R")
def dim_rules(spark, d):  # noqa: ANN001, ANN201
    return rules_frame(spark).drop("multiline")


@query(f"WITH {HITS} SELECT doc_id, line_no, rule_id, severity FROM H")
def theta_rule_line(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d).select("doc_id", "line_no", "rule_id", "severity")


@query(f"WITH {HITS}, {DIM} SELECT doc_id, line_no, rule_id, weakness_id FROM H LEFT JOIN D USING (category)")
def enrich_swc(spark, d):  # noqa: ANN001, ANN201
    return scored(spark, d).select("doc_id", "line_no", "rule_id", "weakness_id")


@query(f"WITH {HITS}, {SCORES} SELECT doc_id, seq, category, score FROM H LEFT JOIN S USING (category)")
def enrich_cvss(spark, d):  # noqa: ANN001, ANN201
    return scored(spark, d).select("doc_id", "seq", "category", "score")


@query(f"WITH {HITS}, {DIM} SELECT doc_id, seq, coalesce(array_to_string(exploits, '|'), '') AS exploits, CAST(coalesce(len(exploits), 0) AS INTEGER) AS n FROM H LEFT JOIN D USING (category)")
def enrich_list_agg(spark, d):  # noqa: ANN001, ANN201
    none = F.coalesce("exploits", F.array().cast("array<string>"))
    return scored(spark, d).select("doc_id", "seq", F.array_join(none, "|").alias("exploits"), F.size(none).alias("n"))


@query(f"WITH {HITS}, {DIM} SELECT doc_id, seq, replace(template, '{{title}}', rule_id) AS story FROM H LEFT JOIN D USING (category)")
def enrich_template(spark, d):  # noqa: ANN001, ANN201
    return scored(spark, d).select("doc_id", "seq", F.replace("template", F.lit("{title}"), F.col("rule_id")).alias("story"))


_FENCE = r"```[a-z]*\n[^`]*```"


@query(rf"""WITH P AS (SELECT doc_id, regexp_extract_all(text, '{_FENCE}') AS m, string_split_regex(text, '{_FENCE}') AS p FROM documents WHERE text IS NOT NULL),
Q AS (SELECT doc_id, m, p, unnest(generate_series(1, len(m))) AS k FROM P WHERE len(m) > 0),
T AS (SELECT doc_id, k, m[k] AS t, array_to_string(p[1:k], '') || coalesce(array_to_string(m[1:k - 1], ''), '') AS before FROM Q)
SELECT doc_id, CAST(k AS INTEGER) AS match_no, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS start_line,
CAST(length(before) - length(replace(before, chr(10), '')) + 1 + length(t) - length(replace(t, chr(10), '')) AS INTEGER) AS end_line, CAST(length(t) AS INTEGER) AS n_chars FROM T""")
def multiline_match(spark, d):  # noqa: ANN001, ANN201
    return scan_texts(documents(spark, d), "doc_id", "text", [_FENCE]).select("doc_id", "match_no", "start_line", "end_line", "n_chars")


@query(f"WITH {HITS}, G AS (SELECT DISTINCT doc_id, category, line_no FROM H WHERE rule_no < 4), N AS (SELECT * FROM H WHERE rule_no >= 4) SELECT doc_id, line_no, rule_id FROM N WHERE NOT EXISTS (SELECT 1 FROM G WHERE G.doc_id = N.doc_id AND G.category = N.category AND abs(G.line_no - N.line_no) <= 3)")
def anti_band_3(spark, d):  # noqa: ANN001, ANN201
    h = hits(spark, d)
    return fd.drop_near(h.filter("rule_no >= 4"), h.filter("rule_no < 4"), "doc_id").select("doc_id", "line_no", "rule_id")


_BYTES = "list_transform(generate_series(0, CAST(length(hex(line)) / 2 AS BIGINT) - 1), lambda i: CAST('0x' || hex(line)[2 * i + 1:2 * i + 2] AS INTEGER))"
_PRINT = f"category || ':' || rule_id || ':' || line_no || ':' || lower(lpad(to_hex(CAST(list_reduce(list_prepend(0, {_BYTES})::HUGEINT[], lambda h, b: (h * 31 + b) % 18446744073709551616) AS UBIGINT)), 16, '0'))"


def prints(rows: DataFrame) -> DataFrame:
    return rows.withColumn("print", fd.fingerprint(F.col("category"), F.col("rule_id"), F.col("line_no"), F.col("line")))


@query(f"WITH {HITS} SELECT doc_id, seq, {_PRINT} AS print FROM H")
def fingerprint(spark, d):  # noqa: ANN001, ANN201
    return prints(hits(spark, d)).select("doc_id", "seq", "print")


@query(f"WITH {HITS}, O AS (SELECT DISTINCT rule_id, line_no, line FROM H JOIN documents USING (doc_id) WHERE ingested_at < TIMESTAMP '{CUTOFF}') SELECT H.doc_id, H.line_no, H.rule_id FROM H LEFT JOIN O USING (rule_id, line_no, line) WHERE O.rule_id IS NULL")
def anti_baseline(spark, d):  # noqa: ANN001, ANN201
    """The baseline is written as a file of fingerprints and read back; what it names is left out."""
    old = documents(spark, d).filter(F.col("ingested_at") < F.lit(CUTOFF).cast("timestamp_ntz"))
    path = scratch(spark, "baseline")
    write_baseline(prints(scan_lines(old, "doc_id", "text")), path)
    return prints(hits(spark, d)).join(read_baseline(spark, path), "print", "left_anti").select("doc_id", "line_no", "rule_id")


@query(f"WITH {HITS}, X AS (SELECT DISTINCT doc_id, category FROM H WHERE rank > 1) SELECT doc_id, seq FROM H WHERE rank > 1 OR NOT EXISTS (SELECT 1 FROM X WHERE X.doc_id = H.doc_id AND X.category = H.category)")
def anti_group(spark, d):  # noqa: ANN001, ANN201
    return fd.drop_covered(hits(spark, d), "doc_id", F.col("rank") <= 1).select("doc_id", "seq")


@query(f"WITH {HITS}, X AS (SELECT DISTINCT doc_id FROM H WHERE rule_id = 'N08') SELECT doc_id, seq FROM H WHERE category <> 'Calls' OR doc_id NOT IN (SELECT doc_id FROM X)")
def anti_safe_pattern(spark, d):  # noqa: ANN001, ANN201
    h = hits(spark, d)
    safe = h.filter("rule_id = 'N08'").select("doc_id", F.lit("Calls").alias("category")).distinct()
    return h.join(safe, ["doc_id", "category"], "left_anti").select("doc_id", "seq")


@query(f"WITH {HITS} SELECT doc_id, line_no, rule_id, CASE WHEN rule_id = 'N03' THEN 'High' WHEN rule_id = 'N07' THEN 'Medium' ELSE severity END AS severity FROM H WHERE rule_id NOT IN ('N01', 'N04')")
def anti_disabled_rules(spark, d):  # noqa: ANN001, ANN201
    pack = override(NEUTRAL, disabled=["N01", "N04"], severities={"N03": "High", "N07": "unheard of"})
    return scan_lines(documents(spark, d), "doc_id", "text", pack).select("doc_id", "line_no", "rule_id", "severity")


@query(f"WITH {HITS} SELECT severity, count(*) AS n FROM H GROUP BY severity")
def agg_severity(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HITS} SELECT category, rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(sum(line_no) AS BIGINT) AS lines FROM H GROUP BY category, rule_id")
def agg_category(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d).groupBy("category", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("line_no").alias("lines"))


@query(f"WITH {HITS} SELECT doc_id, count(*) AS findings, CAST(sum({_WEIGHT}) AS BIGINT) AS weight FROM H GROUP BY doc_id")
def agg_hotspots(spark, d):  # noqa: ANN001, ANN201
    return fd.hotspots(hits(spark, d), "doc_id")


@query(f"WITH {HITS} SELECT least(100.0, coalesce(sum({_WEIGHT}), 0) * (1 + 0.1 * count(*) FILTER (rule_id = 'N03')))::DOUBLE AS risk FROM H")
def agg_risk_score(spark, d):  # noqa: ANN001, ANN201
    return fd.risk_score(hits(spark, d), F.col("rule_id") == "N03")


@query(f"WITH {HITS}, {SCORES} SELECT count(*) AS total, round(avg(score), 6) AS mean_score, CASE WHEN avg(score) >= 7 THEN 'high' WHEN avg(score) >= 4 THEN 'medium' ELSE 'low' END AS rating, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high FROM H LEFT JOIN S USING (category)")
def exec_summary(spark, d):  # noqa: ANN001, ANN201
    mean = F.avg("score")
    return scored(spark, d).agg(F.count(F.lit(1)).alias("total"), F.round(mean, 6).alias("mean_score"), F.when(mean >= 7, "high").when(mean >= 4, "medium").otherwise("low").alias("rating"), F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "High").alias("high"))


_TOP = "score DESC NULLS LAST, rank DESC, doc_id, seq"


@query(f"WITH {HITS}, {SCORES} SELECT doc_id, seq, score FROM H LEFT JOIN S USING (category) ORDER BY {_TOP} LIMIT 5")
def topk_cvss(spark, d):  # noqa: ANN001, ANN201
    return scored(spark, d).orderBy(F.col("score").desc_nulls_last(), F.col("rank").desc(), "doc_id", "seq").select("doc_id", "seq", "score").limit(5)


@query(f"WITH {HITS}, C AS (SELECT doc_id, count(*) AS n FROM H GROUP BY doc_id) SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) AS place FROM C ORDER BY place LIMIT 20")
def sort_tiebreak(spark, d):  # noqa: ANN001, ANN201
    top = hits(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "doc_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "doc_id")).cast("long"))


@query(f"WITH {HITS}, {SCORES} SELECT doc_id, seq, CASE WHEN score * 0.9 >= 7 THEN 'P1' WHEN score * 0.9 >= 4 THEN 'P2' ELSE 'P3' END AS priority FROM H LEFT JOIN S USING (category)")
def case_priority(spark, d):  # noqa: ANN001, ANN201
    return scored(spark, d).select("doc_id", "seq", priority(F.col("score"), F.lit(90)).alias("priority"))


@query(f"WITH {HITS}, {SCORES} SELECT category, round(score * 0.9, 6) AS weighted, count(*) AS n FROM H LEFT JOIN S USING (category) GROUP BY ALL ORDER BY weighted DESC")
def sort_priority(spark, d):  # noqa: ANN001, ANN201
    return scored(spark, d).groupBy("category", F.round(F.col("score") * 0.9, 6).alias("weighted")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("weighted").desc_nulls_last())


@query(f"WITH {HITS}, N AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM H WHERE rank >= 3) SELECT doc_id, max(rank) AS worst, string_agg(k || '. ' || rule_id || ' at ' || line_no, chr(10) ORDER BY k) AS listed FROM N GROUP BY doc_id")
def agg_numbered_list(spark, d):  # noqa: ANN001, ANN201
    rows = hits(spark, d).filter("rank >= 3").groupBy("doc_id").agg(F.max("rank").alias("worst"), F.array_sort(F.collect_list(F.struct("seq", "rule_id", "line_no"))).alias("x"))
    item = F.transform("x", lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["rule_id"], F.lit(" at "), x["line_no"].cast("string")))
    return rows.select("doc_id", "worst", F.array_join(item, "\n").alias("listed"))


_FLAGS = (r"\bif\b", r"\bfor\b", r"&&|\|\|", r"\?")
_FLAG_SQL = " + ".join(f"CAST(regexp_matches(line, '{p}') AS INTEGER)" for p in _FLAGS)


@query(f"WITH {LINES} SELECT doc_id, CAST(sum({_FLAG_SQL}) AS BIGINT) AS complexity FROM L GROUP BY doc_id HAVING sum({_FLAG_SQL}) > 10")
def agg_complexity(spark, d):  # noqa: ANN001, ANN201
    total = sum((F.col("line").rlike(p).cast("int") for p in _FLAGS), F.lit(0))
    return lines(spark, d).groupBy("doc_id").agg(F.sum(total).alias("complexity")).filter("complexity > 10")


@query(f"WITH {HITS} SELECT CAST(min(CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 0 END) FILTER (rank >= 2) AS INTEGER) AS code, max(CASE WHEN rank >= 3 THEN 1 ELSE 0 END) AS failed FROM H")
def agg_exit_code(spark, d):  # noqa: ANN001, ANN201
    h = hits(spark, d)
    code = F.when(F.col("severity") == "Critical", 1).when(F.col("severity") == "High", 2).when(F.col("severity") == "Medium", 3)
    return h.agg(F.min(code).alias("code"), F.max(F.when(F.col("rank") >= 3, 1).otherwise(0)).alias("failed"))


@query(f"WITH {HITS} SELECT count(*) AS original, count(*) FILTER (rank < 2) AS removed, CAST(floor(100 * (count(*) FILTER (rank < 2)) / count(*)) AS BIGINT) AS percent FROM H")
def agg_filter_stats(spark, d):  # noqa: ANN001, ANN201
    h = hits(spark, d).agg(F.count(F.lit(1)).alias("original"), F.count_if(F.col("rank") < 2).alias("removed"))
    return h.withColumn("percent", F.floor(100 * F.col("removed") / F.col("original")))


@query(f"WITH {HITS} SELECT doc_id, rule_id, min(line_no) AS first_line, arg_min(line, line_no) AS line FROM H GROUP BY doc_id, rule_id")
def first_match_per_group(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d).groupBy("doc_id", "rule_id").agg(F.min("line_no").alias("first_line"), F.min_by("line", "line_no").alias("line"))


@query(f"WITH {HITS} SELECT doc_id, line_no, rule_id, seq FROM H")
def win_seq(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d).select("doc_id", "line_no", "rule_id", F.col("seq").cast("long").alias("seq"))


@query(f"WITH {HITS} SELECT doc_id, seq, upper(severity[1]) || '-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, severity ORDER BY seq) AS VARCHAR), 3, '0') AS finding FROM H")
def win_row_number(spark, d):  # noqa: ANN001, ANN201
    n = F.row_number().over(Window.partitionBy("doc_id", "severity").orderBy("seq"))
    return hits(spark, d).select("doc_id", "seq", F.concat(F.substring("severity", 1, 1), F.lit("-"), F.lpad(n.cast("string"), 3, "0")).alias("finding"))


@query(f"WITH {HITS} SELECT doc_id, line_no, seq FROM H ORDER BY doc_id, line_no, seq")
def sort_stable(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d).select("doc_id", "line_no", "seq").orderBy("doc_id", "line_no", "seq")


@query(f"WITH {HITS}, C AS (SELECT doc_id, line_no, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM L) SELECT H.doc_id, H.line_no, H.rule_id, md5(C.context) AS context FROM H JOIN C USING (doc_id, line_no) WHERE rank >= 3")
def win_context(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d, (2, 2)).filter("rank >= 3").select("doc_id", "line_no", "rule_id", F.md5("context").alias("context"))


@query(f"WITH {HITS}, C AS (SELECT doc_id, line_no, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS context FROM L) SELECT H.doc_id, H.line_no, regexp_matches(C.context, 'require\\(|revert\\(|onlyOwner') AS guarded FROM H JOIN C USING (doc_id, line_no) WHERE rule_id = 'N06'")
def win_guard_predicate(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d, (5, 1)).filter("rule_id = 'N06'").select("doc_id", "line_no", F.col("context").rlike(r"require\(|revert\(|onlyOwner").alias("guarded"))


@query(f"WITH {HITS} SELECT doc_id, line_no, category, min(seq) AS seq FROM H GROUP BY doc_id, line_no, category")
def dedup_exact(spark, d):  # noqa: ANN001, ANN201
    return fd.dedup_exact(hits(spark, d), "doc_id").select("doc_id", "line_no", "category", "seq")


@query(f"WITH {HITS}, X AS (SELECT *, lag(line_no) OVER w AS pl, lag(category) OVER w AS pc FROM H WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, seq)) SELECT doc_id, seq FROM X WHERE NOT coalesce(pl = line_no AND pc = category, false)")
def dedup_adjacent(spark, d):  # noqa: ANN001, ANN201
    return fd.dedup_adjacent(hits(spark, d), "doc_id").select("doc_id", "seq")


# Categories that are merged as one.
_GROUPS = {"Calls": "code", "Guards": "code"}
_GROUP = "CASE WHEN category IN ('Calls', 'Guards') THEN 'code' ELSE category END"


@query(f"""WITH RECURSIVE {HITS}, W AS (SELECT doc_id, {_GROUP} AS grp, {{'seq': seq, 'category': category, 'line_no': line_no, 'rank': rank}} AS x, row_number() OVER (PARTITION BY doc_id, {_GROUP} ORDER BY seq) AS n FROM H),
G(doc_id, grp, n, kept) AS (SELECT doc_id, grp, n, [x] FROM W WHERE n = 1 UNION ALL
SELECT doc_id, grp, n, CASE WHEN k = 0 THEN list_append(kept, x) WHEN x.rank > kept[k].rank THEN list_concat(list_append(kept[1:k - 1], x), kept[k + 1:]) ELSE kept END FROM (SELECT W.doc_id, W.grp, W.n, W.x, G.kept, CAST(coalesce(list_position(list_transform(G.kept, lambda y: abs(y.line_no - W.x.line_no) <= 30), true), 0) AS BIGINT) AS k FROM G JOIN W ON W.doc_id = G.doc_id AND W.grp = G.grp AND W.n = G.n + 1)),
Z AS (SELECT doc_id, unnest(arg_max(kept, n)) AS x FROM G GROUP BY doc_id, grp) SELECT doc_id, x.seq AS seq, x.category AS category, x.line_no AS line_no, x.rank AS rank FROM Z""")
def dedup_greedy(spark, d):  # noqa: ANN001, ANN201
    group = F.coalesce(*(F.when(F.col("category") == c, F.lit(g)) for c, g in _GROUPS.items()), F.col("category"))
    return fd.dedup_greedy(hits(spark, d), "doc_id", 30, group).withColumn("seq", F.col("seq").cast("long"))


@query(f"WITH {HITS} SELECT doc_id, line_no, rule_id FROM H WHERE rank >= 2")
def filter_severity(spark, d):  # noqa: ANN001, ANN201
    return hits(spark, d).filter("rank >= 2").select("doc_id", "line_no", "rule_id")


@query(f"WITH {HITS}, {DIM} SELECT doc_id, seq, category FROM H LEFT JOIN D USING (category) WHERE upper(weakness_id) IN ('W-841', 'W-754') OR (weakness_id IS NULL AND rule_id = 'N04')")
def filter_swc_nulls(spark, d):  # noqa: ANN001, ANN201
    wanted = F.coalesce(F.upper("weakness_id").isin("W-841", "W-754"), F.lit(False))
    return scored(spark, d).filter(wanted | (F.col("weakness_id").isNull() & (F.col("rule_id") == "N04"))).select("doc_id", "seq", "category")


@query(f"WITH {HITS} SELECT doc_id, line_no, rule_id FROM H JOIN documents USING (doc_id) WHERE NOT coalesce(contains(text, '```'), false)")
def filter_gates(spark, d):  # noqa: ANN001, ANN201
    gated = documents(spark, d).filter(~F.coalesce(F.contains(F.col("text"), F.lit("```")), F.lit(False)))
    return scan_lines(gated, "doc_id", "text").select("doc_id", "line_no", "rule_id")


@query(f"WITH {HITS} SELECT doc_id, seq FROM H WHERE NOT (CASE category WHEN 'Calls' THEN regexp_matches(line, 'require\\(|e\\.g\\.') WHEN 'Amounts' THEN regexp_matches(line, '^[#>]') WHEN 'Versions' THEN contains(line, 'typo') ELSE false END)")
def filter_layer1(spark, d):  # noqa: ANN001, ANN201
    line, kind = F.col("line"), F.col("category")
    noise = F.when(kind == "Calls", line.rlike(r"require\(|e\.g\.")).when(kind == "Amounts", line.rlike("^[#>]")).when(kind == "Versions", line.contains("typo")).otherwise(False)
    return hits(spark, d).filter(~noise).select("doc_id", "seq")


#: A neutral table of what makes a hit noise.
PREDICATES = (
    Predicate("quoted", "line", any_of=(r"^[#>]",), categories=("Amounts",)),
    Predicate("guarded", "context", any_of=(r"require\(", r"revert\("), none_of=(r"unchecked",), categories=("Calls",)),
    Predicate("named_often", "text", any_of=(r"(?s)\.sol.*\.sol.*\.sol",), categories=("Files",)),
)


@query(f"""WITH {HITS}, C AS (SELECT doc_id, line_no, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM L)
SELECT H.doc_id, seq FROM H JOIN C USING (doc_id, line_no) JOIN documents USING (doc_id) WHERE NOT (category = 'Amounts' AND regexp_matches(line, '^[#>]')) AND NOT (category = 'Calls' AND regexp_matches(context, 'require\\(|revert\\(') AND NOT regexp_matches(context, 'unchecked')) AND NOT (category = 'Files' AND regexp_matches(text, '(?s)\\.sol.*\\.sol.*\\.sol'))""")
def filter_predicates(spark, d):  # noqa: ANN001, ANN201
    found = scan_lines(documents(spark, d), "doc_id", "text", around=(2, 2), carry=text_flags(PREDICATES, "text"))
    return without_noise(found, PREDICATES).select("doc_id", "seq")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS code_lines FROM L WHERE NOT (ltrim(line) LIKE '//%' OR ltrim(line) LIKE '/*%' OR ltrim(line) LIKE '*%') GROUP BY doc_id")
def filter_comment_lines(spark, d):  # noqa: ANN001, ANN201
    start = F.ltrim("line")
    return lines(spark, d).filter(~(start.startswith("//") | start.startswith("/*") | start.startswith("*"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("code_lines"))


@query(f"WITH {HITS}, {SCORES}, T AS (SELECT doc_id, max(score) AS worst, count(*) FILTER (rank >= 3) AS heavy, count(*) AS n FROM H LEFT JOIN S USING (category) GROUP BY doc_id) SELECT doc_id, CASE WHEN heavy >= 3 AND worst >= 9 THEN 'severe' WHEN heavy >= 1 THEN 'raised' ELSE 'normal' END AS tier, CAST(greatest(0, least(100, 50 + 5 * (n - heavy) - 10 * heavy)) AS BIGINT) AS score FROM T")
def agg_risk_tier(spark, d):  # noqa: ANN001, ANN201
    t = scored(spark, d).groupBy("doc_id").agg(F.max("score").alias("worst"), F.count_if(F.col("rank") >= 3).alias("heavy"), F.count(F.lit(1)).alias("n"))
    tier = F.when((F.col("heavy") >= 3) & (F.col("worst") >= 9), "severe").when(F.col("heavy") >= 1, "raised").otherwise("normal")
    return t.select("doc_id", tier.alias("tier"), F.greatest(F.lit(0), F.least(F.lit(100), 50 + 5 * (F.col("n") - F.col("heavy")) - 10 * F.col("heavy"))).alias("score"))


@query(f"""WITH {HITS}, C1 AS (SELECT *, CASE WHEN rank >= 3 THEN greatest(0, least(100, 65 + 40)) ELSE 65 END AS c FROM H), C2 AS (SELECT *, CASE WHEN line LIKE '%test%' THEN greatest(0, least(100, c - 30)) ELSE c END AS c2 FROM C1)
SELECT doc_id, seq, CAST(c2 AS INTEGER) AS percent, CASE WHEN c2 >= 80 THEN 'High' WHEN c2 >= 50 THEN 'Medium' ELSE 'Low' END AS confidence FROM C2""")
def case_confidence(spark, d):  # noqa: ANN001, ANN201
    c = fd.confidence(F.lit(65), [(F.col("rank") >= 3, 40), (F.col("line").contains("test"), -30)])
    return hits(spark, d).select("doc_id", "seq", c.cast("int").alias("percent"), F.when(c >= 80, "High").when(c >= 50, "Medium").otherwise("Low").alias("confidence"))


@query(f"WITH {HITS}, T AS (SELECT doc_id, rule_id, count(*) AS n FROM H GROUP BY doc_id, rule_id) SELECT rule_id, count(*) AS files, CAST(sum(n) AS BIGINT) AS results, CAST(max(n) AS BIGINT) AS most FROM T GROUP BY rule_id")
def sink_json_nested(spark, d):  # noqa: ANN001, ANN201
    """Written as one document a file, read back and counted."""
    path = scratch(spark, "report")
    sinks.write_json(hits(spark, d), "doc_id", path)
    back = spark.read.schema("doc_id bigint, total bigint, results array<struct<rule_id:string,line_no:int,severity:string>>").json(path)
    per = back.select("doc_id", F.explode("results").alias("r")).groupBy("doc_id", "r.rule_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("rule_id").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("results"), F.max("n").alias("most"))


_BADGE = "CASE severity WHEN 'Critical' THEN '[C]' WHEN 'High' THEN '[H]' WHEN 'Medium' THEN '[M]' WHEN 'Low' THEN '[L]' ELSE '[I]' END"


@query(f"WITH {HITS} SELECT doc_id, place, text FROM (SELECT doc_id, 0 AS place, doc_id || ': ' || count(*) || ' findings' AS text FROM H GROUP BY doc_id UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, line_no, seq) AS INTEGER), '  ' || {_BADGE} || ' line ' || line_no || ' ' || rule_id FROM H)")
def report_listing(spark, d):  # noqa: ANN001, ANN201
    return sinks.listing(hits(spark, d), "doc_id")


@query(f"WITH {HITS} SELECT part, CAST(place AS INTEGER) AS place, text FROM (SELECT 1 AS part, row_number() OVER (ORDER BY count(*) DESC, severity) AS place, '| ' || severity || ' | ' || count(*) || ' |' AS text FROM H GROUP BY severity UNION ALL SELECT 2, row_number() OVER (ORDER BY count(*) DESC, category), '| ' || category || ' | ' || count(*) || ' |' FROM H GROUP BY category)")
def report_markdown_tables(spark, d):  # noqa: ANN001, ANN201
    return sinks.markdown_tables(hits(spark, d))


@query(f"WITH {HITS}, {SCORES}, P AS (SELECT CASE WHEN score * 0.9 >= 7 THEN 'P1' WHEN score * 0.9 >= 4 THEN 'P2' ELSE 'P3' END AS priority, severity FROM H LEFT JOIN S USING (category)) SELECT priority, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low, count(*) FILTER (severity = 'Info') AS info FROM P GROUP BY priority")
def report_matrix(spark, d):  # noqa: ANN001, ANN201
    """The matrix of an audit report: priorities by severities."""
    return sinks.matrix(scored(spark, d).select(priority(F.col("score"), F.lit(90)).alias("priority"), "severity"), "priority")


@query(f"WITH {HITS} SELECT rule_id, arg_min(doc_id, [doc_id, seq]) AS first_doc, arg_min(line_no, [doc_id, seq]) AS first_line, CASE arg_min(severity, [doc_id, seq]) WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS level FROM H GROUP BY rule_id")
def sarif_rules_first(spark, d):  # noqa: ANN001, ANN201
    return sinks.sarif_rules(hits(spark, d), "doc_id")


@query(f"WITH {HITS}, U AS (SELECT doc_id, rule_id FROM H UNION ALL SELECT doc_id, 'LONG' FROM L WHERE length(line) > 400 UNION ALL SELECT doc_id, 'EMPTY' FROM documents WHERE coalesce(text, '') = '') SELECT rule_id, count(*) AS n FROM U GROUP BY rule_id")
def union_detectors(spark, d):  # noqa: ANN001, ANN201
    a = hits(spark, d).select("doc_id", "rule_id")
    b = lines(spark, d).filter(F.length("line") > 400).select("doc_id", F.lit("LONG").alias("rule_id"))
    c = table(spark, d, "documents").filter(F.coalesce("text", F.lit("")) == "").select("doc_id", F.lit("EMPTY").alias("rule_id"))
    return a.unionByName(b).unionByName(c).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(text) AS hash, sha256(text) AS strong FROM documents")
def hash_content(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), F.sha2("text", 256).alias("strong"))


@query(f"SELECT doc_id, md5(text) AS hash FROM documents n WHERE ingested_at >= TIMESTAMP '{CUTOFF}' AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.ingested_at < TIMESTAMP '{CUTOFF}' AND md5(o.text) = md5(n.text))")
def src_snapshot_diff(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), "ingested_at")
    old = F.col("ingested_at") < F.lit(CUTOFF).cast("timestamp_ntz")
    return changed_since(docs.filter(~old).select("doc_id", "hash"), docs.filter(old).select("hash"), ["hash"])


@query("SELECT p_name, CAST(list_reduce(list_prepend(0, list_transform(string_split(p_name, ''), lambda c: ord(c)))::HUGEINT[], lambda h, b: (h * 31 + b) % 4294967296) AS BIGINT) AS h FROM (SELECT DISTINCT p_name FROM part)")
def hash_poly32(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part").select("p_name").distinct().select("p_name", poly_hash(F.col("p_name"))["low"].alias("h"))


@query("WITH V AS (SELECT DISTINCT p_name, CAST(list_reduce(list_prepend(0, list_transform(string_split(p_name, ''), lambda c: ord(c)))::HUGEINT[], lambda h, b: (h * 31 + b) % 4294967296) % 64 AS BIGINT) AS slot FROM part) SELECT slot, count(*) AS names, string_agg(p_name, ',' ORDER BY p_name) AS listed FROM V GROUP BY slot HAVING count(*) > 1")
def having_collisions(spark, d):  # noqa: ANN001, ANN201
    v = table(spark, d, "part").select("p_name").distinct().withColumn("slot", F.pmod(poly_hash(F.col("p_name"))["low"], F.lit(64)))
    return v.groupBy("slot").agg(F.count(F.lit(1)).alias("names"), F.array_join(F.sort_array(F.collect_list("p_name")), ",").alias("listed")).filter("names > 1")


_M = lambda name, weights: "CASE regexp_extract(cvss_vector, '/" + name + ":([A-Z])', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " END"


@query(f"""WITH V AS (SELECT DISTINCT cvss_vector, contains(cvss_vector, 'S:C') AS c, {_M("AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2})} AS av, {_M("AC", {"L": 0.77, "H": 0.44})} AS ac, {_M("UI", {"N": 0.85, "R": 0.62})} AS ui,
CASE WHEN contains(cvss_vector, 'S:C') THEN {_M("PR", {"N": 0.85, "L": 0.68, "H": 0.5})} ELSE {_M("PR", {"N": 0.85, "L": 0.62, "H": 0.27})} END AS pr,
1 - (1 - {_M("C", {"H": 0.56, "L": 0.22, "N": 0.0})}) * (1 - {_M("I", {"H": 0.56, "L": 0.22, "N": 0.0})}) * (1 - {_M("A", {"H": 0.56, "L": 0.22, "N": 0.0})}) AS iss FROM project_findings WHERE cvss_vector IS NOT NULL),
W AS (SELECT *, 8.22::DOUBLE * av * ac * pr * ui AS e, CASE WHEN c THEN 7.52::DOUBLE * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42::DOUBLE * iss END AS i FROM V),
X AS (SELECT *, least(10.0, CASE WHEN c THEN 1.08 * (i + e) ELSE i + e END) AS r FROM W)
SELECT cvss_vector, CASE WHEN i <= 0 THEN 0.0 ELSE ceil(round(r * 100000) / 10000) / 10.0 END::DOUBLE AS score FROM X""")
def math_cvss(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "project_findings").filter("cvss_vector is not null").select("cvss_vector").distinct().withColumn("score", cvss_base_score(F.col("cvss_vector")))


@query("SELECT severity, count(*) AS n, CAST(sum(CASE severity WHEN 'Critical' THEN 10 WHEN 'High' THEN 7 WHEN 'Medium' THEN 4 WHEN 'Low' THEN 2 WHEN 'Info' THEN 1 ELSE 0 END * (1 + len(coalesce(cross_file_impact, [])))) AS BIGINT) AS weight FROM (SELECT DISTINCT * FROM project_findings) GROUP BY severity")
def agg_project_weight(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "project_findings").distinct()
    reach = 1 + F.coalesce(F.size("cross_file_impact"), F.lit(0))
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum(severity_weight(F.col("severity")) * F.greatest(reach, F.lit(1))).alias("weight"))
