"""Queries of the problems tagged llm, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.families import file_families, import_origins, not_hand_written
from marlstone.llm.leaks import leaked_items
from marlstone.llm.packing import container_fill, pack_documents
from marlstone.llm.representative import STAND_INS, best_records
from marlstone.llm.sentences import split_sentences
from marlstone.llm.syntax import invalid_rates, parse_reports, scans_of_invalid
from marlstone.llm.top_n import top_findings
from marlstone.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def sources(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "source_files"), "file_id")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_reports(sources(spark, d)).filter("not valid").select("file_id")


def p1_reports(spark: SparkSession, d: str) -> DataFrame:
    return parse_reports(sources(spark, d))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rates(parse_reports(sources(spark, d)))


def p1_scans(spark: SparkSession, d: str) -> DataFrame:
    return scans_of_invalid(parse_reports(sources(spark, d)), table(spark, d, "cache_entries"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    return file_families(sources(spark, d), table(spark, d, "vendor_releases"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return not_hand_written(_families(spark, d)).select("file_id")


def p2_families(spark: SparkSession, d: str) -> DataFrame:
    return _families(spark, d)


def p2_imports(spark: SparkSession, d: str) -> DataFrame:
    return import_origins(table(spark, d, "file_imports"), sources(spark, d), not_hand_written(_families(spark, d)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return best_records(table(spark, d, "cache_entries"), table(spark, d, "scan_origins"), values=False)


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return best_records(table(spark, d, "cache_entries"), table(spark, d, "scan_origins"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_findings(table(spark, d, "project_findings")).select("finding_id", "rank_no")


def p5_top_ten(spark: SparkSession, d: str) -> DataFrame:
    return top_findings(table(spark, d, "project_findings"), n=10)



def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(documents(spark, d), table(spark, d, "pack_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return container_fill(p6_containers(spark, d), table(spark, d, "pack_sizes"))



def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """``pack_name, docs, repeated, overfull``: how many documents lie in containers, how many of their parts lie in more than
    one place, and how many containers hold more than they may."""
    packed, packs = p6_containers(spark, d), table(spark, d, "pack_sizes").groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity"))
    parts = packed.groupBy("pack_name", "doc_id", "part_no").agg(F.count(F.lit(1)).alias("n")).groupBy("pack_name").agg(F.count_if(F.col("part_no") == 0).alias("docs"), F.count_if(F.col("n") > 1).alias("repeated"))
    full = packed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("tokens")).join(packs, "pack_name").groupBy("pack_name").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    return parts.join(full, "pack_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(documents(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(documents(spark, d))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_reports": p1_reports, "p1_rates": p1_rates, "p1_scans": p1_scans, "p2_found": p2_found, "p2_families": p2_families, "p2_imports": p2_imports, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p5_top_ten": p5_top_ten, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_coverage": p6_coverage, "p7_found": p7_found, "p8_found": p8_found}

_PATH = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\\', '/', 'g'), '/+', '/', 'g'), '^(\./)+', ''), '(/\.)+(/|$)', '\2', 'g'),
  '(^|/)[^/.][^/]*/\.\.(/|$)', '\1', 'g'), '(^|/)[^/.][^/]*/\.\.(/|$)', '\1', 'g'), '(^|/)[^/.][^/]*/\.\.(/|$)', '\1', 'g'), '/$', '')"""

_TOP = f"""WITH cur AS (SELECT * FROM project_findings WHERE finding_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY reported_at DESC NULLS LAST, ingested_at DESC NULLS LAST, cvss_score DESC NULLS LAST, file_path) = 1),
f AS (SELECT finding_id, {_PATH.format("file_path")} AS file, cvss_score FROM cur WHERE cvss_score >= 0 AND cvss_score <= 10 AND NOT isnan(cvss_score))
SELECT file, finding_id, cvss_score, CAST(row_number() OVER (PARTITION BY file ORDER BY cvss_score DESC, finding_id) AS INTEGER) AS rank_no FROM f
QUALIFY rank_no <= """

_STAND_INS = ", ".join("'" + x + "'" for x in STAND_INS)
_USABLE = f"lower(regexp_replace({{0}}, '^\\s+|\\s+$', '', 'g')) NOT IN ({_STAND_INS})"
_BARE = r"regexp_replace({0}, '^(\s|\.{{2,}}|…)+|(\s|\.{{2,}}|…)+$', '', 'g')"
_PICK = "SELECT grp, vuln_id FROM {0} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY trust DESC, scan_timestamp DESC, vuln_id) = 1"
_WHOLE = "SELECT * FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE b.grp = a.grp AND length(b.bare) > length(a.bare) AND starts_with(b.bare, a.bare))"

_BEST = f"""WITH E AS (SELECT DISTINCT ON (entry_id) * FROM cache_entries),
R AS (SELECT DISTINCT ON (v.vuln_id) ({_PATH.format("file_path")}) || '|' || v.category || '|' || regexp_replace(v.code_snippet, '\\s+', '', 'g') AS grp, v.vuln_id AS vuln_id, v.title AS title, v.line_number AS line, v.confidence AS confidence, v.recommendation AS recommendation, scan_timestamp, coalesce(trust, -2147483648) AS trust
  FROM E CROSS JOIN unnest(vulnerabilities) AS t(v) LEFT JOIN scan_origins USING (origin)),
G AS (SELECT grp, min(vuln_id) AS group_vuln_id FROM R GROUP BY grp HAVING count(*) > 1),
T0 AS (SELECT *, {_BARE.format("title")} AS bare FROM R WHERE title IS NOT NULL AND {_USABLE.format("title")}), T1 AS ({_WHOLE.format("T0")}), T AS ({_PICK.format("T1")}),
L1 AS (SELECT * FROM R WHERE line >= 1), L AS ({_PICK.format("L1")}), C1 AS (SELECT * FROM R WHERE confidence IS NOT NULL AND {_USABLE.format("confidence")}), C AS ({_PICK.format("C1")}),
X0 AS (SELECT *, {_BARE.format("recommendation")} AS bare FROM R WHERE recommendation IS NOT NULL AND {_USABLE.format("recommendation")}), X1 AS ({_WHOLE.format("X0")}), X AS ({_PICK.format("X1")})"""
_JOINED = "FROM G LEFT JOIN T USING (grp) LEFT JOIN L USING (grp) LEFT JOIN C USING (grp) LEFT JOIN X USING (grp)"
_IDS = "group_vuln_id, coalesce(T.vuln_id, 0) AS title_vuln_id, coalesce(L.vuln_id, 0) AS line_vuln_id, coalesce(C.vuln_id, 0) AS confidence_vuln_id, coalesce(X.vuln_id, 0) AS recommendation_vuln_id"

SQL: dict[str, str] = {
    "p4_found": f"{_BEST} SELECT {_IDS} {_JOINED}",
    "p4_records": f"""{_BEST} SELECT {_IDS}, rt.title AS title, CAST(rl.line AS VARCHAR) AS line, rc.confidence AS confidence, rx.recommendation AS recommendation {_JOINED}
LEFT JOIN R rt ON rt.vuln_id = T.vuln_id LEFT JOIN R rl ON rl.vuln_id = L.vuln_id LEFT JOIN R rc ON rc.vuln_id = C.vuln_id LEFT JOIN R rx ON rx.vuln_id = X.vuln_id""",
    "p6_coverage": "SELECT pack_name, count(DISTINCT doc_id) AS docs, 0 AS repeated, 0 AS overfull FROM pack_sizes, documents GROUP BY pack_name",
    "p5_found": f"SELECT finding_id, rank_no FROM ({_TOP} 3)",
    "p5_top_ten": f"SELECT finding_id, file, cvss_score, rank_no FROM ({_TOP} 10)",
}
