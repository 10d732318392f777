"""Queries over sources, imports, caches, releases and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.paths import canonical_path
from marlstone.functions.scoring import sanitize_name
from marlstone.operators import findings as fd
from marlstone.operators import graph, lines as ln, structure
from marlstone.operators.predicates import features
from marlstone.operators.rules import NEUTRAL
from marlstone.operators.taint import fold_taint as taint_fold
from marlstone.plans.finding_queries import CUTOFF
from marlstone.session import scratch
from marlstone.sources.analyzer import read_report
from marlstone.sources.cache import save_cache, split_by_cache
from marlstone.sources.files import excluded
from marlstone.sources.tables import table
from marlstone.streaming.watch import counts_of_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, d: str) -> DataFrame:
    """One row for each file."""
    return table(spark, d, "source_files").dropDuplicates(["file_id"])


def solidity_lines(spark: SparkSession, d: str) -> DataFrame:
    return ln.split_lines(files(spark, d).filter(F.col("path").endswith(".sol")), "file_id", "content")


SF = "SF AS (SELECT DISTINCT ON (file_id) * FROM source_files)"
LINES = rf"""{SF}, A AS (SELECT file_id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM SF WHERE content IS NOT NULL AND path LIKE '%.sol'),
B AS (SELECT file_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM A),
L AS (SELECT file_id, CAST(unnest(generate_series(1, len(a))) AS INTEGER) AS line_no, unnest(a) AS line FROM B)"""
# Texts with comments and strings blanked; line breaks stay in place.
_NOISE = r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"""
_NOISE_SQL = _NOISE.replace("'", "''")
CLEAN = rf"""{SF}, K0 AS (SELECT file_id, replace(content, chr(13) || chr(10), chr(10)) AS t FROM SF WHERE content IS NOT NULL AND path LIKE '%.sol'),
K1 AS (SELECT file_id, string_split_regex(t, '{_NOISE_SQL}') AS p, regexp_extract_all(t, '{_NOISE_SQL}') AS c FROM K0),
K AS (SELECT file_id, array_to_string(list_transform(generate_series(1, len(p)), lambda i: p[i] || coalesce(repeat(chr(10), length(c[i]) - length(replace(c[i], chr(10), ''))), '')), ' ') AS t FROM K1),
KL AS (SELECT file_id, CAST(unnest(generate_series(1, len(string_split(t, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(t, chr(10))) AS line FROM K)"""
_FN = r"regexp_extract(line, 'function\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1)"
FN = f"{LINES}, FN AS (SELECT *, last_value(nullif({_FN}, '') IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS fn FROM L)"


@query(f"WITH {SF} SELECT file_id, length(content) AS n_chars, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS breaks FROM SF")
def src_pages_scan(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).select("file_id", F.length("content").cast("long").alias("n_chars"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))


_EXCLUDE = ("*/test/*", "*/node_modules/**", "*.json")


@query(f"WITH {SF} SELECT file_id, path FROM SF WHERE NOT (" + " OR ".join(f"path GLOB '{g}'" for g in ("*/test/*", "*/node_modules/*", "*.json")) + ")")
def filter_glob_exclude(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).filter(~excluded(F.col("path"), _EXCLUDE)).select("file_id", "path")


@query(f"""WITH {SF} SELECT file_id, coalesce(contains(content, 'SafeMath'), false) AS safe_math, coalesce(contains(content, 'nonReentrant'), false) AS guarded, coalesce(contains(content, 'unchecked'), false) AS uses_unchecked,
coalesce(regexp_matches(content, 'pragma solidity [\\^>=]*0\\.8'), false) AS checked_arithmetic, coalesce(regexp_matches(content, '(^|\\n)interface ') AND NOT regexp_matches(content, '(^|\\n)(abstract )?contract '), false) AS interface_only, CAST(coalesce(len(modifiers), 0) AS INTEGER) AS n_modifiers FROM SF""")
def proj_features(spark, d):  # noqa: ANN001, ANN201
    c = F.col("content")
    yes = lambda x: F.coalesce(x, F.lit(False))
    return files(spark, d).select(
        "file_id", yes(c.contains("SafeMath")).alias("safe_math"), yes(c.contains("nonReentrant")).alias("guarded"), yes(c.contains("unchecked")).alias("uses_unchecked"), yes(c.rlike(r"pragma solidity [\^>=]*0\.8")).alias("checked_arithmetic"),
        yes(c.rlike(r"(^|\n)interface ") & ~c.rlike(r"(^|\n)(abstract )?contract ")).alias("interface_only"), F.coalesce(F.size("modifiers"), F.lit(0)).alias("n_modifiers"),
    )


_FLAGS = {"checked": r"pragma solidity\s*[\^>=]*\s*0\.[89]", "library": r"(?:^|\n)\s*library\s+[A-Za-z_]", "interface": r"(?:^|\n)\s*interface\s+[A-Za-z_]", "scoped_imports": r"import[^;]*@", "custom_errors": r"\berror\s+[A-Z]", "low_level": r"\.call\{", "assembly_used": r"\bassembly\b", "loops": r"\bfor\s*\(|\bwhile\s*\(", "payable_used": r"\bpayable\b"}
_VALUES = {"version": (r"pragma\s+solidity\s*[\^>=<]*\s*([0-9]+\.[0-9]+\.[0-9]+)", 1), "licence": (r"SPDX-License-Identifier:\s*([A-Za-z0-9.-]+)", 1), "first_modifier": (r"modifier\s+([A-Za-z0-9_]+)", 1)}


@query(f"WITH {SF} SELECT file_id, {', '.join(f'coalesce(regexp_matches(content, {chr(39)}{p}{chr(39)}), false) AS {n}' for n, p in _FLAGS.items())}, {', '.join(f'CASE WHEN regexp_matches(content, {chr(39)}{p}{chr(39)}) THEN regexp_extract(content, {chr(39)}{p}{chr(39)}, {g}) END AS {n}' for n, (p, g) in _VALUES.items())} FROM SF")
def proj_context(spark, d):  # noqa: ANN001, ANN201
    """The second row of features, those of the later filters; flags and values are arguments."""
    return features(files(spark, d), "file_id", "content", _FLAGS, _VALUES)


@query("SELECT DISTINCT file_id, path, alias, array_to_string(symbols, ',') AS symbols, line, is_local FROM file_imports")
def import_statements(spark, d):  # noqa: ANN001, ANN201
    """Import statements read from the sources of which the table of imports knows any; it holds the same."""
    listed = table(spark, d, "file_imports").select("file_id").distinct()
    rows = structure.import_rows(files(spark, d).filter(F.col("path").endswith(".sol")).join(listed, "file_id", "left_semi"), "file_id", "content")
    return rows.select("file_id", "path", "alias", F.array_join("symbols", ",").alias("symbols"), "line", "is_local").distinct()


_VERSION = r"pragma solidity\s+([^;]*)[0-9]+\.([0-9]+)\.([0-9]+)"


@query(f"""WITH {SF}, P AS (SELECT file_id, regexp_extract(content, 'pragma solidity\\s+([\\^>=<]*)\\s*0\\.([0-9]+)\\.([0-9]+)', 1) AS op, TRY_CAST(regexp_extract(content, 'pragma solidity\\s+([\\^>=<]*)\\s*0\\.([0-9]+)\\.([0-9]+)', 2) AS INTEGER) AS minor FROM SF WHERE path LIKE '%.sol' AND content IS NOT NULL)
SELECT file_id, minor, CASE WHEN minor IS NULL THEN 'none' WHEN op = '^' THEN 'caret' WHEN op = '' THEN 'exact' ELSE 'range' END AS kind, CASE WHEN minor IS NULL THEN 'unknown' WHEN minor <= 6 THEN 'old' WHEN minor = 7 THEN 'ageing' ELSE 'current' END AS age FROM P""")
def version_buckets(spark, d):  # noqa: ANN001, ANN201
    pattern = r"pragma solidity\s+([\^>=<]*)\s*0\.([0-9]+)\.([0-9]+)"
    op, minor = F.regexp_extract("content", pattern, 1), F.expr("try_cast(_m as int)")
    rows = files(spark, d).filter(F.col("path").endswith(".sol") & F.col("content").isNotNull()).select("file_id", op.alias("op"), F.regexp_extract("content", pattern, 2).alias("_m")).withColumn("minor", minor)
    kind = F.when(F.col("minor").isNull(), "none").when(F.col("op") == "^", "caret").when(F.col("op") == "", "exact").otherwise("range")
    age = F.when(F.col("minor").isNull(), "unknown").when(F.col("minor") <= 6, "old").when(F.col("minor") == 7, "ageing").otherwise("current")
    return rows.select("file_id", "minor", kind.alias("kind"), age.alias("age"))


@query(f"""WITH {SF} SELECT file_id, CASE WHEN content IS NULL THEN 'unread' WHEN contains(content, 'delegatecall') THEN 'proxy' WHEN regexp_matches(content, 'function (swap|quote)') THEN 'exchange' WHEN regexp_matches(content, 'function (borrow|repay|liquidate)') THEN 'lending' WHEN regexp_matches(content, '(^|\\n)library ') THEN 'library' ELSE 'other' END AS kind FROM SF""")
def case_classify(spark, d):  # noqa: ANN001, ANN201
    c = F.col("content")
    kind = F.when(c.isNull(), "unread").when(c.contains("delegatecall"), "proxy").when(c.rlike("function (swap|quote)"), "exchange").when(c.rlike("function (borrow|repay|liquidate)"), "lending").when(c.rlike(r"(^|\n)library "), "library").otherwise("other")
    return files(spark, d).select("file_id", kind.alias("kind"))


_THREATS = (("reentry", r"\.call\{", "High"), ("clock", r"block\.timestamp", "Medium"), ("assembly", r"assembly \{", "Medium"), ("unchecked", r"unchecked \{", "Low"))


@query(f"WITH {SF}, T(threat, pattern, severity) AS (VALUES {', '.join(repr(t) for t in _THREATS)}) SELECT file_id, threat, CASE WHEN severity = 'High' THEN 'Medium' ELSE severity END AS severity FROM SF JOIN T ON regexp_matches(content, pattern)".replace("\\\\", "\\"))
def case_threats(spark, d):  # noqa: ANN001, ANN201
    found = F.array_compact(F.array(*(F.when(F.col("content").rlike(p), F.struct(F.lit(t).alias("threat"), F.lit("Medium" if s == "High" else s).alias("severity"))) for t, p, s in _THREATS)))
    return files(spark, d).select("file_id", F.explode(found).alias("t")).select("file_id", "t.*")


@query(f"""WITH {LINES}, E AS (SELECT *, CASE WHEN contains(line, '*/') THEN false WHEN contains(line, '/*') THEN true END AS e FROM L)
SELECT file_id, line_no, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_block FROM E""")
def win_block_comment(spark, d):  # noqa: ANN001, ANN201
    return ln.block_comment_state(solidity_lines(spark, d), "file_id").select("file_id", "line_no", "in_block")


@query(f"""WITH {LINES} SELECT file_id, line_no, CAST(sum(length(line) - length(replace(line, '{{', '')) - (length(line) - length(replace(line, '}}', '')))) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM L""")
def win_brace_depth(spark, d):  # noqa: ANN001, ANN201
    return ln.brace_depth(solidity_lines(spark, d), "file_id").select("file_id", "line_no", "depth")


@query(f"WITH {FN} SELECT file_id, line_no, fn FROM FN WHERE contains(line, 'require(')")
def win_last_nonnull(spark, d):  # noqa: ANN001, ANN201
    return graph.function_lines(solidity_lines(spark, d), "file_id").filter(F.col("line").contains("require(")).select("file_id", "line_no", "fn")


@query(f"""WITH {LINES}, W AS (SELECT file_id, line_no, line, list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ahead FROM L),
S AS (SELECT file_id, line_no, ahead, coalesce(list_position(list_transform(ahead, lambda x: contains(x, '{{')), true), 0) AS stop FROM W WHERE {_FN} <> '')
SELECT file_id, line_no, array_to_string(list_transform(CASE WHEN stop > 0 THEN ahead[1:stop] ELSE ahead END, lambda x: trim(x)), ' ') AS signature FROM S""")
def win_signature(spark, d):  # noqa: ANN001, ANN201
    return ln.full_signature(files(spark, d).filter(F.col("path").endswith(".sol")), "file_id", "content", graph.DECLARED)


@query(f"""WITH {FN}, C AS (SELECT *, last_value(CASE WHEN contains(line, '.call{{') THEN line_no END IGNORE NULLS) OVER (PARTITION BY file_id, fn ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call_line FROM FN WHERE fn IS NOT NULL)
SELECT file_id, fn, call_line, line_no AS write_line FROM C WHERE call_line IS NOT NULL AND regexp_matches(line, '^ *[a-zA-Z0-9_]+ [-+*/]?= ')""")
def win_call_before_write(spark, d):  # noqa: ANN001, ANN201
    return graph.call_before_write(solidity_lines(spark, d), "file_id", F.col("line").contains(".call{"), F.col("line").rlike("^ *[a-zA-Z0-9_]+ [-+*/]?= "))


def declared(spark: SparkSession, d: str) -> DataFrame:
    """The declarations of all Solidity sources."""
    return structure.declaration_rows(files(spark, d).filter(F.col("path").endswith(".sol")), "file_id", "content")


_HEADS = r"""B0 AS (SELECT unnest(regexp_extract_all(t, '\b(?:contract|interface|library)\s+[A-Za-z_$][A-Za-z0-9_$]*\s+is\s+[^{;]+\{')) AS h FROM K),
B1 AS (SELECT regexp_extract(h, '^[a-z]+\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS a, unnest(string_split(regexp_replace(regexp_extract(h, '\sis\s+([^{;]+)', 1), '\([^()]*\)', '', 'g'), ',')) AS b FROM B0),
B AS (SELECT DISTINCT a, regexp_extract(b, '([A-Za-z_$][A-Za-z0-9_$]*)\s*$', 1) AS b FROM B1)"""
_CALLED = r"""PC AS (SELECT file_id, regexp_extract(x, '^[A-Za-z_$][A-Za-z0-9_$]*') AS caller, x FROM (SELECT file_id, unnest(string_split_regex(t, '\bfunction\s+')[2:]) AS x FROM K)),
N AS (SELECT DISTINCT file_id, caller, unnest(regexp_extract_all(x, '([A-Za-z0-9_$.]+)\s*\(', 1)) AS callee FROM PC WHERE caller <> ''),
X AS (SELECT N.file_id, caller, callee FROM N JOIN (SELECT DISTINCT file_id, caller AS fn FROM PC) D ON D.file_id = N.file_id AND D.fn = N.callee WHERE caller <> callee),
FNS AS (SELECT file_id, line_no, line, last_value(nullif(regexp_extract(line, '\bfunction\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), '') IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS fn FROM KL)"""


@query(f"WITH {CLEAN}, {_HEADS}, {_CALLED} SELECT 'inherits' AS kind, a, b FROM B UNION ALL SELECT 'calls', file_id || '#' || caller, file_id || '#' || callee FROM X")
def graph_edges(spark, d):  # noqa: ANN001, ANN201
    """Contracts with their bases, and functions with those of the same file that they call."""
    rows = declared(spark, d)
    name = lambda c: F.concat(F.col("file_id").cast("string"), F.lit("#"), c)
    calls = structure.call_edges(rows, "file_id").select(F.lit("calls").alias("kind"), name(F.col("caller")).alias("a"), name(F.col("callee")).alias("b"))
    return structure.base_edges(rows).select(F.lit("inherits").alias("kind"), "a", "b").unionByName(calls)


_FOLDERS = "E0 AS (SELECT path, list_filter(generate_series(1, length(path)), lambda i: path[i] = '/') AS cuts FROM (SELECT DISTINCT path FROM source_files)), E AS (SELECT DISTINCT CASE WHEN k = 1 THEN '' ELSE path[1:cuts[k - 1] - 1] END AS a, CASE WHEN k > len(cuts) THEN path ELSE path[1:cuts[k] - 1] END AS b FROM (SELECT path, cuts, unnest(generate_series(1, len(cuts) + 1)) AS k FROM E0))"


def _folders(spark: SparkSession, d: str) -> DataFrame:
    """``a, b``: every folder with what lies directly in it."""
    steps = F.split("path", "/")
    upto = lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/")
    pair = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(upto(k - 1).alias("a"), upto(k).alias("b")))
    return table(spark, d, "source_files").select("path").distinct().select(F.explode(pair).alias("e")).select("e.*").distinct()


@query(f"WITH RECURSIVE {_FOLDERS}, G AS (SELECT a, b, 1 AS hops FROM E UNION SELECT G.a, E.b, G.hops + 1 FROM G JOIN E ON E.a = G.b) SELECT a, b, CAST(min(hops) AS INTEGER) AS hops FROM G GROUP BY a, b")
def graph_reach(spark, d):  # noqa: ANN001, ANN201
    """The folders of the sources with all that lies below them, at any depth."""
    return graph.reach(_folders(spark, d))


@query(f"WITH RECURSIVE {CLEAN}, {_HEADS}, G AS (SELECT a, b, 1 AS hops FROM B UNION SELECT G.a, B.b, G.hops + 1 FROM G JOIN B ON B.a = G.b WHERE G.hops < 10) SELECT a, b, CAST(min(hops) AS INTEGER) AS hops FROM G GROUP BY a, b")
def graph_reach_bases(spark, d):  # noqa: ANN001, ANN201
    """Contracts with all they inherit from, over at most ten steps."""
    return graph.reach(structure.base_edges(declared(spark, d)), 10)


@query(f"WITH RECURSIVE {_FOLDERS}, G AS (SELECT a AS node FROM E WHERE a LIKE '%/contracts' UNION SELECT E.b FROM G JOIN E ON E.a = G.node) SELECT node FROM G")
def graph_reachable(spark, d):  # noqa: ANN001, ANN201
    """What lies in or below folders named contracts, from those folders on."""
    edges = _folders(spark, d)
    return graph.reachable_from(edges, edges.filter(F.col("a").endswith("/contracts")).select(F.col("a").alias("node")))


@query("""WITH T AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), E AS (SELECT DISTINCT user_id, a, b FROM T WHERE b IS NOT NULL)
SELECT x.user_id, x.a, x.b FROM E x JOIN E y ON x.user_id = y.user_id AND x.a = y.b AND x.b = y.a WHERE x.a < x.b""")
def graph_two_cycle(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).filter("b is not null")
    return graph.two_cycles(e, "user_id")


@query(rf"""WITH RECURSIVE {CLEAN}, {_CALLED}, O AS (SELECT DISTINCT file_id, regexp_extract(line, '\bfunction\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS fn FROM KL WHERE regexp_matches(line, '\bfunction\s+[A-Za-z_$]') AND regexp_matches(line, '\b(public|external)\b')),
G AS (SELECT file_id, fn FROM O UNION SELECT X.file_id, X.callee FROM G JOIN X ON X.file_id = G.file_id AND X.caller = G.fn) SELECT FNS.file_id, FNS.line_no FROM FNS LEFT JOIN G ON G.file_id = FNS.file_id AND G.fn = FNS.fn WHERE regexp_matches(line, '\.call\{{') AND (FNS.fn IS NULL OR G.fn IS NOT NULL)""")
def semi_reachable(spark, d):  # noqa: ANN001, ANN201
    """Low-level calls outside of functions or in functions that an entry point reaches."""
    rows = declared(spark, d)
    name = lambda c: F.concat_ws("#", F.col("file_id").cast("string"), c)
    edges = structure.call_edges(rows, "file_id").select(name(F.col("caller")).alias("a"), name(F.col("callee")).alias("b"))
    reached = graph.reachable_from(edges, structure.entry_points(rows, "file_id").select(name(F.col("fn")).alias("node")))
    clean = files(spark, d).filter(F.col("path").endswith(".sol")).select("file_id", F.regexp_replace("content", "\r\n", "\n").alias("content"))
    places = ln.split_lines(structure.blanked(clean, "file_id", "content"), "file_id", "content").filter(F.col("line").rlike(r"\.call\{"))
    inside = structure.enclosing(places.select("file_id", "line_no"), rows, "file_id").withColumn("node", F.when(F.col("fn").isNotNull(), name(F.col("fn"))))
    return inside.filter("fn is null").select("file_id", "line_no").unionByName(inside.join(reached, "node", "left_semi").select("file_id", "line_no"))


@query()
def fold_taint(spark, d):  # noqa: ANN001, ANN201
    return taint_fold(files(spark, d).filter(F.col("path").endswith(".sol")), "file_id", "content")


@query(rf"WITH {CLEAN} SELECT file_id, fn, line_no AS start_line, CAST(count(*) AS BIGINT) AS n FROM (SELECT file_id, line_no, unnest(regexp_extract_all(line, '\bfunction\s+([A-Za-z_$][A-Za-z0-9_$]*)[^{{;]*[{{;]', 1)) AS fn FROM KL) GROUP BY ALL")
def explode_functions(spark, d):  # noqa: ANN001, ANN201
    """The functions that the sources declare."""
    return structure.functions_of(declared(spark, d)).filter("kind = 'function'").groupBy("file_id", F.col("name").alias("fn"), "start_line").agg(F.count(F.lit(1)).alias("n"))


_SPANS = rf"""{CLEAN}, DL AS (SELECT *, CAST(sum(length(line) - length(replace(line, '{{', '')) - (length(line) - length(replace(line, '}}', '')))) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM KL),
ST AS (SELECT file_id, line_no, line, regexp_extract(line, '\bfunction\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS fn, coalesce(lag(depth) OVER (PARTITION BY file_id ORDER BY line_no), 0) AS before FROM DL QUALIFY fn <> '')"""


@query(rf"WITH {_SPANS} SELECT ST.file_id, fn, ST.line_no AS start_line, CAST(min(DL.line_no) AS INTEGER) AS end_line FROM ST JOIN DL ON DL.file_id = ST.file_id AND DL.line_no >= ST.line_no AND DL.depth <= ST.before WHERE regexp_matches(ST.line, '[{{;]') GROUP BY ST.file_id, fn, ST.line_no")
def function_spans(spark, d):  # noqa: ANN001, ANN201
    """First and last line of every function that ends; of several on one line the first."""
    rows = structure.functions_of(declared(spark, d)).filter("kind = 'function' and end_line is not null")
    first = rows.groupBy("file_id", "start_line").agg(F.min(F.struct("node", "name", "end_line")).alias("x"))
    return first.select("file_id", F.col("x.name").alias("fn"), "start_line", F.col("x.end_line").alias("end_line"))


@query(rf"WITH {CLEAN}, T AS (SELECT file_id, line_no, last_value(nullif(regexp_extract(line, '\bfunction\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), '') IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS fn, CAST(regexp_matches(line, '\bif\b|\bfor\b|\bwhile\b') AS INTEGER) AS hit FROM KL) SELECT fn, CAST(sum(hit) AS BIGINT) AS lines FROM T WHERE fn IS NOT NULL GROUP BY fn HAVING sum(hit) > 3")
def function_branches(spark, d):  # noqa: ANN001, ANN201
    """Lines with branches by name of the function they lie in."""
    clean = files(spark, d).filter(F.col("path").endswith(".sol")).select("file_id", F.regexp_replace("content", "\r\n", "\n").alias("content"))
    places = ln.split_lines(structure.blanked(clean, "file_id", "content"), "file_id", "content").filter(F.col("line").rlike(r"\bif\b|\bfor\b|\bwhile\b")).select("file_id", "line_no")
    return structure.enclosing(places, declared(spark, d), "file_id").filter("fn is not null").groupBy("fn").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 3")


@query(rf"WITH {SF} SELECT file_id, md5(regexp_replace(content, '{_NOISE_SQL}', '\1', 'g')) AS hash, CAST(length(regexp_replace(content, '{_NOISE_SQL}', '\1', 'g')) AS INTEGER) AS n_chars FROM SF WHERE content IS NOT NULL AND path LIKE '%.sol'")
def str_strip_comments(spark, d):  # noqa: ANN001, ANN201
    bare = structure.strip_comments(F.col("content"))
    return files(spark, d).filter(F.col("content").isNotNull() & F.col("path").endswith(".sol")).select("file_id", F.md5(bare).alias("hash"), F.length(bare).alias("n_chars"))


#: Openings of names that belong together, of the words that the test sources use.
_PAIRS = (("harvest", "execute"), ("register", "claim"), ("liquidate", "withdraw"), ("stake", "seize"))


@query(f"WITH {SF}, F AS (SELECT DISTINCT file_id, unnest(functions) AS fn FROM SF), P(x, y) AS (VALUES {', '.join(map(repr, _PAIRS))}) SELECT a.file_id, a.fn AS one, b.fn AS other FROM F a JOIN P ON contains(lower(a.fn), x) JOIN F b ON b.file_id = a.file_id AND contains(lower(b.fn), y)")
def pair_join(spark, d):  # noqa: ANN001, ANN201
    return fd.paired_names(files(spark, d).select("file_id", F.explode("functions").alias("fn")).distinct(), "file_id", "fn", _PAIRS)


@query("SELECT a.user_id, a.event_id AS first_id, b.event_id AS next_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) b ON a.user_id = b.user_id AND b.n = a.n + 1 WHERE a.event_type = 'error' AND b.event_type = 'error'")
def selfjoin_calls(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("next_id", F.lead("event_id").over(w)).withColumn("next_type", F.lead("event_type").over(w))
    return e.filter("event_type = 'error' and next_type = 'error'").select("user_id", F.col("event_id").alias("first_id"), "next_id")


@query("SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def asof_enclosing(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "ts", "event_type")
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("click_id", last).filter("event_type = 'purchase' and click_id is not null").select("event_id", "click_id")


@query("WITH P AS (SELECT DISTINCT package FROM vendor_releases), I AS (SELECT DISTINCT import_id, path FROM file_imports) SELECT import_id, package FROM I JOIN P ON contains(path, package)")
def theta_contains(spark, d):  # noqa: ANN001, ANN201
    packages = table(spark, d, "vendor_releases").select("package").distinct()
    return fd.contained_names(table(spark, d, "file_imports").select("import_id", "path").distinct(), packages, "path", "package").select("import_id", "package")


@query(f"WITH {SF}, I AS (SELECT DISTINCT file_id, path FROM file_imports), N AS (SELECT file_id, repo, regexp_extract(name, '^[A-Z][a-z]+') AS name FROM SF WHERE name IS NOT NULL AND path LIKE '%.sol') SELECT DISTINCT a.file_id AS importer, n.file_id AS imported FROM I i JOIN SF a ON a.file_id = i.file_id JOIN N n ON n.repo = a.repo AND n.file_id <> a.file_id AND n.name <> '' AND contains(i.path, n.name)")
def theta_selfjoin(spark, d):  # noqa: ANN001, ANN201
    """Importing and imported files of a repository: the import path contains the first word of the name (the test
    files carry running numbers, which imports leave out)."""
    own = files(spark, d).select("file_id", "repo", "name", "path")
    paths = table(spark, d, "file_imports").select(F.col("file_id").alias("importer"), F.col("path").alias("target")).distinct().join(own.select(F.col("file_id").alias("importer"), "repo"), "importer")
    named = own.filter(F.col("name").isNotNull() & F.col("path").endswith(".sol")).select(F.col("file_id").alias("imported"), "repo", F.regexp_extract("name", "^[A-Z][a-z]+", 0).alias("name"))
    return fd.contained_names(paths, named, "target", "name", ["repo"]).filter("importer <> imported").select("importer", "imported").distinct()


@query("WITH I AS (SELECT DISTINCT import_id, file_id, path FROM file_imports), N AS (SELECT DISTINCT regexp_extract(path, '^([a-z]+/)', 1) AS name FROM vendor_releases) SELECT DISTINCT file_id, name FROM I JOIN N ON name <> '' AND contains(path, name)".replace("\\\\", "\\"))
def imports_of_releases(spark, d):  # noqa: ANN001, ANN201
    """Files with the folders of the library releases that their import paths name."""
    names = table(spark, d, "vendor_releases").select(F.regexp_extract("path", "^([a-z]+/)", 1).alias("name")).distinct()
    return fd.contained_names(table(spark, d, "file_imports").select("file_id", "path").distinct(), names, "path", "name").select("file_id", "name").distinct()


_STEPS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_path, '^\s+|\s+$', '', 'g'), '\\', '/', 'g'), '/+', '/', 'g'), '^(\./)+', ''), '(/\.)+(/|$)', '\2', 'g'), '(^|/)[^/.][^/]*/\.\.(/|$)', '\1', 'g'), '(^|/)[^/.][^/]*/\.\.(/|$)', '\1', 'g')"


_NOW, _TTL_DAYS = "2025-01-01 00:00:00", 400


@query(f"""WITH {SF}, C AS (SELECT DISTINCT {_STEPS} AS path, CAST(last_modified AS VARCHAR) AS version, scan_timestamp FROM cache_entries), V AS (SELECT DISTINCT path, version FROM C WHERE date_diff('second', scan_timestamp, TIMESTAMP '{_NOW}') <= {_TTL_DAYS} * 86400)
SELECT file_id, CASE WHEN V.path IS NULL THEN 'scan' ELSE 'hit' END AS state FROM SF LEFT JOIN V ON V.path = SF.path AND V.version = CAST(SF.last_modified AS VARCHAR)""")
def cache_hit_split(spark, d):  # noqa: ANN001, ANN201
    """Files whose path and version the cache holds and which are not expired, and those to be scanned. The time of the last
    change stands for the content, as the test cache holds no hash of it."""
    version = lambda: F.col("last_modified").cast("string").alias("hash")
    own = files(spark, d).select("file_id", F.col("path").alias("file"), version())
    cache = table(spark, d, "cache_entries").select(canonical_path(F.col("file_path")).alias("file"), version(), F.col("scan_timestamp").alias("scanned_at"))
    todo, _ = split_by_cache(own, cache, F.lit(_NOW).cast("timestamp"), _TTL_DAYS * 86400)
    state = todo.select("file_id", F.lit("scan").alias("state"))
    return state.unionByName(own.join(todo.select("file_id"), "file_id", "left_anti").select("file_id", F.lit("hit").alias("state")))


@query(f"WITH C AS (SELECT {_STEPS} AS path, entry_id, scan_timestamp FROM (SELECT DISTINCT ON (entry_id) * FROM cache_entries)), M AS (SELECT path, max(scan_timestamp) AS at FROM C GROUP BY path) SELECT C.path AS file, count(*) AS entries, max(C.entry_id) AS last_entry FROM C JOIN M ON M.path = C.path AND M.at = C.scan_timestamp GROUP BY C.path")
def cache_saved(spark, d):  # noqa: ANN001, ANN201
    """Two halves of the cache merged, written and read back: the entries of the latest scan of each file."""
    rows = table(spark, d, "cache_entries").dropDuplicates(["entry_id"]).select(canonical_path(F.col("file_path")).alias("file"), F.col("scan_timestamp").alias("scanned_at"), "entry_id")
    old = F.col("scanned_at") < F.lit(CUTOFF).cast("timestamp_ntz")
    path = scratch(spark, "cache")
    save_cache(rows.filter(old), rows.filter(~old), path)
    return spark.read.parquet(path).groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.max("entry_id").alias("last_entry"))


@query("SELECT package, count(DISTINCT version) AS versions FROM vendor_releases GROUP BY package HAVING count(DISTINCT version) > 1")
def having_distinct(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "vendor_releases").groupBy("package").agg(F.count_distinct("version").alias("versions")).filter("versions > 1")


@query("SELECT file_id, max(CASE WHEN is_local THEN 1 ELSE 0 END) AS any_local, CAST(sum(CASE WHEN is_openzeppelin THEN 1 ELSE 0 END) AS BIGINT) AS trusted, count(DISTINCT split_part(path, '/', 1)) AS families FROM (SELECT DISTINCT import_id, file_id, path, is_local, is_openzeppelin FROM file_imports) GROUP BY file_id")
def agg_conditional(spark, d):  # noqa: ANN001, ANN201
    i = table(spark, d, "file_imports").select("import_id", "file_id", "path", "is_local", "is_openzeppelin").distinct()
    return i.groupBy("file_id").agg(F.max(F.when(F.col("is_local"), 1).otherwise(0)).alias("any_local"), F.sum(F.when(F.col("is_openzeppelin"), 1).otherwise(0)).alias("trusted"), F.count_distinct(F.substring_index("path", "/", 1)).alias("families"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 15")
def agg_repeat_having(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 15")


@query(f"WITH {SF} SELECT file_id, CAST(greatest(0, least(100, 50 + 10 * coalesce(len(modifiers), 0) + 2 * coalesce(len(imports), 0) - 3 * coalesce(len(functions), 0))) AS INTEGER) AS score FROM SF")
def agg_score_expr(spark, d):  # noqa: ANN001, ANN201
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return files(spark, d).select("file_id", F.greatest(F.lit(0), F.least(F.lit(100), 50 + 10 * n("modifiers") + 2 * n("imports") - 3 * n("functions"))).alias("score"))


@query(r"WITH " + LINES + r""", I AS (SELECT file_id, line_no, regexp_extract(line, 'import\s+[^"]*"([^"]+)"', 1) AS target FROM L WHERE regexp_matches(line, '^\s*import\s')) SELECT file_id, line_no, target, starts_with(target, '.') AS is_local, starts_with(target, '@') AS scoped, nullif(regexp_extract(target, '@([0-9]+\.[0-9]+\.[0-9]+)', 1), '') AS version FROM I""")
def regexp_extract_urls(spark, d):  # noqa: ANN001, ANN201
    target = F.regexp_extract("line", r'import\s+[^"]*"([^"]+)"', 1)
    rows = solidity_lines(spark, d).filter(F.col("line").rlike(r"^\s*import\s")).select("file_id", "line_no", target.alias("target"))
    return rows.select("file_id", "line_no", "target", F.startswith("target", F.lit(".")).alias("is_local"), F.startswith("target", F.lit("@")).alias("scoped"), F.nullif(F.regexp_extract("target", r"@([0-9]+\.[0-9]+\.[0-9]+)", 1), F.lit("")).alias("version"))


@query(f"WITH {SF} SELECT file_id, array_to_string(regexp_extract_all(content, 'event ([A-Za-z0-9_]+)', 1), ',') AS events FROM SF WHERE content IS NOT NULL AND contains(content, 'event ')")
def array_extract_all(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).filter(F.col("content").contains("event ")).select("file_id", F.array_join(F.regexp_extract_all("content", F.lit("event ([A-Za-z0-9_]+)"), F.lit(1)), ",").alias("events"))


_KEYWORDS = ("uint256", "address", "public", "private", "internal", "external", "function", "returns", "return", "memory", "if", "else", "require", "emit")


@query(f"WITH {LINES} SELECT file_id, line_no, array_to_string(list_filter(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: x NOT IN {_KEYWORDS}), ' ') AS names FROM L WHERE contains(line, 'require(')")
def array_filter_keywords(spark, d):  # noqa: ANN001, ANN201
    names = F.filter(F.regexp_extract_all("line", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda x: ~x.isin(*_KEYWORDS))
    return solidity_lines(spark, d).filter(F.col("line").contains("require(")).select("file_id", "line_no", F.array_join(names, " ").alias("names"))


@query(f"WITH {SF} SELECT file_id, regexp_replace(regexp_replace(path, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM SF")
def str_sanitize(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).select("file_id", sanitize_name(F.col("path")).alias("safe"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(max(CAST(json_extract(props, '$.k') AS INTEGER)) AS INTEGER) AS most FROM events GROUP BY event_type")
def json_props_parse(spark, d):  # noqa: ANN001, ANN201
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"))


@query("SELECT v.category AS \"check\", v.severity AS impact, v.confidence AS confidence, v.title AS description, file_path AS file, v.line_number AS line_no FROM (SELECT DISTINCT ON (entry_id) entry_id, file_path, vulnerabilities FROM cache_entries), unnest(vulnerabilities) AS t(v)")
def json_nested_explode(spark, d):  # noqa: ANN001, ANN201
    """Cached findings as reports of an external analyser, written as JSON and read with its nested schema."""
    place = F.struct(F.col("file_path").alias("filename_relative"), F.lit(0).alias("start"))
    element = lambda v: F.struct(F.lit("node").alias("type"), F.struct(place["start"].alias("start"), place["filename_relative"].alias("filename_relative"), F.array(v["line_number"]).alias("lines")).alias("source_mapping"))
    detector = lambda v: F.struct(v["category"].alias("check"), v["severity"].alias("impact"), v["confidence"].alias("confidence"), v["title"].alias("description"), F.array(element(v)).alias("elements"))
    e = table(spark, d, "cache_entries").dropDuplicates(["entry_id"]).filter("vulnerabilities is not null")
    reports = e.select(F.lit(True).alias("success"), F.struct(F.transform("vulnerabilities", detector).alias("detectors")).alias("results"))
    path = scratch(spark, "analyser")
    reports.write.json(path)
    return read_report(spark, path, lines=True)


@query("SELECT path FROM source_files UNION SELECT contract_path FROM abi_docs WHERE contract_path IS NOT NULL")
def union_distinct(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "source_files").select("path").union(table(spark, d, "abi_docs").select("contract_path")).filter("path is not null").distinct()


_CHECKS = (("solidity", "S1", "pragma solidity"), ("solidity", "S2", "function [a-z]+"), ("javascript", "J1", r"require\("), ("python", "P1", "import "), ("json", "O1", '"name"'))


@query(f"""WITH {SF}, Y(lang, id, pattern) AS (VALUES {', '.join(map(repr, _CHECKS))}) SELECT file_id, lang, id, regexp_matches(content, pattern) AS met FROM SF JOIN Y ON lang = language WHERE content IS NOT NULL""".replace("\\\\", "\\"))
def equi_then_regex(spark, d):  # noqa: ANN001, ANN201
    """A table of checks, joined by language; each pattern then runs over the texts of its language."""
    checks = spark.createDataFrame(_CHECKS, "lang string, id string, pattern string")
    own = files(spark, d).filter("content is not null").select("file_id", F.col("language").alias("lang"), "content")
    return own.join(checks, "lang").select("file_id", "lang", "id", F.expr("content rlike pattern").alias("met"))


def _tool_rows(spark: SparkSession, d: str, origin: str) -> DataFrame:
    e = table(spark, d, "cache_entries").dropDuplicates(["entry_id"]).filter(F.col("origin") == origin)
    v = e.select(canonical_path(F.col("file_path")).alias("file"), F.explode("vulnerabilities").alias("v"))
    return v.select("file", F.col("v.vuln_id").alias("id"), F.col("v.category").alias("category"), F.col("v.line_number").alias("line_no"), F.coalesce("v.title", F.lit("")).alias("title")).dropDuplicates(["id"])


_TOOL = lambda o: f"SELECT DISTINCT ON (v.vuln_id) {_STEPS} AS file, v.vuln_id AS id, v.category AS category, v.line_number AS line_no, list_distinct(list_filter(string_split_regex(lower(coalesce(v.title, '')), '\\s+'), lambda x: strlen(x) > 3)) AS words FROM (SELECT DISTINCT ON (entry_id) * FROM cache_entries), unnest(vulnerabilities) AS t(v) WHERE origin = '{o}'"


@query(f"""WITH X AS ({_TOOL("ast_engine")}), Y AS ({_TOOL("regex_rules")}), J AS (SELECT x.file, x.id AS left_id, y.id AS right_id, x.category = y.category AS same, abs(x.line_no - y.line_no) AS gap, len(list_intersect(x.words, y.words)) AS common, len(list_distinct(list_concat(x.words, y.words))) AS total FROM X x JOIN Y y USING (file))
SELECT file, left_id, right_id, round(0.4::DOUBLE + CASE WHEN gap = 0 THEN 0.3 WHEN gap <= 5 THEN 0.2 ELSE 0.1 END::DOUBLE + CASE WHEN total > 0 THEN 0.3::DOUBLE * common / total ELSE 0 END, 6) AS score FROM J WHERE same AND gap <= 20""")
def jaccard_similarity(spark, d):  # noqa: ANN001, ANN201
    return fd.match_scores(_tool_rows(spark, d, "ast_engine"), _tool_rows(spark, d, "regex_rules"), "file")


@query(f"""WITH RECURSIVE X AS ({_TOOL("ast_engine")}), Y AS ({_TOOL("regex_rules")}), J AS (SELECT x.file, x.id AS left_id, y.id AS right_id, abs(x.line_no - y.line_no) AS gap, len(list_intersect(x.words, y.words)) AS common, len(list_distinct(list_concat(x.words, y.words))) AS total FROM X x JOIN Y y ON x.file = y.file AND x.category = y.category WHERE abs(x.line_no - y.line_no) <= 20),
M AS (SELECT * FROM (SELECT file, left_id, right_id, round(0.4::DOUBLE + CASE WHEN gap = 0 THEN 0.3 WHEN gap <= 5 THEN 0.2 ELSE 0.1 END::DOUBLE + CASE WHEN total > 0 THEN 0.3::DOUBLE * common / total ELSE 0 END, 6) AS score FROM J) WHERE score > 0.7),
C AS (SELECT file, left_id, list(right_id ORDER BY score DESC, right_id) AS c, row_number() OVER (PARTITION BY file ORDER BY left_id) AS n FROM M GROUP BY file, left_id),
G(file, n, left_id, pick, taken) AS (SELECT file, n, left_id, c[1], [c[1]] FROM C WHERE n = 1 UNION ALL SELECT file, n, left_id, p, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END FROM (SELECT C.file, C.n, C.left_id, G.taken, list_filter(C.c, lambda x: NOT list_contains(G.taken, x))[1] AS p FROM G JOIN C ON C.file = G.file AND C.n = G.n + 1)),
P AS (SELECT G.file, G.left_id, G.pick AS right_id, M.score FROM G JOIN M ON M.file = G.file AND M.left_id = G.left_id AND M.right_id = G.pick)
SELECT X.file, X.id AS left_id, P.right_id, P.score FROM X LEFT JOIN P ON P.file = X.file AND P.left_id = X.id UNION ALL SELECT Y.file, NULL, Y.id, NULL FROM Y WHERE NOT EXISTS (SELECT 1 FROM P WHERE P.right_id = Y.id)""")
def best_match_greedy(spark, d):  # noqa: ANN001, ANN201
    return fd.best_matches(_tool_rows(spark, d, "ast_engine"), _tool_rows(spark, d, "regex_rules"), "file")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark, d):  # noqa: ANN001, ANN201
    """The events as a stream, worked off once; the result has one row for each hour and type."""
    return counts_of_stream(spark, d, "events.parquet")


@query(f"WITH {SF} SELECT file_id, {', '.join(f'CAST(len(regexp_extract_all(content, {r.pattern!r})) AS INTEGER) AS {r.rule_id.lower()}' for r in NEUTRAL)} FROM SF WHERE content IS NOT NULL".replace("\\\\", "\\"))
def multi_count(spark, d):  # noqa: ANN001, ANN201
    return files(spark, d).filter("content is not null").select("file_id", *(F.regexp_count("content", F.lit(r.pattern)).alias(r.rule_id.lower()) for r in NEUTRAL))
