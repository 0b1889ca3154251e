"""Queries over the standard tables read as programs: orders are files, their lines callouts, headed ranges paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.functions import extract
from ferrolith.operators import calls, citations, diagrams, graph
from ferrolith.plans import graphs, texts
from ferrolith.plans.registry import Registry, table

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql

CALLOUTS = """callouts AS (SELECT 'src/O' || l_orderkey || '.cbl' AS file_id, CASE WHEN l_linenumber > 1 THEN 'L' || l_linenumber END AS artifact,
  CASE l_partkey % 4 WHEN 0 THEN 'P' || l_partkey || '.cpy' WHEN 1 THEN 'lib/p' || l_partkey WHEN 2 THEN 'P' || l_partkey ELSE 'X' || l_partkey || '.cobol' END AS target,
  CASE l_suppkey % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'performs' ELSE 'includes' END AS relation, l_linenumber::BIGINT AS line FROM lineitem)"""


def _callouts(spark, d) -> DataFrame:
    k, part = F.col("l_partkey").cast("string"), F.col("l_partkey") % 4
    target = F.when(part == 0, F.concat(F.lit("P"), k, F.lit(".cpy"))).when(part == 1, F.concat(F.lit("lib/p"), k)).when(part == 2, F.concat(F.lit("P"), k)).otherwise(F.concat(F.lit("X"), k, F.lit(".cobol")))
    s = F.col("l_suppkey") % 3
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("src/O"), F.col("l_orderkey").cast("string"), F.lit(".cbl")).alias("file_id"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))).alias("artifact"),
        target.alias("target"), F.when(s == 0, "calls").when(s == 1, "performs").otherwise("includes").alias("relation"), F.col("l_linenumber").cast("bigint").alias("line"),
    )


NAMES = "names AS (SELECT CASE WHEN p_partkey % 8 = 2 THEN 'p' || p_partkey || '.CPY' ELSE 'P' || p_partkey END AS name FROM part)"
EXT = r"'\.(cpy|copy|cbl|cob|cobol)$'"


@registry.add(f"""WITH {CALLOUTS}, {NAMES}, c AS (SELECT *, lower(target) AS t FROM callouts), n AS (SELECT name, lower(name) AS m FROM names)
SELECT name, file_id, artifact, relation, line FROM c JOIN n ON t = m
UNION ALL SELECT name, file_id, artifact, relation, line FROM c JOIN n ON regexp_replace(t, {EXT}, '') = m WHERE regexp_matches(t, {EXT})
UNION ALL SELECT name, file_id, artifact, relation, line FROM c JOIN n ON t = regexp_replace(m, {EXT}, '') WHERE regexp_matches(m, {EXT})
UNION ALL SELECT name, file_id, artifact, relation, line FROM c JOIN n ON split_part(t, '/', -1) = m WHERE contains(t, '/')""")
def callers_of(spark, d):
    k = F.col("p_partkey").cast("string")
    names = table(spark, d, "part").select(F.when(F.col("p_partkey") % 8 == 2, F.concat(F.lit("p"), k, F.lit(".CPY"))).otherwise(F.concat(F.lit("P"), k)).alias("name"))
    return calls.callers(_callouts(spark, d), names)


KNOWN = "known AS (SELECT lower('p' || p_partkey) AS key FROM part WHERE p_partkey % 2 = 0 UNION SELECT lower('O' || o_orderkey) FROM orders)"
DIRECTORY = f"""{CALLOUTS}, {KNOWN}, found AS (SELECT coalesce(artifact, regexp_replace(split_part(file_id, '/', -1), '\\.cbl$', '')) AS "from", target AS "to", relation AS type, line, k.key IS NOT NULL AS resolved FROM callouts LEFT JOIN known k ON k.key = lower(target))"""


def _directory(spark, d) -> DataFrame:
    artifacts = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    files = table(spark, d, "orders").select(F.concat(F.lit("src/O"), F.col("o_orderkey").cast("string"), F.lit(".cbl")).alias("file_id"))
    return calls.directory_callouts(_callouts(spark, d), artifacts, files)


@registry.add(f'WITH {DIRECTORY} SELECT "from", "to", type, line, resolved FROM found')
def callouts_directory(spark, d):
    return _directory(spark, d)


@registry.add(f'WITH {DIRECTORY} SELECT DISTINCT "from" AS from_artifact, "to" AS to_target, type AS call_type FROM found')
def callouts_compact(spark, d):
    return calls.compact_callouts(_directory(spark, d))


@registry.add(f"""WITH {texts.LINES}, {texts.RANGES}, n AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS k, sum(line_end - line_start + 1)::BIGINT AS size FROM ranges GROUP BY doc_id)
SELECT n.doc_id AS file_id, n_lines, coalesce(k, 0) AS n_artifacts, coalesce(size, 0) AS artifact_lines FROM n LEFT JOIN r ON r.doc_id = n.doc_id""")
def file_stats(spark, d):
    lines, ranges = (t.withColumnRenamed("doc_id", "file_id") for t in (texts._lines(spark, d), texts._ranges(spark, d)))
    return calls.file_stats(lines, ranges)


ARTIFACTS = """artifacts AS (SELECT 'src/O' || l_orderkey || '.cbl' AS file_id, l_linenumber || '-' || l_partkey AS name, CASE l_partkey % 5 WHEN 0 THEN 'program' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'function' ELSE 'record_layout' END AS type, l_linenumber AS line_start FROM lineitem)"""


@registry.add(f"""WITH {CALLOUTS}, {ARTIFACTS}, n AS (SELECT file_id, count(*) AS n FROM artifacts GROUP BY file_id),
may AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_start, name) AS p FROM artifacts WHERE type IN ('program', 'procedure', 'function', 'paragraph')),
e AS (SELECT m.file_id, m.name, min(m.p) AS p FROM may m JOIN may f ON f.file_id = m.file_id AND f.p = 1 WHERE CASE WHEN f.type = 'paragraph' THEN m.p = 1 ELSE m.type <> 'paragraph' END GROUP BY m.file_id, m.name),
e5 AS (SELECT file_id, string_agg(name, ' ' ORDER BY p) AS entry_points FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY p) AS k FROM e) WHERE k <= 5 GROUP BY file_id),
c AS (SELECT DISTINCT file_id, target FROM callouts WHERE relation IN ('calls', 'executes', 'performs') AND (artifact IS NOT NULL OR relation <> 'performs')),
c10 AS (SELECT file_id, string_agg(target, ' ' ORDER BY target) AS main_calls FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY target) AS k FROM c) WHERE k <= 10 GROUP BY file_id)
SELECT f.file_id, coalesce(n.n, 0) AS n_artifacts, coalesce(entry_points, '') AS entry_points, coalesce(main_calls, '') AS main_calls
FROM (SELECT 'src/O' || o_orderkey || '.cbl' AS file_id FROM orders) f LEFT JOIN n ON n.file_id = f.file_id LEFT JOIN e5 ON e5.file_id = f.file_id LEFT JOIN c10 ON c10.file_id = f.file_id""")
def file_summary(spark, d):
    files = table(spark, d, "orders").select(F.concat(F.lit("src/O"), F.col("o_orderkey").cast("string"), F.lit(".cbl")).alias("file_id"))
    k = F.col("l_partkey") % 5
    artifacts = table(spark, d, "lineitem").select(
        F.concat(F.lit("src/O"), F.col("l_orderkey").cast("string"), F.lit(".cbl")).alias("file_id"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("name"),
        F.when(k == 0, "program").when(k == 1, "paragraph").when(k == 2, "function").otherwise("record_layout").alias("type"), F.col("l_linenumber").alias("line_start"),
    )
    found = calls.file_summary(files, artifacts, _callouts(spark, d))
    return found.withColumns({c: F.array_join(c, " ") for c in ("entry_points", "main_calls")})


PROGRAM_CALLS = """pcalls AS (SELECT 'CUST' || o_custkey AS src, CASE o_orderkey % 5 WHEN 0 THEN 'DFH' || o_orderkey % 7 WHEN 1 THEN 'cust' || o_orderkey % 100 || '$' WHEN 2 THEN '(WS-PGM)' WHEN 3 THEN 'LIBX' || o_orderkey % 11 ELSE 'ZZ' || o_orderkey % 13 END AS dst FROM orders),
sys AS (WITH e AS (SELECT DISTINCT src AS caller, regexp_replace(upper(dst), '\\$+$', '') AS callee FROM pcalls), o AS (SELECT caller AS name, count(*) AS n FROM e GROUP BY caller), i AS (SELECT callee AS name, count(*) AS n FROM e GROUP BY callee),
  a AS (SELECT name FROM o UNION SELECT name FROM i UNION SELECT 'CUST' || c_custkey FROM customer)
  SELECT a.name, coalesce(o.n, 0) AS n_calls, coalesce(i.n, 0) AS n_called_by, CASE WHEN a.name IN (SELECT 'CUST' || c_custkey FROM customer) THEN
      CASE WHEN o.n IS NULL AND i.n IS NULL THEN 'isolated' WHEN i.n IS NULL THEN 'entry' WHEN o.n IS NULL THEN 'leaf' ELSE 'inner' END
    WHEN a.name LIKE '(%' THEN 'dynamic' WHEN a.name LIKE 'DFH%' THEN 'system_utility' WHEN a.name LIKE 'LIB%' THEN 'external_library' ELSE 'missing_source' END AS kind
  FROM a LEFT JOIN o ON o.name = a.name LEFT JOIN i ON i.name = a.name)""".replace("\\\\", "\\")


def _system(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    dst = F.when(k % 5 == 0, text("DFH", 7)).when(k % 5 == 1, F.concat(text("cust", 100), F.lit("$"))).when(k % 5 == 2, "(WS-PGM)").when(k % 5 == 3, text("LIBX", 11)).otherwise(text("ZZ", 13))
    edges = table(spark, d, "orders").select(F.concat(F.lit("CUST"), F.col("o_custkey").cast("string")).alias("src"), dst.alias("dst"))
    programs = table(spark, d, "customer").select(F.concat(F.lit("CUST"), F.col("c_custkey").cast("string")).alias("name"))
    return calls.system_calls(edges, programs)


@registry.add(f"WITH {PROGRAM_CALLS} SELECT name, kind, n_calls, n_called_by FROM sys")
def system_calls(spark, d):
    return _system(spark, d)


@registry.add(f"""WITH {PROGRAM_CALLS}, l AS (SELECT kind AS section, 0 AS part, '## ' || CASE kind WHEN 'system_utility' THEN 'System Utility' WHEN 'external_library' THEN 'External Library' WHEN 'missing_source' THEN 'Missing Source' ELSE upper(kind[1]) || kind[2:] END || ' (' || count(*) || ')' AS line FROM sys GROUP BY kind
  UNION ALL SELECT kind, 1, '| ' || name || ' | ' || n_calls || ' | ' || n_called_by || ' |' FROM sys)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY part, line) - 1 AS place, line FROM l""")
def call_report_lines(spark, d):
    return diagrams.report_lines(_system(spark, d))


@registry.add(f"WITH {graphs.EDGES} SELECT DISTINCT dst AS artifact_id FROM edges WHERE type = 'supplied_by'")
def executed_programs(spark, d):
    e = graphs.edges(spark, d)
    return calls.executed_programs(e.withColumn("type", F.when(F.col("type") == "supplied_by", "executes").otherwise(F.col("type"))))


@registry.add("""WITH t AS (SELECT coalesce(source, 'UNKNOWN') AS program_type, doc_id FROM documents)
SELECT program_type, count(*) AS n, (SELECT string_agg(x, ' ' ORDER BY x) FROM (SELECT lpad(u.doc_id::VARCHAR, 12, '0') AS x FROM t u WHERE u.program_type = t.program_type GROUP BY x ORDER BY x LIMIT 10)) AS names FROM t GROUP BY program_type""")
def program_categories(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("program_type"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"))
    return calls.program_categories(docs).withColumn("names", F.array_join("names", " "))


@registry.add("""SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'own ' || s_suppkey ELSE 'doc ' || c_mktsegment END AS summary, c_mktsegment AS status FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey""")
def graph_with_docs(spark, d):
    programs = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("own "), F.col("s_suppkey").cast("string"))).alias("summary"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("doc "), F.col("c_mktsegment")).alias("summary"), F.col("c_mktsegment").alias("status"))
    return calls.enriched(programs, docs, "k", ["summary", "status"]).select("name", "summary", "status")


@registry.add(f"""WITH {texts.LINES}, {texts.RANGES}, truth AS (SELECT doc_id, upper(name) AS key, max(line_start) AS a, arg_max(line_end, line_start) AS b FROM ranges GROUP BY doc_id, upper(name)),
cited AS (SELECT DISTINCT doc_id, lower(name) AS name, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN [0, 0] WHEN 2 THEN [1, 2] WHEN 3 THEN [90000, 90001] WHEN 4 THEN [7] ELSE [-1, 4] END AS c FROM ranges UNION ALL SELECT DISTINCT doc_id, 'nowhere', [1, 2] FROM ranges),
j AS (SELECT cited.doc_id, name, c, a, b, CASE WHEN a IS NULL THEN 'UNRESOLVABLE' WHEN c IS NULL OR len(c) = 0 THEN 'MISSING' WHEN len(c) < 2 THEN NULL WHEN NOT (c[1] > 0 AND c[2] > 0) THEN 'MISSING' WHEN NOT (c[1] <= b AND a <= c[2]) THEN 'WRONG_RANGE' END AS issue
  FROM cited LEFT JOIN truth ON truth.doc_id = cited.doc_id AND key = upper(name))
SELECT doc_id AS file_id, name, issue, CASE WHEN issue IN ('UNRESOLVABLE', 'WRONG_RANGE') THEN array_to_string(c, '-') END AS original, CASE WHEN a IS NOT NULL THEN a || '-' || b END AS corrected FROM j WHERE issue IS NOT NULL""")
def citation_check(spark, d):
    truth = texts._ranges(spark, d).withColumnRenamed("doc_id", "file_id")
    k = F.col("file_id") % 6
    lit = lambda *v: F.array(*[F.lit(x).cast("bigint") for x in v])
    c = F.when(k == 1, lit(0, 0)).when(k == 2, lit(1, 2)).when(k == 3, lit(90000, 90001)).when(k == 4, lit(7)).when(k == 5, lit(-1, 4))
    cited = truth.select("file_id", F.lower("name").alias("name"), c.alias("citation")).distinct()
    cited = cited.unionByName(truth.select("file_id").distinct().select("file_id", F.lit("nowhere").alias("name"), lit(1, 2).alias("citation")))
    found = citations.citation_findings(cited, truth.withColumns({c: F.col(c).cast("bigint") for c in ("line_start", "line_end")}))
    return found.withColumns({x: F.array_join(F.col(x).cast("array<string>"), "-") for x in ("original", "corrected")})


@registry.add(f"""WITH {texts.LINES}, {texts.RANGES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id), p AS (SELECT doc_id, upper(name) AS key, min(line_start) AS a, arg_min(line_end, line_start) AS b FROM ranges GROUP BY doc_id, upper(name)),
cited AS (SELECT DISTINCT doc_id, name, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 5 END AS x, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 4 END AS y FROM ranges)
SELECT cited.doc_id AS file_id, name, CASE WHEN x <= y AND y <= n THEN x ELSE a END::BIGINT AS line_start, CASE WHEN x <= y AND y <= n THEN y ELSE b END::BIGINT AS line_end FROM cited JOIN n ON n.doc_id = cited.doc_id LEFT JOIN p ON p.doc_id = cited.doc_id AND key = upper(name)""")
def citation_ranges(spark, d):
    ranges = texts._ranges(spark, d).withColumnRenamed("doc_id", "file_id").withColumn("line_start", F.col("line_start").cast("bigint"))
    n = texts._lines(spark, d).groupBy(F.col("doc_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    even = F.col("file_id") % 2 == 0
    cited = ranges.select("file_id", "name", F.array(F.when(even, 1).otherwise(5).cast("bigint"), F.when(even, 3).otherwise(4).cast("bigint")).alias("citation")).distinct()
    return citations.resolved_citations(cited, ranges, n)


PRECHECK = """i AS (SELECT l_orderkey AS f, 'P' || l_linenumber AS p, 'C' || l_partkey % 50 AS c, l_linenumber AS n, l_partkey AS k FROM lineitem),
doc AS (SELECT DISTINCT f, lower(p) AS p, CASE WHEN n = 3 THEN '[stub] x' ELSE 'does' END AS purpose FROM i WHERE n % 2 = 1),
miss AS (SELECT f, 'stub' AS section, upper(p) AS item, 'BLOCKING' AS severity FROM doc WHERE purpose LIKE '[stub]%'
  UNION ALL SELECT DISTINCT f, 'paragraphs', p, 'BLOCKING' FROM i WHERE n % 2 = 0 AND n NOT IN (4, 6)
  UNION ALL SELECT DISTINCT f, 'calls', p || '>' || c, 'IMPORTANT' FROM i WHERE n % 2 = 1 AND (f, p, c) NOT IN (SELECT f, p, c FROM i WHERE k % 3 = 0)
  UNION ALL SELECT DISTINCT f, 'copybooks_used', c, 'IMPORTANT' FROM i WHERE (f, c) NOT IN (SELECT f, c FROM i WHERE k % 2 = 0)
  UNION ALL SELECT o_orderkey, 'empty', 'purpose', 'BLOCKING' FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'empty', 'inputs', 'IMPORTANT' FROM orders WHERE o_orderkey % 3 = 0)"""


@registry.add(f"""WITH {PRECHECK} SELECT f AS file_id, section, item, severity, row_number() OVER (PARTITION BY f ORDER BY severity, section, item) AS place FROM miss""")
def structural_precheck(spark, d):
    k = F.col("l_linenumber")
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("P"), k.cast("string")).alias("name"), F.concat(F.lit("C"), (F.col("l_partkey") % 50).cast("string")).alias("target"), k.alias("n"), F.col("l_partkey").alias("k"))
    documented = i.where("n % 2 = 1").select("file_id", F.lower("name").alias("name"), F.when(F.col("n") == 3, "[stub] x").otherwise("does").alias("purpose")).distinct()
    includes = i.select("file_id", F.col("target").alias("name"), "k")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"))
    sections = o.select("file_id", F.lit("purpose").alias("section"), (F.col("file_id") % 4 != 0).alias("filled")).unionByName(o.select("file_id", F.lit("inputs").alias("section"), (F.col("file_id") % 3 != 0).alias("filled")))
    return citations.structural_precheck(
        i.select("file_id", "name"), i.select("file_id", "name", "target"), includes.drop("k"), documented, i.where("k % 3 = 0").select("file_id", "name", "target"), includes.where("k % 2 = 0").drop("k"),
        sections, i.where("n = 4").select("file_id", "name"), i.where("n = 6").select("file_id", "name"), "[stub]",
    ).withColumn("place", F.col("place").cast("bigint"))


@registry.add(f"""WITH {texts.LINES}, b AS (SELECT doc_id AS bundle_id, doc_id AS f, 1 + doc_id % 3 AS a, 2 + doc_id % 3 AS z FROM documents), c AS (SELECT doc_id AS claim_id, unnest(list_distinct([doc_id, doc_id + 1, doc_id + 100000000])) AS bundle_id FROM documents),
t AS (SELECT bundle_id, string_agg(text, chr(10) ORDER BY line_no) AS excerpt FROM b JOIN lines ON doc_id = f AND line_no BETWEEN a AND z GROUP BY bundle_id)
SELECT claim_id, c.bundle_id, md5(excerpt) AS excerpt FROM c LEFT JOIN t ON t.bundle_id = c.bundle_id""")
def claim_evidence(spark, d):
    docs = table(spark, d, "documents")
    bundles = docs.select(F.col("doc_id").alias("bundle_id"), F.col("doc_id").alias("file_id"), (F.lit(1) + F.col("doc_id") % 3).alias("line_start"), (F.lit(2) + F.col("doc_id") % 3).alias("line_end"))
    claims = docs.select(F.col("doc_id").alias("claim_id"), F.array("doc_id", F.col("doc_id") + 1, F.col("doc_id") + 100000000).alias("bundle_ids"))
    return citations.evidence(claims, bundles, texts._lines(spark, d).withColumnRenamed("doc_id", "file_id")).withColumn("excerpt", F.md5("excerpt"))


VERDICTS = """judged AS (SELECT o_orderkey AS claim_id, o_custkey AS k, coalesce(v, 'UNVERIFIABLE') AS verdict FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(CASE l_partkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'REFUTED' ELSE 'UNVERIFIABLE' END, l_linenumber::BIGINT * 1000000 + l_partkey) AS v FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


@registry.add(f"""WITH {VERDICTS} SELECT k AS custkey, count(*) FILTER (WHERE verdict = 'VERIFIED') AS n_verified, count(*) FILTER (WHERE verdict = 'REFUTED') AS n_refuted, count(*) FILTER (WHERE verdict = 'UNVERIFIABLE') AS n_unverifiable, NOT bool_or(verdict = 'REFUTED') AS acceptable,
  round(count(*) FILTER (WHERE verdict = 'VERIFIED')::DOUBLE / count(*), 6) AS rate FROM judged GROUP BY k""")
def claim_verdicts(spark, d):
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("custkey"))
    k = F.col("l_partkey") % 3
    verdicts = table(spark, d, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("ord"), F.when(k == 0, "VERIFIED").when(k == 1, "REFUTED").otherwise("UNVERIFIABLE").alias("verdict"))
    counted = citations.verdict_counts(citations.with_verdicts(claims, verdicts), "custkey")
    return counted.withColumn("rate", F.round(citations.rate(F.col("n_verified"), F.col("n_verified") + F.col("n_refuted") + F.col("n_unverifiable")), 6))


@registry.add("""SELECT n_nationkey AS note_id, s AS file_id FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey, s_name AS s FROM supplier WHERE s_suppkey % 2 = 0) ON s_nationkey = n_nationkey""")
def notes_by_file(spark, d):
    held = table(spark, d, "supplier").where("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").alias("note_id")).agg(F.collect_list("s_name").alias("affected"))
    notes = table(spark, d, "nation").select(F.col("n_nationkey").alias("note_id")).join(held, "note_id", "left")
    return citations.notes_by_file(notes)


@registry.add("""WITH g AS (SELECT l_orderkey AS f, string_agg('n' || l_linenumber, ' ' ORDER BY l_linenumber) AS notes, bool_or(l_returnflag = 'R') AS skip FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS ticket_id, CASE WHEN coalesce(skip, false) THEN 'cancelled' WHEN o_orderstatus = 'F' AND notes IS NOT NULL THEN 'rework' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'created' END AS state, coalesce(notes || ' ', '') || 'own' AS notes FROM orders LEFT JOIN g ON f = o_orderkey""")
def feedback_merge(spark, d):
    tickets = table(spark, d, "orders").select(F.col("o_orderkey").alias("ticket_id"), F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("created").alias("state"), F.array(F.lit("own")).alias("notes"))
    feedback = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.when(F.col("l_returnflag") == "R", "skip").otherwise("note").alias("action"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("note"), F.col("l_linenumber").alias("ord"))
    return citations.merged_feedback(tickets, feedback).select("ticket_id", "state", F.array_join("notes", " ").alias("notes"))


@registry.add("""WITH n AS (SELECT n_nationkey AS k, n_regionkey IN (0, 1) AS bad FROM nation), s AS (SELECT s_suppkey AS k, bad FROM supplier JOIN n ON n.k = s_nationkey), c AS (SELECT c_custkey AS k, bad FROM customer JOIN n ON n.k = c_nationkey),
p AS (SELECT l_partkey AS k, bool_or(bad) AS bad FROM lineitem JOIN s ON s.k = l_suppkey GROUP BY l_partkey)
SELECT 'region::' || r_regionkey AS artifact_id, CASE WHEN r_regionkey > 1 THEN 0 END::BIGINT AS level FROM region UNION ALL SELECT 'nation::' || k, CASE WHEN NOT bad THEN 1 END FROM n UNION ALL SELECT 'supplier::' || k, CASE WHEN NOT bad THEN 2 END FROM s
UNION ALL SELECT 'customer::' || k, CASE WHEN NOT bad THEN 2 END FROM c UNION ALL SELECT 'part::' || p_partkey, CASE WHEN bad IS NULL THEN 0 WHEN NOT bad THEN 3 END FROM part LEFT JOIN p ON p.k = p_partkey
UNION ALL SELECT 'order::' || o_orderkey, CASE WHEN NOT bad THEN 3 END FROM orders JOIN c ON c.k = o_custkey""")
def topological_levels(spark, d):
    """The whole graph, in which two regions also call each other: what leads to them has no level."""
    e = graphs.edges(spark, d).select("src", "dst")
    ring = spark.range(2).select(F.concat(F.lit("region::"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("region::"), (1 - F.col("id")).cast("string")).alias("dst"))
    return diagrams.topological_levels(graphs.nodes(spark, d), e.unionByName(ring))


@registry.add("""WITH n AS (SELECT DISTINCT p_size AS f, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 || '-EXIT' ELSE p_partkey % 50 || '-' || upper(p_brand) END AS name FROM part)
SELECT f AS file_id, name FROM n WHERE name LIKE '%-EXIT' AND EXISTS (SELECT 1 FROM n o WHERE o.f = n.f AND o.name <> n.name AND starts_with(o.name, replace(n.name, '-EXIT', '-')))""")
def exit_names(spark, d):
    k = (F.col("p_partkey") % 50).cast("string")
    names = table(spark, d, "part").select(F.col("p_size").alias("file_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(k, F.lit("-exit"))).otherwise(F.concat(k, F.lit("-"), F.col("p_brand"))).alias("name"))
    return diagrams.exit_names(names)


FLOW = """n AS (SELECT DISTINCT l_orderkey AS f, 'N' || l_linenumber AS name FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS f, 'N' || l_linenumber AS src, 'N' || (1 + l_partkey % 9) AS dst FROM lineitem),
x AS (SELECT e.*, n.name IS NOT NULL AS inner_ FROM e LEFT JOIN n ON n.f = e.f AND n.name = e.dst),
l AS (SELECT DISTINCT f, 0 AS part, 'flowchart TD' AS line FROM n UNION ALL SELECT f, 1, '    ' || name || '["' || name || '"]' FROM n UNION ALL SELECT DISTINCT f, 2, '    ' || dst || '(["' || dst || '"])' FROM x WHERE NOT inner_
  UNION ALL SELECT f, 3, '    ' || src || CASE WHEN inner_ THEN ' -->|' ELSE ' -.->|' END || 'performs| ' || dst FROM x)"""


@registry.add(f"WITH {FLOW} SELECT f, row_number() OVER (PARTITION BY f ORDER BY part, line) - 1 AS place, line FROM l")
def flow_diagrams(spark, d):
    i = table(spark, d, "lineitem")
    name = F.concat(F.lit("N"), F.col("l_linenumber").cast("string"))
    nodes = i.select(F.col("l_orderkey").alias("f"), name.alias("name"))
    edges = i.select(F.col("l_orderkey").alias("f"), name.alias("src"), F.concat(F.lit("N"), (1 + F.col("l_partkey") % 9).cast("string")).alias("dst"), F.lit("performs").alias("type"))
    return diagrams.flow_lines(nodes, edges, "f")


@registry.add("""WITH p AS (SELECT 's' || s_suppkey AS start, ['s' || s_suppkey, 'n' || n_nationkey, 'r' || n_regionkey] AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey), w AS (SELECT start, unnest(path) AS name, generate_subscripts(path, 1) AS k FROM p)
SELECT start, 0::BIGINT AS place, 'sequenceDiagram' AS line FROM p UNION ALL SELECT start, k, '    participant ' || name || ' as ' || name FROM w
UNION ALL SELECT a.start, 3 + a.k, '    ' || a.name || '->>' || b.name || ': ' || CASE WHEN a.k = 1 THEN 'in0, in1, in2, ... -&gt; out' ELSE 'calls' END FROM w a JOIN w b ON b.start = a.start AND b.k = a.k + 1""".replace("-&gt;", "- "))
def sequence_diagrams(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    ids = [F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("s", "s_suppkey"), ("n", "n_nationkey"), ("r", "n_regionkey"))]
    paths = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(ids[0].alias("start"), F.array(*ids).alias("path"))
    said = paths.select(F.get("path", 0).alias("src"), F.get("path", 1).alias("dst"), F.array(*[F.lit(f"in{i}") for i in range(5)]).alias("inputs"), F.array(F.lit("out")).alias("outputs"))
    return diagrams.sequence_lines(paths, said)


CARDS = "cards AS (SELECT o_orderkey, '//A DD DSN=PROD.F' || o_orderkey || '.X,DISP=SHR' || chr(10) || ' dsn=''TEST.LIB(' || o_custkey || ')'' INFILE(IN' || o_orderkey % 10 || ') outfile(OUT1)' || chr(10) || 'SELECT * FROM DB.T' || o_custkey % 7 || ' INSERT INTO ARC.T1' AS text FROM orders)"


@registry.add(f"""WITH {CARDS} SELECT o_orderkey, 'DD:IN' || o_orderkey % 10 || ' DD:OUT1 PROD.F' || o_orderkey || '.X TEST.LIB(' || regexp_extract(text, 'LIB\\((\\d+)', 1) || ')' AS datasets, 'ARC.T1 ' || regexp_extract(text, 'DB\\.T\\d', 0) AS tables FROM cards""".replace("\\\\", "\\"))
def data_references(spark, d):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("//A DD DSN=PROD.F"), k, F.lit(".X,DISP=SHR\n dsn='TEST.LIB("), c, F.lit(")' INFILE(IN"), (F.col("o_orderkey") % 10).cast("string"), F.lit(") outfile(OUT1)\nSELECT * FROM DB.T"), (F.col("o_custkey") % 7).cast("string"), F.lit(" INSERT INTO ARC.T1"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(extract.data_references(text), " ").alias("datasets"), F.array_join(extract.table_references(text), " ").alias("tables"))


@registry.add("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'JSON ' || l_partkey WHEN l_partkey % 3 = 1 THEN 'none' ELSE 'list' END AS kind, CASE WHEN l_partkey % 3 = 0 THEN l_partkey::VARCHAR END AS value FROM lineitem""")
def json_in_text(spark, d):
    k = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit('Sure: ```json\n{"a": {"b": '), k, F.lit("}}\n``` done"))).when(F.col("l_partkey") % 3 == 1, F.lit("no {json here")).otherwise(F.concat(F.lit("so [1, "), k, F.lit("] it is")))
    found = extract.json_in(text)
    kind = F.when(found.isNull(), "none").when(found.startswith("["), "list").otherwise(F.concat(F.lit("JSON "), k))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"), extract.path_get(found, "a.b").alias("value"))


@registry.add("""SELECT o_orderkey, 'pm-type:x,pm-state:' || o_orderstatus || CASE WHEN o_custkey % 2 = 0 THEN ',file:a:' || o_custkey ELSE '' END AS labels, CASE WHEN o_custkey % 2 = 0 THEN 'a:' || o_custkey END AS file, epoch(o_orderdate)::BIGINT AS at FROM orders""")
def ticket_labels(spark, d):
    o = table(spark, d, "orders").withColumn("l", extract.labels({"pm-type": F.lit("x"), "pm-state": F.col("o_orderstatus"), "file": F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("a:"), F.col("o_custkey").cast("string")))}))
    at = extract.parsed_time(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("o_orderkey", F.array_join("l", ",").alias("labels"), extract.label_value(F.col("l"), "file").alias("file"), F.unix_seconds(at).alias("at"))


@registry.add("""WITH q AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
SELECT doc_id, 'Q001 General: why ' || doc_id || '? Q002 Part ' || doc_id % 9 || ': what?' AS questions, true AS good, false AS bad FROM q""")
def markdown_questions(spark, d):
    k = F.col("doc_id").cast("string")
    markdown = F.concat(F.lit("intro\n❓ QUESTION: why "), k, F.lit("?\n## Part "), (F.col("doc_id") % 9).cast("string"), F.lit("\n❓ QUESTION:  what?\n```mermaid\n%% x\ngraph TD\n```\n```mermaid\nnonsense\n```\n"))
    found, drawn = extract.inline_questions(markdown), extract.diagrams(markdown)
    said = F.array_join(F.transform(found, lambda q: F.concat(q["question_id"], F.lit(" "), q["context"], F.lit(": "), q["question"])), " ")
    return table(spark, d, "documents").select("doc_id", said.alias("questions"), F.get(drawn, 0)["valid"].alias("good"), F.get(drawn, 1)["valid"].alias("bad"))


@registry.add("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'system_utility' WHEN 1 THEN 'external_library' ELSE 'missing_source' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'interface' ELSE 'code' END AS category, CASE p_partkey % 2 WHEN 0 THEN 'COPY' ELSE 'CALL' END AS call_type,
  p_partkey % 5 = 0 AS auth, p_partkey % 7 = 0 AS connection, 'WS-A' || p_partkey || ' TOTAL' AS variables FROM part""")
def name_classes(spark, d):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = F.concat(F.when(k % 4 == 0, "dfh").when(k % 4 == 1, "Lib").otherwise("X"), n)
    kind = F.when(k % 3 == 0, "table").when(k % 3 == 1, "screen").otherwise("paragraph")
    message = F.concat(F.when(k % 5 == 0, "HTTP 401").otherwise("HTTP 200"), F.when(k % 7 == 0, " read Timed out").otherwise(" ok"))
    text = F.concat(F.lit("compute ws-a"), n, F.lit(" = total + 12 X WS-A"), n)
    return table(spark, d, "part").select(
        "p_partkey", calls.program_type(name).alias("kind"), calls.category(kind).alias("category"), calls.call_type(F.when(k % 2 == 0, "Includes").otherwise("other")).alias("call_type"),
        extract.is_auth_error(F.lit("Error"), F.lit(None).cast("int"), message).alias("auth"), extract.is_connection_error(F.lit("Error"), message).alias("connection"),
        F.array_join(extract.variable_names(text, ["COMPUTE"]), " ").alias("variables"),
    )


@registry.add(f"""WITH {graphs.NODES}, {graphs.EDGES}, gone AS (SELECT artifact_id FROM nodes WHERE type = 'supplier' AND split_part(artifact_id, '::', 2)::BIGINT % 3 = 0)
SELECT 'node' AS kind, type, count(*) AS n FROM (SELECT * FROM nodes WHERE artifact_id NOT IN (SELECT artifact_id FROM gone) UNION ALL SELECT 'new::' || r_regionkey, 'new' FROM region) GROUP BY type
UNION ALL SELECT 'edge', type, count(*) FROM (SELECT src, type FROM edges WHERE src NOT IN (SELECT artifact_id FROM gone) UNION ALL SELECT 'new::' || r_regionkey, 'made_of' FROM region) GROUP BY type""")
def graph_incremental(spark, d):
    """Files are artifacts here: those of every third supplier change."""
    n = graphs.nodes(spark, d).withColumn("file_id", F.col("artifact_id"))
    e = graphs.edges(spark, d).withColumn("file_id", F.col("src"))
    changed = n.where("type = 'supplier' and cast(substring_index(artifact_id, '::', -1) as bigint) % 3 = 0").select("file_id")
    new = table(spark, d, "region").select(F.concat(F.lit("new::"), F.col("r_regionkey").cast("string")).alias("artifact_id"), F.lit("new").alias("type"), F.concat(F.lit("new::"), F.col("r_regionkey").cast("string")).alias("file_id"))
    new_edges = new.select(F.col("artifact_id").alias("src"), F.lit("region::0").alias("dst"), F.lit("made_of").alias("type"), "file_id")
    a, b = graph.incremental(n, e, changed, new, new_edges)
    count = lambda t, kind: t.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(a, "node").unionByName(count(b, "edge"))


@registry.add("""WITH r AS (SELECT 'p' || l_partkey AS artifact_id, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS line_start, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)
SELECT artifact_id, line_start, ord FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY line_start IS NULL, ord) AS k FROM r) WHERE k = 1""")
def node_upserts(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("artifact_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("line_start"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph.upsert_nodes(rows)
