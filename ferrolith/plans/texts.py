"""Queries over documents, pages and conversations: lines, patterns, intervals, chunks, search, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions import text as tx
from ferrolith.operators import aggregates, chunking, intervals, lexer, lines, patterns, search
from ferrolith.plans.registry import Registry, table

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql

LINES = r"""lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def _lines(spark, d) -> DataFrame:
    return lines.explode_lines(_documents(spark, d), "doc_id", "text")


def _rule_sql() -> str:
    """Matches of the document rules in lines, as SQL."""
    each = [f"SELECT doc_id, line_no, '{r.category}' AS category, '{r.name}' AS name, unnest(regexp_extract_all(text, '{r.regex}')) AS found FROM lines" for r in patterns.DOCUMENT_RULES]
    return "matches AS (" + "\n UNION ALL ".join(each) + ")"


def _matches(spark, d) -> DataFrame:
    return patterns.extract_matches(_lines(spark, d), patterns.DOCUMENT_RULES)


@registry.add(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, text FROM lines")
def lines_explode(spark, d):
    return _lines(spark, d)


@registry.add(f"""WITH {LINES}, times AS (SELECT doc_id, text, count(*) AS n FROM lines WHERE trim(text) <> '' GROUP BY doc_id, text)
SELECT l.doc_id, CAST(line_no AS BIGINT) AS line_no, trim(l.text) = '' AS is_blank, length(l.text) > 200 AS is_long, coalesce(n > 1, false) AS is_repeated
FROM lines l LEFT JOIN times t ON t.doc_id = l.doc_id AND t.text = l.text""")
def line_flags(spark, d):
    return lines.flag_lines(_lines(spark, d), "doc_id").drop("text")


@registry.add(f"WITH {LINES}, {_rule_sql()} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, category, name, found FROM matches")
def pattern_matches(spark, d):
    return _matches(spark, d)


@registry.add(f"""WITH {LINES}, {_rule_sql()}, sizes(category, total) AS (VALUES {", ".join(f"('{c}', {sum(r.category == c for r in patterns.DOCUMENT_RULES)})" for c in dict.fromkeys(r.category for r in patterns.DOCUMENT_RULES))})
SELECT doc_id, m.category, count(*) AS n_matches, count(DISTINCT name) AS n_rules, round(100.0::DOUBLE * count(DISTINCT name) / total, 2) AS coverage
FROM matches m JOIN sizes s ON s.category = m.category GROUP BY doc_id, m.category, total""")
def pattern_coverage(spark, d):
    counts = patterns.rule_counts(_documents(spark, d), patterns.DOCUMENT_RULES, "doc_id")
    return patterns.coverage_of(counts, patterns.DOCUMENT_RULES, "doc_id")


@registry.add(f"""WITH {LINES}, {_rule_sql()}, wanted(category, name) AS (VALUES {", ".join(f"('{r.category}', '{r.name}')" for r in patterns.DOCUMENT_RULES if r.required)})
SELECT d.doc_id, w.category, w.name FROM documents d, wanted w
WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = d.doc_id AND m.category = w.category AND m.name = w.name)""")
def required_missing(spark, d):
    return patterns.required_without_count(patterns.rule_counts(_documents(spark, d), patterns.DOCUMENT_RULES, "doc_id"), patterns.DOCUMENT_RULES, "doc_id")


CLASSES = [("licensed", "[Ll]icense"), ("contact", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+"), ("symbols", "[#*$%&]{3}"), ("shouting", "[A-Z]{4,}!"), ("listing", r" \| ")]


@registry.add("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{r}') THEN '{n}'" for n, r in CLASSES) + " ELSE 'prose' END AS class FROM documents")
def pattern_first_class(spark, d):
    return _documents(spark, d).select("doc_id", patterns.first_class(F.col("text"), CLASSES, "prose").alias("class"))


@registry.add(r"""SELECT page_id, length(regexp_replace(regexp_replace(html, '"[^"\n]*"', '""', 'g'), '''[^''\n]*''', '''''', 'g'))::BIGINT AS n_masked,
  md5(regexp_replace(regexp_replace(html, '"[^"\n]*"', '""', 'g'), '''[^''\n]*''', '''''', 'g')) AS masked FROM pages""")
def mask_quoted(spark, d):
    masked = lines.mask_quoted(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(masked).cast("bigint").alias("n_masked"), F.md5(masked).alias("masked"))


@registry.add("SELECT page_id, md5(regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<style>.*?</style>', '', 'gs')) AS body FROM pages")
def strip_block_comments(spark, d):
    body = lines.strip_block_comments(lines.strip_block_comments(F.col("html"), "<script>", "</script>"), "<style>", "</style>")
    return table(spark, d, "pages").select("page_id", F.md5(body).alias("body"))


@registry.add(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<p>([^<]*)</p>', 1) AS first_paragraph FROM pages""")
def title_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<p>([^<]*)</p>", 1).alias("first_paragraph"))


@registry.add(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{2,}[A-Z]*|[A-Z]{3,}') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM t),
f AS (SELECT doc_id, w, min(k) AS k FROM e GROUP BY doc_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (WHERE n <= 8), '') AS identifiers FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def harvest_identifiers(spark, d):
    found = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}[A-Z]*|[A-Z]{3,}"), 0)), 1, 8)
    return _documents(spark, d).select("doc_id", F.array_join(found, " ").alias("identifiers"))


@registry.add(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM t), f AS (SELECT doc_id, w, min(k) AS k FROM e GROUP BY doc_id, w)
SELECT d.doc_id, count(w) AS n_tokens, md5(coalesce(string_agg(w, ' ' ORDER BY k), '')) AS digest FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def ordered_distinct_tokens(spark, d):
    found = tx.tokens(F.col("text"))
    return _documents(spark, d).select("doc_id", F.size(found).cast("bigint").alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("digest"))


@registry.add(f"""WITH {LINES}, c AS (SELECT *, list(text) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ctx FROM lines)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, text, array_to_string(ctx, chr(10)) AS context FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM c WHERE regexp_matches(text, '[Ll]icense|[0-9]{{5,}}')) WHERE k <= 3""")
def context_lines_search(spark, d):
    found = patterns.context_lines(_lines(spark, d), "[Ll]icense|[0-9]{5,}", 1, "doc_id", 3)
    return found.withColumn("context", F.array_join("context", "\n"))


HEADER = "^[A-Z][a-z]+\\.$|^The and attion"


@registry.add(f"""WITH {LINES}, h AS (SELECT doc_id, line_no, text FROM lines WHERE regexp_matches(text, '{HEADER}'))
SELECT l.doc_id, CAST(l.line_no AS BIGINT) AS line_no, h.text AS section, h.line_no::BIGINT AS section_line
FROM lines l ASOF LEFT JOIN h ON h.doc_id = l.doc_id AND h.line_no <= l.line_no""")
def containing_section(spark, d):
    rows = _lines(spark, d)
    heads = rows.where(F.col("text").rlike(HEADER)).select("doc_id", "line_no", F.struct("text", "line_no").alias("section"))
    found = intervals.preceding_start(rows.select("doc_id", "line_no"), heads, "doc_id", "line_no", "line_no", "section")
    return found.select("doc_id", "line_no", F.col("section.text").alias("section"), F.col("section.line_no").alias("section_line"))


RANGES = f"""h AS (SELECT doc_id, line_no, text FROM lines WHERE regexp_matches(text, '{HEADER}')),
e AS (SELECT doc_id, max(line_no) AS last_line FROM lines GROUP BY doc_id),
ranges AS (SELECT h.doc_id, text AS name, line_no AS line_start, coalesce(lead(line_no) OVER (PARTITION BY h.doc_id ORDER BY line_no) - 1, last_line) AS line_end FROM h JOIN e ON e.doc_id = h.doc_id)"""


def _ranges(spark, d):
    rows = _lines(spark, d)
    heads = rows.where(F.col("text").rlike(HEADER)).select("doc_id", "line_no", F.col("text").alias("name"))
    return lines.header_ranges(heads, rows.groupBy("doc_id").agg(F.max("line_no").alias("last_line")), "doc_id")


@registry.add(f"WITH {LINES}, {RANGES} SELECT doc_id, name, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM ranges")
def section_ranges(spark, d):
    return _ranges(spark, d)


@registry.add(f"""WITH {LINES}, {_rule_sql()}, {RANGES}, p AS (SELECT DISTINCT doc_id, line_no FROM matches)
SELECT p.doc_id, p.line_no::BIGINT AS line_no, coalesce(arg_min(r.name, (r.line_start, r.name)), 'UNKNOWN') AS name
FROM p LEFT JOIN ranges r ON r.doc_id = p.doc_id AND p.line_no BETWEEN r.line_start AND r.line_end GROUP BY p.doc_id, p.line_no""")
def interval_assign(spark, d):
    points = _matches(spark, d).select("doc_id", "line_no").distinct()
    return intervals.covering_range(points, _ranges(spark, d), "doc_id", "line_no")


@registry.add(f"""WITH {LINES}, {RANGES}, w AS (SELECT doc_id, 'w' || line_no AS name, line_no AS line_start, line_no + 2 AS line_end FROM lines WHERE length(text) > 200)
SELECT a.doc_id, a.name AS name_a, a.line_start::BIGINT AS start_a, a.line_end::BIGINT AS end_a, b.name AS name_b, b.line_start::BIGINT AS start_b, b.line_end::BIGINT AS end_b
FROM ranges a JOIN w b ON a.doc_id = b.doc_id AND a.line_start <= b.line_end AND b.line_start <= a.line_end""")
def ranges_overlap(spark, d):
    long = _lines(spark, d).where(F.length("text") > 200)
    w = long.select("doc_id", F.concat(F.lit("w"), F.col("line_no")).alias("name"), F.col("line_no").alias("line_start"), (F.col("line_no") + 2).alias("line_end"))
    return intervals.overlapping(_ranges(spark, d), w, "doc_id")


WINDOWS = f"""w AS (SELECT doc_id, line_no AS start_line, line_no AS end_line, length(text) AS score, CASE WHEN regexp_matches(text, '[Ll]icense') THEN 'license' ELSE 'question' END AS reason
  FROM lines WHERE regexp_matches(text, '[Ll]icense|[A-Za-z]\\?'))"""


def _windows(spark, d):
    rows = _lines(spark, d).where(F.col("text").rlike("[Ll]icense|[A-Za-z]\\?"))
    reason = F.when(F.col("text").rlike("[Ll]icense"), "license").otherwise("question")
    return rows.select("doc_id", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.length("text").cast("bigint").alias("score"), reason.alias("reason"))


MERGED = f"""{WINDOWS}, g AS (SELECT doc_id, greatest(1, start_line - 2) AS start_line, end_line + 2 AS end_line, score, reason FROM w),
m AS (SELECT *, max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, end_line, reason ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_line, end_line, reason ROWS UNBOUNDED PRECEDING) AS island FROM m),
merged AS (SELECT doc_id, min(start_line)::BIGINT AS start_line, max(end_line)::BIGINT AS end_line, max(score)::BIGINT AS score, arg_min(reason, (-score, reason)) AS reason FROM i GROUP BY doc_id, island)"""


@registry.add(f"WITH {LINES}, {MERGED} SELECT * FROM merged")
def merge_windows(spark, d):
    return intervals.merge_windows(_windows(spark, d), "doc_id", 2)


@registry.add(f"WITH {LINES}, {MERGED} SELECT doc_id, start_line, end_line, start_line - coalesce(lag(end_line) OVER (PARTITION BY doc_id ORDER BY start_line), 0) - 1 AS omitted FROM merged")
def window_gaps(spark, d):
    return intervals.gap_before(intervals.merge_windows(_windows(spark, d), "doc_id", 2), "doc_id").drop("score", "reason")


@registry.add(f"""WITH RECURSIVE {LINES}, items AS (SELECT doc_id, line_no, length(text)::BIGINT AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, line_no) AS k FROM lines),
f AS (SELECT doc_id, k, line_no, cost, CASE WHEN cost <= 400 THEN cost ELSE 0 END AS used, cost <= 400 AS taken FROM items WHERE k = 1
  UNION ALL SELECT i.doc_id, i.k, i.line_no, i.cost, CASE WHEN f.used + i.cost <= 400 THEN f.used + i.cost ELSE f.used END, f.used + i.cost <= 400 FROM f JOIN items i ON i.doc_id = f.doc_id AND i.k = f.k + 1)
SELECT doc_id, line_no::BIGINT AS line_no, cost FROM f WHERE taken""")
def budget_select(spark, d):
    items = _lines(spark, d).select("doc_id", "line_no", F.length("text").cast("bigint").alias("cost"))
    return intervals.select_in_budget(items, "doc_id", [F.desc("cost"), F.col("line_no")], "cost", 400)


@registry.add(f"""WITH RECURSIVE {LINES}, items AS (SELECT doc_id, line_no, length(text)::BIGINT AS cost FROM lines),
f AS (SELECT doc_id, line_no, cost, 0 AS batch, cost AS used, 1 AS n FROM items WHERE line_no = 1
  UNION ALL SELECT i.doc_id, i.line_no, i.cost, CASE WHEN f.used + i.cost > 1000 OR f.n >= 5 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.used + i.cost > 1000 OR f.n >= 5 THEN i.cost ELSE f.used + i.cost END, CASE WHEN f.used + i.cost > 1000 OR f.n >= 5 THEN 1 ELSE f.n + 1 END
  FROM f JOIN items i ON i.doc_id = f.doc_id AND i.line_no = f.line_no + 1)
SELECT doc_id, line_no::BIGINT AS line_no, cost, batch::BIGINT AS batch FROM f""")
def greedy_batches(spark, d):
    items = _lines(spark, d).select("doc_id", "line_no", F.length("text").cast("bigint").alias("cost"))
    return intervals.greedy_batches(items, "doc_id", "line_no", "cost", 1000, 5).withColumn("batch", F.col("batch").cast("bigint"))


@registry.add(f"WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, ((row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 5)::BIGINT AS batch FROM lines")
def fixed_batches(spark, d):
    return intervals.fixed_batches(_lines(spark, d).select("doc_id", "line_no"), ["doc_id"], ["line_no"], 5)


@registry.add(f"""WITH {LINES}, n AS (SELECT doc_id, max(line_no)::BIGINT AS n_lines FROM lines GROUP BY doc_id),
s AS (SELECT doc_id, n_lines, unnest(CASE WHEN n_lines <= 20 THEN [1::BIGINT] ELSE generate_series(1::BIGINT, n_lines - 4, 16::BIGINT) END) AS start_line FROM n)
SELECT doc_id, n_lines, start_line, least(start_line + 19, n_lines) AS end_line FROM s""")
def overlap_windows(spark, d):
    n = _lines(spark, d).groupBy("doc_id").agg(F.max("line_no").alias("n_lines"))
    return intervals.overlap_windows(n, "n_lines", 20, 4)


ESTIMATE = r"""(CASE WHEN contains(upper(text), 'IDENTIFICATION DIVISION') OR contains(upper(text), 'PROCEDURE DIVISION') OR regexp_matches(substr(trim(text), 1, 6), '^[0-9]{6}$')
  THEN floor(length(text) / 3.5) ELSE floor(length(text) / 4) END)::BIGINT"""


@registry.add(f"SELECT doc_id, {ESTIMATE} AS tokens, {ESTIMATE} > 500 AS needs_chunking FROM documents")
def token_estimate(spark, d):
    n = tx.token_estimate(F.col("text"))
    return _documents(spark, d).select("doc_id", n.alias("tokens"), chunking.needs_chunking(n, 500).alias("needs_chunking"))


@registry.add(f"""SELECT conv_id, n_turns, tokens, greatest(0, 8000 - 4000 - tokens)::BIGINT AS available FROM (
  SELECT conv_id, count(*) AS n_turns, sum({ESTIMATE})::BIGINT AS tokens FROM conversations GROUP BY conv_id)""")
def prompt_budget(spark, d):
    sums = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))
    return sums.withColumn("available", tx.available_tokens(F.col("tokens"), 8000))


@registry.add("""WITH s AS (SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS upto FROM conversations)
SELECT conv_id, turn, role FROM s WHERE role = 'system' OR upto // 4 <= 200""")
def history_trim(spark, d):
    """System rows, and the last others whose characters over 4 fit 200 tokens."""
    suffix = F.sum(F.length("text")).over(Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("_s", suffix).where((F.col("role") == "system") | (F.floor(F.col("_s") / 4) <= 200)).select("conv_id", "turn", "role")


LOW, HIGH = r"^\s*$|not sure|cannot determine|unclear|unknown|maybe", r"because|line [0-9]+|see |according|[0-9]{2,}"
INTENT = [("DATA_SOURCE", "where|source|from which|come from"), ("BRANCH_COVERAGE", "when|if |branch|condition|case")]


@registry.add(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '{LOW}') THEN 'LOW' WHEN regexp_matches(lower(text), '{HIGH}') THEN 'HIGH' ELSE 'MEDIUM' END AS quality
FROM conversations WHERE role = 'assistant'""")
def answer_quality(spark, d):
    answers = table(spark, d, "conversations").where("role = 'assistant'")
    return answers.select("conv_id", "turn", patterns.first_class(F.lower("text"), [("LOW", LOW), ("HIGH", HIGH)], "MEDIUM").alias("quality"))


@registry.add("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{r}') THEN '{n}'" for n, r in INTENT) + " ELSE 'INTENT' END AS intent FROM conversations WHERE role = 'user'")
def question_intent(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", patterns.first_class(F.lower("text"), INTENT, "INTENT").alias("intent"))


@registry.add(f"""WITH {LINES}, {_rule_sql()}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE category = 'sentence') AS decisions, count(*) FILTER (WHERE category = 'markup') AS loops, count(*) FILTER (WHERE category = 'legal') AS errors FROM matches GROUP BY doc_id),
s AS (SELECT *, least(n // 5, 3) + least(decisions, 3) + CASE WHEN loops > 0 THEN 2 ELSE 0 END + CASE WHEN errors > 0 THEN 1 ELSE 0 END AS score FROM c)
SELECT doc_id, n, CASE WHEN score <= 2 THEN 'simple' WHEN score <= 5 THEN 'moderate' ELSE 'complex' END AS complexity,
  CASE WHEN errors >= 5 THEN 'good' WHEN errors >= 2 THEN 'moderate' WHEN errors >= 1 THEN 'minimal' ELSE 'none' END AS error_coverage FROM s""")
def complexity_class(spark, d):
    c = _matches(spark, d).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == "sentence").alias("dec"), F.count_if(F.col("category") == "markup").alias("loops"), F.count_if(F.col("category") == "legal").alias("errors")
    )
    kind = aggregates.complexity_class(F.col("n"), F.col("dec"), F.col("loops"), F.col("errors"))
    return c.select("doc_id", "n", kind.alias("complexity"), aggregates.error_coverage(F.col("errors")).alias("error_coverage"))


@registry.add(f"""WITH {LINES}, {_rule_sql()} SELECT found AS variable, CAST(sum(CASE WHEN name = 'decimal' THEN 2 ELSE 1 END) AS BIGINT) AS weight, count(DISTINCT doc_id) AS n_docs
FROM matches WHERE category IN ('number', 'contact') GROUP BY found""")
def variable_frequency(spark, d):
    m = _matches(spark, d).where(F.col("category").isin("number", "contact"))
    return m.groupBy(F.col("found").alias("variable")).agg(F.sum(F.when(F.col("name") == "decimal", 2).otherwise(1)).alias("weight"), F.countDistinct("doc_id").alias("n_docs"))


@registry.add(f"""WITH {LINES}, {_rule_sql()}, {RANGES}
SELECT r.doc_id, r.name, r.line_start::BIGINT AS line_start, count(m.found) AS n, count(DISTINCT m.category) AS n_categories, coalesce(array_to_string(list_sort(list(DISTINCT m.name) FILTER (WHERE m.name IS NOT NULL))[1:3], ','), '') AS first_names
FROM ranges r LEFT JOIN matches m ON m.doc_id = r.doc_id AND m.line_no BETWEEN r.line_start AND r.line_end GROUP BY r.doc_id, r.name, r.line_start""")
def paragraph_facts(spark, d):
    ranges = _ranges(spark, d)
    m = _matches(spark, d).withColumnRenamed("name", "rule")
    # ranges of a document follow each other: a match is in the last one that starts at or before it
    starts = ranges.select("doc_id", "line_start")
    hits = intervals.preceding_start(m, starts.withColumn("_s", F.col("line_start")), "doc_id", "line_no", "line_start", "_s").where("_s is not null").withColumnRenamed("_s", "line_start")
    # by rule first: so few rows are left for each range that nothing grows with the matches
    by_rule = hits.groupBy("doc_id", "line_start", "category", "rule").agg(F.count(F.lit(1)).alias("k"))
    facts = by_rule.groupBy("doc_id", "line_start").agg(F.sum("k").alias("n"), F.countDistinct("category").alias("n_categories"), F.array_join(aggregates.first_n(F.collect_set("rule"), 3), ",").alias("first_names"))
    return ranges.drop("line_end").join(facts, ["doc_id", "line_start"], "left").fillna(0, ["n", "n_categories"]).fillna("", ["first_names"])


@registry.add(r"""WITH i AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents) SELECT token, count(*) AS n_docs FROM i GROUP BY token""")
def inverted_index(spark, d):
    return search.document_frequency(search.postings(_documents(spark, d), ["text"]))


@registry.add(r"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark),
i AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', source, lang, text)), '[\p{L}\p{N}_]+')) AS token FROM documents),
s AS (SELECT q.query_id, i.doc_id, CAST(sum(CASE WHEN contains(lower(source), q.token) THEN 3 WHEN contains(lower(lang), q.token) THEN 2 ELSE 1 END) AS BIGINT) AS score, count(*) AS n_matched
  FROM q JOIN i ON i.token = q.token JOIN documents d ON d.doc_id = i.doc_id GROUP BY q.query_id, i.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s)
SELECT query_id, doc_id, score, n_matched, place FROM r WHERE place <= 10""")
def scored_search(spark, d):
    docs = _documents(spark, d).select("doc_id", F.col("source").alias("name"), F.col("lang").alias("description"), F.col("text").alias("content"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = search.scored_search(asked, docs, 10)
    return found.select("query_id", "doc_id", "score", "n_matched", F.col("place").cast("bigint").alias("place"))


@registry.add("""SELECT page_id, CAST((CASE WHEN trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(regexp_extract(html, '<p>([^<]*)</p>', 1)) <> '' THEN 1 ELSE 0 END)
  + (CASE WHEN trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_sections, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) = '' OR trim(regexp_extract(html, '<p>([^<]*)</p>', 1)) = '' AS failed FROM pages""")
def document_validation(spark, d):
    part = {k: tx.is_meaningful(F.regexp_extract("html", f"<{k}>([^<]*)</{k}>", 1)) for k in ("title", "p", "h1")}
    n = sum((v.cast("bigint") for v in part.values()), F.lit(0).cast("bigint"))
    return table(spark, d, "pages").select("page_id", n.alias("n_sections"), (~part["title"] | ~part["p"]).alias("failed"))


SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[_ ]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@registry.add(f"WITH s AS (SELECT p_partkey, regexp_replace(substr({SLUG.format(x='p_name')}, 1, 64), '-$', '') AS slug FROM part) SELECT p_partkey, slug, CASE WHEN slug = '' THEN 'empty' END AS problem FROM s")
def slug(spark, d):
    s = tx.slug(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", s.alias("slug"), tx.slug_problem(s).alias("problem"))


@registry.add("""SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN length(url) > 64 THEN 'too long' WHEN regexp_matches(url, '[^a-z0-9-]') THEN 'bad character'
  WHEN regexp_matches(url, '^-|-$') THEN 'hyphen at an end' WHEN contains(url, '--') THEN 'double hyphen' END AS problem FROM pages""")
def validate_slug(spark, d):
    return table(spark, d, "pages").select("page_id", tx.slug_problem(F.col("url")).alias("problem"))


@registry.add("""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE (CASE WHEN regexp_extract(substr(text, 1, 117), '^(.*) ', 1, 's') = '' THEN substr(text, 1, 117) ELSE regexp_extract(substr(text, 1, 117), '^(.*) ', 1, 's') END) || '...' END AS short FROM documents""")
def truncate_words(spark, d):
    return _documents(spark, d).select("doc_id", tx.truncate_words(F.col("text"), 120).alias("short"))


@registry.add("""WITH c AS (SELECT doc_id, CASE WHEN contains(text, 'icense') THEN 0 WHEN n_chars < 300 THEN 1 ELSE 2 END AS class, md5(doc_id::VARCHAR) AS h, lang FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY class, h) AS place FROM c) SELECT lang, doc_id, class::BIGINT AS class, place FROM r WHERE place <= 20""")
def priority_sample(spark, d):
    """Per language the first 20 by class, filled up in an order that is random but fixed."""
    kind = F.when(F.col("text").contains("icense"), 0).when(F.col("n_chars") < 300, 1).otherwise(2).cast("bigint")
    rows = _documents(spark, d).select("lang", "doc_id", kind.alias("class"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("class", "h")).cast("bigint")
    return rows.withColumn("place", place).where("place <= 20").drop("h")


@registry.add("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source, l.quality::BIGINT AS quality, CASE WHEN l.doc_id IS NULL THEN 'document' WHEN d.doc_id IS NULL THEN 'label' ELSE 'both' END AS side
FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def full_outer_merge(spark, d):
    a, b = _documents(spark, d).select("doc_id", "source", F.lit(1).alias("a")), table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.lit(1).alias("b"))
    side = F.when(F.col("b").isNull(), "document").when(F.col("a").isNull(), "label").otherwise("both")
    return a.join(b, "doc_id", "full").select("doc_id", "source", "quality", side.alias("side"))


@registry.add()
def chunk_documents(spark, d):
    """Chunks of at most 200 tokens that end after blank lines where they can: each end depends on the one before."""
    return chunking.chunk_files(_documents(spark, d), 200, "doc_id", "text").drop("chunk")


#: A syntax under which the documents' runs of symbols are strings and comments.
SYMBOLS = lexer.Syntax(strings=("%", '"'), line=("#",), block=(("$*", "*$"),))
_TOKEN = r"""%(?:[^%]|%%)*(?:%|\z)|"(?:[^"]|"")*(?:"|\z)|#[^\n]*|\$\*(?:[^*]|\*+[^*$])*(?:\*+\$|\**\z)"""
_LEXED = f"""t AS (SELECT doc_id, text, string_split_regex(text, '{_TOKEN}') AS gaps, regexp_extract_all(text, '{_TOKEN}') AS found FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
s AS (SELECT *, list_transform(found, lambda x: x[1] IN ('%', '"')) AS quoted FROM t),
k AS (SELECT *, list_transform(range(1, len(found) + 1), lambda i: len(list_filter(quoted[1:i], lambda q: q))) AS nth FROM s)"""


@registry.add(f"""WITH {_LEXED}
SELECT doc_id, len(list_filter(quoted, lambda q: q))::BIGINT AS n_strings, len(list_filter(quoted, lambda q: NOT q))::BIGINT AS n_comments,
 md5(array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i <= len(found) AND quoted[i] THEN '__STR_' || (nth[i] - 1) || '__' ELSE '' END), '')) AS clean FROM k""")
def lexed_documents(spark, d):
    """Strings and comments of all documents, and the text without them."""
    found = lexer.lexed(_documents(spark, d), SYMBOLS, "doc_id", "text")
    return found.select("doc_id", F.size("masked").cast("bigint").alias("n_strings"), F.col("n_comments").cast("bigint").alias("n_comments"), F.md5(F.encode("clean", "UTF-8")).alias("clean"))


@registry.add(f"""WITH {_LEXED}, p AS (SELECT doc_id, text, unnest(range(1, len(found) + 1)) AS i, gaps, found, quoted, nth FROM k),
o AS (SELECT doc_id, nth[i] - 1 AS n, array_to_string(list_transform(range(1, i + 1), lambda j: gaps[j] || CASE WHEN j < i THEN found[j] ELSE '' END), '') AS before FROM p WHERE quoted[i])
SELECT doc_id, n::BIGINT AS n, 1 + length(before) - length(replace(before, chr(10), '')) AS line, length(string_split(before, chr(10))[-1]) + 1 AS "column" FROM o""")
def string_places(spark, d):
    """Lines and columns of all strings, found in the cleaned texts and looked up in the original ones."""
    docs = _documents(spark, d).select("doc_id", "text")
    clean = lexer.lexed(docs, SYMBOLS, "doc_id", "text")
    found = lexer.original_places(lexer.matches_at(clean, "__STR_[0-9]+__", "doc_id", "clean"), clean, docs, "doc_id", "text")
    return found.select("doc_id", F.regexp_extract("found", "[0-9]+", 0).cast("bigint").alias("n"), F.col("line").cast("bigint").alias("line"), F.col("column").cast("bigint").alias("column"))
