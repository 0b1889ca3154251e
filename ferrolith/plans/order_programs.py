"""Queries over one COBOL program for each order: a record for each of its lines, and a paragraph of as many statements as
the line's quantity says, so that no two orders need be alike. The SQL knows the heads as they are written, without
parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators import lines, structure_chunks
from ferrolith.plans.registry import Registry, table

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql

BUDGET = 120

#: Order lines numbered within their order (n), ties in these columns being alike.
NUMBERED = """SELECT l_orderkey AS o, l_partkey AS p, CAST(floor(l_quantity / 3) AS INT) AS q, l_returnflag AS f,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS n FROM lineitem"""

#: Lines (part, j: places; text; head and name as written) of an order, of an order line, and of its statements.
FIXED = [
    (1, "       IDENTIFICATION DIVISION.", "division", "IDENTIFICATION"),
    (3, "       DATA DIVISION.", "division", "DATA"),
    (4, "       WORKING-STORAGE SECTION.", "section", "WORKING-STORAGE"),
    (6, "       PROCEDURE DIVISION.", "division", "PROCEDURE"),
]


def _source(spark, d) -> DataFrame:
    """(file_id, line_no, text) of every order's program. A line's place follows from numbers and sums over the order lines, so
    that no window holds the lines written."""
    of = Window.partitionBy("l_orderkey")
    within = of.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    steps = F.greatest(F.coalesce(F.floor(F.col("l_quantity") / 3).cast("int"), F.lit(0)), F.lit(0))
    headed = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    dealt = lines.dealt(rows, "l_orderkey", 20000).withColumns({"r": headed, "size": headed + 1 + steps})
    numbered = dealt.select(
        F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("string").alias("p"), (F.col("l_partkey") % 90 + 1).cast("string").alias("width"), F.row_number().over(within).alias("n"), "r", "size",
        F.count(F.lit(1)).over(of).alias("k"), F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    once = F.when(F.col("n") == 1, 5).otherwise(0)
    i, x, y, n = F.col("i"), F.col("i") - once, F.col("i") - once - 3 - F.col("r"), F.col("n").cast("string")
    fixed = [F.lit(FIXED[0][1]), F.concat(F.lit("       PROGRAM-ID. O"), F.col("o").cast("string"), F.lit(".")), *[F.lit(text) for _, text, _, _ in FIXED[1:]]]
    head = F.lit(None).cast("string")
    for k, text in enumerate(fixed, 1):
        head = F.when(i == k, text).otherwise(head)
    text = (
        F.when(x < 1, head).when(x == 1, F.concat(F.lit("       01  ITEM-"), n, F.lit("."))).when(x == 2, F.concat(F.lit("           05  F-"), n, F.lit(" PIC X("), "width", F.lit(").")))
        .when(y < 0, F.concat(F.lit("       S-"), n, F.lit(" SECTION."))).when(y == 0, F.concat(F.lit("       P-"), n, F.lit("."))).otherwise(F.concat(F.lit("           ADD "), "p", F.lit(" TO F-"), n, F.lit(".")))
    )
    procedures = 5 + 2 * F.col("k")
    at = F.when(x < 1, F.when(i == 5, procedures).otherwise(i)).when(x < 3, 2 + 2 * F.col("n") + x).otherwise(procedures + F.col("before") + x - 2)
    each = numbered.select("*", F.explode(F.sequence(F.lit(1), once + 2 + F.col("size"))).alias("i"))
    return each.select(F.col("o").alias("file_id"), at.cast("bigint").alias("line_no"), text.alias("text"))


PROGRAMS = f"""li AS ({NUMBERED}), os AS (SELECT o, count(*) AS k FROM li GROUP BY o),
written AS (SELECT o, part, 0 AS n, 0 AS j, text, head, name FROM os, (VALUES {", ".join(f"({p}, '{t}', '{h}', '{m}')" for p, t, h, m in FIXED)}) v(part, text, head, name)
  UNION ALL SELECT o, 2, 0, 0, '       PROGRAM-ID. O' || o || '.', 'unit', 'PROGRAM-ID' FROM os
  UNION ALL SELECT o, 5, n, 0, '       01  ITEM-' || n || '.', 'unit', 'ITEM-' || n FROM li
  UNION ALL SELECT o, 5, n, 1, '           05  F-' || n || ' PIC X(' || p % 90 + 1 || ').', NULL, NULL FROM li
  UNION ALL SELECT o, 7, n, 0, '       S-' || n || ' SECTION.', 'section', 'S-' || n FROM li WHERE f = 'R'
  UNION ALL SELECT o, 7, n, 1, '       P-' || n || '.', 'unit', 'P-' || n FROM li
  UNION ALL SELECT o, 7, n, 1 + j, '           ADD ' || p || ' TO F-' || n || '.', NULL, NULL FROM (SELECT *, unnest(range(1, q + 1)) AS j FROM li)),
lines AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY part, n, j) AS line_no, text, head, name, length(text) + 1 AS cost FROM written)"""

#: 423 characters are 120 tokens of 3.5 characters.
CHUNKS = f"""{PROGRAMS}, about AS (SELECT o, '      * Part of program O' || o || chr(10) || '      * DATA DIVISION: lines 3 to ' || (4 + 2 * k) AS summary FROM os),
g AS (SELECT *, sum((head IS NOT DISTINCT FROM 'division')::INT) OVER w AS g1, sum((coalesce(head, '') IN ('division', 'section'))::INT) OVER w AS g2, sum((head IS NOT NULL)::INT) OVER w AS g3
  FROM lines WINDOW w AS (PARTITION BY o ORDER BY line_no)),
c AS (SELECT g.*, 423 - length(summary) AS room, sum(cost) OVER (PARTITION BY g.o) AS c0, sum(cost) OVER (PARTITION BY g.o, g1) AS c1, sum(cost) OVER (PARTITION BY g.o, g2) AS c2, sum(cost) OVER (PARTITION BY g.o, g3) AS c3 FROM g JOIN about USING (o)),
l AS (SELECT *, CASE WHEN c0 <= 424 THEN 'file' WHEN c1 <= room THEN 'division' WHEN c2 <= room THEN 'section' WHEN c3 <= room THEN 'unit' ELSE 'line' END AS level FROM c),
u AS (SELECT o, level, CASE level WHEN 'file' THEN 0 WHEN 'division' THEN 0 WHEN 'section' THEN g1 WHEN 'unit' THEN g2 ELSE g3 END AS parent,
  CASE level WHEN 'file' THEN 0 WHEN 'division' THEN g1 WHEN 'section' THEN g2 WHEN 'unit' THEN g3 ELSE line_no END AS inside, min(line_no) AS start, max(line_no) AS stop, sum(cost) AS cost, any_value(room) AS room FROM l GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY start) AS k FROM u),
f AS (SELECT o, k, level, parent, cost AS used, 1 AS m, 0 AS seq, start, stop FROM n WHERE k = 1
  UNION ALL SELECT n.o, n.k, n.level, n.parent, CASE WHEN x.fresh THEN n.cost ELSE f.used + n.cost END, CASE WHEN x.fresh THEN 1 ELSE f.m + 1 END, CASE WHEN x.fresh THEN f.seq + 1 ELSE f.seq END, n.start, n.stop
  FROM f JOIN n ON n.o = f.o AND n.k = f.k + 1, LATERAL (SELECT n.level <> f.level OR n.parent <> f.parent OR n.level = 'section' OR f.used + n.cost > n.room OR (n.level = 'line' AND f.m >= 50) AS fresh) x),
r AS (SELECT o, seq, any_value(level) AS level, min(start) AS first_line, max(stop) AS last_line FROM f GROUP BY o, seq)"""


@registry.add(f"""WITH RECURSIVE {CHUNKS}, t AS (SELECT r.o, seq, r.level, first_line, last_line, string_agg(name, ' ' ORDER BY line_no) AS names, string_agg(text, chr(10) ORDER BY line_no) AS body FROM r JOIN lines ON lines.o = r.o AND line_no BETWEEN first_line AND last_line GROUP BY ALL),
s AS (SELECT t.*, CASE WHEN seq > 0 THEN summary || chr(10) || body ELSE body END AS chunk FROM t JOIN about USING (o))
SELECT o AS file_id, seq::BIGINT AS seq, level, first_line, last_line, coalesce(names, '') AS names, floor(length(chunk) / 3.5)::BIGINT AS tokens, md5(chunk) AS digest FROM s""")
def cobol_chunks(spark, d):
    found = structure_chunks.cobol_chunks(_source(spark, d), BUDGET)
    return found.select("file_id", "seq", "level", "first_line", "last_line", F.array_join("names", " ").alias("names"), "tokens", F.md5(F.col("chunk").cast("binary")).alias("digest"))
