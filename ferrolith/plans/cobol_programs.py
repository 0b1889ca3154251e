"""Queries over one COBOL program for each customer, written from its key (k) and nation (n); the SQL states what the
program holds from those alone, without reading it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.operators import cobol, source_rules, statements, variables
from ferrolith.operators import lines as ln
from ferrolith.plans.registry import Registry, table

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql

#: Lines of the program; {...} are expressions of k and n in SQL that Spark and DuckDB both read.
PROGRAM = [
    "       IDENTIFICATION DIVISION.", "       PROGRAM-ID. C{k}.", "       DATA DIVISION.", "       WORKING-STORAGE SECTION.", "       01 REC-A.",
    "          05 FLD-N PIC 9({1 + n % 5})V99 COMP-3.", "          05 FLD-X PIC X({1 + k % 9}) OCCURS {1 + n % 3} TIMES.", "             88 IS-ON VALUE 'Y'.",
    "      * a comment CALL 'NOPE'", "       COPY CB{n % 7}.", "       PROCEDURE DIVISION.", "       MAIN-PARA.", "           PERFORM STEP-1.", "           PERFORM STEP-2 THRU STEP-3.",
    "           {CASE WHEN k % 2 = 0 THEN 'IF A = B' ELSE 'DISPLAY A' END}", "              CALL 'PGM{n % 11}'", "           {CASE WHEN k % 2 = 0 THEN 'END-IF.' ELSE 'CONTINUE.' END}", "           STOP RUN.",
    "       STEP-1.", "           EXEC SQL SELECT X INTO :HV-A", "             FROM T{n % 5} WHERE K = :HV-B END-EXEC.", "       STEP-2.", "           MOVE 'one", "      -    ' two' TO B.", "       STEP-3.",
    "           {CASE WHEN k % 3 = 0 THEN 'GO TO STEP-5.' ELSE 'EXIT.' END}", "       STEP-4.", "           DISPLAY 'DEAD'.", "       STEP-5.", "           GOBACK.",
]


def _text() -> Column:
    parts = []
    for line in PROGRAM:
        rest, one = line, []
        while "{" in rest:
            before, _, rest = rest.partition("{")
            inside, _, rest = rest.partition("}")
            one += [F.lit(before), F.expr(inside).cast("string")]
        parts.append(F.concat(*one, F.lit(rest)))
    return F.concat_ws("\n", *parts)


def _source(spark, d) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("n"))
    return ln.explode_lines(ln.dealt(keys, "k").select(F.col("k").alias("file_id"), _text().alias("content")))


def _sql(columns: str, rows: str) -> str:
    """columns of the rows (VALUES of expressions of k and n) of each customer."""
    return f"WITH c AS (SELECT c_custkey AS k, c_nationkey::BIGINT AS n FROM customer) SELECT k AS file_id, r.* FROM c, LATERAL (SELECT * FROM (VALUES {rows}) AS v({columns})) r"


PARAGRAPHS = [("MAIN-PARA", 12, 18), ("STEP-1", 19, 21), ("STEP-2", 22, 24), ("STEP-3", 25, 26), ("STEP-4", 27, 28), ("STEP-5", 29, 30)]


@registry.add(_sql("name, line_start, line_end", ", ".join(f"('{p}', {a}::BIGINT, {b}::BIGINT)" for p, a, b in PARAGRAPHS)))
def cobol_paragraphs(spark, d):
    return cobol.paragraphs(_source(spark, d))


@registry.add(_sql("name, line_start, line_end", "('IDENTIFICATION', 1::BIGINT, 2::BIGINT), ('DATA', 3, 10), ('PROCEDURE', 11, 30)"))
def cobol_divisions(spark, d):
    return cobol.divisions(_source(spark, d))


@registry.add(_sql("line_no, indicator, code, is_comment, is_continuation", "(8::BIGINT, ' ', '      88 IS-ON VALUE ''Y''.', false, false), (9, '*', ' a comment CALL ''NOPE''', true, false), (24, '-', '    '' two'' TO B.', false, true)"))
def cobol_fixed_columns(spark, d):
    found = ln.fixed_format(_source(spark, d)).where("line_no in (8, 9, 24)")
    return found.select("file_id", "line_no", "indicator", "code", "is_comment", "is_continuation")


@registry.add(_sql("line_no, last_line, text", "(23::BIGINT, 24::BIGINT, '    MOVE ''one two'' TO B.'), (18, 18, '    STOP RUN.')"))
def cobol_logical_lines(spark, d):
    return cobol.logical(_source(spark, d)).where("line_no in (18, 23)").select("file_id", "line_no", "last_line", "text")


@registry.add("SELECT * FROM (" + _sql("line_no, category, name, found", "(10::BIGINT, 'copy', 'copy', 'CB' || n % 7), (13, 'perform', 'simple', 'STEP-1'), (14, 'perform', 'thru', 'STEP-2'), (16, 'call', 'static', 'PGM' || n % 11), (26, 'goto', 'go_to', CASE WHEN k % 3 = 0 THEN 'STEP-5' END)") + ") WHERE found IS NOT NULL")
def cobol_references(spark, d):
    return cobol.references(_source(spark, d))


@registry.add(_sql("number, kind, subtype, line_start, line_end, inputs, outputs", "(1::BIGINT, 'SQL', 'SELECT', 20::BIGINT, 21::BIGINT, 'HV-B', 'HV-A')"))
def cobol_exec_blocks(spark, d):
    found = cobol.exec_blocks(_source(spark, d))
    return found.select("file_id", "number", "kind", "subtype", "line_start", "line_end", F.array_join("inputs", " ").alias("inputs"), F.array_join("outputs", " ").alias("outputs"))


@registry.add(_sql(
    "ord, line_no, level, name, pic, usage, occurs, parent, n_bytes, total_bytes",
    "(1::BIGINT, 5::BIGINT, 1, 'REC-A', NULL, NULL, NULL::INTEGER, NULL::BIGINT, 0, ((1 + n % 5 + 2 + 2) // 2 + (1 + k % 9) * (1 + n % 3))::BIGINT), (2, 6, 5, 'FLD-N', '9(' || 1 + n % 5 || ')V99', 'COMP-3', NULL, 1, ((1 + n % 5 + 2 + 2) // 2)::INTEGER, (1 + n % 5 + 2 + 2) // 2), "
    "(3, 7, 5, 'FLD-X', 'X(' || 1 + k % 9 || ')', NULL, (1 + n % 3)::INTEGER, 1, (1 + k % 9)::INTEGER, (1 + k % 9) * (1 + n % 3)), (4, 8, 88, 'IS-ON', NULL, NULL, NULL, 3, 0, 0)",
))
def cobol_data_items(spark, d):
    found = cobol.item_tree(cobol.data_items(_source(spark, d)))
    return found.select("file_id", "ord", "line_no", "level", "name", "pic", "usage", "occurs", "parent", "n_bytes", "total_bytes")


@registry.add(_sql("name, n_lines, complexity", "('MAIN-PARA', 6::BIGINT, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END), ('STEP-1', 2, 1), ('STEP-2', 1, 1), ('STEP-3', 1, CASE WHEN k % 3 = 0 THEN 4 ELSE 1 END), ('STEP-4', 1, 1), ('STEP-5', 1, 1)"))
def cobol_paragraph_facts(spark, d):
    return cobol.paragraph_facts(_source(spark, d)).select("file_id", "name", "n_lines", "complexity")


@registry.add("SELECT * FROM (" + _sql("name", "('STEP-4'), (CASE WHEN k % 3 <> 0 THEN 'STEP-5' END)") + ") WHERE name IS NOT NULL")
def cobol_dead_paragraphs(spark, d):
    return cobol.dead_paragraphs(_source(spark, d)).select("file_id", "name")


@registry.add("SELECT * FROM (" + _sql(
    "src, dst, type, line_no",
    "('program::C' || k, 'copybook::CB' || n % 7, 'includes', 10::BIGINT), ('paragraph::C' || k || '.MAIN-PARA', 'paragraph::C' || k || '.STEP-1', 'performs', 13), ('paragraph::C' || k || '.MAIN-PARA', 'paragraph::C' || k || '.STEP-2', 'performs', 14), "
    "('paragraph::C' || k || '.MAIN-PARA', 'program::PGM' || n % 11, 'calls', 16), ('paragraph::C' || k || '.STEP-3', CASE WHEN k % 3 = 0 THEN 'paragraph::C' || k || '.STEP-5' END, 'performs', 26)",
) + ") WHERE dst IS NOT NULL")
def cobol_program_edges(spark, d):
    return cobol.program_graph(_source(spark, d))[1].select("file_id", "src", "dst", "type", "line_no")


@registry.add("SELECT k AS file_id, 'program' AS type, 1::BIGINT AS n FROM (SELECT c_custkey AS k FROM customer) UNION ALL SELECT c_custkey, 'paragraph', 6 FROM customer")
def cobol_program_nodes(spark, d):
    return cobol.program_graph(_source(spark, d))[0].groupBy("file_id", "type").agg(F.count(F.lit(1)).alias("n"))


STATEMENTS = """('MAIN-PARA', 13::BIGINT, 'PERFORM', 'STEP-1'), ('MAIN-PARA', 14, 'PERFORM_THRU', 'STEP-2'), ('MAIN-PARA', 15, CASE WHEN k % 2 = 0 THEN 'IF' ELSE 'DISPLAY' END, NULL), ('MAIN-PARA', 16, 'CALL', 'PGM' || n % 11),
 ('MAIN-PARA', 17, CASE WHEN k % 2 = 0 THEN 'END-IF' ELSE 'CONTINUE' END, NULL), ('MAIN-PARA', 18, 'STOP_RUN', NULL), ('STEP-1', 20, 'EXEC_SQL', NULL), ('STEP-2', 23, 'MOVE', NULL), ('STEP-3', 26, CASE WHEN k % 3 = 0 THEN 'GO_TO' ELSE 'EXIT' END, CASE WHEN k % 3 = 0 THEN 'STEP-5' END),
 ('STEP-4', 28, 'DISPLAY', NULL), ('STEP-5', 30, 'GOBACK', NULL)"""


@registry.add(_sql("paragraph, line_start, type, target", STATEMENTS))
def cobol_statements(spark, d):
    found = statements.classified(_source(spark, d))
    return found.select("file_id", "paragraph", "line_start", "type", F.element_at("attributes", "target").alias("target"))


@registry.add(_sql("paragraph, n_statements, max_depth", "('MAIN-PARA', (CASE WHEN k % 2 = 0 THEN 5 ELSE 6 END)::BIGINT, (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::BIGINT), ('STEP-1', 1, 0), ('STEP-2', 1, 0), ('STEP-3', 1, 0), ('STEP-4', 1, 0), ('STEP-5', 1, 0)"))
def cobol_tree_statistics(spark, d):
    found = statements.tree_statistics(statements.statement_tree(_source(spark, d)))
    return found.select("file_id", "paragraph", F.col("n_statements").cast("bigint").alias("n_statements"), F.col("max_depth").cast("bigint").alias("max_depth"))


@registry.add(_sql("name, n", "('MAIN-PARA', (CASE WHEN k % 2 = 0 THEN 5 ELSE 6 END)::BIGINT), ('STEP-1', 1), ('STEP-2', 1), ('STEP-3', 1), ('STEP-4', 1), ('STEP-5', 1)"))
def cobol_tree_round_trip(spark, d):
    """Trees written as JSON and read again."""
    flat = statements.flatten_json(statements.tree_json(statements.statement_tree(_source(spark, d))).select("file_id", "json"))
    return flat.groupBy(F.col("program_id").cast("bigint").alias("file_id"), F.col("paragraph").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@registry.add("SELECT * FROM (" + _sql("name", "('STEP-4'), (CASE WHEN k % 3 <> 0 THEN 'STEP-5' END)") + ") WHERE name IS NOT NULL")
def cobol_dead_in_trees(spark, d):
    source = _source(spark, d)
    return statements.dead_in_tree(source, statements.statement_tree(source)).select("file_id", "name")


@registry.add("""WITH c AS (SELECT c_custkey AS k, c_nationkey::BIGINT AS n FROM customer) SELECT k AS file_id, CASE WHEN n % 7 = 0 THEN 30 WHEN n % 7 < 4 THEN 32 ELSE 30 END::BIGINT AS n_lines,
  CASE WHEN n % 7 = 0 THEN 'BASE' WHEN n % 7 < 4 THEN 'BASE IN' || n % 7 ELSE '' END AS items FROM c""")
def cobol_expanded_copies(spark, d):
    """Copybook CB0 is one line; CB1 to CB3 are a line, CB0 again and a blank one; the others aren't there."""
    keys = spark.range(4).withColumn("name", F.concat(F.lit("CB"), F.col("id").cast("string")))
    inner = F.concat(F.lit("       05 IN"), F.col("id").cast("string"), F.lit(" PIC X.\n       COPY CB0.\n       05 FILLER PIC X."))
    books = ln.explode_lines(keys.select("name", F.when(F.col("id") == 0, "       05 BASE PIC X.").otherwise(inner).alias("content")), "name", "content")
    found = cobol.expand_copies(_source(spark, d), books)
    names = F.array_sort(F.collect_set(F.when(F.col("text").rlike("05 (BASE|IN[0-9])"), F.regexp_extract("text", "05 (BASE|IN[0-9])", 1))))
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(names, " ").alias("items"))


@registry.add(_sql("name, body", "('STEP-4', '           DISPLAY ''DEAD''.')"))
def cobol_bodies(spark, d):
    source = _source(spark, d)
    ranges = cobol.paragraphs(source).where("name = 'STEP-4'").withColumn("line_start", F.col("line_start") + 1)
    return ln.bodies(source, ranges)


@registry.add("WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS file_id, r.* FROM c, LATERAL (SELECT * FROM (VALUES (2::BIGINT, 'IN0', 'LOST.F', 'UNKNOWN'), (4, 'IN1', 'PROD.F' || k, 'STEP1'), (6, 'OUT1', NULL, 'STEP2')) AS v(line_no, dd, dsn, step)) r")
def job_steps(spark, d):
    job = F.concat(F.lit("//J"), F.col("k").cast("string"), F.lit(" JOB (A)\n//IN0 DD DSN=LOST.F,DISP=SHR\n//STEP1 EXEC PGM=PGM"), (F.col("k") % 5).cast("string"), F.lit("\n//IN1 DD DSN=PROD.F"), F.col("k").cast("string"), F.lit(",DISP=SHR\n//STEP2 EXEC PGM=IEBGENER\n//OUT1 DD SYSOUT=*"))
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("file_id"), job.alias("content"))
    return source_rules.jcl_steps(ln.explode_lines(jobs))


CARDS = ["SORT FIELDS=(1,5,A)", "REPRO INFILE(A) OUTFILE(B)", "DELETE PROD.X", "UNLOAD TABLESPACE T", "nothing here"]


@registry.add("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'DFSORT' WHEN 1 THEN 'IDCAMS REPRO' WHEN 2 THEN 'IDCAMS DELETE' WHEN 3 THEN 'DB2 UNLOAD' ELSE 'UNKNOWN' END AS utility, CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CARDS)) + " END || ' ' || c_custkey AS preview FROM customer")
def card_utilities(spark, d):
    card = F.element_at(F.array(*map(F.lit, CARDS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    content = F.concat(F.lit("\n  "), card, F.lit("\n\n"), F.col("c_custkey").cast("string"), F.lit("\n"))
    return table(spark, d, "customer").select("c_custkey", source_rules.utility(content).alias("utility"), source_rules.card_preview(content).alias("preview"))


#: Statements over the items of a program of its own for each part; the one taken depends on the part's key, and so does
#: which of two items of one name is meant. For each: text, and the items read and written ({o} the qualified one).
ACCESSES = [
    ("MOVE {q} TO OUT-1", ["{o}"], ["OUT-1"]),
    ("ADD 1 CNT TO {q}", ["CNT"], ["{o}"]),
    ("SUBTRACT CNT FROM {q}", ["CNT", "{o}"], ["{o}"]),
    ("COMPUTE OUT-1 = {q} * CNT + 2", ["{o}", "CNT"], ["OUT-1"]),
    ("DIVIDE {q} INTO CNT GIVING OUT-1", ["{o}", "CNT"], ["OUT-1"]),
    ("IF IS-SET AND {q} > 'CNT' DISPLAY CNT", ["FLAG", "{o}", "CNT"], []),
    ("SET IS-SET TO TRUE", [], ["FLAG"]),
    ("ACCEPT {q} FROM DATE", [], ["{o}"]),
    ("EXEC SQL SELECT A INTO :OUT-1 FROM T WHERE B = :CNT END-EXEC", ["CNT"], ["OUT-1"]),
    ("MOVE SPACES TO ALT OUT-1", [], ["ALT", "OUT-1"]),
    ("PERFORM OTHER UNTIL {q} = CNT", ["{o}", "CNT"], []),
]
#: The two items of the name, by qualifiers; the first is meant without any.
QUALIFIED = [("AMT", "G1"), ("AMT OF REC-1", "G1"), ("AMT IN G2 OF REC-2", "G2"), ("AMT OF REC-2", "G2")]


def _accessing(spark, d) -> DataFrame:
    """A program for each part: MAIN holds one of ACCESSES, OTHER the next one."""
    kinds = F.array(*[F.lit(text) for text, _, _ in ACCESSES])
    names = F.array(*[F.lit(q) for q, _ in QUALIFIED])
    k = F.col("p_partkey")
    said = lambda at: F.replace(F.get(kinds, (at % len(ACCESSES)).cast("int")), F.lit("{q}"), F.get(names, (F.floor(at / len(ACCESSES)) % len(QUALIFIED)).cast("int")))
    head = [
        "       IDENTIFICATION DIVISION.", "       PROGRAM-ID. P.", "       DATA DIVISION.", "       WORKING-STORAGE SECTION.", "       01 REC-1.", "          05 G1.", "             10 AMT PIC 9(5).", "          05 FLAG PIC X.",
        "             88 IS-SET VALUE 'Y'.", "       01 REC-2.", "          05 G2.", "             10 AMT PIC 9(5).", "          05 ALT REDEFINES G2 PIC X(5).", "       01 CNT PIC 9(4).", "       01 OUT-1 PIC X.", "       PROCEDURE DIVISION.", "       MAIN.",
    ]
    body = F.concat(F.lit("\n".join(head) + "\n           "), said(k), F.lit(".\n       OTHER.\n           "), said(k + 1), F.lit(".\n"))
    return ln.explode_lines(ln.dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select(k.alias("file_id"), body.alias("content")))


def _accesses_sql() -> str:
    rows = []
    for i, (_, reads, writes) in enumerate(ACCESSES):
        for j, (_, group) in enumerate(QUALIFIED):
            for mode, names in (("r", reads), ("w", writes)):
                for n in names:
                    item = "AMT" if n == "{o}" else n
                    rows.append(f"({i}, {j}, '{item}', '{'G2' if item == 'ALT' else item}', '{mode}', '{group if n == '{o}' else ''}')")
    places = "SELECT p_partkey AS file_id, 'MAIN' AS paragraph, p_partkey AS spot FROM part UNION ALL SELECT p_partkey, 'OTHER', p_partkey + 1 FROM part"
    return f"""SELECT DISTINCT file_id, paragraph, item, storage, mode, CASE WHEN item = 'AMT' THEN grp END AS within FROM ({places}) p
JOIN (VALUES {", ".join(rows)}) v(i, j, item, storage, mode, grp) ON spot % {len(ACCESSES)} = i AND (spot // {len(ACCESSES)}) % {len(QUALIFIED)} = j"""


@registry.add(_accesses_sql())
def cobol_accesses(spark, d):
    """What the paragraphs read and write, and which of the items of one name."""
    return variables.accesses(_accessing(spark, d)).withColumn("within", F.when(F.col("item") == "AMT", F.get("path", 0))).drop("path")
