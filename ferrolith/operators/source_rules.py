"""Definitions and references in JCL, DDL, BMS, Python and data cards, read from the parts of their statements.

JCL and BMS statements have a label, an operation and operands parted by commas; DDL is read as tokens, so that names may
be qualified, quoted or written in any case; Python statements begin with a keyword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators.intervals import preceding_start
from ferrolith.operators.patterns import first_class

#: What the operation of a labelled statement defines.
JCL_LABELS = {"JOB": "procedure", "PROC": "procedure", "EXEC": "paragraph"}
BMS_LABELS = {"DFHMSD": "screen", "DFHMDI": "map", "DFHMDF": "field"}
#: What a CREATE statement defines, and what may stand between CREATE and that word.
DDL_KINDS = {"INDEX": "index", "TABLE": "table", "VIEW": "view"}
DDL_BETWEEN = ["AUXILIARY", "GLOBAL", "LARGE", "OR", "REPLACE", "TEMPORARY", "UNIQUE", "WHERE"]
#: The types that a column of a table can have.
COLUMN_TYPES = (
    "BIGINT BINARY BLOB BOOLEAN CHAR CHARACTER CLOB DATE DBCLOB DECFLOAT DECIMAL DOUBLE FLOAT GRAPHIC INT INTEGER NUMERIC REAL ROWID SMALLINT TIME TIMESTAMP VARBINARY VARCHAR VARGRAPHIC XML"
).split()

_FOUND = "array<struct<type:string,name:string>>"
_USED = "array<struct<raw_text:string,relationship_type:string,expected_type:string>>"


def _statement(text: Column, prefix: str) -> tuple[Column, Column, Column]:
    """Label (may be empty), operation and operands of a line that begins with prefix; nulls for other lines and for
    comments."""
    body = F.when(F.startswith(text, F.lit(prefix)) & ~F.substring(text, len(prefix) + 1, 1).isin("*", ""), F.substring(text, F.lit(len(prefix) + 1), F.length(text)))
    parts = F.split(F.regexp_replace(body, "\\s+$", ""), "\\s+", 3)
    return F.get(parts, 0), F.get(parts, 1), F.coalesce(F.get(parts, 2), F.lit(""))


def _operands(operands: Column) -> Column:
    """Operands up to the first blank outside quotes: texts without a comma outside quotes and brackets."""
    held = F.regexp_extract(operands, "^(?:'[^']*'|[^'\\s])*", 0)
    return F.regexp_extract_all(held, F.lit("(?:'[^']*'|\\([^()]*\\)|[^,'(])+"), F.lit(0))


def _keyword(operands: Column, *names: str) -> Column:
    """The value of the first operand with one of the names, without quotes and what follows in brackets; null."""
    held = F.get(F.filter(operands, lambda x: F.substring_index(x, "=", 1).isin(*names) & F.contains(x, F.lit("="))), 0)
    value = F.translate(F.substring(held, F.instr(held, "=") + 1, F.length(held)), "'", "")
    return F.nullif(F.substring_index(value, "(", 1), F.lit(""))


def _some(kind: str, *rows: Column) -> Column:
    """The rows that aren't null."""
    return F.array_compact(F.array(*rows)).cast(kind)


def _use(name: Column, relation: str, target: str) -> Column:
    return F.when(name.isNotNull() & (name != ""), F.struct(name.alias("raw_text"), F.lit(relation).alias("relationship_type"), F.lit(target).alias("expected_type")))


def _labels(text: Column, prefix: str, kinds: dict[str, str]) -> Column:
    label, operation, _ = _statement(text, prefix)
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return _some(_FOUND, F.when((label != "") & operation.isin(*kinds), F.struct(F.element_at(kind, operation).alias("type"), label.alias("name"))))


def _jcl_uses(text: Column) -> Column:
    _, operation, rest = _statement(text, "//")
    operands = _operands(rest)
    first = F.get(operands, 0)
    procedure = F.coalesce(_keyword(operands, "PROC"), F.when(~F.contains(first, F.lit("=")), first))
    card = F.filter(F.split(F.upper(F.when(~F.startswith(text, F.lit("//")), text)), "[\\s()]+"), lambda x: x != "")
    run = F.array_position(card, "RUN").cast("int")
    return _some(
        _USED, _use(F.when(operation == "EXEC", _keyword(operands, "PGM")), "executes", "program"), _use(F.when(operation == "EXEC", procedure), "calls", "procedure"),
        _use(F.when(operation == "DD", _keyword(operands, "DSN", "DSNAME")), "references", "dataset"), _use(F.when(operation == "INCLUDE", _keyword(operands, "MEMBER")), "includes", "procedure"),
        _use(F.when((run > 0) & (F.get(card, run) == "PROGRAM"), F.get(card, run + 1)), "executes", "program"),
    )


def _ddl_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"[^"]*"|[\\w$#@]+|[^\\s\\w]'), F.lit(0))


def _ddl_name(tokens: Column, at: Column) -> Column:
    """The last part of the possibly qualified, possibly quoted name that begins at a place; null if none does."""
    part = lambda i: F.when(F.get(tokens, i).rlike('^["\\w$#@]'), F.translate(F.get(tokens, i), '"', ""))
    return F.when(F.get(tokens, at + 1) == ".", part(at + 2)).otherwise(part(at))


def _places(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))


def _ddl_definitions(text: Column) -> Column:
    tokens = _ddl_tokens(text)
    upper = F.transform(tokens, F.upper)
    kind = F.create_map(*[F.lit(x) for kv in DDL_KINDS.items() for x in kv])

    def created(i: Column) -> Column:
        before = F.slice(upper, F.lit(1), i)
        start = i - F.array_position(F.reverse(before), "CREATE").cast("int")
        between = F.slice(upper, start + 2, i - start - 1)
        return F.get(upper, i).isin(*DDL_KINDS) & F.array_contains(before, "CREATE") & F.forall(between, lambda x: x.isin(*DDL_BETWEEN, "NOT", "NULL"))

    made = F.transform(F.filter(_places(tokens), created), lambda i: F.struct(F.element_at(kind, F.get(upper, i)).alias("type"), _ddl_name(tokens, i + 1).alias("name")))
    column = F.startswith(text, F.lit(" ")) & F.get(upper, F.lit(1)).isin(*COLUMN_TYPES) & ~F.get(upper, F.lit(0)).isin("AS", "SELECT")
    return F.concat(made.cast(_FOUND), _some(_FOUND, F.when(column, F.struct(F.lit("column").alias("type"), _ddl_name(tokens, F.lit(0)).alias("name")))))


def _ddl_uses(text: Column) -> Column:
    tokens = _ddl_tokens(text)
    upper = F.transform(tokens, F.upper)
    found = F.filter(_places(tokens), lambda i: F.get(upper, i).isin("REFERENCES", "FROM", "JOIN"))
    relation = lambda i: F.when(F.get(upper, i) == "REFERENCES", "references").otherwise("reads")
    rows = F.transform(found, lambda i: F.struct(_ddl_name(tokens, i + 1).alias("raw_text"), relation(i).alias("relationship_type"), F.lit("table").alias("expected_type")))
    return F.filter(rows.cast(_USED), lambda r: r.raw_text.isNotNull())


def _python_words(text: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(text), "^async\\s+def\\b", "def"), "[\\s(:]+")


def _python_definitions(text: Column) -> Column:
    words = _python_words(text)
    kind = F.when(F.get(words, F.lit(0)) == "class", "class").when(F.get(words, F.lit(0)) == "def", "function")
    return _some(_FOUND, F.when(kind.isNotNull() & F.get(words, F.lit(1)).rlike("^\\w+$"), F.struct(kind.alias("type"), F.get(words, F.lit(1)).alias("name"))))


def _python_uses(text: Column) -> Column:
    words = _python_words(text)
    listed = F.split(F.regexp_replace(F.trim(text), "^import\\s+|#.*$", ""), "\\s*,\\s*")
    whole = F.when(F.get(words, F.lit(0)) == "import", F.transform(listed, lambda x: F.substring_index(F.trim(x), " ", 1)))
    part = F.when((F.get(words, F.lit(0)) == "from") & (F.get(words, F.lit(2)) == "import"), F.array(F.get(words, F.lit(1))))
    names = F.coalesce(whole, part, F.array().cast("array<string>"))
    return F.transform(names, lambda x: F.struct(x.alias("raw_text"), F.lit("imports").alias("relationship_type"), F.lit("module").alias("expected_type"))).cast(_USED)


#: For each source type what a line defines and what it uses, as functions of the line.
STATEMENTS = {
    "jcl": (lambda text: _labels(text, "//", JCL_LABELS), _jcl_uses),
    "db2_ddl": (_ddl_definitions, _ddl_uses),
    "bms": (lambda text: _labels(text, "", BMS_LABELS), lambda text: F.array().cast(_USED)),
    "python": (_python_definitions, _python_uses),
}

#: Kinds of data cards by the first expression that their text matches.
UTILITIES = [
    ("DB2 UNLOAD", r"(?i)UNLOAD\s+(DIRECT|TABLESPACE|TABLE|DATA)"),
    ("DB2 LOAD", r"(?i)LOAD\s+(DATA|INTO)"),
    ("IDCAMS REPRO", r"(?i)REPRO\s*-?\s*(INFILE|OUTFILE|INDATASET|OUTDATASET)"),
    ("IDCAMS DEFINE", r"(?i)DEFINE\s+(CLUSTER|AIX|PATH|GDG|ALIAS)"),
    ("IDCAMS DELETE", r"(?i)DELETE\s+"),
    ("IDCAMS LISTCAT", r"(?i)LISTCAT\s+"),
    ("IDCAMS ALTER", r"(?i)ALTER\s+"),
    ("IDCAMS PRINT", r"(?i)PRINT\s+"),
    ("DFSORT", r"(?i)SORT\s+(FIELDS|FORMAT)"),
    ("ICETOOL", r"(?i)ICETOOL"),
    ("IEBCOPY", r"(?i)COPY\s+(INDD|OUTDD)"),
    ("IEBGENER", r"(?i)GENERATE\s*"),
    ("IEFBR14", r"(?i)IEFBR14|//\s*DD\s+.*DISP=\(NEW"),
    ("FTP", r"(?i)(GET|PUT|MGET|MPUT)\s+"),
]


def utility(content: Column) -> Column:
    return first_class(content, UTILITIES, "UNKNOWN")


def card_preview(content: Column, lines: int = 3, most: int = 200) -> Column:
    """The first lines that aren't blank, joined by a blank, cut."""
    full = F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.array_join(F.slice(full, 1, lines), " "), 1, most)


def definitions(lines: DataFrame, source_type: str) -> DataFrame:
    """(artifact_id, type, name, file_id, line_start) of what the lines of a source type define."""
    found = lines.select("file_id", F.col("line_no").alias("line_start"), F.explode(STATEMENTS[source_type][0](F.col("text"))).alias("d"))
    named = found.where("d.name is not null").select("file_id", "line_start", "d.type", F.upper("d.name").alias("name"))
    return named.select(F.concat("type", F.lit("::"), "name").alias("artifact_id"), "type", "name", "file_id", "line_start").distinct()


def references(lines: DataFrame, source_type: str) -> DataFrame:
    """(file_id, line_no, raw_text, relationship_type, expected_type, containing_id): each with the definition that
    stands nearest before it, or the file."""
    found = lines.select("file_id", "line_no", F.inline(STATEMENTS[source_type][1](F.col("text"))))
    near = preceding_start(found, definitions(lines, source_type), "file_id", "line_no", "line_start", "artifact_id")
    return near.withColumn("containing_id", F.coalesce("artifact_id", F.concat(F.lit("file::"), "file_id"))).select(*found.columns, "containing_id")


def jcl_steps(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, dd, dsn, step): each DD statement with the step before it, UNKNOWN without one."""
    label, operation, rest = _statement(F.col("text"), "//")
    step = F.when((operation == "EXEC") & (label != ""), label)
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("step", F.coalesce(F.last(step, ignorenulls=True).over(w), F.lit("UNKNOWN")))
    return carried.where((operation == "DD") & (label != "")).select("file_id", "line_no", label.alias("dd"), _keyword(_operands(rest), "DSN", "DSNAME").alias("dsn"), "step")
