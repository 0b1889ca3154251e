"""COBOL statements: assembled from tokens, classified, and as trees of one row a node.

Tokens are dealt by (file, paragraph), so no task holds more than the paragraphs it is given; only the fold that finds
each statement's parent needs a paragraph's statements in order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.operators import cobol
from ferrolith.operators import lines as ln

NAME = cobol.NAME

#: Words that begin a statement.
VERBS = (
    "ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE ELSE EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MERGE MOVE "
    "MULTIPLY OPEN PERFORM READ RELEASE RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WHEN WRITE"
).split()

#: Ends that close a container; other END- words only end their own verb's phrase.
CLOSES = {"END-IF": "IF", "END-EVALUATE": "EVALUATE", "END-PERFORM": "PERFORM_INLINE", "END-SEARCH": "SEARCH", "END-START": "START"}
CONTAINERS = {"IF", "ELSE", "EVALUATE", "WHEN", "PERFORM_INLINE", "SEARCH", "START"}

#: (type, expression): a statement is of the first type whose expression it matches.
TYPES = [
    ("PERFORM_INLINE", r"(?i)^PERFORM\s+(?:(?:WITH\s+)?TEST\s+\w+\s+)?(?:UNTIL|VARYING)\b"),
    ("PERFORM_INLINE", r"(?i)^PERFORM(?:\s+[A-Z0-9-]+\s+TIMES)?$"),
    ("PERFORM_THRU", rf"(?i)^PERFORM\s+{NAME}\s+(?:THRU|THROUGH)\s+{NAME}"),
    ("PERFORM_UNTIL", rf"(?i)^PERFORM\s+{NAME}\s+(?:(?:WITH\s+)?TEST\s+\w+\s+)?UNTIL\b"),
    ("PERFORM", r"(?i)^PERFORM\b"),
    ("EXEC_SQL", r"(?i)^EXEC\s+SQL\b"), ("EXEC_CICS", r"(?i)^EXEC\s+CICS\b"), ("EXEC_DLI", r"(?i)^EXEC\s+DLI\b"), ("EXEC_OTHER", r"(?i)^EXEC\b"),
    ("STOP_RUN", r"(?i)^STOP\s+RUN\b"), ("GO_TO", r"(?i)^GO\s+TO\b"),
    *((v, rf"(?i)^{v}(?![A-Z0-9-])") for v in VERBS if v not in ("PERFORM", "EXEC", "STOP", "GO", "CANCEL", "DELETE", "MERGE", "RELEASE", "RETURN")),
]

#: (attribute, types, expression): its first group is the attribute's value.
ATTRIBUTES = [
    ("condition", ["IF"], r"(?is)^IF\s+(.*?)(?:\s+THEN)?$"),
    ("condition", ["PERFORM_INLINE"], r"(?is)^PERFORM\s+(?:(?:WITH\s+)?TEST\s+\w+\s+)?UNTIL\s+(.*)$"),
    ("condition", ["PERFORM_UNTIL"], r"(?is)\bUNTIL\s+(.*)$"),
    ("varying", ["PERFORM_INLINE"], r"(?is)^PERFORM\s+(?:(?:WITH\s+)?TEST\s+\w+\s+)?(VARYING\s.*)$"),
    ("subject", ["EVALUATE"], r"(?is)^EVALUATE\s+(.*)$"),
    ("value", ["WHEN"], r"(?is)^WHEN\s+(.*)$"),
    ("target", ["PERFORM", "PERFORM_THRU", "PERFORM_UNTIL"], rf"(?i)^PERFORM\s+({NAME})"),
    ("thru", ["PERFORM_THRU"], rf"(?i)\b(?:THRU|THROUGH)\s+({NAME})"),
    ("times", ["PERFORM"], rf"(?i)^PERFORM\s+{NAME}\s+([0-9]+)\s+TIMES\b"),
    ("target", ["GO_TO"], rf"(?i)^GO\s+TO\s+({NAME})"),
    ("target", ["CALL"], r"(?i)^CALL\s+['\"]?([A-Z0-9$#@-]+)"),
    ("target", ["COPY"], rf"(?i)^COPY\s+['\"]?({NAME})"),
    ("source", ["MOVE"], r"(?is)^MOVE\s+(.*?)\s+TO\s"),
    ("targets", ["MOVE"], r"(?is)^MOVE\s+.*?\s+TO\s+(.*)$"),
    ("target", ["COMPUTE"], rf"(?i)^COMPUTE\s+({NAME})"),
    ("expression", ["COMPUTE"], r"(?s)=\s*(.*)$"),
    ("raw_text", ["EXEC_SQL", "EXEC_CICS", "EXEC_DLI", "EXEC_OTHER"], r"(?s)^(.*)$"),
]
#: Attributes that are names are upper case.
NAMES = {"target", "thru"}

#: Nodes that a data frame of flatten_json() has.
FRAME = 10000
FLAT = "program_id string, paragraph string, node_id bigint, parent_id bigint, depth int, type string, text string, line_start bigint, line_end bigint, attributes map<string,string>"


def tokens(source: DataFrame) -> DataFrame:
    """(file_id, paragraph, para_start, line_no, last_line, at, token): words and literals of the paragraphs' code; a
    period at the end of a word or after a literal stays with it."""
    inside = cobol.paragraph_lines(source)
    word = F.regexp_extract_all("text", F.lit(r"""(?:'[^']*'|"[^"]*"|[^\s'"])+"""), 0)
    return inside.select("file_id", "paragraph", "para_start", "line_no", "last_line", F.posexplode(word).alias("at", "token"))


def assemble(source: DataFrame) -> DataFrame:
    """(file_id, paragraph, para_start, ord, text, line_start, line_end, ended): a statement begins at a verb or at an
    END- word, and after a period; EXEC blocks stay whole. ended: a period closes it; text is without that."""
    of = ["file_id", "paragraph", "para_start"]
    so_far = Window.partitionBy(*of).orderBy("line_no", "at")
    word = F.upper(F.rtrim("token", F.lit(".")))
    before = F.lag(word, 1, "").over(so_far)
    count = lambda c: F.sum(c.cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    marked = tokens(source).withColumn("_word", word).withColumn("_before", before)
    in_block = F.coalesce(count(F.col("_word") == "EXEC") > count(F.col("_word") == "END-EXEC"), F.lit(False))
    starts = F.col("_word").isin(VERBS) & ~((F.col("_before") == "EXIT") & (F.col("_word") == "PERFORM")) | F.col("_word").rlike("^END-(?!EXEC$)[A-Z]+$")
    after_end = F.lag(F.col("token").endswith("."), 1, True).over(so_far)
    marked = marked.withColumn("_new", ~in_block & (starts | after_end))
    parts = marked.withColumn("island", F.sum(F.coalesce(F.col("_new").cast("int"), F.lit(0))).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "at", "token")))
    text = F.array_join(F.transform(rows, lambda r: r["token"]), " ")
    whole = parts.groupBy(*of, F.col("island").alias("ord")).agg(F.min("line_no").alias("line_start"), F.max("last_line").alias("line_end"), text.alias("_text"))
    return whole.select(*of, "ord", F.rtrim(F.rtrim("_text", F.lit("."))).alias("text"), "line_start", "line_end", F.col("_text").endswith(".").alias("ended")).where("text <> '' or ended")


_TOKEN = re.compile(r"""(?:'[^']*'|"[^"]*"|[^\s'"])+""", re.A)
_BEGIN = re.compile(r"\s*PROCEDURE\s+DIVISION", re.A)
#: Spark's $ also stands before one of these last signs.
_PARAGRAPH = re.compile(rf"(?!(?:DECLARATIVES|END)(?![A-Z0-9-]))({NAME})(?:\s+SECTION)?\s*\.\s*[\x85\u2028\u2029]?\Z", re.I | re.A)
_END = re.compile(r"END-(?!EXEC\Z)[A-Z]+", re.A)
_QUOTE = re.compile("['\"]")
_VERBS = frozenset(VERBS)


def _marked(text: str) -> list[tuple[str, str, bool, bool]]:
    """The tokens of a line: each one, its word, whether that begins a statement, and whether a period ends it."""
    words = [(t, t.rstrip(".").upper()) for t in _TOKEN.findall(text)]
    return [(t, w, w in _VERBS or _END.fullmatch(w) is not None, t.endswith(".")) for t, w in words]


def statements_in(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, int, int, str, bool]]:
    """The rows of assemble() in whole files (file_id, line_no, text, _n) that are in order: number of the file in the batch,
    paragraph, para_start, line_start, line_end, text, ended. One pass over the lines; equal lines are cut once."""
    new = batch.column("_n").to_numpy() == 1
    mark, code = ln.fixed_code(batch.column("text"))
    kept = pc.and_not(pc.not_equal(pc.utf8_ltrim(code, " "), ""), pc.is_in(mark, pa.array(["*", "/"], mark.type)))
    at = pa.array(np.flatnonzero(kept.to_numpy(zero_copy_only=False)))
    lines = zip((np.cumsum(new) - 1)[at.to_numpy()].tolist(), batch.column("line_no").take(at).to_pylist(), pc.equal(mark, "-").take(at).to_pylist(), code.take(at).to_pylist())
    known: dict[str, list] = {}
    file, begun, head = -1, False, None
    held = None  # the logical line so far: its file, head, first and last line and text
    parts: list[str] = []  # the statement so far, of the paragraph para in file own
    own, para, start, end, blocks, before, after_end = -1, None, 0, 0, 0, "", True

    def stated():
        whole = " ".join(parts)
        text, ended = whole.rstrip(".").rstrip(" "), whole.endswith(".")
        return [(own, *para, start, end, text, ended)] if parts and (text or ended) else []

    for line in [*lines, None]:
        if line is not None and line[2] and line[0] == file:
            _, line_no, _, text = line
            piece, (of, its, first, _, so_far) = text.lstrip(" "), held
            if so_far.count("'") % 2:
                held = of, its, first, line_no, so_far + (piece[1:] if _QUOTE.match(piece) else piece)
            else:
                held = of, its, first, line_no, f"{so_far} {piece}"
            begun = begun or _BEGIN.match(text.upper()) is not None
            continue
        if held is not None and held[1] is not None and held[2] > held[1][1]:
            of, its, first, last, text = held
            if of != own or its is not para:
                yield from stated()
                own, para, parts, blocks, before, after_end = of, its, [], 0, "", True
            tokens = known.get(text)
            if tokens is None:
                tokens = known[text] = _marked(text)
            for token, word, starts, ends in tokens:
                if blocks <= 0 and (after_end or starts and not (word == "PERFORM" and before == "EXIT")):
                    yield from stated()
                    parts, start = [], first
                parts.append(token)
                end, before, after_end = last, word, ends
                blocks += (word == "EXEC") - (word == "END-EXEC")
        if line is None:
            yield from stated()
            return
        of, line_no, more, text = line
        if of != file:
            file, begun, head = of, False, None
        begun = begun or _BEGIN.match(text.upper()) is not None
        if begun and not more and text[0] != " " and (named := _PARAGRAPH.match(text)):
            head = named[1].upper(), line_no
        held = of, head, line_no, line_no, text


def statement_type(text: Column) -> Column:
    """The first of TYPES that the text is of, the END- word itself, or UNKNOWN."""
    out = F.lit("UNKNOWN")
    for name, regex in reversed(TYPES):
        out = F.when(text.rlike(regex), F.lit(name)).otherwise(out)
    return F.when(text.rlike(r"(?i)^END-[A-Z]+$"), F.upper(text)).otherwise(out)


def statement_attributes(text: Column, kind: Column) -> Column:
    """A map of what a statement of that type names: condition, subject, value, target, thru, and so on."""
    found = []
    for name, kinds, regex in ATTRIBUTES:
        value = F.regexp_extract(text, regex, 1)
        found.append(F.when(kind.isin(kinds) & (value != ""), F.struct(F.lit(name).alias("key"), (F.upper(value) if name in NAMES else value).alias("value"))))
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e.isNotNull()))


def classified(source: DataFrame) -> DataFrame:
    """assemble() with type and attributes."""
    typed = assemble(source).withColumn("type", statement_type(F.col("text")))
    return typed.withColumn("attributes", statement_attributes(F.col("text"), F.col("type")))


def parents(kinds: list[str], ended: list[bool]) -> list[tuple[int, int] | None]:
    """(index of the parent or -1, depth from 1) of each statement of a paragraph; None for END- words."""
    open_: list[int] = []
    has_else: set[int] = set()
    out: list[tuple[int, int] | None] = []
    for at, (kind, stop) in enumerate(zip(kinds, ended)):
        if kind.startswith("END-"):
            if kind in CLOSES:  # without its opener, an end closes all
                while open_ and kinds[open_.pop()] != CLOSES[kind]:
                    pass
            out.append(None)
        else:
            if kind == "ELSE":
                ifs = [k for k, i in enumerate(open_) if kinds[i] == "IF"]
                free = [k for k in ifs if open_[k] not in has_else]
                if ifs:
                    owner = (free or ifs)[-1]
                    del open_[owner + 1 :]
                    has_else.add(open_[owner])
            elif kind == "WHEN" and open_ and kinds[open_[-1]] == "WHEN":
                open_.pop()
            out.append((open_[-1] if open_ else -1, len(open_) + 1))
            if kind in CONTAINERS:
                open_.append(at)
        if stop:
            open_.clear()
    return out


def statement_tree(source: DataFrame) -> DataFrame:
    """One row a node: file_id, paragraph, para_start, node_id (in order from 1), parent_id (0: the paragraph), depth,
    type, text, line_start, line_end, attributes. A period closes all that is open; an ELSE belongs to the nearest open
    IF without one; END- words make no node. The fold takes one paragraph at a time, but many of them go to Python at once."""
    of = ["file_id", "paragraph", "para_start"]
    place = pa.struct([("node_id", pa.int64()), ("parent_id", pa.int64()), ("depth", pa.int32())])

    def nodes(kinds: list[str], ended: list[bool]) -> list[dict | None]:
        ids, out = {-1: 0}, []
        for at, p in enumerate(parents(kinds, ended)):
            if p is not None:
                ids[at] = len(ids)
            out.append(None if p is None else {"node_id": ids[at], "parent_id": ids[p[0]], "depth": p[1]})
        return out

    @F.arrow_udf("array<struct<node_id:bigint,parent_id:bigint,depth:int>>")
    def placed(kinds: pa.Array, ended: pa.Array) -> pa.Array:
        return pa.array([nodes(k, e) for k, e in zip(kinds.to_pylist(), ended.to_pylist())], pa.list_(place))

    row = F.struct("ord", statement_type(F.col("text")).alias("type"), "ended", "text", "line_start", "line_end")
    held = assemble(source).groupBy(*of).agg(F.array_sort(F.collect_list(row)).alias("s"))
    held = held.withColumn("n", placed(F.col("s.type"), F.col("s.ended")))
    each = held.select(*of, F.explode(F.arrays_zip("s", "n")).alias("r")).where("r.n is not null and r.s.text <> ''")
    rows = each.select(*of, "r.n.*", *[f"r.s.{c}" for c in ("type", "text", "line_start", "line_end")])
    return rows.withColumn("attributes", statement_attributes(F.col("text"), F.col("type")))


def tree_statistics(tree: DataFrame) -> DataFrame:
    """(file_id, paragraph, para_start, n_statements, max_depth): the depth is that of containers, ELSE and WHEN aside."""
    nests = F.col("type").isin(sorted(CONTAINERS - {"ELSE", "WHEN"}))
    return tree.groupBy("file_id", "paragraph", "para_start").agg(F.count(F.lit(1)).alias("n_statements"), F.coalesce(F.max(F.when(nests, F.col("depth"))), F.lit(0)).alias("max_depth"))


def tree_problems(tree: DataFrame) -> DataFrame:
    """(file_id, paragraph, type, line_start, problem): a type whose word the text lacks, lines out of order in or
    between nodes, a target that the text doesn't name."""
    w = Window.partitionBy("file_id", "paragraph", "para_start").orderBy("node_id")
    word = F.split(F.col("type"), "_").getItem(0)
    target = F.col("attributes")["target"]
    checks = F.array(
        F.when((F.col("type") != "UNKNOWN") & ~F.upper("text").contains(word), F.lit("keyword missing")),
        F.when(F.col("line_start") > F.col("line_end"), F.lit("ends before it starts")),
        F.when(target.isNotNull() & ~F.upper("text").contains(F.upper(target)), F.lit("target missing")),
        F.when(F.col("_last") > F.col("line_start"), F.lit("starts before the one before")),
    )
    rows = tree.withColumn("_last", F.lag("line_start").over(w))
    found = rows.select("file_id", "paragraph", "type", "line_start", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("problem"))
    return found


def tree_lines(tree: DataFrame) -> DataFrame:
    """(file_id, paragraph, node_id, line): trees as indented text."""
    return tree.select("file_id", "paragraph", "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.col("type"), F.lit(" "), F.col("text")).alias("line"))


def tree_targets(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, name) of paragraphs that are performed or gone to, and (file_id, first, last) of THRU ranges."""
    named = tree.where(F.col("type").isin("PERFORM", "PERFORM_THRU", "PERFORM_UNTIL", "GO_TO"))
    names = named.select("file_id", F.explode(F.filter(F.array(F.col("attributes")["target"], F.col("attributes")["thru"]), lambda n: n.isNotNull())).alias("name"))
    spans = tree.where("type = 'PERFORM_THRU'").select("file_id", F.col("attributes")["target"].alias("first"), F.col("attributes")["thru"].alias("last"))
    return names, spans


def dead_in_tree(source: DataFrame, tree: DataFrame) -> DataFrame:
    """Paragraphs that no node of the trees performs or goes to, nor any THRU range spans; the first one is exempt."""
    from ferrolith.operators.graph import dead_paragraphs

    return dead_paragraphs(cobol.paragraphs(source), *tree_targets(tree))


def tree_json(tree: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, json): program_id and its paragraphs with nested statements. Nodes stand in reading order, so that what a node
    closes before it opens follows from its depth and that of the node before; a paragraph's nodes are joined that way."""
    said = F.to_json(F.struct("type", "text", "line_start", "line_end", "attributes"))
    rows = F.array_sort(F.collect_list(F.struct("node_id", "depth", F.left(said, F.length(said) - 1).alias("said"))))
    each = tree.groupBy(key, "paragraph", "para_start").agg(rows.alias("nodes"), F.max("line_end").alias("line_end"))

    def opened(r: Column, i: Column) -> Column:
        before = F.coalesce(F.get("nodes", i - 1)["depth"], F.lit(0))
        closed = F.when((i > 0) & (r["depth"] <= before), F.concat(F.repeat(F.lit("]}"), before - r["depth"] + 1), F.lit(", "))).otherwise("")
        return F.concat(closed, r["said"], F.lit(', "children": ['))

    head = F.to_json(F.struct(F.col("paragraph").alias("name"), F.col("para_start").alias("line_start"), "line_end"))
    ends = F.repeat(F.lit("]}"), F.element_at("nodes", -1)["depth"])
    body = F.concat(F.left(head, F.length(head) - 1), F.lit(', "statements": ['), F.array_join(F.transform("nodes", opened), ""), ends, F.lit("]}"))
    bodies = F.array_sort(F.collect_list(F.struct("para_start", "body")))
    whole = F.concat(F.lit('{"program_id": "'), F.col(key).cast("string"), F.lit('", "paragraphs": ['), F.array_join(F.transform("rows", lambda r: r["body"]), ", "), F.lit("]}"))
    return each.select(key, "para_start", body.alias("body")).groupBy(key).agg(bodies.alias("rows")).select(key, whole.alias("json"))


def flatten_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Nodes (FLAT) of the trees in a column of JSON texts; a text that isn't such JSON gives no rows. One text at a
    time is held, and some FRAME nodes, which leave together."""

    def nodes(paragraph, program):
        todo = [(s, 0, 1) for s in reversed(paragraph.get("statements") or [])]
        k = 0
        while todo:
            s, parent, depth = todo.pop()
            k += 1
            attributes = {str(a): v if isinstance(v, str) else json.dumps(v) for a, v in (s.get("attributes") or {}).items()}
            yield program, paragraph.get("name"), k, parent, depth, s.get("type"), s.get("text"), s.get("line_start"), s.get("line_end"), attributes
            todo += [(c, k, depth + 1) for c in reversed(s.get("children") or [])]

    columns = [c.split()[0] for c in FLAT.replace("map<string,string>", "map").split(", ")]

    def run(frames):
        held = []
        for frame in frames:
            for text in frame[column]:
                try:
                    read = json.loads(text)
                    rows = [r for p in read["paragraphs"] for r in nodes(p, read.get("program_id"))]
                except (TypeError, ValueError, KeyError, AttributeError):
                    continue
                held += rows
                if len(held) >= FRAME:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=columns)

    return texts.select(column).mapInPandas(run, FLAT)


def scan_trees(spark: SparkSession, root: str, glob: str = "*.ast") -> DataFrame:
    """Nodes (FLAT) of all tree files below root that match glob."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return flatten_json(files, "value")
