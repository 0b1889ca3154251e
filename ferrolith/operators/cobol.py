"""Fixed-format COBOL as tables: includes, paragraphs, statements' facts, data items, and the graph they make.

All take lines (file_id, line_no, text) as of lines.explode_lines(), or lines.fixed_format() of them as `code`.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators import lines as ln
from ferrolith.operators.patterns import Rule
from ferrolith.sources.shared import settled

NAME = r"[A-Z0-9][A-Z0-9-]*"
COPY_DEPTH = 10

#: References in a line of code: what it names and how.
REFERENCES = [
    Rule("perform", "thru", rf"(?i)\bPERFORM\s+({NAME})\s+(?:THRU|THROUGH)\s+{NAME}", 1, relationship_type="performs", target_type="paragraph"),
    Rule("perform", "simple", rf"(?i)\bPERFORM\s+(?!UNTIL\b|VARYING\b|WITH\b|TEST\b|[0-9]+\s+TIMES)({NAME})", 1, relationship_type="performs", target_type="paragraph"),
    Rule("goto", "go_to", rf"(?i)\bGO\s+TO\s+({NAME})", 1, relationship_type="performs", target_type="paragraph"),
    Rule("call", "static", r"(?i)\bCALL\s+'([A-Z0-9$#@-]+)'", 1, relationship_type="calls", target_type="program"),
    Rule("call", "dynamic", rf"(?i)\bCALL\s+({NAME})\b(?!')", 1, relationship_type="calls", target_type="program"),
    Rule("copy", "copy", rf"(?i)\bCOPY\s+['\"]?({NAME})", 1, relationship_type="includes", target_type="copybook"),
    Rule("file", "select", rf"(?i)\bSELECT\s+(?:OPTIONAL\s+)?({NAME})\s+ASSIGN", 1, relationship_type="uses", target_type="file"),
]


def logical(source: DataFrame) -> DataFrame:
    """Lines of code with continuations joined: file_id, line_no, last_line, text (from column 8 on)."""
    return ln.merge_continuations(ln.fixed_format(source))


def parse_replacing(text: str) -> list[tuple[str, str]]:
    """The ==old== BY ==new== pairs of a REPLACING phrase."""
    return re.findall(r"==(.*?)==\s+BY\s+==(.*?)==", text, re.I | re.S)


def replaced(text: Column, replacing: Column) -> Column:
    """text with the pairs of a REPLACING phrase put in."""
    old, new = (F.regexp_extract_all(replacing, F.lit(r"(?is)==(.*?)==\s+BY\s+==(.*?)=="), k) for k in (1, 2))
    pairs = F.zip_with(old, new, lambda o, n: F.struct(o.alias("o"), n.alias("n")))
    return F.aggregate(pairs, text, lambda a, p: F.replace(a, p["o"], p["n"]))


def expand_copies(source: DataFrame, books: DataFrame) -> DataFrame:
    """source with the lines of copybooks in place of COPY lines, to a depth of COPY_DEPTH, with the path of lines that
    each came by (order) and the book it is from. books: name, line_no, text. A book that is missing or in itself
    leaves a comment."""
    book = books.select(F.upper("name").alias("_book"), F.col("line_no").alias("_line"), F.col("text").alias("_text"))
    known = book.select("_book").distinct().withColumn("_known", F.lit(True))
    held = source.select("file_id", F.array("line_no").alias("order"), "text", F.lit(None).cast("string").alias("book"), F.array().cast("array<string>").alias("chain"))
    wants = F.upper(F.regexp_extract(F.substring("text", 8, 65), rf"(?i)^\s*COPY\s+['\"]?({NAME})", 1))
    is_code = ~F.substring(F.rpad("text", 7, " "), 7, 1).isin("*", "/")
    done = None
    for _ in range(COPY_DEPTH):
        held = settled(held)  # a round's expressions would otherwise be repeated in all later ones
        if held.isEmpty():
            return done
        named = held.withColumn("_name", F.when(is_code & (wants != ""), wants)).join(known.withColumnRenamed("_book", "_name"), "_name", "left")
        broken = F.col("_name").isNotNull() & (F.col("_known").isNull() | F.array_contains("chain", F.col("_name")))
        note = F.concat(F.lit("      * COPY "), "_name", F.when(F.col("_known").isNull(), F.lit(" not found")).otherwise(F.lit(" is in itself")))
        plain = named.where(F.col("_name").isNull() | broken).select("file_id", "order", F.when(F.col("_name").isNull(), F.col("text")).otherwise(note).alias("text"), "book")
        done = plain if done is None else done.unionByName(plain)
        again = named.where(F.col("_name").isNotNull() & ~broken).drop("_known")
        held = again.join(book, F.col("_name") == F.col("_book")).select(
            "file_id", F.concat("order", F.array("_line")).alias("order"), F.when(F.upper("text").contains("REPLACING"), replaced(F.col("_text"), F.col("text"))).otherwise(F.col("_text")).alias("text"),
            F.col("_book").alias("book"), F.concat("chain", F.array("_book")).alias("chain"),
        )
    deep = held.select("file_id", "order", F.lit("      * COPY too deep").alias("text"), "book")
    return done.unionByName(deep)


def numbered(expanded: DataFrame) -> DataFrame:
    """Expanded lines with running numbers."""
    return expanded.withColumn("line_no", F.row_number().over(Window.partitionBy("file_id").orderBy("order")).cast("bigint")).drop("order")


def divisions(source: DataFrame) -> DataFrame:
    """(file_id, name, line_start, line_end) of the divisions."""
    name = F.upper(F.regexp_extract("text", r"(?i)^\s*([A-Z]+)\s+DIVISION\b", 1))
    heads = logical(source).select("file_id", "line_no", name.alias("name")).where("name <> ''")
    return ln.header_ranges(heads, source.groupBy("file_id").agg(F.max("line_no").alias("last_line")))


def paragraphs(source: DataFrame) -> DataFrame:
    """(file_id, name, line_start, line_end): names in area A below PROCEDURE DIVISION; each ends before the next, the
    last with the file's last line of code. One pass: a group holds the names of a file."""
    code = ln.fixed_format(source).where(~F.col("is_comment") & ~F.col("is_blank")).select("file_id", "line_no", _paragraph_name().alias("name"), _begins_procedures().alias("begins"))
    heads = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("line_no", "name")))
    begin = F.min(F.when(F.col("begins"), F.col("line_no")))
    files = code.groupBy("file_id").agg(F.array_sort(heads).alias("heads"), begin.alias("begin"), F.max("line_no").alias("last_line"))
    files = files.withColumn("heads", F.filter("heads", lambda h: h["line_no"] > F.col("begin")))
    after = F.slice("heads", F.lit(2), F.greatest(F.size("heads"), F.lit(1)))
    ranges = F.zip_with("heads", after, lambda h, nxt: F.struct(h["name"].alias("name"), h["line_no"].alias("line_start"), F.coalesce(nxt["line_no"] - 1, F.col("last_line")).alias("line_end")))
    return files.select("file_id", F.inline(ranges))


def _begins_procedures() -> Column:
    return F.upper("code").rlike(r"^\s*PROCEDURE\s+DIVISION")


def _paragraph_name() -> Column:
    """The name in area A of a line of code that may head a paragraph, else null."""
    name = F.upper(F.regexp_extract("code", rf"(?i)^(?!(?:DECLARATIVES|END)(?![A-Z0-9-]))({NAME})(?:\s+SECTION)?\s*\.\s*$", 1))
    return F.when(~F.col("is_continuation") & (F.col("area_a") != "    "), F.nullif(name, F.lit("")))


def located(source: DataFrame) -> DataFrame:
    """logical() with paragraph and para_start, those of the last head at or before a line, null before the first one. The
    head is found by a window over the file, in the pass that joins continuations."""
    upto = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    code = ln.fixed_format(source).where(~F.col("is_comment") & ~F.col("is_blank"))
    marked = code.withColumns({"_begun": F.max(_begins_procedures()).over(upto), "_name": _paragraph_name()})
    head = F.when(F.col("_begun") & F.col("_name").isNotNull(), F.struct(F.col("_name").alias("name"), F.col("line_no").alias("line_no")))
    held = marked.withColumn("_head", F.last(head, True).over(upto))
    rows = ln.merge_continuations(held, keep=["_head"])
    return rows.select("file_id", F.col("_head.name").alias("paragraph"), F.col("_head.line_no").alias("para_start"), "line_no", "last_line", "text")


def paragraph_lines(source: DataFrame) -> DataFrame:
    """located() lines within paragraphs, without those that head them."""
    return located(source).where("line_no > para_start")


def references(source: DataFrame) -> DataFrame:
    """(file_id, line_no, category, name, found): of each place the first rule of its category counts."""
    return references_in(logical(source).drop("last_line"))


def references_in(lines: DataFrame) -> DataFrame:
    """The references in logical lines, with the other columns of these."""
    from ferrolith.operators.patterns import extract_matches

    found = extract_matches(lines, REFERENCES).withColumn("found", F.upper("found"))
    order = F.lit(99)
    for k, r in reversed(list(enumerate(REFERENCES))):
        order = F.when(F.col("name") == r.name, k).otherwise(order)
    w = Window.partitionBy("file_id", "line_no", "category", "found").orderBy(order)
    return found.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def exec_blocks(source: DataFrame) -> DataFrame:
    """(file_id, number, kind, line_start, line_end, text, subtype, inputs, outputs) of EXEC .. END-EXEC."""
    code = ln.fixed_format(source).where(~F.col("is_comment") & ~F.col("is_blank"))
    upper = F.upper("code")
    marked = ln.islands(code, upper.rlike(r"\bEXEC\s+(SQL|CICS|DLI)\b"), ["file_id"], "line_no").where("island > 0")
    ends = F.sum(upper.contains("END-EXEC").cast("int")).over(Window.partitionBy("file_id", "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    inside = marked.withColumn("_ended", F.coalesce(ends, F.lit(0))).where("_ended = 0")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "code")))
    blocks = inside.groupBy("file_id", F.col("island").alias("number")).agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.array_join(F.transform(rows, lambda r: F.trim(r["code"])), " ").alias("text"))
    kind = F.upper(F.regexp_extract("text", r"(?i)EXEC\s+(SQL|CICS|DLI)", 1))
    hosts = F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(rf":({NAME})"), 1))
    into = F.array_distinct(F.regexp_extract_all(F.regexp_extract(F.upper("text"), r"INTO\s+((?::[A-Z0-9-]+\s*,?\s*)+)", 1), F.lit(rf":({NAME})"), 1))
    return blocks.withColumn("kind", kind).withColumn("subtype", F.upper(F.regexp_extract("text", r"(?i)EXEC\s+\w+\s+(\w+)", 1))).withColumn("outputs", into).withColumn("inputs", F.array_except(hosts, into))


ITEM = r"(?is)^\s*(\d\d?)\s+([A-Z0-9-]+)"


def data_items(source: DataFrame) -> DataFrame:
    """(file_id, ord, line_no, level, name, pic, usage, value, redefines, occurs): statements of the data division."""
    code = logical(source)
    div = divisions(source).where("name = 'DATA'").select("file_id", F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    inside = code.join(div.hint("merge"), "file_id").where("line_no between a and b").drop("a", "b")
    ended = F.lag(F.rtrim("text").endswith("."), 1, True).over(Window.partitionBy("file_id").orderBy("line_no"))
    stmts = ln.islands(inside.withColumn("_new", ended), F.col("_new"), ["file_id"], "line_no")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    whole = stmts.groupBy("file_id", "island").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(rows, lambda r: F.trim(r["text"])), " ").alias("s"))
    whole = whole.where(F.col("s").rlike(ITEM))
    get = lambda regex, group=1: F.nullif(F.upper(F.regexp_extract("s", regex, group)), F.lit(""))
    usage = get(r"(?i)\b(COMP(?:UTATIONAL)?(?:-[1-5])?|BINARY|PACKED-DECIMAL|DISPLAY|INDEX|POINTER)\b")
    usage = F.when(usage.isin("BINARY", "COMPUTATIONAL"), "COMP").when(usage == "PACKED-DECIMAL", "COMP-3").otherwise(F.replace(usage, F.lit("COMPUTATIONAL"), F.lit("COMP")))
    items = whole.select(
        "file_id", "line_no", F.regexp_extract("s", ITEM, 1).cast("int").alias("level"), F.upper(F.regexp_extract("s", ITEM, 2)).alias("name"), get(r"(?i)\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+?)\.?(?:\s|$)").alias("pic"),
        usage.alias("usage"), F.nullif(F.regexp_extract("s", r"(?i)\bVALUES?\s+(?:IS\s+|ARE\s+)?('[^']*'|\"[^\"]*\"|[^\s.]+)", 1), F.lit("")).alias("value"), get(rf"(?i)\bREDEFINES\s+({NAME})").alias("redefines"), get(r"(?i)\bOCCURS\s+(\d+)").cast("int").alias("occurs"),
    )
    return items.withColumn("ord", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no")).cast("bigint"))


def expand_picture(pic: str) -> str:
    """X(3)9V99 as XXX9V99."""
    return re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), pic.upper().rstrip("."))


@functools.lru_cache(1 << 14)
def picture_facts(pic: str | None, usage: str | None) -> dict:
    """Sign, digits, scale, category and bytes of a picture under its usage."""
    if not pic:
        return {"signed": False, "digits": 0, "scale": 0, "category": None, "n_bytes": {"COMP-1": 4, "COMP-2": 8, "INDEX": 4, "POINTER": 4}.get(usage or "", 0)}
    p = expand_picture(pic)
    whole, _, part = p.partition("V")
    digits, scale = sum(c in "9Z*" for c in p), sum(c in "9Z*" for c in part)
    kind = "alphanumeric" if "X" in p else "alphabetic" if "A" in p and "9" not in p else "numeric" if set(p) <= set("S9VP") else "edited"
    shown = sum(c not in "SVP" for c in p)
    if kind == "numeric" and usage in ("COMP", "COMP-4", "COMP-5"):
        size = 2 if digits <= 4 else 4 if digits <= 9 else 8
    elif kind == "numeric" and usage == "COMP-3":
        size = (digits + 2) // 2
    else:
        size = shown
    return {"signed": p.startswith("S"), "digits": digits, "scale": scale, "category": kind, "n_bytes": size}


def item_tree(items: DataFrame) -> DataFrame:
    """items with parent (the ord of the nearest earlier item of a smaller level; a level 88's is the item before), the
    facts of their pictures and total_bytes (a group's is the sum of its members', times OCCURS; REDEFINES adds
    nothing). A stack over each file's items in order; many files' arrays of items go to Python at once."""
    place = pa.struct([("parent", pa.int64()), ("signed", pa.bool_()), ("digits", pa.int32()), ("scale", pa.int32()), ("category", pa.string()), ("n_bytes", pa.int32()), ("total_bytes", pa.int64())])

    extra = "array<struct<parent:bigint,signed:boolean,digits:int,scale:int,category:string,n_bytes:int,total_bytes:bigint>>"

    def build(ords: list, levels: list, pics: list, usages: list, over: list, occurs: list) -> list[dict]:
        stack: list[tuple[int, int]] = []
        parents, facts, last = [], [], None
        for o, level, pic, usage in zip(ords, levels, pics, usages):
            facts.append(picture_facts(pic, usage))
            if level == 88:
                parents.append(last)
                continue
            while stack and (stack[-1][0] >= level or level in (66, 77)):
                stack.pop()
            parents.append(stack[-1][1] if stack else None)
            stack.append((level, o))
            last = o
        total = {o: f["n_bytes"] for o, f in zip(ords, facts)}
        for o, level, redefines, times, parent in reversed(list(zip(ords, levels, over, occurs, parents))):
            total[o] *= times or 1
            if parent is not None and level != 88 and redefines is None:
                total[parent] += total[o]
        return [{"parent": p, **f, "total_bytes": total[o]} for o, p, f in zip(ords, parents, facts)]

    @F.arrow_udf(extra)
    def placed(ords: pa.Array, levels: pa.Array, pics: pa.Array, usages: pa.Array, over: pa.Array, occurs: pa.Array) -> pa.Array:
        files = zip(*[c.to_pylist() for c in (ords, levels, pics, usages, over, occurs)])
        return pa.array([build(*f) for f in files], pa.list_(place))

    others = [c for c in items.columns if c not in ("file_id", "ord")]
    files = items.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", *others))).alias("i"))
    files = files.withColumn("p", placed(*[F.col("i")[c] for c in ("ord", "level", "pic", "usage", "redefines", "occurs")]))
    each = files.select("file_id", F.explode(F.arrays_zip("i", "p")).alias("r"))
    return each.select(*[F.col(c) if c == "file_id" else F.col("r.i")[c].alias(c) for c in items.columns], "r.p.*")


def nesting_depth(upper_lines: Column) -> Column:
    """The deepest nesting over an array of upper-case lines: in each, ends close before starts open, never below 0."""
    opens = lambda s: F.regexp_count(s, F.lit(r"(?<![A-Z0-9-])(?:IF|EVALUATE)(?![A-Z0-9-])"))
    closes = lambda s: F.regexp_count(s, F.lit(r"END-(?:IF|EVALUATE)"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(a: Column, s: Column) -> Column:
        depth = F.greatest(F.lit(0), a["depth"] - closes(s)) + opens(s)
        return F.struct(depth.alias("depth"), F.greatest(a["most"], depth).alias("most"))

    return F.aggregate(upper_lines, start, step)["most"]


def paragraph_facts(source: DataFrame) -> DataFrame:
    """(file_id, name, line_start, line_end, n_lines, complexity 1 to 5, notes) of each paragraph."""
    body = paragraph_lines(source).select("file_id", F.col("paragraph").alias("name"), "line_no", "text")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: F.upper(r["text"]))
    facts = body.groupBy("file_id", "name").agg(rows.alias("ls"))
    text = F.array_join("ls", "\n")
    count = lambda regex: F.regexp_count(text, F.lit(regex))
    c = {k: count(r) for k, r in {"alter": r"\bALTER\b", "goto": r"\bGO\s+TO\b", "until": r"\bPERFORM\s+(?:VARYING|UNTIL)\b", "thru": r"\b(?:THRU|THROUGH)\b", "perform": r"\bPERFORM\b", "evaluate": r"\bEVALUATE\b", "when": r"\bWHEN\b", "if": r"\bIF\b", "math": r"\b(?:COMPUTE|SUBTRACT)\b"}.items()}
    depth = nesting_depth(F.col("ls"))
    level = (
        F.when(c["alter"] > 0, 5).when(c["goto"] > 0, F.when(depth >= 3, 5).otherwise(4)).when(depth >= 5, 5)
        .when((c["until"] >= 2) & (c["thru"] > 0), 4).when((c["until"] > 0) & (c["thru"] > 0) & (c["perform"] > 3), 4)
        .when((c["evaluate"] > 0) & (c["when"] >= 3), 3).when((c["if"] > 0) & (c["evaluate"] > 0), 3).when((depth >= 3) & (c["if"] >= 2), 3)
        .when((c["if"] >= 2) & (depth >= 2) & (c["math"] > 0), 3).when((c["if"] > 0) | (c["evaluate"] > 0), 2).otherwise(1)
    )
    notes = F.filter(
        F.array(F.when(text.rlike(r"^\s*EXIT\s*\.\s*$"), "exit only"), F.when(text.rlike(r"\bGOBACK\b"), "goback"), F.when(text.rlike(r"\bSTOP\s+RUN\b"), "stop run"), F.when(c["goto"] > 0, "go to"), F.when(c["alter"] > 0, "alter"), F.when(c["until"] > 0, "loop")),
        lambda n: n.isNotNull(),
    )
    found = facts.select("file_id", "name", F.size("ls").cast("bigint").alias("n_lines"), level.alias("complexity"), notes.alias("notes"))
    return paragraphs(source).join(found.hint("merge"), ["file_id", "name"], "left").fillna({"n_lines": 0, "complexity": 1})


def program_graph(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (artifact_id, type, name, file_id, line_start) and edges (src, dst, type, file_id, line_no) of programs."""
    program = F.upper(F.regexp_extract("text", rf"(?i)PROGRAM-ID\s*\.\s*({NAME})", 1))
    lines = located(source).drop("last_line")
    named = lines.withColumn("_program", F.when(program != "", F.struct("line_no", program.alias("name"))))
    para_id = lambda p: F.concat(F.lit("paragraph::"), "program", F.lit("."), p)
    heads = F.collect_list(F.when(F.col("line_no") == F.col("para_start"), F.struct("para_start", "paragraph")))
    files = named.groupBy("file_id").agg(F.min("_program").alias("_program"), F.array_sort(heads).alias("heads")).where("_program is not null")
    files = files.select("file_id", F.col("_program.name").alias("program"), F.col("_program.line_no").alias("line_start"), "heads")
    own = F.struct(F.concat(F.lit("program::"), "program").alias("artifact_id"), F.lit("program").alias("type"), F.col("program").alias("name"), "file_id", "line_start")
    held = F.transform("heads", lambda h: F.struct(para_id(h["paragraph"]).alias("artifact_id"), F.lit("paragraph").alias("type"), h["paragraph"].alias("name"), F.col("file_id").alias("file_id"), h["para_start"].alias("line_start")))
    nodes = files.select(F.inline(F.concat(F.array(own), held)))
    first = F.min("_program").over(Window.partitionBy("file_id"))["name"]
    kept = references_in(named.withColumn("program", first).where("program is not null").select("file_id", "line_no", "text", "program", F.col("paragraph").alias("within")))
    src = F.when(F.col("within").isNull(), F.concat(F.lit("program::"), "program")).otherwise(para_id(F.col("within")))
    kinds = {r.category: (r.relationship_type, r.target_type) for r in REFERENCES}
    relation, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (rel, tgt) in kinds.items():
        relation, target = F.when(F.col("category") == k, rel).otherwise(relation), F.when(F.col("category") == k, tgt).otherwise(target)
    dst = F.when(target == "paragraph", para_id(F.col("found"))).otherwise(F.concat(target, F.lit("::"), F.col("found")))
    return nodes, kept.select(src.alias("src"), dst.alias("dst"), relation.alias("type"), "file_id", "line_no")


def dead_paragraphs(source: DataFrame) -> DataFrame:
    from ferrolith.operators.graph import dead_paragraphs as dead

    refs = references(source).where("category in ('perform', 'goto')").select("file_id", F.col("found").alias("name"))
    span = logical(source).select("file_id", F.upper("text").alias("t"))
    regex = rf"\bPERFORM\s+({NAME})\s+(?:THRU|THROUGH)\s+({NAME})"
    thru = span.select("file_id", F.regexp_extract("t", regex, 1).alias("first"), F.regexp_extract("t", regex, 2).alias("last")).where("first <> ''")
    ends = thru.select("file_id", F.col("first").alias("name")).unionByName(thru.select("file_id", F.col("last").alias("name")))
    return dead(paragraphs(source), refs.unionByName(ends), thru)
