"""Chunks of files along their structure: whole files that fit a budget, else their divisions, sections and paragraphs, and
runs of lines where nothing smaller is headed.

Lines are shuffled once, by file, and go sorted to Python in Arrow batches of whole files. There the pieces between head lines,
the sizes of all levels and the chunks are computed for all files of a batch at once, on the texts' buffers. What a task
holds is some lines (lines.whole_files), or a file that has more of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolith.operators import lines as ln

LINES_A_RUN = 50
COBOL_CHARS = 3.5

CHUNK_COLUMNS = {"seq": "bigint", "level": "string", "first_line": "bigint", "last_line": "bigint", "names": "array<string>", "tokens": "bigint", "chunk": "string"}

AREA_A_NAME = r"^([A-Za-z0-9][A-Za-z0-9-]*)"
#: What begins a line of code that may be a head or name the program, tried before the expressions below: a name in area A,
#: a record's level, words that may stand behind blanks. Letters beyond ASCII may fold to others.
MAY_HEAD = r"(?i)^(?:[A-Z0-9]|[ \t\n\x0B\f\r]*(?:01|77|[A-Z]+[ \t\n\x0B\f\r]+DIVISION|PROGRAM-ID))|[^\x00-\x7F]"
DIVISION = re.compile(r"\s*([A-Z]+)\s+DIVISION", re.I | re.A)
SECTION = re.compile(r"([A-Z0-9][A-Z0-9-]*)\s+SECTION", re.I | re.A)
PARAGRAPH = re.compile(r"([A-Z0-9][A-Z0-9-]*)\s*\.", re.I | re.A)
RECORD = re.compile(r"(?:\s*(?:01|77)|FD|SD)\s+([A-Z0-9][A-Z0-9-]*)", re.I | re.A)
PROGRAM = re.compile(r"\s*PROGRAM-ID\s*\.\s*['\"]?([A-Z0-9$#@-]+)", re.A)


def most_characters(budget_tokens: int, chars_a_token: float = 4) -> int:
    """The longest text whose estimate, characters over chars_a_token rounded down, is within the budget."""
    return math.ceil((budget_tokens + 1) * chars_a_token) - 1


def chunked(
    new: np.ndarray, text: pa.Array, depth: np.ndarray, levels: int, most: int, summary: pa.Array, alone: list[int],
) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The chunks of some files: the first line of each, its number in its file, its level (0: the file, levels + 1: lines) and
    its text. new: whether a file begins with a line. depth: the level, from 1, that begins with a line, else 0; a head also
    ends all units of the levels below its own. summary: of each file, or null. alone: levels whose units stay alone.

    Pieces lie between head lines. The largest unit that fits and holds a piece says its level; pieces of one unit stay together,
    neighbouring units of one level within one unit above go together while they fit, and lines, each a unit, make runs of at
    most LINES_A_RUN. A line over the room is a chunk alone."""
    n, file = len(new), np.cumsum(new) - 1
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 1, out=upto[1:])
    room = most - pc.fill_null(pc.utf8_length(summary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.flatnonzero(new | (depth > 0))
    begins, own = new[piece], depth[piece]
    cost = np.diff(upto[np.append(piece, n)])
    opens = [begins | ((own > 0) & (own <= k)) for k in range(levels + 1)]  # a unit of level k
    unit = [np.cumsum(o) - 1 for o in opens]
    level = np.full(len(piece), levels + 1)
    for k in range(levels, -1, -1):
        size = np.add.reduceat(cost, np.flatnonzero(opens[k]))[unit[k]] if len(piece) else cost
        level[size <= (room[file[piece]] if k else most + 1)] = k
    above, inside = (np.choose(np.clip(level + by, 0, levels), unit) for by in (-1, 0))
    other = begins | (np.diff(level, prepend=-1) != 0)
    run = other | (np.diff(above, prepend=-1) != 0)
    fresh = other | (np.diff(inside, prepend=-1) != 0)

    marked, runs = np.zeros(n, bool), np.zeros(n, bool)
    marked[piece[fresh]], runs[piece[run]] = True, True
    of_line = np.repeat(level, np.diff(np.append(piece, n)))
    units = np.flatnonzero(marked | (of_line == levels + 1))
    level, here = of_line[units], np.arange(len(units))
    before = upto[np.append(units, n)]
    after = np.maximum(np.searchsorted(before, before[:-1] + room[file[units]], side="right") - 1, here + 1)
    after = np.where(np.isin(level, alone), here + 1, np.where(level == levels + 1, np.minimum(after, here + LINES_A_RUN), after))
    lead = np.flatnonzero(runs[units])
    after = np.minimum(after, np.append(lead[1:], len(units))[np.cumsum(runs[units]) - 1]).tolist()
    taken, at = [], 0
    while at < len(after):
        taken.append(at)
        at = after[at]
    first, level = units[taken], level[taken]
    owner = file[first]
    seq = np.arange(len(first)) - np.searchsorted(owner, owner)
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), text), "\n")
    said = summary.take(pa.array(owner))
    return first, seq, level, pc.if_else(pc.and_(pa.array(seq > 0), said.is_valid()), pc.binary_join_element_wise(said, body, "\n", null_handling="replace"), body)


def _chunks_of(rows: DataFrame, key: str, order: list[str], levels: list[str], most: int, alone: tuple[str, ...], chars_a_token: float, read: Callable) -> DataFrame:
    """The chunks of rows (key, line_no, text and what read needs), sorted by order in each file. read: gives of a batch of whole
    files (new) the rows that are lines, their depths, the names of the heads among them, and the summary of each file."""
    schema = T.StructType([rows.schema[key], *[T.StructField(c, T._parse_datatype_string(t)) for c, t in CHUNK_COLUMNS.items()]])
    named = pa.array(["file", *levels, "line"])

    def run(batches):
        for batch in ln.whole_files(batches):
            new = batch.column("_n").to_numpy() == 1
            lines, depth, names, summary = read(batch, new)
            if lines is not None:  # rows that aren't lines come first in their file
                file = np.cumsum(new)[lines]
                batch, new = batch.take(pa.array(lines)), np.diff(file, prepend=0) > 0
                summary = summary.take(pa.array(file[new] - 1))
            if not len(new):
                continue
            first, seq, level, text = chunked(new, batch.column("text"), depth, len(levels), most, summary, [k for k, x in enumerate(levels, 1) if x in alone])
            last = np.append(first[1:], len(new)) - 1
            held = np.searchsorted(np.flatnonzero(depth), np.append(first, len(new)))
            known = np.concatenate([[0], np.cumsum(names.is_valid().to_numpy(zero_copy_only=False))])
            tokens = np.floor(pc.utf8_length(text).to_numpy(zero_copy_only=False) / chars_a_token).astype(np.int64)
            line_no = batch.column("line_no")
            columns = [batch.column(key).take(pa.array(first)), pa.array(seq), named.take(pa.array(level)), line_no.take(pa.array(first)), line_no.take(pa.array(last)),
                       pa.ListArray.from_arrays(pa.array(known[held], pa.int32()), names.drop_null()), pa.array(tokens), text]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ln.filed(rows, key, order).mapInArrow(run, schema)


def structure_chunks(
    lines: DataFrame, heads: list[tuple[str, Column]], budget_tokens: int, summaries: DataFrame | None = None, alone: tuple[str, ...] = ("section",),
    chars_a_token: float = 4, name: Column | None = None, key: str = "file_id", text: str = "text",
) -> DataFrame:
    """(key, seq, level, first_line, last_line, names, tokens, chunk): every line of a file (key, line_no, text) is in just one
    chunk, in order.

    heads, outermost first, says which lines begin a unit of a level. names are those of the head lines in a chunk (name,
    else the trimmed text). The chunks of a file behind its first one begin with its summary (summaries: key, summary), whose
    length the budget counts. A chunk is over the budget only if a single line with the summary is. Files without lines
    have no chunks; a null text is an empty line; line numbers must differ in a file."""
    depth = F.coalesce(*[F.when(head, k) for k, (_, head) in enumerate(heads, 1)], F.lit(0))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = lines.select(F.col(key), F.col("line_no").cast("bigint").alias("line_no"), body.alias("text"), depth.alias("depth"), F.when(depth > 0, name if name is not None else F.trim(body)).alias("name"), F.lit(True).alias("is_line"))
    if summaries is not None:
        rows = rows.unionByName(summaries.where("summary is not null").select(key, F.col("summary").alias("text"), F.lit(0).alias("depth"), F.lit(False).alias("is_line")), allowMissingColumns=True)

    def read(batch: pa.RecordBatch, new: np.ndarray):
        is_line, depth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("is_line", "depth"))
        at = np.flatnonzero(is_line)
        first = pa.array(np.flatnonzero(new))
        summary = pc.if_else(batch.column("is_line").take(first), pa.scalar(None, pa.string()), batch.column("text").take(first))
        return at, depth[at], batch.column("name").take(pa.array(np.flatnonzero(depth))), summary

    return _chunks_of(rows, key, ["is_line", "line_no"], [level for level, _ in heads], most_characters(budget_tokens, chars_a_token), alone, chars_a_token, read)


def cobol_heads(code: DataFrame) -> DataFrame:
    """Lines of fixed_format() with head (division, section, unit or null) and name. Units are paragraphs, and outside the
    procedure division also file descriptions and records of level 01 or 77."""
    is_code = ~F.col("is_comment") & ~F.col("is_continuation") & ~F.col("is_blank")
    division = F.upper(F.regexp_extract("code", r"(?i)^\s*([A-Z]+)\s+DIVISION\b", 1))
    section = F.upper(F.regexp_extract("code", rf"(?i){AREA_A_NAME}\s+SECTION\b", 1))
    paragraph = F.upper(F.regexp_extract("code", rf"{AREA_A_NAME}\s*\.", 1))
    record = F.upper(F.regexp_extract("code", r"(?i)^(?:\s*(?:01|77)|FD|SD)\s+([A-Z0-9][A-Z0-9-]*)", 1))
    head = F.when(division != "", "division").when(section != "", "section").when((paragraph != "") | (record != ""), "unit")
    found = code.withColumn("_head", F.when(is_code, head)).withColumn("_in", F.when(is_code & (division != ""), division))
    upto = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.last("_in", True).over(upto), F.lit(""))
    is_unit = (paragraph != "") | (inside != "PROCEDURE")
    head = F.when((F.col("_head") != "unit") | is_unit, F.col("_head"))
    name = F.when(division != "", division).when(section != "", section).when(paragraph != "", paragraph).otherwise(record)
    return found.withColumns({"head": head, "name": F.when(head.isNotNull(), name)}).drop("_head", "_in")


def cobol_summaries(code: DataFrame) -> DataFrame:
    """(file_id, summary): comment lines that name a program and the lines of its data division, from lines of
    fixed_format()."""
    is_code = ~F.col("is_comment") & ~F.col("is_continuation") & ~F.col("is_blank")
    program = F.regexp_extract(F.upper("code"), r"^\s*PROGRAM-ID\s*\.\s*['\"]?([A-Z0-9$#@-]+)", 1)
    division = F.when(is_code, F.upper(F.regexp_extract("code", r"(?i)^\s*([A-Z]+)\s+DIVISION\b", 1)))
    at = F.col("line_no").cast("bigint")
    facts = code.select("file_id", at.alias("at"), F.when(is_code & (program != ""), program).alias("program"), division.alias("division")).groupBy("file_id").agg(
        F.min_by("program", F.when(F.col("program").isNotNull(), F.col("at"))).alias("program"), F.min(F.when(F.col("division") == "DATA", F.col("at"))).alias("begin"),
        F.collect_list(F.when(F.col("division") != "", F.col("at"))).alias("divisions"), F.max("at").alias("last"),
    )
    end = F.coalesce(F.array_min(F.filter("divisions", lambda x: x > F.col("begin"))) - 1, "last")
    data = F.concat(F.lit("\n      * DATA DIVISION: lines "), F.col("begin").cast("string"), F.lit(" to "), end.cast("string"))
    return facts.select("file_id", F.concat(F.lit("      * Part of program "), F.coalesce("program", F.lit("without a name")), F.coalesce(data, F.lit(""))).alias("summary"))


def _ends_word(text: str, at: int) -> bool:
    return at == len(text) or not (text[at] == "_" or text[at].isalnum())


def cobol_head(code: str) -> tuple[int, str, str]:
    """What a line of code may begin, from column 8 on: 1 a division, 2 a section, 3 a paragraph, 4 a record, which is a unit
    outside the procedure division only, else 0; its name; the program that it names."""
    program = PROGRAM.match(code.upper())
    for kind, regex, is_word in ((1, DIVISION, True), (2, SECTION, True), (3, PARAGRAPH, False), (4, RECORD, False)):
        found = regex.match(code)
        if found and (not is_word or _ends_word(code, found.end())):
            return kind, found[1].upper(), program[1] if program else ""
    return 0, "", program[1] if program else ""


def cobol_read(batch: pa.RecordBatch, new: np.ndarray) -> tuple[None, np.ndarray, pa.Array, pa.Array]:
    """What cobol_heads() and cobol_summaries() say of whole files, for chunks: depths, the heads' names, and a summary for each
    file. Equal lines are read once a batch."""
    text, line_no = batch.column("text"), batch.column("line_no").to_numpy()
    mark, code = ln.fixed_code(text)
    other = pc.is_in(mark, pa.array(["*", "/", "-"], text.type))
    may = pc.and_not(pc.match_substring_regex(code, MAY_HEAD), other)
    at = np.flatnonzero(may.to_numpy(zero_copy_only=False))
    words = code.take(pa.array(at)).dictionary_encode()
    heads = [cobol_head(x) for x in words.dictionary.to_pylist()]
    which = words.indices.to_numpy()
    kind = np.array([k for k, _, _ in heads], np.int64)[which]
    file = (np.cumsum(new) - 1)[at]
    # a record is a unit if the last division head of its file isn't that of the procedures
    here = np.arange(len(at))
    last = np.maximum.accumulate(np.where(kind == 1, here, -1)) if len(at) else here
    procedures = np.array([name == "PROCEDURE" for _, name, _ in heads], bool)[which]
    inside = (last >= 0) & (file[last] == file) & procedures[last]
    depth = np.where(kind == 4, np.where(inside, 0, 3), kind)
    depths = np.zeros(len(new), np.int8)
    depths[at] = depth
    names = pa.array([name for _, name, _ in heads], pa.string()).take(pa.array(which[depth > 0]))

    # files as rows: the first program named, the first data division and the line before the next division's head
    ends = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    program, begin, end = {}, {}, {}
    named = np.array([p != "" for _, _, p in heads], bool)[which]
    for f, w, k, line in zip(*(x[named | (kind == 1)].tolist() for x in (file, which, kind, line_no[at]))):
        _, name, said = heads[w]
        if said:
            program.setdefault(f, said)
        if k == 1:
            if f in begin:
                end.setdefault(f, line - 1)
            elif name == "DATA":
                begin[f] = line
    summary = [
        f"      * Part of program {program.get(f, 'without a name')}" + (f"\n      * DATA DIVISION: lines {begin[f]} to {end.get(f, line)}" if f in begin else "")
        for f, line in enumerate(line_no[ends].tolist())
    ]
    return None, depths, names, pa.array(summary, pa.string())


def cobol_chunks(source: DataFrame, budget_tokens: int) -> DataFrame:
    """structure_chunks() of fixed-format COBOL (file_id, line_no, text) by divisions, sections and paragraphs or records;
    sections stay alone, other neighbours are packed."""
    rows = source.where("line_no is not null").select("file_id", F.col("line_no").cast("bigint").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"))
    return _chunks_of(rows, "file_id", ["line_no"], ["division", "section", "unit"], most_characters(budget_tokens, COBOL_CHARS), ("section",), COBOL_CHARS, cobol_read)
