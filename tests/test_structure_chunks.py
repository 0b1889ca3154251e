import random
import re

import pytest
from pyspark.sql import functions as F

from ferrolith.operators import lines as ln
from ferrolith.operators import structure_chunks as sc

LEVELS = ["division", "section", "unit"]


def plain_chunks(texts, heads, most, summary):
    """Chunks of one file, as (level, first, last), by recursion; heads: the level that begins at a line, or None."""
    room = most - (len(summary) if summary is not None else -1)
    cost = lambda a, b: sum(len(t) + 1 for t in texts[a:b])
    out = []

    def split(a, b, depth):
        """Parts of lines a to b at the heads of levels up to depth, packed."""
        if depth == len(LEVELS):
            used = n = 0
            for i in range(a, b):
                if n and n < sc.LINES_A_RUN and used + cost(i, i + 1) <= room:
                    out[-1] = ("line", out[-1][1], i + 1)
                else:
                    used = n = 0
                    out.append(("line", i + 1, i + 1))
                used, n = used + cost(i, i + 1), n + 1
            return
        marks = [i for i in range(a + 1, b) if heads[i] in LEVELS[: depth + 1]]
        used = None
        for x, y in zip([a] + marks, marks + [b]):
            if cost(x, y) > room:
                split(x, y, depth + 1)
                used = None
            elif used is not None and LEVELS[depth] != "section" and used + cost(x, y) <= room:
                out[-1] = (LEVELS[depth], out[-1][1], y)
                used += cost(x, y)
            else:
                out.append((LEVELS[depth], x + 1, y))
                used = cost(x, y)

    if cost(0, len(texts)) - 1 <= most:
        return [("file", 1, len(texts))]
    split(0, len(texts), 0)
    return out


@pytest.mark.parametrize("budget", [8, 40, 150])
def test_chunks_equal_recursion(spark, budget):
    draw = random.Random(budget)
    files, marked = {}, []
    for f in range(60):
        n, long = draw.choice([1, 2, 30, 130]), draw.choice([3, 30, 90])
        heads = [draw.choices([None, *LEVELS], [20, 1, 2, 4])[0] for _ in range(n)]
        texts = ["x" * draw.randint(0, long) for _ in range(n)]
        summary = draw.choice([None, "sum", "s" * 25])
        files[f] = (texts, heads, summary)
        marked += [(f, i + 1, t, h) for i, (t, h) in enumerate(zip(texts, heads))]
    draw.shuffle(marked)
    lines = spark.createDataFrame(marked, "file_id int, line_no int, text string, head string")
    summaries = spark.createDataFrame([(f, s) for f, (_, _, s) in files.items()], "file_id int, summary string")
    found = sc.structure_chunks(lines, [(level, F.col("head") == level) for level in LEVELS], budget, summaries).collect()
    most = sc.most_characters(budget)
    for f, (texts, heads, summary) in files.items():
        mine = sorted((r for r in found if r.file_id == f), key=lambda r: r.seq)
        assert [(r.level, r.first_line, r.last_line) for r in mine] == plain_chunks(texts, heads, most, summary)
        assert [r.seq for r in mine] == list(range(len(mine)))
        for r in mine:
            body = "\n".join(texts[r.first_line - 1 : r.last_line])
            assert r.chunk == (f"{summary}\n{body}" if r.seq and summary is not None else body)
            assert r.tokens == len(r.chunk) // 4
            assert r.tokens <= budget or r.first_line == r.last_line


PROGRAM = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAY01.
       DATA DIVISION.
       FILE SECTION.
       FD  INFILE.
       WORKING-STORAGE SECTION.
       01  REC-A.
           05  F1 PIC X.
       77  N PIC 9.
       PROCEDURE DIVISION.
       MAIN-PART SECTION.
       P1.
           MOVE 01 TO N.
      *P2 SECTION.
       P3.  DISPLAY 'X DIVISION'.
           GOBACK."""


def test_cobol_heads_and_summary(spark):
    source = ln.explode_lines(spark.createDataFrame([("a", PROGRAM), ("b", "       P1.\n           STOP RUN."), ("c", None), ("d", "")], "file_id string, content string"))
    headed = sc.cobol_heads(ln.fixed_format(source))
    found = [(r.line_no, r["head"], r.name) for r in headed.where("file_id = 'a' and head is not null").orderBy("line_no").collect()]
    assert found == [
        (1, "division", "IDENTIFICATION"), (2, "unit", "PROGRAM-ID"), (3, "division", "DATA"), (4, "section", "FILE"), (5, "unit", "INFILE"), (6, "section", "WORKING-STORAGE"),
        (7, "unit", "REC-A"), (9, "unit", "N"), (10, "division", "PROCEDURE"), (11, "section", "MAIN-PART"), (12, "unit", "P1"), (15, "unit", "P3"),
    ]
    summaries = {r.file_id: r.summary for r in sc.cobol_summaries(ln.fixed_format(source)).collect()}
    assert summaries["a"] == "      * Part of program PAY01\n      * DATA DIVISION: lines 3 to 9"
    assert summaries["b"] == "      * Part of program without a name"
    chunks = sc.cobol_chunks(source, 45).orderBy("file_id", "seq").collect()
    mine = [r for r in chunks if r.file_id == "a"]
    assert "\n".join(re.sub(r"(?s)^      \* Part.*?to 9\n", "", r.chunk) for r in mine) == PROGRAM
    assert all(r.tokens <= 45 for r in mine) and len(mine) > 2
    assert [r.names for r in chunks if r.file_id == "b"] == [["P1"]]


def test_empty_tables_nulls_and_extra_columns(spark):
    none = spark.createDataFrame([], "file_id string, line_no int, text string")
    assert sc.cobol_chunks(none, 10).count() == 0
    rows = spark.createDataFrame([("a", 1, None, "k"), ("a", 2, "y" * 500, None), ("a", 3, "z", "k")], "file_id string, line_no int, text string, level string")
    found = sc.structure_chunks(rows, [("unit", F.lit(None).cast("boolean"))], 10).orderBy("seq").collect()
    assert [(r.level, r.first_line, r.last_line, r.tokens) for r in found] == [("line", 1, 1, 0), ("line", 2, 2, 125), ("line", 3, 3, 0)]


def test_cobol_is_read_alike_in_batches_and_in_columns(spark, monkeypatch):
    """Chunks read in batches of a few files are those by the columns of cobol_heads() and cobol_summaries()."""
    monkeypatch.setattr(ln, "BATCH_LINES", 40)
    draw = random.Random(5)
    odd = [
        *PROGRAM.split("\n"), None, "", "       DATA DIVISION X", "       DATA DIVISIONS.", "       data division.", "      -DATA DIVISION.", "      / X SECTION.", "       X\tSECTION.", "       PROCEDURE DIVISION\u00e9.", "       PROCEDURE DIVISION_.", "       -A.", "       A",
        "       A .", "       A-1.B.", "       FD F-1", "       SD  9", "       0177 A.", "         01 \u00e9.", "         77  Z9 PIC X.", "       program-id . 'ab$1'.", "         PROGRAM-ID.", "       Environment  Division.", "       \u00e9 SECTION.", "\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9 PX.", "*      P9.",
        "       P-1. 123456789 123456789 123456789 123456789 123456789 123456789 tail beyond column 72", " " * 71 + "X.", "       SECTION.", "       A SECTION SECTION.", "       01 01 A.", "       \x0bDATA DIVISION.", "      D01  DEBUG.", "       DIVISION DIVISION.",
    ]
    rows = [(f"f{f}" if f else None, k * 3, draw.choice(odd)) for f in range(50) for k in range(draw.choice([1, 4, 15, 60]))] + [("f1", None, "       P0.")]
    draw.shuffle(rows)
    source = spark.createDataFrame(rows, "file_id string, line_no int, text string").repartition(3)
    code = ln.fixed_format(source.where("line_no is not null").withColumn("text", F.coalesce("text", F.lit(""))))
    heads = [(level, F.col("head") == level) for level in LEVELS]
    for budget in (30, 60):
        wanted = sc.structure_chunks(sc.cobol_heads(code), heads, budget, sc.cobol_summaries(code), chars_a_token=sc.COBOL_CHARS, name=F.col("name")).where("file_id is not null")
        found = sc.cobol_chunks(source, budget)
        assert sorted(map(str, found.where("file_id is not null").collect())) == sorted(map(str, wanted.collect()))
        assert found.where("file_id is null and seq = 0").count() == 1


def test_chunks_of_lines_that_come_in_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(f, k, "y" * (k % 5)) for f, n in enumerate((1, 100, 3, 7, 14, 40)) for k in range(n)]
        found = sc.structure_chunks(spark.createDataFrame(rows, "file_id int, line_no int, text string"), [("unit", F.col("line_no") % 9 == 0)], 6).collect()
        assert sum(r.last_line - r.first_line + 1 for r in found) == len(rows) and all(r.tokens <= 6 for r in found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
