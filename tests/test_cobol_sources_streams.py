import json

import pytest
from pyspark.sql import functions as F

from ferrolith.operators import cobol, lines
from ferrolith.sources import files
from ferrolith.streaming import ticket_stream

PROGRAM = """\
000010 IDENTIFICATION DIVISION.
000020 PROGRAM-ID. PAYROLL.
000030 DATA DIVISION.
000040 WORKING-STORAGE SECTION.
000050 01  WS-REC.
000060     05  WS-NAME      PIC X(10).
000070     05  WS-PAY       PIC S9(5)V99 COMP-3 OCCURS 3.
000080         88  NO-PAY   VALUE 0.
000090     05  WS-ALT REDEFINES WS-NAME.
000100         10  WS-A     PIC 9(4) COMP.
000110 77  WS-END           PIC X VALUE 'N'.
000120     COPY CUSTREC.
000130 PROCEDURE DIVISION.
000140 MAIN-PARA.
000150     PERFORM READ-PARA THRU READ-EXIT.
000160     IF WS-END = 'Y'
000170         EVALUATE WS-NAME
000180           WHEN 'A' PERFORM CALC-PARA
000190         END-EVALUATE
000200     END-IF.
000210     STOP RUN.
000220*    PERFORM UNUSED-PARA.
000230 READ-PARA.
000240     EXEC SQL
000250       SELECT PAY INTO :WS-PAY FROM EMP WHERE NAME = :WS-NAME
000260     END-EXEC.
000270 READ-EXIT.
000280     EXIT.
000290 CALC-PARA.
000300     CALL 'TAXCALC' USING WS-REC.
000310     CALL WS-NAME.
000320 UNUSED-PARA.
000330     GO TO MAIN-PARA.
"""


@pytest.fixture(scope="module")
def source(spark):
    return lines.explode_lines(spark.createDataFrame([("PAYROLL.cbl", PROGRAM)], "file_id string, content string")).cache()


def test_structure(source):
    assert [(r.name, r.line_start, r.line_end) for r in cobol.paragraphs(source).orderBy("line_start").collect()] == [("MAIN-PARA", 14, 22), ("READ-PARA", 23, 26), ("READ-EXIT", 27, 28), ("CALC-PARA", 29, 31), ("UNUSED-PARA", 32, 33)]
    assert [(r.name, r.line_start) for r in cobol.divisions(source).orderBy("line_start").collect()] == [("IDENTIFICATION", 1), ("DATA", 3), ("PROCEDURE", 13)]
    refs = {(r.category, r.name, r.found) for r in cobol.references(source).collect()}
    assert refs == {("perform", "thru", "READ-PARA"), ("perform", "simple", "CALC-PARA"), ("copy", "copy", "CUSTREC"), ("call", "static", "TAXCALC"), ("call", "dynamic", "WS-NAME"), ("goto", "go_to", "MAIN-PARA")}
    (block,) = cobol.exec_blocks(source).collect()
    assert (block.kind, block.subtype, block.line_start, block.line_end, block.outputs, block.inputs) == ("SQL", "SELECT", 24, 26, ["WS-PAY"], ["WS-NAME"])
    assert {r.name for r in cobol.dead_paragraphs(source).collect()} == {"UNUSED-PARA"}
    facts = {r.name: (r.complexity, r.notes) for r in cobol.paragraph_facts(source).collect()}
    assert facts["MAIN-PARA"] == (3, ["stop run"]) and facts["READ-EXIT"] == (1, ["exit only"]) and facts["UNUSED-PARA"] == (4, ["go to"])


def test_data_items(source):
    rows = {r.name: r for r in cobol.item_tree(cobol.data_items(source)).collect()}
    assert (rows["WS-PAY"].usage, rows["WS-PAY"].occurs, rows["WS-PAY"].n_bytes, rows["WS-PAY"].total_bytes, rows["WS-PAY"].scale) == ("COMP-3", 3, 4, 12, 2)
    assert rows["WS-REC"].total_bytes == 22 and rows["WS-ALT"].redefines == "WS-NAME" and rows["WS-ALT"].total_bytes == 2
    assert rows["NO-PAY"].parent == rows["WS-PAY"].ord and rows["WS-A"].parent == rows["WS-ALT"].ord and rows["WS-END"].parent is None and rows["WS-END"].value == "'N'"


def test_graph(source):
    nodes, edges = cobol.program_graph(source)
    assert nodes.count() == 6
    assert {(r.src, r.dst, r.type) for r in edges.collect()} >= {
        ("paragraph::PAYROLL.MAIN-PARA", "paragraph::PAYROLL.READ-PARA", "performs"), ("paragraph::PAYROLL.CALC-PARA", "program::TAXCALC", "calls"), ("program::PAYROLL", "copybook::CUSTREC", "includes"),
    }


def test_copies(spark):
    main = "       01  A.\n       COPY ONE REPLACING ==:P:== BY ==XX==.\n       COPY NONE.\n      *COPY ONE."
    books = [("ONE", 1, "       05  :P:-NAME PIC X."), ("ONE", 2, "       COPY TWO."), ("TWO", 1, "       05  T PIC 9."), ("TWO", 2, "       COPY ONE.")]
    source = lines.explode_lines(spark.createDataFrame([("F", main)], "file_id string, content string"))
    out = cobol.numbered(cobol.expand_copies(source, spark.createDataFrame(books, "name string, line_no bigint, text string"))).orderBy("line_no").collect()
    assert [r.text.strip() for r in out] == ["01  A.", "05  XX-NAME PIC X.", "05  T PIC 9.", "* COPY ONE is in itself", "* COPY NONE not found", "*COPY ONE."]


@pytest.mark.parametrize("pic, usage, want", [("X(3)", None, ("alphanumeric", 3)), ("S9(4)", "COMP", ("numeric", 2)), ("9(10)", "COMP", ("numeric", 8)), ("S9(7)V99", "COMP-3", ("numeric", 5)), ("ZZ9.99", None, ("edited", 6)), (None, "COMP-2", (None, 8))])
def test_pictures(pic, usage, want):
    facts = cobol.picture_facts(pic, usage)
    assert (facts["category"], facts["n_bytes"]) == want


def test_scan(spark, tmp_path):
    for name, body in {"src/A.cbl": PROGRAM.encode(), "cpy/custrec.CPY": b"       01 C.", "alt/CUSTREC": b"x", "x.bin": "é".encode("latin-1"), ".git/h.cbl": b"", "old/B.cbl": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = files.scan(spark, str(tmp_path), ["old/*"])
    assert {r.file_id: (r.source_type, r.content[:1]) for r in rows.collect()} == {"src/A.cbl": ("cobol", "0"), "cpy/custrec.CPY": ("copybook", " "), "alt/CUSTREC": (None, "x"), "x.bin": (None, "é")}
    counts = {r.source_type: r.n_files for r in files.inventory(rows).collect()}
    assert counts["cobol"] == 1 and counts["jcl"] == 0
    assert {r.name: r.file_id for r in files.includes(rows, ["cpy"]).collect()}["CUSTREC"] == "cpy/custrec.CPY"
    types = rows.select(files.guess_type(F.col("content")).alias("t"), files.source_type(F.lit("a/MYSORT1.cbl"), True).alias("g"))
    assert {r.t for r in types.collect()} == {"cobol", "other"} and types.first().g == "datacard"


def test_ticket_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "created", None), (1, "2024-01-01 00:01:00", 2, "claimed", "a"), (1, "2024-01-01 00:02:00", 3, "claimed", "b"), (2, "2024-01-01 00:00:00", 4, "completed", "c")]
    spark.createDataFrame(rows, "ticket_id bigint, ts string, seq bigint, state string, worker string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = ticket_stream.ticket_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {(r.ticket_id, r.state, r.worker, r.n_events) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "claimed", "a", 3), (2, "completed", "c", 1)}


def test_query_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"schema_version": "1.0", "query_id": "q1", "query_type": "FIELD_SOURCE", "target": "WS-PAY"}
    (tmp_path / "in/a.json").write_text(json.dumps(good, indent=1))  # a file of several lines is one query
    (tmp_path / "in/b.json").write_text(json.dumps(good | {"query_type": "OTHER"}))
    (tmp_path / "in/c.json").write_text("{not json")
    run = lambda: ticket_stream.answer_queries(ticket_stream.query_files(spark, f"{tmp_path}/in"), ticket_stream.pending, f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    run()
    run()  # nothing is answered twice
    assert [(r.query_id, r.status) for r in spark.read.json(f"{tmp_path}/ok").collect()] == [("q1", "PENDING")]
    assert {(r.file, r.problem) for r in spark.read.json(f"{tmp_path}/bad").collect()} == {("b.json", "query_type"), ("c.json", "not JSON")}
