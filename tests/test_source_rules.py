from pyspark.sql import functions as F

from ferrolith.operators import lines, resolve
from ferrolith.operators import source_rules as sr

JCL = """\
//PAYJOB   JOB (1),'X'
//S1       EXEC PGM=PAYROLL
//IN       DD DSN=PROD.PAY.DATA,DISP=SHR
//S2       EXEC NIGHTLY,PARM=1
//         INCLUDE MEMBER=COMMON
//OUT      DD SYSOUT=*"""


def test_jcl(spark):
    rows = lines.explode_lines(spark.createDataFrame([("a.jcl", JCL)], "file_id string, content string"))
    assert {r.artifact_id for r in sr.definitions(rows, "jcl").collect()} == {"procedure::PAYJOB", "paragraph::S1", "paragraph::S2"}
    refs = {(r.raw_text, r.relationship_type, r.containing_id) for r in sr.references(rows, "jcl").collect()}
    assert refs == {("PAYROLL", "executes", "paragraph::S1"), ("PROD.PAY.DATA", "references", "paragraph::S1"), ("NIGHTLY", "calls", "paragraph::S2"), ("COMMON", "includes", "paragraph::S2")}
    assert {(r.dd, r.dsn, r.step) for r in sr.jcl_steps(rows).collect()} == {("IN", "PROD.PAY.DATA", "S1"), ("OUT", None, "S2")}
    kept = resolve.without_external(sr.references(rows, "jcl"), ["nightly"])
    assert {r.raw_text for r in kept.collect()} == {"PAYROLL", "COMMON"}


def test_more_jcl(spark):
    text = """//* COMMENT EXEC PGM=NO
//P        PROC A=1
//S1       EXEC PROC=OTHER,COND=(0,NE)
//A        DD DISP=(NEW,CATLG),DSNAME='MY.SET(M1)'  A COMMENT DSN=NO
//B        DD  DSN=&&TEMP,UNIT=SYSDA
  run program (PAY01) plan(X)
//         DD SYSOUT=*"""
    rows = lines.explode_lines(spark.createDataFrame([("a.jcl", text), ("empty", ""), ("none", None)], "file_id string, content string"))
    assert {r.artifact_id for r in sr.definitions(rows, "jcl").collect()} == {"procedure::P", "paragraph::S1"}
    assert {(r.raw_text, r.relationship_type) for r in sr.references(rows, "jcl").collect()} == {("OTHER", "calls"), ("MY.SET", "references"), ("&&TEMP", "references"), ("PAY01", "executes")}


def found(spark, text, kind):
    rows = lines.explode_lines(spark.createDataFrame([("f", text)], "file_id string, content string"))
    return {r.artifact_id for r in sr.definitions(rows, kind).collect()}, {(r.raw_text, r.relationship_type) for r in sr.references(rows, kind).collect()}


def test_ddl(spark):
    ddl = "CREATE TABLE HR.EMP (\n  ID INTEGER,\n  DEPT CHAR(3) REFERENCES HR.DEPT\n);\nCREATE VIEW V AS SELECT ID FROM HR.EMP;"
    assert found(spark, ddl, "db2_ddl") == ({"table::EMP", "column::ID", "column::DEPT", "view::V"}, {("DEPT", "references"), ("EMP", "reads")})
    ddl = 'create unique index s."My Ix" on T\nCREATE OR REPLACE VIEW "S"."V 1" AS SELECT A FROM (SELECT 1) X JOIN S.T2 ON 1=1\n  "Col" XML,\n  N NUMERIC(3)\n-- CREATE A VIEW\nCREATE GLOBAL TEMPORARY TABLE TT'
    assert found(spark, ddl, "db2_ddl") == ({"index::MY IX", "view::V 1", "column::COL", "column::N", "table::TT"}, {("T2", "reads")})


def test_bms_and_python(spark):
    assert found(spark, "SET1     DFHMSD TYPE=MAP\nMAP1     DFHMDI SIZE=(24,80)\nF1       DFHMDF POS=(1,1)\n         DFHMDF POS=(2,1)\n* DFHMDF", "bms") == ({"screen::SET1", "map::MAP1", "field::F1"}, set())
    code = "import os, numpy as np\nfrom a.b import c\nclass A(B):\n    async def run(self):\n        pass\ndef f(x): return x"
    assert found(spark, code, "python") == ({"class::A", "function::RUN", "function::F"}, {("os", "imports"), ("numpy", "imports"), ("a.b", "imports")})


def test_cards(spark):
    cards = spark.createDataFrame([("\n DELETE A.B\n\n SET MAXCC=0",), ("  sort fields=copy",), ("x",)], "content string")
    got = [(r.u, r.p) for r in cards.select(sr.utility(F.col("content")).alias("u"), sr.card_preview(F.col("content")).alias("p")).collect()]
    assert got == [("IDCAMS DELETE", "DELETE A.B SET MAXCC=0"), ("DFSORT", "sort fields=copy"), ("UNKNOWN", "x")]
