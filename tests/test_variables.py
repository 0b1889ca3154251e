import pytest
from pyspark.sql import functions as F

from ferrolith.operators import lines, variables

CASES = {
    "MOVE A OF B TO C, D IN E OF F": [("A", ["B"], "r"), ("C", [], "w"), ("D", ["E", "F"], "w")],
    "compute x = y * (z - 1)": [("X", [], "w"), ("Y", [], "r"), ("Z", [], "r"), ("1", [], "r")],
    "ADD A TO B": [("A", [], "r"), ("B", [], "w")],
    "ADD A TO B GIVING C": [("A", [], "r"), ("B", [], "r"), ("C", [], "w")],
    "SUBTRACT A FROM B": [("A", [], "r"), ("B", [], "rw")],
    "DIVIDE A INTO B GIVING C REMAINDER D": [("A", [], "r"), ("B", [], "r"), ("C", [], "w"), ("D", [], "w")],
    "SET IS-ON TO TRUE": [("IS-ON", [], "w"), ("TRUE", [], "r")],
    "ACCEPT A FROM DATE": [("A", [], "w")],
    "PERFORM P UNTIL A > 'X TO Y'": [("A", [], "r")],
    "DISPLAY 'MOVE A TO B' C": [("C", [], "r")],
    "GO TO P": [],
    "MOVE": [],
}


@pytest.mark.parametrize("text", CASES)
def test_operands(spark, text):
    (row,) = spark.createDataFrame([(text,)], "t string").select(variables.operands(F.col("t")).alias("o")).collect()
    assert [(o["name"], o["of"], o["role"]) for o in row.o] == CASES[text]


PROGRAM = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. P.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 REC-A.
          05 AMT PIC 9(5).
          05 FLAG PIC X.
             88 IS-ON VALUE 'Y'.
       01 REC-B.
          05 GRP.
             10 AMT PIC 9(5).
          05 ALT REDEFINES GRP PIC X(5).
       01 HV PIC X.
       PROCEDURE DIVISION.
       ONE.
           MOVE AMT OF REC-B TO AMT.
           IF IS-ON
              SET IS-ON TO TRUE
           END-IF.
       TWO.
           SUBTRACT 1 FROM AMT IN GRP OF REC-B.
           MOVE SPACES TO ALT.
           EXEC SQL SELECT X INTO :HV FROM T WHERE K = :AMT END-EXEC.
"""


def test_accesses(spark):
    source = lines.explode_lines(spark.createDataFrame([(1, PROGRAM), (2, "")], "file_id bigint, content string"))
    rows = sorted((r.paragraph, r.item, r.storage, r.mode, r.path[0] if r.path else None) for r in variables.accesses(source).collect())
    assert rows == [
        ("ONE", "AMT", "AMT", "r", "GRP"), ("ONE", "AMT", "AMT", "w", "REC-A"), ("ONE", "FLAG", "FLAG", "r", "FLAG"), ("ONE", "FLAG", "FLAG", "w", "FLAG"),
        ("TWO", "ALT", "GRP", "w", "REC-B"), ("TWO", "AMT", "AMT", "r", "GRP"), ("TWO", "AMT", "AMT", "r", "REC-A"), ("TWO", "AMT", "AMT", "w", "GRP"), ("TWO", "HV", "HV", "w", None),
    ]
