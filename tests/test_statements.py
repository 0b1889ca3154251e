import pytest
from pyspark.sql import functions as F

from ferrolith.operators import lines, statements

PROGRAM = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. TREES.
       PROCEDURE DIVISION.
       MAIN-PARA.
           IF A = 'MOVE IT. NOW' THEN
              MOVE 1 TO B ELSE IF C > 2
                 PERFORM SUB-PARA THRU SUB-EXIT
              ELSE
                 GO TO SUB-EXIT
              END-IF
           END-IF.
           EVALUATE TRUE
             WHEN A
             WHEN B COMPUTE X = Y * 1.5
             WHEN OTHER
               PERFORM UNTIL X > 3
                  ADD 1 TO X
               END-PERFORM
           END-EVALUATE
           DISPLAY 'DONE'.
           EXEC SQL SELECT SET INTO :A
              FROM T
           END-EXEC.
           STOP RUN.
       SUB-PARA.
           PERFORM LOOP-PARA UNTIL DONE.
           IF X = 1 DISPLAY 'ONE'.
           CALL 'OTHER' USING X.
       SUB-EXIT.
           EXIT.
       LOOP-PARA.
           CONTINUE.
       LOST-PARA.
           GOBACK.
"""


@pytest.fixture(scope="module")
def source(spark):
    return lines.explode_lines(spark.createDataFrame([("TREES", PROGRAM), ("EMPTY", ""), ("NULL", None)], "file_id string, content string")).cache()


@pytest.fixture(scope="module")
def tree(source):
    return statements.statement_tree(source).cache()


def test_main_paragraph(tree):
    rows = tree.where("paragraph = 'MAIN-PARA'").orderBy("node_id").collect()
    assert [(r.node_id, r.parent_id, r.depth, r.type) for r in rows] == [
        (1, 0, 1, "IF"), (2, 1, 2, "MOVE"), (3, 1, 2, "ELSE"), (4, 3, 3, "IF"), (5, 4, 4, "PERFORM_THRU"), (6, 4, 4, "ELSE"), (7, 6, 5, "GO_TO"),
        (8, 0, 1, "EVALUATE"), (9, 8, 2, "WHEN"), (10, 8, 2, "WHEN"), (11, 10, 3, "COMPUTE"), (12, 8, 2, "WHEN"), (13, 12, 3, "PERFORM_INLINE"), (14, 13, 4, "ADD"),
        (15, 0, 1, "DISPLAY"), (16, 0, 1, "EXEC_SQL"), (17, 0, 1, "STOP_RUN"),
    ]
    by = {r.node_id: r for r in rows}
    assert by[1].attributes == {"condition": "A = 'MOVE IT. NOW'"}
    assert by[2].attributes == {"source": "1", "targets": "B"}
    assert by[5].attributes == {"target": "SUB-PARA", "thru": "SUB-EXIT"}
    assert by[11].attributes == {"target": "X", "expression": "Y * 1.5"}
    assert by[13].attributes == {"condition": "X > 3"}
    assert (by[16].line_start, by[16].line_end) == (21, 23)


def test_period_closes_all(tree):
    rows = tree.where("paragraph = 'SUB-PARA'").orderBy("node_id").collect()
    assert [(r.type, r.parent_id) for r in rows] == [("PERFORM_UNTIL", 0), ("IF", 0), ("DISPLAY", 2), ("CALL", 0)]
    assert rows[0].attributes == {"target": "LOOP-PARA", "condition": "DONE"}
    assert rows[3].attributes == {"target": "OTHER"}


@pytest.mark.parametrize(
    "kinds, ended, want",
    [
        (["END-IF", "MOVE"], [False, False], [None, (-1, 1)]),
        (["IF", "EVALUATE", "END-IF", "MOVE"], [False] * 4, [(-1, 1), (0, 2), None, (-1, 1)]),
        (["ELSE", "MOVE"], [False, True], [(-1, 1), (0, 2)]),
        (["IF", "IF", "ELSE", "ELSE"], [False] * 4, [(-1, 1), (0, 2), (1, 3), (0, 2)]),
        (["IF", "MOVE", "MOVE"], [False, True, False], [(-1, 1), (0, 2), (-1, 1)]),
        ([], [], []),
    ],
)
def test_parents(kinds, ended, want):
    assert statements.parents(kinds, ended) == want


def test_statistics_problems_and_dead(source, tree):
    stats = {r.paragraph: (r.n_statements, r.max_depth) for r in statements.tree_statistics(tree).collect()}
    assert stats == {"MAIN-PARA": (17, 3), "SUB-PARA": (4, 1), "SUB-EXIT": (1, 0), "LOOP-PARA": (1, 0), "LOST-PARA": (1, 0)}
    assert statements.tree_problems(tree).count() == 0
    broken = tree.where("node_id = 5").withColumn("text", F.lit("MOVE A")).withColumn("line_end", F.lit(0).cast("bigint"))
    assert {r.problem for r in statements.tree_problems(broken).collect()} == {"keyword missing", "ends before it starts", "target missing"}
    assert [r.name for r in statements.dead_in_tree(source, tree).collect()] == ["LOST-PARA"]


def test_json_round_trip(spark, tree, tmp_path):
    texts = statements.tree_json(tree)
    flat = ["paragraph", "node_id", "parent_id", "depth", "type", "text", "line_start", "line_end", "attributes"]
    rows = lambda t: sorted((tuple(str(dict(v)) if isinstance(v, dict) else v for v in r) for r in t.select(*flat).collect()))
    assert rows(statements.flatten_json(texts)) == rows(tree)
    (tmp_path / "a.ast").write_text(texts.where("file_id = 'TREES'").first().json.replace(", ", ",\n"))
    # line breaks between the parts of a file must not matter
    (tmp_path / "b.ast").write_text("{not json")
    (tmp_path / "c.ast").write_text('{"program_id": "C", "paragraphs": null}')
    assert rows(statements.scan_trees(spark, str(tmp_path))) == rows(tree)
