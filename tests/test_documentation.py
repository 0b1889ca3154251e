import json

from ferrolith.operators import aggregates as ag
from ferrolith.sources import documents


def test_scan(spark, tmp_path):
    one = {"header": {"program_id": "A", "final_status": "done"}, "purpose": {"summary": "s", "program_type": "BATCH"}, "paragraphs": [{"paragraph_name": "P", "summary": "x", "is_dead_code": True}, {"paragraph_name": "Q", "summary": "[stub]"}, {"paragraph_name": "R"}], "inputs": [{"name": "IN", "citation": [3, 4]}]}
    (tmp_path / "a.cbl.doc.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "b.cbl.doc.json").write_text("{broken")
    (tmp_path / "c.cbl.doc.json").write_text("{}")
    (tmp_path / "d.json").write_text("{}")
    docs = documents.scan_documents(spark, str(tmp_path))
    got = {r.file_id: (r.program_id, r.n_paragraphs, r.n_rules, r.n_dead) for r in documents.summaries(docs).collect()}
    assert got == {"a.cbl.doc.json": ("A", 3, 0, 1), "c.cbl.doc.json": (None, 0, 0, 0)}
    assert [tuple(r)[:2] + (r.name, r.citation) for r in documents.section(docs, "inputs").collect()] == [("a.cbl.doc.json", 0, "IN", [3, 4])]
    assert {r.paragraph_name for r in documents.without_summary(docs).collect()} == {"Q", "R"}


def test_purposes(spark):
    schema = "doc_id int, chunk int, has_header boolean, summary string, business_context string, program_type string, citations array<bigint>"
    rows = [(1, 0, False, "body", None, "B", [9, 2]), (1, 1, True, "head", "c", "A", [5]), (1, 2, None, None, None, None, [7]), (2, 0, False, None, None, None, None), (3, 1, False, "b", None, None, None), (3, 0, None, "a", None, None, None)]
    got = {r.doc_id: (r.summary, r.citations) for r in ag.merge_purposes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("head", [2, 5, 9]), 2: (None, []), 3: ("a", [])}
    assert ag.merge_purposes(spark.createDataFrame([], schema)).count() == 0


def test_cited_rules_and_questions(spark):
    io = spark.createDataFrame([(1, 0, 0, "A", "x", [3]), (1, 1, 0, "A", "y", [1, 3]), (1, 1, 1, "B", "z", None), (1, 2, 0, None, "n", [8]), (1, 3, 0, None, "m", [2])], "doc_id int, chunk int, ord int, name string, text string, citation array<bigint>")
    got = {r.name: (r.text, r.citation) for r in ag.merge_cited(io, ["name"]).collect()}
    assert got == {"A": ("x", [1, 3]), "B": ("z", None), None: ("n", [2, 8])}
    rules = spark.createDataFrame([(1, 0, 0, "R9", "Pay tax"), (1, 0, 1, "R1", "Other"), (1, 1, 0, "R1", " pay TAX "), (2, 0, 0, None, None)], "doc_id int, chunk int, ord int, rule_id string, description string")
    assert {(r.doc_id, r.rule_id, r.description) for r in ag.merge_rules(rules).collect()} == {(1, "BR001", "Pay tax"), (1, "BR002", "Other"), (2, "BR001", None)}
    asked = spark.createDataFrame([(1, 1, 9, "why?"), (1, None, None, "why?")], "doc_id int, start_line int, end_line int, question string")
    assert [r.question for r in ag.merge_questions(asked).collect()] == ["[lines 1-9] why?", "why?"]
