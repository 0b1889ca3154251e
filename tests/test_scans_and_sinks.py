import json

from pyspark.sql import functions as F

from ferrolith.operators import chunking, render, tickets
from ferrolith.sources import documents, files, scans


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_saved_graphs(spark, tmp_path):
    place = {"file_path": "a.cbl", "line_start": 3, "line_end": 9}
    put(tmp_path, "g.json", {"version": "1", "artifacts": {"program::A": {"id": "program::A", "artifact_type": "program", "canonical_name": "A", "aliases": ["X"], "defined_in": place}}, "relationships": [{"from_artifact": "program::A", "to_artifact": "program::B", "relationship_type": "calls", "location": place, "confidence": 0.5}], "unresolved": [{"reference_text": "Q", "expected_type": "table", "candidates": ["Q1"]}]})
    put(tmp_path, "bad.json", "{not json")
    nodes, edges, unresolved = scans.scan_graphs(spark, str(tmp_path))
    assert [(r.artifact_id, r.type, r.name, r.aliases, r.file_id, r.line_start) for r in nodes.collect()] == [("program::A", "program", "A", ["X"], "a.cbl", 3)]
    assert [(r.src, r.dst, r.type, r.line, r.confidence) for r in edges.collect()] == [("program::A", "program::B", "calls", 3, 0.5)]
    assert [(r.raw_text, r.candidates) for r in unresolved.collect()] == [("Q", ["Q1"])]


def test_chunks_in_order(spark, tmp_path):
    put(tmp_path, "chunk_a.json", {"batch_idx": 10, "total_batches": 11, "template": {"purpose": {"summary": "late"}, "paragraphs": [{"paragraph_name": "P", "summary": "s"}, {"summary": "unnamed"}]}})
    put(tmp_path, "chunk_b.json", {"batch_idx": 2})
    put(tmp_path, "other.json", {"batch_idx": 0})
    rows = scans.scan_chunks(spark, str(tmp_path)).collect()
    assert [(r.batch_idx, r.total_batches, r.purpose, [p.paragraph_name for p in r.paragraphs]) for r in rows] == [(2, 0, None, []), (10, 11, "late", ["P"])]


def test_ticket_stores(spark, tmp_path):
    one = lambda i, state, at, **k: {"ticket_id": i, "ticket_type": "x", "state": state, "file_name": "f", "worker_id": "w", "updated_at": at} | k
    put(tmp_path, "t.json", {"current_cycle": 2, "tickets": [one("a", "claimed", "2024-01-01T00:00:00"), one("b", "completed", "soon"), one("c", "created", "2024-01-01T00:00:00"), one("c", "blocked", "2024-01-02T00:00:00", cycle_number=3), {"ticket_id": "d"}]})
    got = {r.ticket_id: (r.state, r.worker_id, r.cycle_number, r.updated_at is None) for r in scans.scan_tickets(spark, str(tmp_path)).collect()}
    assert got == {"a": ("created", None, 1, False), "b": ("completed", "w", 1, True), "c": ("created", None, 3, False)}


def test_skill_files(spark, tmp_path):
    put(tmp_path, "one/SKILL.md", "---\nname: 'First'\ndescription: what\ntags: [a, b c]\n---\n\nbody\n")
    put(tmp_path, "two/skill.md", "---\ntags:\n  - x\n  - y\n---\ntext")
    put(tmp_path, "three/SKILL.md", "plain")
    put(tmp_path, "other.md", "no")
    got = sorted((r.name, r.description, r.tags or [], r.content.strip()) for r in scans.scan_skills(spark, str(tmp_path)).collect())
    assert got == [("First", "what", ["a", "b c"], "body"), ("SKILL", "", [], "plain"), ("skill", "", ["x", "y"], "text")]


def test_ebcdic(spark):
    rows = spark.createDataFrame([(bytearray("HELLO 123 (é)".encode("cp037")),)], "b binary")
    assert rows.select(files.decoded_ebcdic(F.col("b")).alias("t")).first().t == "HELLO 123 (é)"


def test_new_tickets_have_running_ids(spark):
    asked = spark.createDataFrame([("x", f"f{i}", 1 + i % 2, 50 - i) for i in range(40)], "ticket_type string, file_id string, cycle int, ord int")
    made = tickets.created(asked, after=7)
    assert [r.ticket_id for r in made.orderBy("ord").collect()] == [f"mem-{i:06}" for i in range(8, 48)]
    assert tickets.available(made, "x", 2).count() == 20 and tickets.available(made, "y").count() == 0
    assert tickets.created(asked.limit(0)).count() == 0


def test_windows_of_hints_and_hashed_ones(spark):
    hints = spark.createDataFrame([("f", [5, 50], ["Data"], ["ws-a"])], "file_id string, lines array<int>, sections array<string>, names array<string>")
    starts = spark.createDataFrame([("f", "section", "DATA", 20), ("f", "name", "WS-A", 30), ("g", "name", "WS-A", 1)], "file_id string, kind string, name string, line_no int")
    got = sorted((r.start_line, r.end_line, r.score, r.reason) for r in chunking.hint_windows(hints, starts).collect())
    assert got == [(1, 15, 1.0, "line"), (10, 30, 0.9, "section"), (20, 40, 0.7, "name"), (40, 60, 1.0, "line")]
    sized = spark.createDataFrame([("f", 1000, 5000), ("g", 7, 10), ("h", 100, 0)], "file_id string, n_lines bigint, n_tokens bigint")
    got = {r.file_id: (r.start_line, r.end_line) for r in chunking.hashed_window(sized, 500).collect()}
    assert got["f"][1] - got["f"][0] == 99 and 1 <= got["f"][0] <= 901 and got["g"] == (1, 7) and got["h"] == (1, 100)
    sizes = [F.lit(x) for x in (0, 5, 5, 1)]
    assert spark.range(1).select(chunking.prompt_reductions(*sizes, F.lit(9)).alias("x"), chunking.prompt_reductions(*sizes, F.lit(11)).alias("y")).first()[:] == ("source", None)


def test_documentation_as_markdown_and_links(spark, tmp_path):
    put(tmp_path, "A.doc.json", {"header": {"program_id": "A"}, "purpose": {"summary": "Does."}, "inputs": [{"name": "IN", "description": "file"}], "paragraphs": [{"paragraph_name": "MAIN", "summary": "starts"}]})
    lines = render.document_lines(documents.scan_documents(spark, str(tmp_path)))
    assert [r.line for r in lines.orderBy("place").collect()] == ["# A", "", "## Purpose", "", "Does.", "", "## Inputs", "", "- **IN**: file", "", "## Paragraphs", "", "- **MAIN**: starts"]
    text = spark.createDataFrame([("f", i, t) for i, t in enumerate(["# A", "### `Main`", "x", "### OTHER", "[Source](o.txt)"], 1)], "file_id string, line_no bigint, text string")
    links = spark.createDataFrame([("f", "MAIN", "m.txt"), ("f", "other", "o.txt")], "file_id string, name string, target string")
    once = render.linked_lines(text, links)
    assert [r.text for r in once.orderBy("line_no").collect()] == ["# A", "### `Main`", "[Source](m.txt)", "x", "### OTHER", "[Source](o.txt)"]
    assert [r.text for r in render.linked_lines(once, links).orderBy("line_no").collect()] == [r.text for r in once.orderBy("line_no").collect()]
    bodies = spark.createDataFrame([("P", "A/B", "one\ntwo")], "program string, name string, body string")
    render.write_bodies(bodies, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/program=P/paragraph=A_B").collect()] == ["one", "two"]
    render.write_lines(once.withColumnRenamed("text", "line"), f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 6 and render.json_rows(links).first().line.startswith('{"file_id":"f"')
