import pytest
from pyspark.sql import functions as F

from ferrolith.functions import extract, text
from ferrolith.operators import aggregates, calls, citations, diagrams, intervals, patterns, render, search, tickets


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=lambda t: [(x is None, x) for x in t])


CALLOUTS = "file_id string, artifact string, target string, relation string, line int"


def test_callers_by_every_form_of_a_name(spark):
    found = [("a.cbl", "P1", "Cust", "calls", 3), ("a.cbl", None, "cust.CPY", "includes", 1), ("b.cbl", "P2", "lib/CUST", "calls", 9), ("b.cbl", "P2", "custom", "calls", 2), ("b.cbl", "P2", None, "calls", 4), ("c.cbl", "P", "cust.cpy.cob", "calls", 1)]
    callouts = spark.createDataFrame(found, CALLOUTS)
    names = spark.createDataFrame([("CUST",), ("custom.cbl",), ("cust.cpy",)], "name string")
    got = rows(calls.callers(callouts, names), "name", "file_id", "line")
    assert got == sorted([("CUST", "a.cbl", 3), ("CUST", "a.cbl", 1), ("CUST", "b.cbl", 9), ("custom.cbl", "b.cbl", 2), ("cust.cpy", "a.cbl", 1), ("cust.cpy", "a.cbl", 3), ("cust.cpy", "c.cbl", 1)])


def test_directory_callouts_and_their_compact_form(spark):
    callouts = spark.createDataFrame([("src/a.cbl", None, "B", "calls", 1), ("src/a.cbl", "P", "para-2", "performs", 2), ("src/a.cbl", "P", "PARA-2", "performs", 7), ("src/a.cbl", "P", "", "calls", 3), ("src/b", "Q", "gone", "calls", 4)], CALLOUTS)
    artifacts = spark.createDataFrame([("Para-2",)], "name string")
    files = spark.createDataFrame([("src/a.cbl",), ("src/b",)], "file_id string")
    found = calls.directory_callouts(callouts, artifacts, files)
    assert rows(found, "from", "to", "resolved") == [("P", "", False), ("P", "PARA-2", True), ("P", "para-2", True), ("Q", "gone", False), ("a", "B", True)]
    assert len(rows(calls.compact_callouts(found))) == 4
    assert [r[0] for r in rows(spark.createDataFrame([("x/.profile",), ("a.b.c",), ("n",)], "f string").select(calls.file_stem(F.col("f"))))] == [".profile", "a.b", "n"]


def test_file_summary_takes_a_leading_paragraph_alone(spark):
    kinds = [("f", "P1", "paragraph", 1), ("f", "X", "program", 2), ("g", "X", "program", 1), ("g", "Q", "paragraph", 2), ("g", "F", "function", 3), ("h", "T", "table", 1)]
    artifacts = spark.createDataFrame([(*k, k[3]) for k in kinds], "file_id string, name string, type string, line_start int, line_end int")
    callouts = spark.createDataFrame([("g", "X", f"T{i:02}", "calls", i) for i in range(12)] + [("g", None, "A", "performs", 1), ("g", None, "B", "executes", 1), ("g", "X", "C", "includes", 1)], CALLOUTS)
    files = spark.createDataFrame([("f",), ("g",), ("h",), ("none",)], "file_id string")
    got = {r.file_id: r for r in calls.file_summary(files, artifacts, callouts).collect()}
    assert (got["f"].entry_points, got["g"].entry_points, got["h"].entry_points, got["none"].n_artifacts) == (["P1"], ["X", "F"], [], 0)
    assert got["g"].main_calls == ["B"] + [f"T{i:02}" for i in range(9)]


def test_citations_against_the_truth(spark):
    truth = spark.createDataFrame([("f", "Main", 8, 11), ("f", "LAST", 14, None)], "file_id string, name string, line_start bigint, line_end bigint")
    given = {"main": None, "MAIN": [], "Main": [0, 0], "mAin": [9, 20], "maIn": [12, 20], "maiN": [-1, 4], "MAin": [3], "last": [14, 14], "gone": [1, 2], "": [1, 2]}
    cited = spark.createDataFrame([("f", n, c) for n, c in given.items()] + [("other", "x", [1, 2])], "file_id string, name string, citation array<bigint>")
    got = {r.name: (r.issue, r.original, r.corrected) for r in citations.citation_findings(cited, truth).collect()}
    assert got == {
        "main": ("MISSING", None, [8, 11]), "MAIN": ("MISSING", None, [8, 11]), "Main": ("MISSING", None, [8, 11]), "maIn": ("WRONG_RANGE", [12, 20], [8, 11]), "maiN": ("MISSING", None, [8, 11]), "gone": ("UNRESOLVABLE", [1, 2], None),
    }


def test_evidence_verdicts_notes_and_feedback(spark):
    claims = spark.createDataFrame([(1, ["b", "b", "x"]), (2, [])], "claim_id int, bundle_ids array<string>")
    bundles = spark.createDataFrame([("b", "f", 2, 3)], "bundle_id string, file_id string, line_start bigint, line_end bigint")
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 5)], "file_id string, line_no bigint, text string")
    assert rows(citations.evidence(claims, bundles, lines)) == [(1, "b", "l2\nl3"), (1, "x", None)]
    verdicts = spark.createDataFrame([(1, "VERIFIED", 1), (1, "REFUTED", 2)], "claim_id int, verdict string, ord int")
    judged = citations.with_verdicts(claims.withColumn("k", F.lit(0)), verdicts)
    assert rows(judged, "claim_id", "verdict") == [(1, "REFUTED"), (2, "UNVERIFIABLE")]
    assert rows(citations.verdict_counts(judged, "k")) == [(0, 0, 1, 1, False)]
    assert [r[0] for r in rows(spark.range(1).select(citations.rate(F.lit(0), F.lit(0))))] == [1.0]
    notes = spark.createDataFrame([("n", []), ("m", ["f", "g"])], "note_id string, affected array<string>")
    assert rows(citations.notes_by_file(notes)) == [("f", "m"), ("g", "m"), (None, "n")]
    work = spark.createDataFrame([(1, "f", "completed", ["own"]), (2, "g", "created", None), (3, "h", "completed", None)], "ticket_id int, file_id string, state string, notes array<string>")
    said = spark.createDataFrame([("f", "note", "second", 2), ("f", "note", "first", 1), ("g", "skip", None, 1)], "file_id string, action string, note string, ord int")
    got = citations.merged_feedback(work, said)
    assert rows(got, "ticket_id", "state", "notes") == [(1, "rework", ["first", "second", "own"]), (2, "cancelled", []), (3, "completed", [])]


def test_levels_stop_at_cycles(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "artifact_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("a", "missing")], "src string, dst string")
    assert {r.artifact_id: r.level for r in diagrams.topological_levels(nodes, edges).collect()} == {"a": 2, "b": 1, "c": 0, "d": 0, "x": None, "y": None, "z": None}


def test_diagrams(spark):
    nodes = spark.createDataFrame([("f", "A"), ("f", "B"), ("f", "C")], "k string, name string")
    edges = spark.createDataFrame([("f", "A", "B", "performs"), ("f", "A", "B", "performs"), ("f", "B", "X-1", "calls"), ("f", "C", "A", "performs")], "k string, src string, dst string, type string")
    whole = [r.line.strip() for r in diagrams.flow_lines(nodes, edges, "k").orderBy("place").collect()]
    assert whole == ["flowchart TD", 'A["A"]', 'B["B"]', 'C["C"]', 'X_1(["X-1"])', "A -->|performs| B", "B -.->|calls| X_1", "C -->|performs| A"]
    part = [r.line.strip() for r in diagrams.flow_lines(nodes, edges, "k", spark.createDataFrame([("f/B",)], "start string")).orderBy("place").collect()]
    assert part == ["flowchart TD", 'B["B"]', 'X_1(["X-1"])', "B -.->|calls| X_1"]
    paths = spark.createDataFrame([("A", ["A", "B", "A"])], "start string, path array<string>")
    assert [r.line.strip() for r in diagrams.sequence_lines(paths).orderBy("place").collect()] == ["sequenceDiagram", "participant A as A", "participant B as B", "A->>B: calls", "B->>A: calls"]
    names = spark.createDataFrame([("f", "9500-LOG"), ("f", "9500-exit"), ("f", "8-EXIT"), ("f", "A-EXIT"), ("g", "A-B")], "file_id string, name string")
    assert rows(diagrams.exit_names(names)) == [("f", "9500-EXIT")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda t: extract.json_in(t('say {"a": [1]} now')), '{"a": [1]}'), (lambda t: extract.json_in(t("no {json")), None), (lambda t: extract.json_in(t("```json\n[1, 2]\n```")), "[1, 2]"),
        (lambda t: extract.path_get(t('{"a": {"b": 3}}'), "a.b"), "3"), (lambda t: extract.path_get(t('{"a": 1}'), "a.b"), None),
        (lambda t: F.unix_seconds(extract.parsed_time(t("1970-01-01T00:01:00Z"))), 60), (lambda t: extract.parsed_time(t("soon")), None),
        (lambda t: extract.unmasked(t("A __STR_0__ B __STR_1__"), F.array(F.lit("'x'"), F.lit("'y'"))), "A 'x' B 'y'"),
        (lambda t: extract.columns_in(t("a.id, b.Name, a.id"), r"\.(\w+)"), ["ID", "NAME"]),
        (lambda t: extract.target_fields(t("is WS-A or WS-A or LIMIT-9"), F.lit(None).cast("string")), ["WS-A", "LIMIT-9"]),
        (lambda t: extract.variable_names(t("move ws-a to X b1 12 WS-A"), ["MOVE", "TO"]), ["WS-A", "B1"]),
        (lambda t: extract.capped_cells(t("| ab | " + "c" * 20 + " |\n" + "d" * 20), 10), "| ab | cccccc...|\n" + "d" * 20),
        (lambda t: extract.first_paragraphs(t("a\n\nb\n \nc\n\nd"), 3), "a\n\nb\n\nc"),
        (lambda t: extract.section_text(t("# x\n## Executive Summary\nyes\n\nmore\n## Next\nno"), "executive summary"), "yes\n\nmore"),
        (lambda t: extract.definition_kind(t("       01  WS-A PIC X."), F.lit("ws-a"), [("paragraph", r"^\s{7}{name}\."), ("data", r"\b\d\d\s+{name}\b")]), "data"),
        (lambda t: extract.is_connection_error(F.lit("X"), t("Read timed out")), True), (lambda t: extract.is_auth_error(F.lit("X"), F.lit(500), t("bad")), False),
        (lambda t: extract.field_kind(F.lit(5), t("X(3)")), "elementary"), (lambda t: extract.label_value(F.array(t("a:b:c")), "a"), "b:c"),
        (lambda t: extract.numbered_lines(t("a\nb\nc"), 2), "     1  a\n     2  b\n... 1 more lines"),
        (lambda t: extract.without_bad_diagrams(t("x\n```mermaid\nnope\n```\ny\n```mermaid\n%% c\npie\n```"), "-"), "x\n-\ny\n```mermaid\n%% c\npie\n```"),
        (lambda t: calls.program_type(t("dfhxyz")), "system_utility"), (lambda t: calls.category(t("screen")), "interface"), (lambda t: calls.call_type(t("Includes")), "COPY"), (lambda t: calls.file_type(t("bms")), "BMS"),
        (lambda t: text.is_meaningful(t("  ")), False), (lambda t: aggregates.error_coverage(F.length(t("ab"))), "moderate"), (lambda t: aggregates.percentage(F.lit(1), F.length(t("abc"))), 33.33),
        (lambda t: render.markdown_row(t("a|b"), F.lit(1)), "| a\\|b | 1 |"), (lambda t: render.dot_node(t("a"), F.lit('b"')), '  "a" [label="b\\""];'), (lambda t: render.cypher_edge(t("a"), F.lit("b"), F.lit("calls")), "MATCH (a {id: 'a'}), (b {id: 'b'}) CREATE (a)-[:CALLS]->(b);"),
        (lambda t: tickets.coarse_state(t("merged")), "closed"),
    ],
)
def test_text_functions(spark, make, want):
    assert one(spark, make(F.lit)) == want


def test_markdown_summary_questions_and_hints(spark):
    page = "---\na: b\n---\n# Title\n\n![x](y)\n\n- list\n\nFirst real\nparagraph.\n"
    assert tuple(one(spark, extract.markdown_summary(F.lit(page)))) == ("Title", "First real paragraph.")
    found = one(spark, extract.inline_questions(F.lit("❓ QUESTION: a?\n## H\n❓ QUESTION:  b?")))
    assert [tuple(q) for q in found] == [("Q001", "General", "a?"), ("Q002", "H", "b?")]
    hints = one(spark, extract.relevance_hints(F.lit("see line 12 and lines 3-9 of WS-A, COBOL"), ["COBOL"]))
    assert (hints["lines"], hints["ranges"], hints["identifiers"]) == ([3, 12], ["3-9"], ["WS-A"])


def test_skills_by_name_and_tag(spark):
    skills = spark.createDataFrame([("Order Entry", ["a", "B"]), ("entry", ["c"])], "name string, tags array<string>")
    assert search.by_name(skills, "ENTRY").first().name == "entry" and search.by_name(skills, "order").first().name == "Order Entry"
    assert [r.name for r in search.by_tag(skills, "b").collect()] == ["Order Entry"]


def test_ranges_may_nest_and_counts_replace_matches(spark):
    points = spark.createDataFrame([("f", i) for i in (1, 70, 130, 500)], "k string, at int")
    ranges = spark.createDataFrame([("f", "wide", 1, 200), ("f", "inner", 60, 140)], "k string, name string, line_start int, line_end int")
    assert rows(intervals.covering_range(points, ranges, "k", "at"), "at", "name") == [(1, "wide"), (70, "wide"), (130, "wide"), (500, "UNKNOWN")]
    docs = spark.createDataFrame([(1, "mail a@b.de and a@c.de"), (1, "why?"), (2, None)], "k int, text string")
    counts = patterns.rule_counts(docs, patterns.DOCUMENT_RULES, "k")
    by_rows = patterns.coverage(patterns.extract_matches(docs.na.fill(""), patterns.DOCUMENT_RULES), patterns.DOCUMENT_RULES, "k")
    assert rows(patterns.coverage_of(counts, patterns.DOCUMENT_RULES, "k")) == rows(by_rows)


def test_latest_keeps_later_metadata(spark):
    log = spark.createDataFrame([("t", 1, 1, "created", None, {"a": "1", "b": "1"}), ("t", 2, 1, "claimed", "w", {"a": "2"}), ("u", 1, 1, "created", None, None)], "ticket_id string, ts int, seq int, state string, worker string, metadata map<string,string>")
    got = {r.ticket_id: r for r in tickets.latest(log).collect()}
    assert (got["t"].state, got["t"].worker, got["t"].metadata, got["u"].metadata) == ("claimed", "w", {"a": "2", "b": "1"}, {})
    reset = {r.ticket_id: r.state for r in tickets.orphans_reset(tickets.latest(log)).collect()}
    assert reset == {"t": "created", "u": "created"}
