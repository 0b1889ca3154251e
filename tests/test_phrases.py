import json
import random
import re

import pyarrow as pa

from ferrolith.operators import lines as ln
from ferrolith.operators import patterns, phrases, statements

ASKED = [
    ("MOVE @ TO @", ["MOVE A TO B", "move  a-1(2)\n to b"], ["MOVE A B TO C", "XMOVE A TO B", "MOVE-IT A TO B", "MOVE A TO-B C"]),
    ("COMPUTE @ .. =", ["COMPUTE X=1", "COMPUTE X ROUNDED = 1", "COMPUTE X = 1"], ["COMPUTE = 1"]),
    ("WHEN !OTHER @", ["WHEN 1", "WHEN OTHERS-X"], ["WHEN OTHER", "WHEN other "]),
    ("PERFORM .. @ TIMES", ["PERFORM 3 TIMES", "PERFORM P-1 N TIMES"], ["PERFORM TIMES", "PERFORM P-1 UNTIL A"]),
    ("IF ~(STATUS|STAT) (=|NOT|EQUAL)", ["IF FS-STATUS = 1", "IF A-STAT NOT = 2"], ["IF STATUS = 1", "IF FS-STATUS-X = 1", "IF FS-STATUS > 1"]),
    ("NOT AT END", ["READ F NOT AT END", "not  at end"], ["NOT AT ENDING", "AT END"]),
    ("STRING .. INTO @", ["STRING A B INTO C"], ["UNSTRING A INTO C", "STRING A INTO"]),
]


def test_phrases_as_expressions():
    for phrase, yes, no in ASKED:
        regex = phrases.compiled(phrase)
        assert all(re.search(regex, t) for t in yes), phrase
        assert not any(re.search(regex, t) for t in no), phrase
    assert re.search(phrases.compiled("MOVE @ TO @"), "MOVE A TO B").groups() == ("A", "B")


def test_specifications_have_precedence_versions_and_problems(spark, tmp_path):
    own, cache = tmp_path / "own", tmp_path / "cache"
    own.mkdir(), cache.mkdir()
    first = phrases.specification("one", {"c": {"a": "GO TO @", "b": "+IF .. PERFORM @"}}, ["CBL", ".Cob"], ["a"])
    (own / "one.json").write_text(json.dumps(first))
    (cache / "one.json").write_text(json.dumps(phrases.specification("one", {"c": {"z": "STOP RUN"}})))
    (cache / "two.yaml").write_text("spec_id: two\nphrases:\n- {category: c, name: s, phrase: STOP RUN}\n")
    (cache / "three.json").write_text(json.dumps(dict(reversed(first.items())) | {"spec_id": "three"}, indent=3))
    (cache / "bad.json").write_text('{"spec_id": "Bad", "phrases": [{"name": 1}]}')
    (cache / "broken.yml").write_text("a: [")
    found, bad = phrases.scan_specifications(spark, [str(own), str(cache)])
    rows = {r.spec_id: r for r in found.select("spec_id", "version", "file_id", "extensions").collect()}
    assert set(rows) == {"one", "two", "three"} and rows["one"].extensions == [".cbl", ".cob"] and rows["two"].extensions == []
    assert [(r.name, r.required) for r in phrases.rules_of(found, "one")] == [("a", True), ("b", False)]
    assert [r.name for r in phrases.rules_of(found, "two")] == ["s"] and phrases.rules_of(found, "none") == []
    assert sorted((r.file_id, r.path, r.problem) for r in bad.collect()) == [
        ("bad.json", "/phrases/0/category", "required"), ("bad.json", "/phrases/0/name", "type"), ("bad.json", "/phrases/0/phrase", "required"), ("bad.json", "/spec_id", "pattern"), ("broken.yml", "", "not JSON"),
    ]
    (own / "one.json").write_text(json.dumps(dict(reversed(first.items())), indent=1))
    again, _ = phrases.scan_specifications(spark, [str(own), str(cache)])
    assert again.where("spec_id = 'one'").first().version == rows["one"].version != rows["three"].version


PROGRAM = """\
       PROCEDURE DIVISION.
       P1.
           READ F1 AT END DISPLAY 'GO TO X' NOT AT END
             MOVE A TO B.
      *    MOVE C TO D.
           IF A = B
              PERFORM P2
           END-IF.
           IF A = B NEXT SENTENCE.
           PERFORM P2.
       P2.
           GOBACK."""


def test_matches_and_coverage(spark):
    source = ln.explode_lines(spark.createDataFrame([("a", PROGRAM), ("b", ""), ("c", None)], "file_id string, content string"))
    rules = [patterns.Rule(c, n, ("+" if p[0] == "+" else "") + phrases.compiled(p)) for c, named in phrases.COBOL_PHRASES.items() for n, p in named.items()]
    assert patterns.rule_problems([patterns.Rule(r.category, r.name, r.regex.removeprefix("+")) for r in rules]) == []
    matches = phrases.phrase_matches(source, rules)
    assert sorted((r.line_no, r.name) for r in matches.collect()) == [(3, "at_end"), (3, "at_end"), (3, "not_at_end"), (4, "move_simple"), (6, "if_perform"), (6, "if_then"), (9, "if_then")]
    covered = {r.category: (r.n_matches, r.n_rules) for r in patterns.coverage(matches, rules, "file_id").collect()}
    assert covered == {"data_flow": (1, 1), "control_flow": (3, 2), "error_handling": (3, 2)}
    assert phrases.phrase_matches(source, []).count() == 0 and phrases.phrase_matches(source.where("false"), rules).count() == 0


ODD = [
    "       PROCEDURE DIVISION.", "       procedure  division using x", "       P1.", "       P-2 SECTION .", "       DECLARATIVES.", "       END DECLARATIVES.", "       END-X.", "       EXIT.", "       p3.\u0085", "      -P4.", "       P5. MOVE A TO B.", " " * 70 + "MOVE",
    "           MOVE A TO B.", "           MOVE 'A. B' TO C", "           MOVE 'it''s", "      -    'more' TO D.", "      -    TAIL", "      -", "      *    GO TO X.", "      /", "", None, "           .", "           ..", "           IF A = B", "              PERFORM P1", "           ELSE", "           END-IF.",
    "           EXIT PERFORM.", "           EXEC SQL SELECT IF FROM GO", "           END-EXEC.", "           END-EXEC", "           EXEC.", "           GO TO P1. GO TO P2 PERFORM P3 UNTIL X", "           DISPLAY \"NOT AT END\" 'x' Y.", "           CALL 'X'. ON EXCEPTION 'a.'", "           '", "           é ifé ıf x.",
    "           READ F AT END GOBACK NOT AT END STOP RUN.", "           END-", "           END-EXECUTE.", "      D    MOVE D TO E.", "           IF WS-STAT = 1 NEXT SENTENCE", "           move corr a to b", "       MOVE A TO B.", "       P6.\t", "           TEXT.  .",
]


def odd_programs(spark):
    draw = random.Random(3)
    rows = [(f"f{f}", k * 2, draw.choice(ODD[:3] if k < 2 else ODD)) for f in range(120) for k in range(draw.choice([1, 5, 30, 80]))]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "file_id string, line_no int, text string").repartition(3)


def test_statements_in_whole_files_are_those_assembled(spark, monkeypatch):
    source = odd_programs(spark)
    wanted = [(r.file_id, r.paragraph, r.para_start, r.line_start, r.line_end, r.text, r.ended) for r in statements.assemble(source).collect()]
    lines = sorted(((r.file_id, r.line_no, r.text or "") for r in source.collect()))
    numbers = [k - next(i for i, x in enumerate(lines) if x[0] == f) + 1 for k, (f, _, _) in enumerate(lines)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(x)) for x in (*zip(*lines), numbers)], names=["file_id", "line_no", "text", "_n"])
    files = sorted({f for f, _, _ in lines})
    assert len(wanted) > 500
    assert sorted((files[f], *rest) for f, *rest in statements.statements_in(batch)) == sorted(wanted)
    monkeypatch.setattr(ln, "BATCH_LINES", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)
    try:
        parts = [sorted(statements.statements_in(b)) for b in ln.whole_files([batch.slice(k, 60) for k in range(0, len(lines), 60)])]
        assert len(parts) > 5 and sum(map(len, parts)) == len(wanted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rules_in_python_and_in_spark_agree(spark):
    """A rule with syntax that only Spark reads has all rules searched there; matches and counts are the same."""
    source = odd_programs(spark)
    rules = [patterns.Rule(c, n, ("+" if p[0] == "+" else "") + phrases.compiled(p), required=n in ("go_to", "compute")) for c, named in phrases.COBOL_PHRASES.items() for n, p in named.items()]
    only_spark = patterns.Rule("odd", "posix", r"(?is)\p{Alpha}+-STAT")
    assert all(phrases.same_in_python(r.regex.removeprefix("+")) for r in rules) and not phrases.same_in_python(only_spark.regex)
    found, spark_found = phrases.phrase_matches(source, rules), phrases.phrase_matches(source, [*rules, only_spark])
    assert found.schema["line_no"].dataType == source.schema["line_no"].dataType and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    one = sorted(map(str, found.collect()))
    assert len(one) > 300 and one == sorted(map(str, spark_found.where("category <> 'odd'").collect())) and spark_found.where("category = 'odd'").count() > 0
    keys = source.select("file_id").distinct()
    for each in (rules, [*rules, only_spark]):
        counts = phrases.phrase_counts(source, each)
        assert sorted(map(str, patterns.coverage_of(counts, each, "file_id").collect())) == sorted(map(str, patterns.coverage(phrases.phrase_matches(source, each), each, "file_id").collect()))
        assert sorted(map(str, patterns.required_without_count(counts, each, "file_id").collect())) == sorted(map(str, patterns.missing_required(keys, found, each, "file_id").collect()))
