import json

import pytest
from pyspark.sql import functions as F

from ferrolith.functions import json_schema as js
from ferrolith.sources import documents as dc


def found(spark, schema, *values):
    texts = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "file_id int, text string")
    out = {k: [] for k in range(len(values))}
    for r in dc.problems(texts, schema).collect():
        out[r.file_id].append((r.path, r.problem))
    return [sorted(out[k]) for k in range(len(values))]


DOCUMENT = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["header", "inputs"],
    "properties": {
        "header": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^[A-Z]+$", "maxLength": 4}, "count": {"type": "integer", "minimum": 0, "exclusiveMaximum": 9}}},
        "inputs": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/input"}},
        "a/b~c": {"const": {"x": [1, None]}},
        "tags": {"type": ["array", "null"], "uniqueItems": True, "minItems": 1},
    },
    "additionalProperties": False,
    "$defs": {"input": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 1}, "kind": {"enum": ["in", "out", 1, None]}}, "additionalProperties": {"type": "boolean"}}},
}


def test_places_of_nested_documents(spark):
    good = {"header": {"id": "AB", "count": 3.0}, "inputs": [{"name": "x", "kind": 1.0, "more": True}, {"name": "y", "kind": None}], "a/b~c": {"x": [1, None]}, "tags": None}
    bad = {"header": {"id": "abcde", "count": 9}, "inputs": [{"kind": "up"}, 3, {"name": "", "o/p": 1}], "a/b~c": {"x": [1]}, "tags": [1, 1.0], "new": 1}
    cases = [
        (good, []),
        (bad, [("/a~1b~0c", "const"), ("/header/count", "exclusiveMaximum"), ("/header/id", "maxLength"), ("/header/id", "pattern"), ("/inputs", "maxItems"), ("/inputs/0/kind", "enum"), ("/inputs/0/name", "required"), ("/inputs/1", "type"), ("/inputs/2/name", "minLength"), ("/inputs/2/o~1p", "type"), ("/new", "additionalProperties"), ("/tags", "uniqueItems")]),
        ({"header": {"id": None, "count": 1.5}, "inputs": {}, "tags": []}, [("/header/count", "type"), ("/header/id", "type"), ("/inputs", "type"), ("/tags", "minItems")]),
        ({"header": {"count": True}}, [("/header/count", "type"), ("/header/id", "required"), ("/inputs", "required")]),
        ([], [("", "type")]),
        ("{broken", [("", "not JSON")]),
        ("", [("", "not JSON")]),
    ]
    assert found(spark, DOCUMENT, *[c for c, _ in cases]) == [sorted(p) for _, p in cases]


def test_combined_schemas(spark):
    schema = {"anyOf": [{"type": "string"}, {"type": "integer", "minimum": 5}], "not": {"const": "no"}}
    assert found(spark, schema, '"a"', "7", "3", '"no"') == [[], [], [("", "anyOf")], [("", "not")]]
    assert found(spark, {"oneOf": [{"minimum": 2}, {"maximum": 5}]}, "1", "3", "9", '"s"') == [[], [("", "oneOf")], [], [("", "oneOf")]]
    assert found(spark, {"properties": {"a": False}, "minProperties": 1, "maxProperties": 2}, {"a": 1}, {}, {"b": 1, "c": 2, "d": 3}) == [[("/a", "false")], [("", "minProperties")], [("", "maxProperties")]]


def test_what_cannot_be_compiled_is_an_error():
    for schema in [{"type": "object", "dependentRequired": {}}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"$ref": "other.json"}]:
        with pytest.raises(ValueError):
            js.schema_problems(F.lit(None).cast("variant"), schema)


def test_scan_null_texts_and_valid(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.doc.json").write_text('{"header": {"id": "A"}, "inputs": []}')
    (tmp_path / "b.doc.json").write_text("{")
    (tmp_path / "c.txt").write_text("{}")
    texts = dc.scan_values(spark, str(tmp_path), "*.doc.json")
    assert [(r.file_id, r.path, r.problem) for r in dc.problems(texts, DOCUMENT).collect()] == [("b.doc.json", "", "not JSON")]
    assert [r.file_id for r in dc.valid(texts, DOCUMENT).select("file_id").collect()] == ["a.doc.json"]
    nulls = spark.createDataFrame([(1, None, "x")], "file_id int, text string, path string")
    assert [tuple(r) for r in dc.problems(nulls, DOCUMENT).collect()] == [(1, "", "not JSON")]
    assert dc.problems(nulls.where("false"), DOCUMENT).count() == 0


def test_failed_criteria(spark):
    criteria = [dc.Criterion("COBOL", "WHY", "purpose", "CRITICAL"), dc.Criterion("COBOL", "IN", "inputs"), dc.Criterion("COBOL", "FLOW", "data.flow"), dc.Criterion("JCL", "NOTE", "note")]
    texts = [
        ("COBOL", {"purpose": {"summary": "s" * 20}, "inputs": [{"name": " ", "citation": [1]}, {"name": "f"}], "data": {"flow": {"reads": [{"n": 1}]}}}),
        ("COBOL", {"purpose": {"summary": " " * 9 + "s" * 19}, "inputs": [{"name": " ", "citation": [1]}, {}, None], "data": {"flow": {"reads": [], "_own": 1, "writes": [{"citation": 3}]}}}),
        ("COBOL", {"purpose": "s" * 30, "inputs": [], "data": 3}),
        ("JCL", {"note": "n" * 20}),
        ("JCL", {"note": None}),
        ("JCL", {"note": 0}),
        ("BMS", {}),
        (None, {}),
    ]
    rows = spark.createDataFrame([(k, t, json.dumps(v)) for k, (t, v) in enumerate(texts)] + [(9, "JCL", None)], "file_id int, file_type string, text string")
    rows = rows.withColumn("value", F.try_parse_json("text"))
    assert sorted((r.file_id, r.name, r.priority) for r in dc.failed_criteria(rows, criteria).collect()) == [
        (1, "FLOW", "HIGH"), (1, "IN", "HIGH"), (1, "WHY", "CRITICAL"), (2, "FLOW", "HIGH"), (2, "IN", "HIGH"), (2, "WHY", "CRITICAL"), (4, "NOTE", "HIGH"), (9, "NOTE", "HIGH"),
    ]
    assert dc.failed_criteria(rows, []).count() == 0
