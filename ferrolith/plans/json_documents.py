"""Queries that check JSON against schemas and criteria: the properties of events as they are, and a document for each order
whose faults follow from the order's lines; the SQL states those faults from the columns, without reading JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators import lines
from ferrolith.plans.registry import Registry, table
from ferrolith.sources import documents as dc

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql

#: Properties whose k is a whole number from 0 to 90, without a last digit of 7.
PROPS = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 90, "not": {"enum": [7, 17, 27, 37, 47, 57, 67, 77, 87, 97]}}}, "additionalProperties": False}

ORDER = {
    "type": "object",
    "required": ["header", "inputs"],
    "properties": {
        "header": {"type": "object", "required": ["program_id"], "properties": {"program_id": {"type": "string", "pattern": "^O[0-9]*[0-8]$"}, "iteration_count": {"type": "integer", "minimum": 1}}},
        "inputs": {"type": "array", "maxItems": 5, "items": {"$ref": "#/$defs/input"}},
    },
    "$defs": {
        "input": {
            "type": "object",
            "required": ["name", "io_type"],
            "properties": {"name": {"type": "string"}, "io_type": {"enum": ["A", "N"]}, "citation": {"type": "array", "items": {"type": "integer", "minimum": 1}}},
            "additionalProperties": False,
        }
    },
}

CRITERIA = [dc.Criterion("A", "WHY", "purpose", "CRITICAL"), dc.Criterion("A", "IN", "inputs"), dc.Criterion("B", "FLOW", "data_flow"), dc.Criterion("B", "IN", "inputs", "MEDIUM")]


def _documents(spark, d) -> DataFrame:
    """(file_id, file_type, text): a document an order."""
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    n, p, quoted = F.row_number().over(within), F.col("l_partkey"), lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    name = F.when(p % 10 == 0, "").otherwise(F.concat(F.lit('"name": "'), F.when(p % 4 == 1, " ").otherwise(F.concat(F.lit("F"), p.cast("string"))), F.lit('", ')))
    entry = F.concat(F.lit("{"), name, F.lit('"io_type": '), quoted(F.col("l_returnflag")), F.lit(', "citation": ['), n.cast("string"), F.lit(", "), (p % 3).cast("string"), F.lit("]"), F.when(p % 13 == 0, ', "extra": null').otherwise(""), F.lit("}"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    entries = lines.dealt(rows, "l_orderkey", 20000).select(F.col("l_orderkey").alias("o"), n.alias("n"), entry.alias("entry")).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("e"))
    o = F.col("o")
    program = F.when(o % 7 == 0, "null").otherwise(quoted(F.concat(F.lit("O"), o.cast("string"))))
    count = F.when(o % 11 == 0, '"1"').otherwise((o % 5).cast("string"))
    inputs = F.when(o % 19 == 0, "").otherwise(F.concat(F.lit('"inputs": ['), F.array_join(F.transform("e", lambda x: x["entry"]), ", "), F.lit("], ")))
    summary = F.concat(F.lit('"purpose": {"summary": '), quoted(F.repeat(F.lit("s"), (o % 40).cast("int"))), F.lit("}, "))
    flow = F.when(o % 3 == 0, '"data_flow": {"reads": [], "_n": 1}').when(o % 3 == 1, '"data_flow": {"reads": [{"name": " ", "citation": 2}], "n": null}').otherwise('"data_flow": {"reads": [], "writes": [{"name": "x"}]}')
    text = F.concat(F.lit('{"header": {"program_id": '), program, F.lit(', "iteration_count": '), count, F.lit("}, "), inputs, summary, flow, F.lit("}"))
    text = F.when(o % 17 == 0, F.left(text, F.lit(30))).otherwise(text)
    return entries.select(o.alias("file_id"), F.when(o % 2 == 0, "A").otherwise("B").alias("file_type"), text.alias("text"))


LI = """li AS (SELECT l_orderkey AS o, l_partkey AS p, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS i FROM lineitem),
os AS (SELECT o, count(*) AS k, bool_or(p % 10 <> 0 AND p % 4 <> 1 OR f IS NOT NULL) AS says FROM li GROUP BY o)"""


@registry.add("""WITH k AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, '/k' AS path, problem FROM (SELECT event_id, unnest(CASE WHEN k IS NULL THEN ['required'] ELSE list_concat(CASE WHEN k > 90 THEN ['maximum'] ELSE [] END, CASE WHEN k % 10 = 7 THEN ['not'] ELSE [] END) END) AS problem FROM k)""")
def event_property_problems(spark, d):
    return dc.problems(table(spark, d, "events"), PROPS, "event_id", "props")


@registry.add(f"""WITH {LI}, found AS (SELECT o, '' AS path, 'not JSON' AS problem FROM os WHERE o % 17 = 0
  UNION ALL SELECT o, '/header/program_id', CASE WHEN o % 7 = 0 THEN 'type' ELSE 'pattern' END FROM os WHERE o % 17 <> 0 AND (o % 7 = 0 OR o % 10 = 9)
  UNION ALL SELECT o, '/header/iteration_count', CASE WHEN o % 11 = 0 THEN 'type' ELSE 'minimum' END FROM os WHERE o % 17 <> 0 AND (o % 11 = 0 OR o % 5 = 0)
  UNION ALL SELECT o, '/inputs', CASE WHEN o % 19 = 0 THEN 'required' ELSE 'maxItems' END FROM os WHERE o % 17 <> 0 AND (o % 19 = 0 OR k > 5)
  UNION ALL SELECT o, '/inputs/' || i || r.place, r.problem FROM li, LATERAL (SELECT unnest([{{'place': '/name', 'problem': CASE WHEN p % 10 = 0 THEN 'required' END}}, {{'place': '/io_type', 'problem': CASE WHEN f NOT IN ('A', 'N') THEN 'enum' END}},
    {{'place': '/citation/1', 'problem': CASE WHEN p % 3 = 0 THEN 'minimum' END}}, {{'place': '/extra', 'problem': CASE WHEN p % 13 = 0 THEN 'additionalProperties' END}}]) AS r) WHERE o % 17 <> 0 AND o % 19 <> 0 AND r.problem IS NOT NULL)
SELECT o AS file_id, path, problem FROM found""")
def document_problems(spark, d):
    return dc.problems(_documents(spark, d), ORDER)


@registry.add(f"""WITH {LI} SELECT o AS file_id, r.name, r.section, r.priority FROM os, LATERAL (SELECT unnest([
  CASE WHEN o % 2 = 0 AND (o % 17 = 0 OR o % 40 < 20) THEN {{'name': 'WHY', 'section': 'purpose', 'priority': 'CRITICAL'}} END,
  CASE WHEN o % 17 = 0 OR o % 19 = 0 OR NOT says THEN {{'name': 'IN', 'section': 'inputs', 'priority': CASE WHEN o % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END}} END,
  CASE WHEN o % 2 = 1 AND (o % 17 = 0 OR o % 3 <> 2) THEN {{'name': 'FLOW', 'section': 'data_flow', 'priority': 'HIGH'}} END]) AS r) WHERE r IS NOT NULL""")
def document_criteria(spark, d):
    docs = _documents(spark, d)
    return dc.failed_criteria(docs.withColumn("value", F.try_parse_json("text")), CRITERIA)
