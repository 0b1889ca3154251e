import json

import pytest
from pyspark.sql import functions as F

from ferrolith.operators import graph, lines, statements
from ferrolith.plans import catalog

SF = "/root/testdata/sf0.001"

ONE_PASS = ["cobol_paragraphs", "cobol_statements", "cobol_program_edges", "cobol_program_nodes"]
BY_FILE = ["cobol_bodies", "cobol_dead_paragraphs"]
# a shuffle follows where rows come back from Python, or where one small part is spread
OTHERS = ["cobol_data_items", "cobol_tree_statistics", "cobol_dead_in_trees", "cobol_paragraph_facts", "cobol_tree_round_trip", "cobol_accesses"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ONE_PASS + BY_FILE + OTHERS)
def test_programs_are_dealt_once_and_not_broadcast(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert "Broadcast" not in plan and "FlatMapGroupsInPandas" not in plan and "REPARTITION_BY_NUM" in plan
    if name in ONE_PASS + BY_FILE:
        assert "ENSURE_REQUIREMENTS" not in plan
    if name in ONE_PASS:
        assert plan.count("REPARTITION_BY_NUM") == 1


def test_dealt_parts_grow_with_rows(spark):
    parts = lambda n: lines.dealt(spark.range(n), "id", 100).rdd.getNumPartitions()
    assert (parts(0), parts(100), parts(1001)) == (1, 1, 11)


def test_dead_paragraphs_with_names_that_repeat(spark):
    paras = spark.createDataFrame([(1, n, k) for k, n in enumerate("MAIN A B A C D B".split())] + [(2, "ONLY", 1)], "file_id bigint, name string, line_start bigint")
    none = spark.createDataFrame([], "file_id bigint, name string")
    thru = spark.createDataFrame([(1, "C", "A"), (1, "D", "LOST")], "file_id bigint, first string, last string")
    # from the first A to C all are performed, and so is the last B by its name
    assert {(r.name, r.line_start) for r in graph.dead_paragraphs(paras, none, thru).collect()} == {("D", 5)}
    assert {(r.name, r.line_start) for r in graph.dead_paragraphs(paras, none, thru.where("first = 'D'")).collect()} == {("A", 1), ("B", 2), ("A", 3), ("C", 4), ("D", 5), ("B", 6)}


def test_many_trees_leave_as_few_frames(spark):
    one = {"paragraphs": [{"name": "P", "statements": [{"type": "IF", "text": "IF A", "children": [{"type": "MOVE", "text": "MOVE 1 TO B"}]}]}]}
    texts = spark.createDataFrame([(json.dumps({**one, "program_id": str(k)}),) for k in range(300)], "json string").coalesce(1)
    found = statements.flatten_json(texts).withColumn("part", F.spark_partition_id())
    assert found.count() == 600 and found.where("parent_id = 1 and depth = 2").count() == 300


@pytest.mark.parametrize("name", ["cobol_phrase_matches", "cobol_chunks"])
def test_order_programs_are_shuffled_once(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan


def test_chunks_are_found_in_one_sorted_pass(spark):
    plan = _plan(catalog.QUERIES["cobol_chunks"](spark, SF))
    # order lines are numbered, then their programs' lines are sorted once; nothing is gathered and taken apart again
    assert "collect_list" not in plan and "Join" not in plan and plan.count("Generate explode") == 1 and plan.count("MapInArrow") == 1 and plan.count("Sort [") <= 2


@pytest.mark.parametrize("name", ["cobol_phrase_matches", "cobol_phrase_coverage", "cobol_required_phrases"])
def test_phrases_are_found_in_one_sorted_pass(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert "collect_list" not in plan and "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan and plan.count("MapInArrow") == 1


def test_lost_edges_are_found_without_broadcast(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("x", "a"), ("file::1", "a"), ("a", "y"), ("file::1", "y"), (None, "a"), ("a", None)], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "artifact_id string")
    lost = graph.split_edges(edges, nodes)[1]
    assert sorted(map(str, lost.collect())) == sorted(map(str, edges.where("src = 'x' or dst = 'y' or dst is null").collect()))
    assert "Broadcast" not in _plan(lost) and "REPARTITION_BY_NUM" in _plan(lost)
