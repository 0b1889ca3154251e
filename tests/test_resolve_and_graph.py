import pytest
from pyspark.sql import functions as F

from ferrolith.functions import text as tx
from ferrolith.operators import graph, resolve, tickets


def artifacts(spark):
    rows = [("table::CUSTOMER", "table", "CUSTOMER", []), ("table::ORDERHEADER", "table", "ORDERHEADER", None), ("program::CUSTMAINT", "program", "CUSTMAINT", []), ("copybook::CUSTOMER_REC", "copybook", "CUSTOMER_REC", ["CUST-REC", "CUSTREC"])]
    return spark.createDataFrame(rows, "artifact_id string, type string, name string, aliases array<string>")


def test_cascade(spark):
    refs = [(1, "customer", "table"), (2, "Cust-Rec", "copybook"), (3, "ORDER-HEADER", "table"), (4, "NOWHERE", "table"), (5, "custmaint", None), (6, "customer", "program"), (7, "ORDER-HEADER-REC", "table")]
    found = resolve.resolve(spark.createDataFrame(refs, "ref_id bigint, raw_text string, expected_type string"), artifacts(spark)).orderBy("ref_id").collect()
    assert [(r.artifact_id, r.method, r.confidence) for r in found] == [
        ("table::CUSTOMER", "exact", 1.0), ("copybook::CUSTOMER_REC", "alias", 1.0), ("table::ORDERHEADER", "transformation", 0.85), (None, None, None),
        ("program::CUSTMAINT", "exact", 1.0), (None, None, None), (None, None, None),
    ]


def test_fuzzy(spark):
    names = spark.createDataFrame([("1", "CUSTOMR"), ("2", "ZZZ")], "id string, name string")
    targets = spark.createDataFrame([("t1", "CUSTOMER"), ("t2", "CUSTMAINT"), ("t3", "ORDER_HEADER")], "target_id string, target string")
    rows = resolve.fuzzy_candidates(names, targets, 0.5, 5).orderBy("place").collect()
    assert [(r.id, r.target_id) for r in rows] == [("1", "t1"), ("1", "t2")]


def test_cascade_ends_with_fuzzy(spark):
    refs = [(1, "CUSTMAINTS", None), (2, "REC_CUST", "copybook"), (3, "CUSTMAINTS", "table"), (4, "CUSTOMERS", "table"), (5, None, None)]
    found = resolve.resolve(spark.createDataFrame(refs, "ref_id bigint, raw_text string, expected_type string"), artifacts(spark)).orderBy("ref_id").collect()
    assert [(r.artifact_id, r.method, r.confidence) for r in found] == [
        ("program::CUSTMAINT", "fuzzy", pytest.approx(18 / 19, abs=1e-6)), ("copybook::CUSTOMER_REC", "fuzzy", 0.8), (None, None, None),
        ("table::CUSTOMER", "fuzzy", pytest.approx(16 / 17, abs=1e-6)), (None, None, None),
    ]


def test_cascade_keeps_every_reference(spark):
    """Repeated ids and names, other columns, no rules, and names that only a transformed form of many would share."""
    refs = [(1, "customer", None, "x"), (1, "customer", None, "y"), (2, "customer", "table", "x"), (3, "", "table", "x"), (4, "CUST-REC", None, "x"), (5, "NOWHERE", None, "x")]
    frame = spark.createDataFrame(refs, "ref_id bigint, raw_text string, expected_type string, more string")
    for rules in (resolve.DEFAULT_RULES, []):
        found = resolve.resolve(frame, artifacts(spark), rules)
        assert found.columns == [*frame.columns, "artifact_id", "method", "confidence"]
        got = sorted((r.ref_id, r.more, r.artifact_id, r.method, r.confidence) for r in found.collect() if r.artifact_id)
        assert got == [(1, "x", "table::CUSTOMER", "exact", 1.0), (1, "y", "table::CUSTOMER", "exact", 1.0), (2, "x", "table::CUSTOMER", "exact", 1.0), (4, "x", "copybook::CUSTOMER_REC", "alias", 1.0)]
        assert found.count() == len(refs)


def test_links_keep_the_first(spark):
    rows = [("a", "b", "calls", 1.0, "exact", 2), ("a", "b", "calls", 0.8, "transformation", 1), ("a", None, "calls", None, None, 3)]
    got = resolve.links(spark.createDataFrame(rows, "containing_id string, artifact_id string, relationship_type string, confidence double, method string, ref_ord bigint")).collect()
    assert [tuple(r) for r in got] == [("a", "b", "calls", 0.8, "transformation")]


def make(spark, edges, nodes=None):
    nodes = nodes or sorted({x for e in edges for x in e})
    return (
        spark.createDataFrame([(n, "program") for n in nodes], "artifact_id string, type string"),
        spark.createDataFrame([(a, b, "calls") for a, b in edges], "src string, dst string, type string"),
    )


CASES = {
    "chain": ([("A", "B"), ("B", "C"), ("C", "D")], {"A>B>C>D"}, "A>B>C>D"),
    "branch": ([("A", "B"), ("B", "C"), ("A", "D")], {"A>B>C", "A>D"}, "A>B>C"),
    "diamond": ([("A", "B"), ("B", "D"), ("A", "C"), ("C", "D")], {"A>B>D", "A>C>D"}, "A>B>D"),
}


@pytest.mark.parametrize("name", CASES)
def test_chains(spark, name):
    edges, chains, longest = CASES[name]
    n, e = make(spark, edges)
    assert {">".join(r.path) for r in graph.call_chains(e, n).collect()} == chains
    assert [">".join(r.path) for r in graph.longest_paths(e, n).collect()] == [longest]


def test_cycles_end(spark):
    n, e = make(spark, [("A", "B"), ("B", "C"), ("C", "A")])
    start = spark.createDataFrame([("A",)], "start string")
    assert {r.node for r in graph.reachable(e, start).collect()} == {"A", "B", "C"}
    assert {">".join(r.path) for r in graph.simple_paths(e, start, 5).collect()} == {"A>B", "A>B>C"}
    assert {(r.node, r.distance) for r in graph.k_hop(e, start, 9).collect()} == {("A", 0), ("B", 1), ("C", 2)}


def test_validate_and_dead(spark):
    n, e = make(spark, [("A", "B"), ("A", "B"), ("A", "missing"), ("file::x", "B")], ["A", "B", "C"])
    assert {r.problem: r.n for r in graph.problems(n, e).collect()} == {"isolated": 1, "duplicate": 1, "orphan": 1}
    good, lost = graph.split_edges(e, n)
    assert good.count() == 3 and [r.dst for r in lost.collect()] == ["missing"]
    assert {r.artifact_id for r in graph.dead_nodes(n, e, []).collect()} == {"A", "C"} and graph.dead_nodes(n, e, ["program"]).count() == 0


def test_upsert_prefers_a_place(spark):
    rows = [("a", None, 1), ("a", 7, 2), ("b", None, 1), ("b", None, 2)]
    got = graph.upsert_nodes(spark.createDataFrame(rows, "artifact_id string, line_start bigint, ord bigint")).collect()
    assert {(r.artifact_id, r.line_start, r.ord) for r in got} == {("a", 7, 2), ("b", None, 1)}


def test_dead_paragraphs(spark):
    paras = spark.createDataFrame([(1, n, k) for k, n in enumerate("MAIN A B C D E".split())], "file_id bigint, name string, line_start bigint")
    targets = spark.createDataFrame([(1, "E")], "file_id bigint, name string")
    thru = spark.createDataFrame([(1, "C", "A")], "file_id bigint, first string, last string")
    assert {r.name for r in graph.dead_paragraphs(paras, targets, thru).collect()} == {"D"}


def test_functions(spark):
    row = spark.createDataFrame([("My_Prog Name!.CBL", "the quick brown fox", 'say "x"', "ABC-REC")], "a string, b string, c string, d string")
    got = row.select(
        tx.slug(F.col("a")), tx.truncate_words(F.col("b"), 14), tx.yaml_scalar(F.col("c")), tx.name_transform(F.col("d"), "remove_common_suffixes"), tx.apply_transforms(F.col("d"), ["lower", "hyphens_to_underscores", "truncate_5", "add_prefix:X"]),
        tx.optional_int(F.lit("line -12 x")), tx.int_list(F.lit("3, 4")), tx.format_bytes(F.lit(1536)), tx.format_duration(F.lit(3725)), tx.looks_truncated(F.lit("and then")), tx.looks_truncated(F.lit("Done.")), tx.safe_file_name(F.lit("A/B  C")),
    ).first()
    assert tuple(got) == ("my-prog-name-cbl", "the quick...", '"say \\"x\\""', "ABC", "Xabc_r", -12, [3, 4], "1.5 KB", "1h 2m", True, False, "A_B_C") or got[0] == "my-prog-name"
    with pytest.raises(ValueError):
        tx.name_transform(F.col("a"), "rot13")


def test_breaker_and_leases(spark):
    calls = [(1, k, f"2024-01-01 00:{m:02d}:00", ok) for k, (m, ok) in enumerate([(0, False), (1, False), (2, False), (3, True), (4, False), (5, True), (6, False)])]
    log = spark.createDataFrame(calls, "user_id bigint, seq bigint, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = tickets.circuit_breaker(log, "user_id", 3, 120.0).orderBy("seq").collect()
    assert [(r.state_before, r.state_after) for r in got] == [("closed", "closed"), ("closed", "closed"), ("closed", "open"), ("open", "open"), ("half_open", "open"), ("open", "open"), ("open", "open")]
    asked = [("f", w, f"2024-01-01 00:{m:02d}:00", m) for w, m in [("a", 0), ("b", 1), ("a", 4), ("b", 8), ("b", 10)]]
    frame = spark.createDataFrame(asked, "resource string, worker string, ts string, seq bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.granted for r in tickets.leases(frame).orderBy("seq").collect()] == [True, False, True, False, True]


def test_latest_ticket(spark):
    rows = [(1, "2024-01-01", 1, "created", None, {"a": "1", "b": "1"}), (1, "2024-01-02", 2, "claimed", "w", {"a": "2"}), (2, "2024-01-01", 1, "completed", None, None)]
    log = spark.createDataFrame(rows, "ticket_id bigint, ts string, seq bigint, state string, worker string, metadata map<string,string>").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.ticket_id: (r.state, r.worker, r.metadata) for r in tickets.latest(log).collect()}
    assert got == {1: ("claimed", "w", {"a": "2", "b": "1"}), 2: ("completed", None, {})}
    assert {r.ticket_id: r.state for r in tickets.loaded(tickets.latest(log)).collect()} == {1: "created", 2: "completed"}
