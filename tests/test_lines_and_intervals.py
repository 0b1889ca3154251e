import pytest
from pyspark.sql import functions as F

from ferrolith.operators import chunking, intervals, lines, patterns


def src(spark, *texts):
    return lines.explode_lines(spark.createDataFrame(list(enumerate(texts)), "file_id bigint, content string"))


def test_lines_round_trip(spark):
    texts = ["a\nb\n", "", None, "x"]
    rows = src(spark, *texts)
    assert {r.file_id: r.content for r in lines.join_lines(rows).collect()} == {0: "a\nb\n", 1: "", 2: "", 3: "x"}


def test_flags(spark):
    rows = lines.flag_lines(src(spark, "a\n\na\n" + "x" * 201)).orderBy("line_no").collect()
    assert [(r.is_blank, r.is_long, r.is_repeated) for r in rows] == [(False, False, True), (True, False, False), (False, False, True), (False, True, False)]


def test_fixed_format_and_continuations(spark):
    text = "000100 IDENTIFICATION DIVISION.\n000200*COMMENT\n000300     MOVE 'ABC\n000400-    'DEF' TO X.\n\n000500     STOP RUN."
    code = lines.fixed_format(src(spark, text))
    assert [r.is_comment for r in code.orderBy("line_no").collect()] == [False, True, False, False, False, False]
    merged = lines.merge_continuations(code).orderBy("line_no").collect()
    assert [(r.line_no, r.last_line, r.text.strip()) for r in merged] == [(1, 1, "IDENTIFICATION DIVISION."), (3, 4, "MOVE 'ABCDEF' TO X."), (6, 6, "STOP RUN.")]


def test_strips(spark):
    row = spark.createDataFrame([("123456ABCDEF   ", "a /* b\n c */ d", "x = \"q'q\" + 'y'")], "a string, b string, c string")
    got = row.select(lines.strip_left(F.col("a"), 6), lines.strip_right(F.col("a"), 8), lines.strip_block_comments(F.col("b")), lines.mask_quoted(F.col("c"))).first()
    assert tuple(got) == ("ABCDEF   ", "123456AB", "a  d", "x = \"\" + ''")


def test_ranges_and_bodies(spark):
    rows = src(spark, "one\nA.\nx\ny\nB.\nz")
    heads = rows.where(F.col("text").rlike(r"^[A-Z]\.")).select("file_id", "line_no", F.col("text").alias("name"))
    ranges = lines.header_ranges(heads, rows.groupBy("file_id").agg(F.max("line_no").alias("last_line")))
    assert sorted(tuple(r)[1:] for r in ranges.collect()) == [("A.", 2, 4), ("B.", 5, 6)]
    assert {r.name: r.body for r in lines.bodies(rows, ranges).collect()} == {"A.": "A.\nx\ny", "B.": "B.\nz"}


def windows(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "file_id bigint, start_line bigint, end_line bigint, score double, reason string")


@pytest.mark.parametrize(
    "rows, grow, want",
    [
        ([(10, 30, 0.8, "a"), (25, 45, 0.7, "b")], 0, [(10, 45, 0.8, "a")]),
        ([(10, 20, 0.8, "a"), (50, 60, 0.9, "b")], 5, [(5, 25, 0.8, "a"), (45, 65, 0.9, "b")]),
        ([(10, 20, 0.8, "z"), (21, 30, 0.8, "b")], 0, [(10, 30, 0.8, "b")]),
        ([(10, 50, 0.1, "a"), (12, 13, 0.2, "b"), (51, 52, 0.3, "c"), (54, 55, 0.1, "d")], 0, [(10, 52, 0.3, "c"), (54, 55, 0.1, "d")]),
        ([(2, 3, 0.5, "a")], 5, [(1, 8, 0.5, "a")]),
    ],
)
def test_merge_windows(spark, rows, grow, want):
    assert sorted(tuple(r)[1:] for r in intervals.merge_windows(windows(spark, rows), "file_id", grow).collect()) == want


def test_budget_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, k, c) for k, c in enumerate([50, 60, 30, 15])], "file_id bigint, k bigint, cost bigint")
    assert [r.k for r in intervals.select_in_budget(items, "file_id", [F.col("k")], "cost", 100).orderBy("k").collect()] == [0, 2, 3]


def test_greedy_batches_keep_large_items_alone(spark):
    items = spark.createDataFrame([(1, k, c) for k, c in enumerate([5, 99, 3, 3, 3, 3])], "file_id bigint, k bigint, cost bigint")
    assert [r.batch for r in intervals.greedy_batches(items, "file_id", "k", "cost", 10, 3).orderBy("k").collect()] == [0, 1, 2, 2, 2, 3]


def test_preceding_start_and_covering_range(spark):
    points = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 3)], "file_id bigint, line_no bigint")
    starts = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 8, "c")], "file_id bigint, line_start bigint, name string")
    found = intervals.preceding_start(points, starts, "file_id", "line_no", "line_start", "name")
    assert {(r.file_id, r.line_no): r.name for r in found.collect()} == {(1, 1): None, (1, 5): "a", (1, 9): "c", (2, 3): None}
    ranges = starts.withColumn("line_end", F.col("line_start") + 1)
    assert {(r.file_id, r.line_no): r.name for r in intervals.covering_range(points, ranges, "file_id", "line_no").collect()} == {(1, 1): "UNKNOWN", (1, 5): "a", (1, 9): "c", (2, 3): "UNKNOWN"}


def test_overlaps_across_bins(spark):
    a = spark.createDataFrame([(1, "a", 1, 500), (1, "b", 70, 71)], "file_id bigint, name string, line_start bigint, line_end bigint")
    got = {(r.name_a, r.name_b) for r in intervals.overlapping(a, a, "file_id").collect()}
    assert got == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")} and intervals.overlapping(a, a, "file_id").count() == 4


def test_chunks_end_after_blank_lines_and_cover_the_file(spark):
    text = ["x" * 20] * 5 + [""] + ["y" * 20] * 9 + ["def f():"] + ["z" * 20] * 3
    assert chunking.chunk_ends(text, 170) == [6, 14, 19]
    assert chunking.chunk_ends(["q" * 999], 10) == [1]
    files = spark.createDataFrame([(1, "\n".join(text)), (2, None)], "file_id bigint, content string")
    rows = chunking.chunk_files(files, 40).orderBy("file_id", "seq").collect()
    assert "\n".join(r.chunk for r in rows if r.file_id == 1) == "\n".join(text)
    assert [r.chunk for r in rows if r.file_id == 2] == [""]


def test_rules_are_checked():
    r = patterns.Rule
    assert patterns.rule_problems([r("a", "b", "("), r("a", "b", "x", 1)]) and not patterns.rule_problems(patterns.DOCUMENT_RULES)


def test_scope(spark):
    rows = patterns.in_scope(src(spark, "a\nH1:\nb\nH2:\nc"), r"^(H\d):", "file_id").orderBy("line_no").collect()
    assert [r.scope for r in rows] == [None, "H1", "H1", "H2", "H2"]
