import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrolith.llm import line_dedup as ld
from tests.conftest import against_duckdb
from tests.llm.cases import AWKWARD, documents, saved, with_clashes


def key(line):
    plain = line.strip("\x20\x09\x0a\x0b\x0c\x0d")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in plain)


def brute(texts, least):
    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for lines in split for k in {key(x) for x in lines})
    out = []
    for lines in split:
        left = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


TEXTS = AWKWARD + ["Footer \nown line", " footer\nown line two\nfooter", "FOOTER", "a\n\nfooter\nb", "ünique\nFooter\t", "a\nc", "\x00footer"]


@pytest.mark.parametrize("least", [2, 4, 10])
def test_equals_brute_force(spark, least):
    clashes = ("n_lines", "n_dropped", "key", "pos", "_drop", "_lines", "_row", "drop", "lines", "row", "batch", "doc")
    docs = with_clashes(documents(spark, TEXTS), *clashes)
    out = ld.dedup_lines(docs, least, batches=5)
    assert out.columns == [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    found = out.collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found) == [(i, *x) for i, x in enumerate(brute(TEXTS, least))]
    assert all(r[c] == "clash" for r in found for c in clashes[2:])


def test_repeated_and_null_ids(spark):
    docs = documents(spark, ["x\ny", "x\ny", "x\nz", "x", "x\nv"], ids=[1, 1, 2, None, None])
    assert sorted(r.text for r in ld.dedup_lines(docs, 5).collect()) == ["x", "x\nv", "x\ny", "x\ny", "x\nz"]
    assert sorted(r.text for r in ld.dedup_lines(docs, 4).collect()) == ["", "v", "y", "y", "z"]
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_ids_equal_sql(spark, tmp_path):
    rows = [("common\nown %d" % (i % 7), i // 3 if i % 5 else None) for i in range(40)] + [("common", 3)] * 20 + [("rare\nline", 4)] * 12
    saved(documents(spark, [t for t, _ in rows], ids=[i for _, i in rows]), tmp_path, "documents")
    a, b = against_duckdb(ld.op1_line_dedup(spark, str(tmp_path)), ld.OP1_SQL, str(tmp_path))
    assert a == b and len(a) == len(rows)


def test_levels_are_compacted_and_hold_all_counts(spark):
    runs = ld.LineRuns(spark, fanout=2)
    for batch in (["a\nb"], ["a\nc", "a"], ["a"], ["d\nb"], ["a"]):
        runs.add(ld.document_keys(documents(spark, batch)).groupBy("key").agg(F.count("*").alias("n_docs")))
        assert all(len(level) < 2 for level in runs.levels)
    found = {bytes(r.key): r.n_docs for r in runs.counts().collect()}
    assert found == {hashlib.md5(k).digest(): n for k, n in ((b"a", 5), (b"b", 2), (b"c", 1), (b"d", 1))}
    keys = spark.createDataFrame([("a",), ("new",)], "line string").withColumn("key", ld.line_key(F.col("line")))
    assert [r.line for r in runs.unseen(keys).collect()] == ["new"]


def test_runs_are_merged_and_anti_joined_without_a_shuffle(spark):
    runs = ld.LineRuns(spark, buckets=5)
    for batch in (["a\nb"], ["a\nc", "a"], ["q"]):
        runs.add(ld.document_keys(documents(spark, batch)).groupBy("key").agg(F.count("*").alias("n_docs")))
    plan = runs.counts()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 12
    keys = spark.createDataFrame([("a",), ("new",)], "line string").withColumn("key", ld.line_key(F.col("line"))).repartition(5, "key")
    plan = runs.unseen(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 6 and plan.count("Exchange") == 1


def test_frequent_keys_are_never_counted_again(spark):
    runs = ld.LineRuns(spark, fanout=3, least=2)
    for batch in (["a\nb"], ["a\nc"], ["a\nb", "a"], ["a\nd"], ["a\nc"]):
        runs.add(ld.document_keys(documents(spark, batch)).groupBy("key").agg(F.count("*").alias("n_docs")))
    a, b, c, d = (hashlib.md5(k).digest() for k in (b"a", b"b", b"c", b"d"))
    held = [bytes(r.key) for run in runs.frequent_runs() for r in run.collect()]
    assert sorted(held) == sorted([a, b, c])
    # a was counted in two batches, then left out of three; compaction forgets what became frequent
    assert {bytes(r.key): r.n_docs for r in runs.counts().collect()} == {a: 2, b: 2, c: 2, d: 1}
    assert [sum(bytes(r.key) == a for r in run.collect()) for run in runs.runs()] == [0, 0, 0]
    assert len([t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]) == len(runs.runs()) + len(runs.frequent_runs())
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_nothing_stays_in_the_catalogue(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert ld.dedup_lines(documents(spark, ["a\nb"] * 12)).select("text").distinct().count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_text_longer_than_two_megabytes(spark):
    long = "\n".join(f"line {i}" for i in range(250_000))
    found = {r.doc_id: r for r in ld.dedup_lines(documents(spark, [long, "line 5\nother"]), 2, batches=2).collect()}
    assert len(long) > 1 << 21 and (found[0].n_lines, found[0].n_dropped, found[1].text) == (250_000, 1, "other")


def test_new_batches_lose_lines_of_earlier_ones(spark):
    runs = ld.LineRuns(spark)
    first = ld.dedup_new_lines(documents(spark, ["one\ntwo"]), runs)
    second = ld.dedup_new_lines(documents(spark, ["TWO \nthree", "three"]), runs)
    assert [r.text for r in first.collect()] == ["one\ntwo"]
    assert sorted(r.text for r in second.collect()) == ["three", "three"]


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    a, b = against_duckdb(ld.op1_line_dedup(spark, sf), ld.OP1_SQL, sf)
    assert a == b
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(text)
    want = dict(zip(order, brute([text[i] for i in order], 10)))
    for r in ld.op1_line_dedup(spark, sf).collect():
        assert (r.n_lines, r.n_dropped) == want[r.doc_id][:2] and r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest()
    assert re.fullmatch("[0-9a-f]{64}", r.kept_sha256)
