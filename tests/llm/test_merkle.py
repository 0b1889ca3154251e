import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ferrolith.llm import merkle
from tests.conftest import against_duckdb
from tests.llm.cases import AWKWARD, DOCS, saved, with_clashes


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def grown(level):
    """All levels of one tree."""
    found = [level]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 8]) for i in range(0, len(found[-1]), 8)])
    return found


def up(tree, i, start):
    """The siblings on the way up, and what start folds to."""
    others = []
    for level in tree[:-1]:
        lo = i // 8 * 8
        run = level[lo : lo + 8]
        others += run[: i - lo] + run[i - lo + 1 :]
        start = h(*run[: i - lo], start, *run[i - lo + 1 :])
        i //= 8
    return others, start


def brute(rows):
    lower = str.maketrans(merkle.LETTERS, merkle.LETTERS.lower())
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = grown([x[2] for x in groups[g]])
    top = grown([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(groups[g]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            start = leaf(r, r.text.translate(lower)) if hit and r.text is not None else own
            below, mid = up(trees[g], i, start)
            above, end = up(top, k, mid)
            out.append((r.doc_id, own, trees[g][-1][0], top[-1][0], h(*below, *above), end, end == top[-1][0]))
    return sorted(out, key=str)


def table(spark, langs, ids, texts):
    rows = [(d, t, g, None if i % 5 == 0 else f"s{i % 3}", None if t is None or i % 7 == 0 else len(t)) for i, (d, t, g) in enumerate(zip(ids, texts, langs))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("langs", [["en"], ["en"] * 9, ["en"] * 8, [None, "en", "é", "zz", ""], ["en"] * 70 + ["de"] * 5 + [None] * 3, [f"l{i}" for i in range(30)] * 3])
def test_query_equals_brute_force(spark, tmp_path, langs):
    n = len(langs)
    ids = [None if i % 13 == 5 else i // 2 * 3 for i in range(n)]
    docs = table(spark, langs, ids, [(AWKWARD * n)[i] for i in range(n)])
    saved(with_clashes(docs, "leaf", "path", "idx", "n", "run", "digest", "root", "_g"), tmp_path, "documents")
    found = sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert found == brute(docs.collect())


def test_empty_table(spark, tmp_path):
    saved(table(spark, ["en"], [1], ["x"]).limit(0), tmp_path, "documents")
    assert merkle.op12_merkle_manifest(spark, str(tmp_path)).count() == 0


def test_sql_and_brute_force_over_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    found = merkle.op12_merkle_manifest(spark, folder)
    ours, sql = against_duckdb(found, merkle.OP12_SQL, folder)
    assert ours == sql and len(ours) == 200
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert {r.verified for r in found.collect()} == {True, False}


def test_numbers_of_a_group_over_many_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = merkle.numbered(rows, "g", ["v"])
        assert found.where("idx <> v or n <> 5000").count() == 0 and found.count() == 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_task_holds_a_group(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("idx"), F.lit(1000).cast("bigint").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    plan = merkle._runs(rows, "g")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and "_parent" in plan.split("hashpartitioning(g", 1)[1].split(")")[0] and "SinglePartition" not in plan
