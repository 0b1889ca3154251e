from collections import Counter

import corpus_pipeline as cp

from ferrolith.llm import quality_rules as q
from tests.llm.cases import documents
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_near_duplicates import brute as near_brute
from tests.llm.test_quality_rules import brute as counts_brute

SF = "/root/testdata/sf0.001"


def test_stages_in_turn_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables, columns = {}, docs.columns
    before = {"start": docs}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = before[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns or name == cp.STAGES[-1][0]
        tables[name] = docs.collect()
    start = before["start"].collect()

    kept = {r.doc_id for r in tables["quality rules"]}
    for r in start:
        n, _, _, _, repeat = counts_brute(r.text)
        assert not (n < 20 or 100 * repeat > 30 * n) or r.doc_id not in kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r.doc_id for r in start if labels.get(r.doc_id) == 1 and counts_brute(r.text)[0] >= 20 and 100 * counts_brute(r.text)[4] <= 30 * counts_brute(r.text)[0]]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)

    source = sorted(tables["quality rules"], key=lambda r: r.doc_id)
    want = {r.doc_id: x[2] for r, x in zip(source, lines_brute([r.text for r in source], 10))}
    assert {r.doc_id: (r.text, r.n_chars) for r in tables["line dedup"]} == {i: (t, len(t)) for i, t in want.items()}

    source = sorted(tables["line dedup"], key=lambda r: r.doc_id)
    want = {i for i, _, _, k in near_brute([r.doc_id for r in source], [r.text for r in source], 5, 80) if k}
    assert Counter(r.doc_id for r in tables["near dedup"]) == Counter(want)

    times = Counter(r.doc_id for r in tables["source mixing"])
    assert set(times) <= want and max(times.values()) <= 3
    text = {r.doc_id: r.text for r in tables["near dedup"]}
    assert all(r.text == text[r.doc_id] for r in tables["source mixing"])

    last = tables["sentencepiece"]
    assert {r.doc_id for r in last} == set(times) and all(r.round_trip for r in last)


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "ids", "log_inclusion"} <= set(out.columns) and out.count() > 0 and cp.ORACLE_SQL is None
    assert len(cp.STAGES) == 5 and q.SAMPLE_ROWS > 0


def test_words_that_only_begin_like_a_piece_pass_the_last_stage(spark):
    docs = documents(spark, ["a differeauyp of words", "an informaabnc", "plain"])
    rows = cp.pieces_stage(spark, docs, "").collect()
    assert {r.doc_id for r in rows} == {0, 1, 2} and all(r.round_trip for r in rows)
