import pytest

from ferrolith.llm import mixing as m
from tests.conftest import against_duckdb
from tests.llm.cases import AWKWARD, documents, saved, with_clashes


def targets(sizes, weights=(1, 2, 3), most=3):
    """By sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = dict.fromkeys(names, 0.0)
    left, open_ = float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share = sum(weight[s] for s in open_)
        for s in open_:
            out[s] += left * weight[s] / share
        left = 0.0
        for s in list(open_):
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
                open_.discard(s)
    return out


def case(spark):
    texts, sources = [], []
    for i in range(900):
        texts.append(" ".join(["w"] * (i * 7919 % 40)))
        sources.append(["big", "big", "big", "a", None, "z%d" % (i % 50), "Ä"][i % 7])
    return documents(spark, texts + AWKWARD, sources + ["odd"] * len(AWKWARD))


def test_targets_are_met(spark, tmp_path):
    saved(case(spark), tmp_path, "documents")
    rows = m.op8_source_mixing(spark, str(tmp_path)).collect()
    source = {r.doc_id: r.source for r in case(spark).collect()}
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        largest[s] = max(largest.get(s, 0), r.size)
        assert 0 <= r.taken <= 3 * r.size
    want = targets(sizes)
    assert {r.doc_id: r.source_size for r in rows} == {r.doc_id: sizes[source[r.doc_id]] for r in rows}
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(rows) == sorted(m.op8_source_mixing(spark, str(tmp_path)).collect())


def test_oracle_with_ties_and_nulls(spark, tmp_path):
    ids = [None if i % 11 == 0 else i // 2 for i in range(900 + len(AWKWARD))]
    docs = case(spark).toPandas()
    docs["doc_id"] = [None if i is None else i for i in ids]
    rows = [(i, t, "en", s, 0) for i, t, s in zip(ids, docs.text, docs.source)]
    saved(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), tmp_path, "documents")
    a, b = against_duckdb(m.op8_source_mixing(spark, str(tmp_path)), m.OP8_SQL, str(tmp_path))
    assert a == b and len(a) == len(ids)
    sf = "/root/testdata/sf0.01"
    a, b = against_duckdb(m.op8_source_mixing(spark, sf), m.OP8_SQL, sf)
    assert a == b


def test_documents_are_repeated_with_their_columns(spark):
    docs = with_clashes(case(spark), "hash", "size", "copies", "source_size")
    out = m.mixed_documents(docs)
    assert out.columns == docs.columns and 0 < out.count() < 3 * docs.count()
    assert m.mixed_documents(docs.limit(0)).count() == 0
