import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.llm import neighbours as nn


def table(spark, vectors, ids=None):
    rows = [(int(i if ids is None else ids[i]) if ids is None or ids[i] is not None else None, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def brute(x, ids, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        other = np.flatnonzero(ids != ids[i])
        best = other[np.lexsort((ids[other], d[other]))][:k]
        out[int(ids[i])] = [(int(ids[b]), d[b]) for b in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_one_part_is_exact_with_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_ROWS", 37)  # several blocks of rows and of queries
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (450, 3)).astype(np.float32)
    x[::7] = [1, 1, 1]
    bad = {5: None, 6: [0, 0, 0], 9: [1, None, 2], 11: [1, float("nan"), 0], 12: [1, float("inf"), 0], 13: [1, 2], 300: [0, 0, 0]}
    rows = [bad.get(i, v) for i, v in enumerate(x)]
    ids = np.arange(450)
    ok = np.array([i not in bad and np.abs(x[i]).sum() > 0 for i in ids])
    got = found(nn.nearest(table(spark, rows), F.col("vec_id") % 100 == 0, sample_rows=16))
    want = brute(x[ok].astype(float), ids[ok])
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in got for a, b in zip(got[q], want[q]))


def test_vectors_of_other_lengths_meet_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [rng.normal(0, 1, 4 if i % 10 else 3) for i in range(300)]
    from tests.llm.cases import with_clashes

    docs = with_clashes(table(spark, rows), "part", "v", "q", "r", "rank", "score", "query_id")
    got = found(nn.nearest(docs, F.col("vec_id") % 50 == 0, sample_rows=256, parts=4, recall=1.0))
    x, ids = np.array([v for v in rows if len(v) == 3]).astype(np.float32).astype(float), np.array([i for i in range(300) if len(rows[i]) == 3])
    want = brute(x, ids)
    assert set(got) == set(range(0, 300, 50)) and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in (0, 100, 200))


def test_few_parts_are_probed_where_vectors_are_clustered(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (60, 24))
    x = (centres[rng.integers(0, 60, 6000)] + rng.normal(0, 0.15, (6000, 24))).astype(np.float32)
    ids = np.arange(6000)
    got, want = found(nn.nearest(table(spark, x), F.col("vec_id") % 100 == 0, parts=24)), brute(x.astype(float), ids)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert nn.fit_router(x[:4096].astype(float), 24).probes <= 8
    assert nn.parts_for(50_000) == 16 and nn.parts_for(10**6) == 71 and nn.parts_for(10**12) == 1024


def test_few_or_no_rows(spark):
    assert found(nn.nearest(table(spark, [[1, 0], [0, 1], [1, 1]]), F.col("vec_id") % 100 == 0)) == {0: [(2, 1.0), (1, pytest.approx(2**0.5))]}
    assert nn.nearest(table(spark, [[1, 0]]).limit(0), F.lit(True)).count() == 0
    assert nn.nearest(table(spark, [[1, 0]]), F.lit(True)).count() == 0
    assert found(nn.nearest(table(spark, [[1, 0], [1, 0], [2, 0]], [0, 0, None]), F.lit(True))) == {}


def test_recall_with_parts(spark):
    sf = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    t = vectors.toPandas()
    x, ids = np.stack(t.embedding.to_numpy()).astype(float), t.vec_id.to_numpy()
    got, want = found(nn.op10_nearest_neighbours(spark, sf)), brute(x, ids)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits / sum(map(len, want.values())) >= 0.9
    router = nn.fit_router(x)
    assert router.parts == nn.PARTS and router.probes < router.parts


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (8, 16))
    x = np.concatenate([c + rng.normal(0, 0.2, (60, 16)) for c in centres])
    graph = nn.neighbour_graph(x, 6)
    part = nn.balanced_parts(x, graph, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.05 * 60)
    assert (part[graph] == part[:, None]).mean() > 0.8
    assert nn.fit_router(x, parts=8).probes <= 3
