import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ferrolith.llm import near_duplicates as nd
from ferrolith.llm.bytetext import chunks
from ferrolith.llm.components import components, forest
from tests.llm.cases import AWKWARD, documents, with_clashes


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(ids, texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and ids[a] is not None and ids[b] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in zip(ids, sets)]


def corpus(seed, groups=12, copies=9, words=60):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    texts = list(AWKWARD)
    for _ in range(groups):
        body = [word() for _ in range(rng.randrange(4, words))]
        for _ in range(rng.randrange(1, copies)):
            texts.append(" ".join(body))
            body = list(body)  # a chain of edits: the ends are far apart
            for _ in range(rng.randrange(0, 3)):
                body[rng.randrange(len(body))] = word()
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, block", [(1, 2000), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    docs = with_clashes(documents(spark, texts, ids=ids), "n_shingles", "component_id", "node")
    found = nd.near_duplicates(docs, 4).collect()
    assert sorted(map(tuple, found)) == sorted(brute(ids, texts, 4, 80))


@pytest.mark.parametrize("sizes", [(6000, 1), (6000, 30, 20), (500, 450, 1, 1), (1,) * 400, (60, 1)])
def test_tasks_of_a_large_group_hold_two_blocks_and_all_pairs_meet_once(spark, monkeypatch, sizes):
    monkeypatch.setattr(nd, "BLOCK", 100)
    rows = [(7, 1000 * c * len(sizes) + k, c) for c, n in enumerate(sizes) for k in range(n)]
    dealt = nd._dealt(spark.createDataFrame(rows, "band bigint, node bigint, component bigint"), "band", 20).toPandas()
    assert dealt.groupby("task").size().max() < 300
    assert sizes[0] < 6000 or len(dealt) < 2 * len(rows)
    component, met = dealt["component"].to_numpy(), 0
    for _, frame in dealt.groupby("task"):
        frame = frame.reset_index(drop=True)
        c = frame["component"].to_numpy()
        for left, right in nd._meetings(frame, "band"):
            apart = int((c[left][:, None] != c[right][None, :]).sum())
            met += apart // 2 if left is right else apart
    assert met == (len(rows) ** 2 - sum(n * n for n in sizes)) // 2 and set(component) == set(range(len(sizes)))


def test_ids_that_repeat_or_are_null(spark):
    texts = ["a b c d e f"] * 4 + ["p q r s t"] * 2
    ids = [5, 5, None, 3, None, 9]
    assert sorted(map(str, map(tuple, nd.near_duplicates(documents(spark, texts, ids=ids)).collect()))) == sorted(map(str, brute(ids, texts, 5, 80)))
    assert nd.near_duplicates(documents(spark, texts).limit(0)).count() == 0
    assert nd.without_ids(documents(spark, texts, ids=ids), spark.createDataFrame([(5,)], "doc_id bigint")).count() == 4


def test_signatures_estimate_similarity_and_fill_all_slots():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    for size in (1, 3, 40, 1000):
        a, b = pool[:size], pool[size // 10 : size + size // 10]
        doc = np.repeat([0, 1], [len(a), len(b)])
        s = nd.super_minhash(doc, np.concatenate([a, b]), 3)
        assert (s[2] == nd._FREE).all() and (s[:2] != nd._FREE).all()
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - real) < 0.13
        steps = s[0] >> np.uint64(32)
        assert steps.max() < 128 and (size < 1000 or steps.max() <= 3)


def test_common_elements_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300))) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    assert nd.common_elements(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(100, k) for k in range(101, 180)]
    links = [(b, a) if k % 2 else (a, b) for k, (a, b) in enumerate(chain + hub)] + [(7, 7), (3, 4), (3, 4)]
    random.Random(1).shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(8)).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}
    node, root = forest(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(node, root)) == {2: 1, 3: 1, 9: 8}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shingle_sets_of_chunks_do_not_depend_on_the_chunk():
    texts = [t.encode() if t is not None else None for t in corpus(5)]
    whole = [nd.sketch_chunk(c, 4) for c in chunks(pa.array(texts, pa.binary()))]
    alone = [nd.sketch_chunk(c, 4) for t in texts for c in chunks(pa.array([t], pa.binary()))]
    for name in ("n_shingles", "d1", "d2"):
        assert np.concatenate([w[name] for w in whole]).tolist() == np.concatenate([w[name] for w in alone]).tolist()
    assert sum([w["signature"] for w in whole], []) == sum([w["signature"] for w in alone], [])


def test_oracle(spark):
    from tests.conftest import against_duckdb

    sf = "/root/testdata/sf0.001"
    a, b = against_duckdb(nd.op6_near_duplicates(spark, sf), nd.OP6_SQL, sf)
    assert a == b and any(r[2] == "False" for r in a)
