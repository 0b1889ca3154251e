import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrolith.llm import periodic_runs as pr
from tests.llm.cases import AWKWARD, documents, saved, with_clashes


def brute(words, least=12):
    """All runs, from the definition: every period, every maximal stretch, the smallest period only."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= 2 * q and not any((s, e + q) == (a, b) for a, b in found):
                found[s, e + q] = q
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q))


def runs_of(words, least=12):
    numbers = np.array(words, np.int64)
    n = len(numbers)
    found = pr.maximal_runs(np.unique(numbers, return_inverse=True)[1], np.full(n, n), np.zeros(n, np.int64), least)
    return [tuple(map(int, r)) for r in zip(*found)]


@given(st.integers(1, 3).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60)), st.integers(1, 12))
@settings(max_examples=400, deadline=None)
def test_runs_equal_the_definition(words, least):
    assert runs_of(words, least) == brute(words, least)


@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_repeated_blocks(parts):
    words = [w for block, times in parts for w in block * times]
    assert runs_of(words) == brute(words)


@pytest.mark.parametrize("words", [[0] * 3000, [0, 1] * 1500, ([0] * 50 + [1]) * 60, list(range(700)) * 4, [i * i % 7 for i in range(3000)]])
def test_long_periods(words):
    if len(set(words)) > 2 or len(words) > 2990:
        period = next(q for q in range(1, len(words)) if words[q:] == words[:-q])
        assert (0, len(words), period) in runs_of(words)
    else:
        assert runs_of(words[:600]) == brute(words[:600])


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def wanted(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    first = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    return (doc_id, len(runs), *first, sha(listed), sha(" ".join(kept)))


TEXTS = [t if t is None or len(t) < 4000 else t[:800] for t in AWKWARD] + ["a b " * 6 + "c " + "d e f d e f " * 3, "one two three four five six " * 4 + "tail", "x y z", "zz " * 12, "zz " * 11, "a a a b " * 9]


def test_query_equals_brute_force(spark, tmp_path):
    ids = [None, 3, 3, *range(100, 100 + len(TEXTS) - 3)]
    docs = documents(spark, TEXTS * 4, ids=ids + [None, *range(1000, 1000 + 3 * len(TEXTS) - 1)])
    saved(with_clashes(docs, "runs", "collapsed", "run_starts", "n_runs", "b"), tmp_path, "documents")
    found = sorted(map(tuple, pr.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    rows = docs.select("doc_id", "text").collect()
    assert found == sorted((wanted(r.doc_id, r.text) for r in rows), key=str)
    saved(docs.limit(0), tmp_path, "documents")
    assert pr.op13_periodic_runs(spark, str(tmp_path)).count() == 0


def test_query_over_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if r.text is None or len(r.text) < 4000]
    found = {r[0]: tuple(r) for r in pr.op13_periodic_runs(spark, folder).collect()}
    assert len(rows) > 100 and [found[r.doc_id] for r in rows] == [wanted(r.doc_id, r.text) for r in rows]


def test_spans_and_text(spark):
    docs = with_clashes(documents(spark, ["go on " * 7 + "end", None, ""]), "runs", "collapsed")
    found = pr.periodic_runs(docs).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.runs] for r in found] == [[(0, 14, 2)], [], []]
    assert [r.collapsed for r in found] == ["go on end", "", ""] and found[0].source is None
    assert pr.periodic_runs(docs, ["doc_id"], least=20).select(F.sum(F.size("runs"))).first()[0] == 0
