import base64
import hashlib

import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrolith.llm import byte_pairs as bp
from ferrolith.llm.bytetext import chunks
from tests.llm.cases import AWKWARD, documents, saved, with_clashes

PATH = tokenizers.path("byte_bpe_50k.tiktoken")


def plain(ranks):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs():
    return bp.BytePairs(PATH, tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(pairs):
    return plain(pairs.ranks)


TEXTS = AWKWARD + [
    "it's we'll 's's ''s \n's I'VE don't'", "a  b   c \n\n d\t\te  ", "x=1234567 ½²٣ 12ab", "中文字符测试" * 40, "ab" * 900 + "c", " theinand" * 300,
    "".join(np.random.default_rng(1).choice(list("etaoin"), 1500)), "<|endoftext|>", "\x1c\x85 　 x y", "👩‍👩‍👧 🇩🇪 é", "\x00\x00a\x00",
]


def encoded(pairs, texts, limit=1 << 21):
    got = []
    for chunk in chunks(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), limit):
        ids, counts = pairs.encode(chunk)
        assert pairs.decode(ids, counts) == [(t or "").encode() for t in texts[chunk.lo : chunk.hi]]
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return got


@pytest.mark.parametrize("limit", [300, 1 << 21])
def test_ids_equal_the_library(pairs, library, limit):
    assert encoded(pairs, TEXTS, limit) == [library.encode_ordinary(t or "") for t in TEXTS]


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=40, deadline=None)
def test_any_text_equals_the_library(pairs, library, texts):
    assert encoded(pairs, texts) == [library.encode_ordinary(t) for t in texts]


def definition(ranks, word):
    """The leftmost pair of minimum rank, one after another."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@given(st.permutations(["aa", "ab", "ba", "bb", "aab", "aba", "bab", "abb", "abab", "bba", "aaa", "bbbb"]), st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_any_order_of_ranks(tmp_path_factory, pieces, words):
    """Ranks in any order, also such that a contraction makes a pair of lower rank; both queries."""
    ranks = {bytes([b]): b for b in range(256)} | {p.encode(): 256 + i for i, p in enumerate(pieces)}
    path = tmp_path_factory.mktemp("ranks") / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % r for p, r in ranks.items()))
    own = bp.BytePairs(str(path), tokenizers.PATTERN)
    words = [w.encode() for w in words if w.encode() not in ranks]
    for query in (bp._SHORT, bp._LONG):
        if words:
            ids, counts = own._merged(words, query)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [definition(ranks, w) for w in words]


def test_forgetting_changes_nothing(library):
    for limit in (0, 3, 4):
        own = bp.BytePairs(PATH, tokenizers.PATTERN, limit)
        for texts in (["alpha beta gamma"], ["alpha beta gamma delta epsilon zeta eta theta"], ["theta alpha"]):
            assert encoded(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_gaps_and_bad_bytes():
    own = bp.BytePairs(PATH, "[a-z]+")
    (chunk,) = chunks(pa.array([b"ab 1 cd", "é xé".encode(), b"\xff\x80a\xc3"], pa.binary()))
    begin, stop, doc = own.words(chunk)
    body = chunk.data.tobytes()
    assert [(d, body[a:b]) for a, b, d in zip(begin, stop, doc)] == [(0, b"ab"), (0, b"cd"), (1, b"x"), (2, b"a")]
    with pytest.raises(ValueError):
        own.decode(np.array([50_300], np.int64), np.array([1]))


def test_query_equals_the_library(spark, tmp_path, library):
    ids = [None, 4, 4, *range(10, 10 + len(TEXTS) - 3)]
    docs = documents(spark, TEXTS, ids=ids)
    saved(with_clashes(docs, "n_tokens", "token_ids", "decoded"), tmp_path, "documents")
    found = [tuple(r) for r in bp.op11_byte_pairs(spark, str(tmp_path)).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(x := library.encode_ordinary(t or "")), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for d, t in zip(ids, TEXTS)]
    assert sorted(found, key=str) == sorted(want, key=str)
    back = bp.byte_pair_bytes(bp.byte_pair_ids(docs, PATH, tokenizers.PATTERN), PATH, tokenizers.PATTERN)
    assert back.selectExpr("count(*)", "sum(int(decoded = cast(coalesce(text, '') as binary)))").first()[:] == (len(TEXTS),) * 2
    saved(docs.limit(0), tmp_path, "documents")
    assert bp.op11_byte_pairs(spark, str(tmp_path)).count() == 0


def test_query_over_a_whole_table(spark, library):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bp.op11_byte_pairs(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        assert found[r.doc_id] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
