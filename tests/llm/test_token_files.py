import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ferrolith.llm import token_files as tf
from ferrolith.llm.bytetext import chunks
from tests.llm.cases import AWKWARD, documents, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.integers(0, (1 << bits) - 1), max_size=300), st.integers(0, 300), st.integers(0, 300))))
@settings(max_examples=80, deadline=None)
def test_pack_round_trip_and_random_access(case):
    bits, ids, lo, hi = case
    ids = np.array(ids * 40, "<u4")
    payload, offsets = tf.pack(ids, bits)
    assert len(offsets) == -(-len(ids) // tf.BLOCK_IDS) and len(payload) <= len(ids) * bits / 8 + len(offsets)
    assert (tf.unpack(payload, offsets, len(ids), bits) == ids).all()
    lo, hi = lo * 37, hi * 37
    assert (tf.unpack(payload, offsets, len(ids), bits, lo, hi) == ids[lo:hi]).all()


def test_bits():
    assert [tf.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


TEXTS = AWKWARD + ["nul \x00 word x\x00y \x00", "<|endoftext|> in text<|startoftext|>", "Don't we'll stop now \x1c x", "é ́ ß ΣΑΣ Σ", "12 3a4 !?! a!\x00!b"]


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_words_equal_the_library(limit):
    coder, plain = tf.WordEncoder(PATH, limit), Tokenizer.from_file(PATH)
    for _ in range(2):
        for texts in (TEXTS, TEXTS[::-1]):
            got = []
            for chunk in chunks(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 200):
                ids, sizes = coder.encode(chunk, 1)
                got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
            assert got == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


@pytest.mark.parametrize("limit", [0, 3, 4, 5, 8, 9])
def test_more_words_than_are_remembered(limit):
    """A chunk whose new words pass the limit, some of its words being known."""
    coder, plain = tf.WordEncoder(PATH, limit), Tokenizer.from_file(PATH)
    for text in ("alpha beta gamma", "alpha beta gamma delta epsilon zeta eta theta", "theta iota", "alpha beta gamma delta epsilon zeta eta theta iota kappa"):
        (chunk,) = chunks(pa.array([text.encode()], pa.binary()))
        assert coder.encode(chunk, 1)[0].tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def test_files_read_back(spark, monkeypatch):
    ids = [40, None, 7, 7, *range(100, 100 + len(TEXTS) - 4)]
    docs = with_clashes(documents(spark, TEXTS, ids=ids), "start", "n_tokens", "shard", "at").repartition(3)
    file = tf.write_tokens(docs, PATH)
    found = file.documents().collect()
    plain = Tokenizer.from_file(PATH)
    rows = sorted(zip(ids, TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc_id, text in rows:
        found_ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((doc_id, start, len(found_ids), zlib.crc32(found_ids.tobytes())))
        start += len(found_ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted((w[1], w[0], w[2], w[3]) for w in want)
    assert file.ids_of(40).tolist() == [1] and file.ids_of(100).tolist()[-1] == 1
    with pytest.raises(KeyError):
        file.ids_of(-5)
    assert tf.write_tokens(docs.limit(0), PATH).documents().count() == 0
