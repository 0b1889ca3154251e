import math
import re
from collections import Counter

import pytest

from ferrolith.llm import language_model as lm
from tests.conftest import against_duckdb
from tests.llm.cases import AWKWARD, documents, with_clashes


def brute(texts, alpha=0.4, least=2):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) for t in texts]
    one, two = Counter(w for s in split for w in s), Counter(p for s in split for p in zip(s, s[1:]))
    total, out = sum(one.values()), []
    for s in split:
        score, backed = 0.0, 0
        for i, w in enumerate(s):
            if i and two[s[i - 1], w] >= least:
                score += math.log(two[s[i - 1], w] / one[s[i - 1]])
            else:
                score += math.log(one[w] / total) + (math.log(alpha) if i else 0)
                backed += i > 0
        out.append((len(s), backed, score if s else None))
    return out


@pytest.mark.parametrize("words, pairs, least", [(1 << 20, 1 << 19, 2), (20, 10, 2), (30, 300, 1), (1, 1, 3)])
def test_equals_brute_force(spark, words, pairs, least):
    texts = AWKWARD + ["a b c a b d", "A B x", "c a b", "the cat sat", "z", "q r", "q r q s", "only here once"] * 3 + ["rare1 rare2 a rare1 b", "rare3 rare4", "rare3 rare4 x"]
    docs = with_clashes(documents(spark, texts), "k", "key", "o", "n_words", "count", "c")
    found = sorted(lm.stupid_backoff(docs, least=least, words=words, pairs=pairs).collect(), key=lambda r: r.doc_id)
    for r, (n, backed, score) in zip(found, brute(texts, least=least)):
        assert (r.n_words, r.n_backoff) == (n, backed)
        assert r.log_score is None if score is None else r.log_score == pytest.approx(score)
        assert r.mean_log_score is None if score is None else r.mean_log_score == pytest.approx(score / n)
    assert len(found) == len(texts)


def test_empty_table_and_repeated_rows(spark):
    docs = documents(spark, ["a b", "a b", None], ids=[1, 1, None])
    assert lm.stupid_backoff(docs.limit(0)).count() == 0
    assert sorted(r.n_words for r in lm.stupid_backoff(docs).collect()) == [0, 2, 2]


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    a, b = against_duckdb(lm.op4_lm_scores(spark, sf), lm.OP4_SQL, sf)
    assert a == b
