import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrolith.llm import byte_cnn as c
from ferrolith.llm.bytetext import chunks
from ferrolith.llm.samples import held_out, labelled_sample
from tests.llm.cases import AWKWARD, documents, with_clashes


def _toy():
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", np.uint8)
    texts, y = [], []
    for i in range(400):
        body = bytearray(rng.choice(letters, rng.integers(30, 900)).tobytes())
        if i % 3 == 0:
            for k in range(5, len(body), 12):
                body[k : k + 3] = b"#%&"
        texts.append(bytes(body))
        y.append(float(i % 3 != 0))
    return texts, np.array(y)


def _pieces(texts):
    out = []
    for chunk in chunks(pa.array(texts, pa.binary())):
        out += [np.frombuffer(p, np.uint8).reshape(-1, 2 * c.HALF + c.WIDTH) for p in c.training_pieces(chunk)["pieces"]]
    return out


def test_held_out_accuracy():
    texts, y = _toy()
    net = c.train(_pieces(texts[:300]), y[:300])
    assert ((c.score_texts(net, texts[300:]) > 0.5) == y[300:]).mean() > 0.97


def test_the_whole_text_counts():
    texts, y = _toy()
    net = c.train(_pieces(texts), y)
    clean, junk = texts[1] * 40, texts[0] * 40
    assert c.score_texts(net, [clean])[0] > c.score_texts(net, [clean + junk])[0] > c.score_texts(net, [junk])[0]


def test_scores_do_not_depend_on_the_batch():
    texts, y = _toy()
    net = c.train(_pieces(texts[:60]), y[:60], steps=20)
    together = c.score_texts(net, texts[:50] + [b"", b"x" * 700])
    alone = np.concatenate([c.score_texts(net, [t]) for t in texts[:50] + [b"", b"x" * 700]])
    assert np.allclose(together, alone, atol=1e-6)


def plain_score(net, text):
    """Window by window, filter by filter."""
    body = bytes(c.WIDTH) + text
    n_halves = -(-len(body) // c.HALF)
    body += bytes(n_halves * c.HALF - len(body) + c.WIDTH)
    logits = []
    for half in range(max(1, n_halves - 1)):
        places = range(half * c.HALF, min(half + 2, n_halves) * c.HALF, c.STRIDE)
        x = [max(0.0, net.bias[f] + max(sum(float(net.tables[j][body[at + j]][f]) for j in range(c.WIDTH)) for at in places)) for f in range(c.FILTERS)]
        hidden = [max(0.0, net.b1[h] + sum(x[f] * net.w1[f][h] for f in range(c.FILTERS))) for h in range(c.HIDDEN)]
        logits.append(net.b2[0] + sum(hidden[h] * net.w2[h] for h in range(c.HIDDEN)))
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_scores_equal_a_plain_convolution():
    texts, y = _toy()
    net = c.train(_pieces(texts[:60]), y[:60], steps=20)
    some = [b"", b"a", b"x" * 250, b"y" * 251, texts[3], texts[4] * 2, "Été ".encode() * 100]
    assert np.allclose(c.score_texts(net, some), [plain_score(net, t) for t in some], atol=1e-4)


def test_training_sees_what_scoring_sees():
    texts, y = _toy()
    net = c.train(_pieces(texts[:60]), y[:60], steps=20)
    for text in (b"", b"ab", b"x" * 250, texts[3], texts[4] * 3):
        rows = _pieces([text])[0]
        response = sum(net.tables[j][rows[:, j : j + 2 * c.HALF : c.STRIDE]] for j in range(c.WIDTH)).max(axis=1)
        assert 1 / (1 + np.exp(-net.chunk_logits(response).mean())) == np.float32(c.score_texts(net, [text])[0]) or abs(1 / (1 + np.exp(-net.chunk_logits(response).mean())) - c.score_texts(net, [text])[0]) < 1e-5


def test_the_sample_is_bounded_whatever_repeats(spark):
    docs = documents(spark, ["long " * 50] * 500 + ["b", "c"], ids=[1] * 500 + [2, 3])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id bigint, quality int")
    sample = labelled_sample(docs, labels, "quality", 5, ["doc_id", "text"]).collect()
    assert sorted(r.doc_id for r in sample) == [i for i in (1, 2, 3) if i in {r.doc_id for r in sample}] and len(sample) <= 3


def test_a_text_longer_than_two_megabytes():
    net = c.constant(0.8)
    net.bias[:] = 1.0
    assert abs(c.score_texts(net, [b"ab " * 800_000, b"x"])[0] - 0.8) < 0.01


@pytest.mark.parametrize("place", [0, 100, 199])
def test_a_text_longer_than_the_sample_changes_little(spark, place):
    """First, in the middle or last in hash order: the others are learned from as before."""
    texts, y = _toy()
    texts = [t.decode() for t in texts[:200]]
    by_hash = [r.id for r in spark.range(1000).where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(200).collect()]
    texts[place] = "long text " * 200_000
    docs = documents(spark, texts, ids=by_hash)
    labels = spark.createDataFrame([(i, int(v)) for i, v in zip(by_hash, y)], "doc_id bigint, quality int")
    net = c.fit(docs, labels, most_bytes=400_000)
    scores = c.score_texts(net, [t.encode() for t in texts])
    known = np.arange(200) != place
    assert ((scores > 0.5) == y[:200])[known].mean() > 0.95
    assert c.fit(docs, labels, most_bytes=10).tables.any() == 0


def test_chunks_of_a_long_text_are_spread_over_it():
    (chunk,) = chunks(pa.array([b"".join(b"%07d " % i for i in range(20_000)), b"ab"], pa.binary()))
    found = c.training_pieces(chunk)
    rows = np.frombuffer(found["pieces"][0], np.uint8).reshape(-1, 2 * c.HALF + c.WIDTH)
    assert len(rows) == c.SAMPLE_CHUNKS and found["size"].tolist() == [rows.size, 2 * c.HALF + c.WIDTH]
    assert b"0000001" in rows[0].tobytes() and b"0019999" in rows[-1].tobytes() and b"00101" in rows[c.SAMPLE_CHUNKS // 2].tobytes()


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark, AWKWARD), "score")
    scored = c.classify(docs, c.constant(0.8))
    rows = scored.collect()
    assert len(rows) == len(AWKWARD) and all(0.79 < r.score < 0.81 for r in rows)
    assert c.classify(docs.limit(0), c.constant(0.5)).count() == 0
    assert c.train([], np.zeros(0)).chunk_logits(np.zeros((1, c.FILTERS)))[0] == 0


def test_query_on_tables(spark):
    sf = "/root/testdata/sf0.01"
    out = c.op7_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    rank = rows.score.rank()
    good, bad = (rows.quality == 1).sum(), (rows.quality == 0).sum()
    assert (rank[rows.quality == 1].sum() - good * (good + 1) / 2) / good / bad > 0.9
    assert out.count() == 1000 and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.where(F.col("held_out") != held_out(F.col("doc_id"))).count() == 0
