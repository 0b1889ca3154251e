"""LM scoring: stupid backoff over n-gram counts of the corpus itself, computed as relations.

Three tables are made from the documents. `words` counts every word (group by). `grams` has a row for each document and
each different pair of neighbouring words in it, with how often. It is partitioned by the hash of the pair, or of the
rare word in it; there the pair's count over the whole corpus is a sum over the partition, and rows of `words` stand
beside the pairs of rare words. The counts of frequent words are joined by broadcast. Each row then has its part of the
score, and a document's parts are summed (group by).

Frequent means at least one in FREQUENT_WORDS of all words, or about one in FREQUENT_PAIRS of all pairs, so that there
can't be more of them than that whatever the size of the corpus: they fit a broadcast. Rows of frequent pairs, which
would meet in one task, are not sent: their counts are added up first and joined where the documents are read. Of what
is sent, no key has more than about one in FREQUENT_PAIRS of the rows.

A word is known by a 62-bit hash: among 10^8 different words two have the same with a probability of about 0.001.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm.bytetext import Chunk, chunks, release, span_hashes
from ferrolith.llm.stages import written

ALPHA = 0.4
MIN_COUNT = 2
FREQUENT_WORDS = 1 << 20
FREQUENT_PAIRS = 1 << 19
#: Words of a task that are counted at once before their counts are sent.
BLOCK_WORDS = 2_000_000

#: A pair of frequent words is one number: the number of the first above SHIFT bits, that of the second in them.
SHIFT = 21
_DOCS = 1 << 50  # keys from here on are of documents
_FIRST = 1 << 40  # in place of the other word: none, as the word begins a document
_WORD = _FIRST + 2  # the row is of `words`


def _hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The hash and document of every word; A-Z counts as a-z."""
    lowered = chunk.lowered()
    start, end, doc = lowered.words()
    return (span_hashes(lowered.data, start, end) >> np.uint64(2)).astype(np.int64), doc


def _second(doc: np.ndarray) -> np.ndarray:
    """The places of the words that follow another in their document."""
    return np.flatnonzero(doc[1:] == doc[:-1]) + 1


def _texts(batches):
    for batch in batches:
        yield from chunks(batch.column(0).cast(pa.large_binary()))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int64())


def _unique_pairs(p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, p))
    p, w = p[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])])) if len(p) else order
    return p[first], w[first], np.diff(np.append(first, len(p)))


def _count_words(pairs: int):
    """Rows (p, w, n): of each word (p null), and of those pairs that hold at least one in `pairs` of a block's words.
    A pair that is left out of every block is rarer than that in the corpus too."""

    def block(words: list[np.ndarray], p: list[np.ndarray], w: list[np.ndarray]):
        total = sum(map(len, words))
        word, n = np.unique(np.concatenate(words), return_counts=True)
        yield _batch(p=pa.nulls(len(word), pa.int64()), w=_longs(word), n=_longs(n))
        a, b, n = _unique_pairs(np.concatenate(p), np.concatenate(w))
        most = n * pairs >= total
        yield _batch(p=_longs(a[most]), w=_longs(b[most]), n=_longs(n[most]))

    def run(batches):
        words, p, w, held = [], [], [], 0
        for chunk in _texts(batches):
            h, doc = _hashes(chunk)
            second = _second(doc)
            words.append(h)
            p.append(h[second - 1])
            w.append(h[second])
            held += len(h)
            if held >= BLOCK_WORDS:
                yield from block(words, p, w)
                words, p, w, held = [], [], [], 0
        if held:
            yield from block(words, p, w)
        del words, p, w
        release()

    return run


@dataclass
class Frequent:
    """Frequent words (ascending hashes, and counts) and pairs of their numbers (ascending, and counts)."""

    words: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The number of a frequent word; -1 - hash of another."""
        return np.where(_holds(self.words, hashes), np.searchsorted(self.words, hashes), -1 - hashes)

    def pair_at(self, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The place of each pair of codes among the frequent pairs, else -1."""
        packed = np.where((p >= 0) & (w >= 0), (p << SHIFT) | w, -1)
        return np.where(_holds(self.pairs, packed), np.searchsorted(self.pairs, packed), -1)


def _holds(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _count_pairs(shared):
    """Rows (pair, n) of a task's frequent pairs."""

    def run(batches):
        frequent = shared.value
        n = np.zeros(len(frequent.pairs), np.int64)
        for chunk in _texts(batches):
            h, doc = _hashes(chunk)
            code, second = frequent.codes(h), _second(doc)
            at = frequent.pair_at(code[second - 1], code[second])
            n += np.bincount(at[at >= 0], minlength=len(n))
        at = np.flatnonzero(n)
        yield _batch(pair=_longs(frequent.pairs[at]), n=_longs(n[at]))
        release()

    return run


def _explode(shared, total: int, alpha: float, least: int, id_type: pa.DataType):
    """Rows (k, key, o, n, x, doc_id): one of each document, with its number k, its words n, and what is known already:
    the score x and backoffs o of its frequent pairs and first word; and those of `grams`.

    Of a pair of frequent words the key is the pair, and o 0. Of others it is the code of a rare word, and o the code of
    the other one, doubled, and 1 more if the rare word comes second; a pair of two rare words has a row for either.
    """

    def rows(frequent: Frequent, chunk: Chunk, ids: pa.Array, k: np.ndarray) -> list[pa.RecordBatch]:
        h, doc = _hashes(chunk)
        code, second = frequent.codes(h), _second(doc)
        first = np.ones(len(doc), bool)
        first[second] = False
        first = np.flatnonzero(first)
        p, w, d = code[second - 1], code[second], doc[second]
        at = frequent.pair_at(p, w)
        here = at >= 0
        c = frequent.pair_counts[at[here]]
        known = c >= least
        x = np.where(known, np.log(c / frequent.counts[p[here]]), np.log(alpha * frequent.counts[w[here]] / total))
        begins = first[code[first] >= 0]
        score = np.bincount(d[here], x, chunk.n) + np.bincount(doc[begins], np.log(frequent.counts[code[begins]] / total), chunk.n)
        backed = np.bincount(d[here][~known], minlength=chunk.n)
        size = chunk.per_doc(doc)
        yield _batch(k=_longs(k), key=_longs(_DOCS + k), o=_longs(backed), n=_longs(size), x=pa.array(score, pa.float64()), doc_id=ids)
        rare_p, rare_w, rare_first = p < 0, w < 0, first[code[first] < 0]
        both = ~here & ~rare_p & ~rare_w
        key = np.concatenate([(p[both] << SHIFT) | w[both], p[rare_p], w[rare_w], code[rare_first]])
        o = np.concatenate([np.zeros(int(both.sum()), np.int64), 2 * w[rare_p], 2 * p[rare_w] + 1, np.full(len(rare_first), _FIRST)])
        d = np.concatenate([d[both], d[rare_p], d[rare_w], doc[rare_first]])
        order = np.lexsort((d, o, key))
        key, o, d = key[order], o[order], d[order]
        one = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (o[1:] != o[:-1]) | (d[1:] != d[:-1])])) if len(key) else order
        n = np.diff(np.append(one, len(key)))
        yield _batch(k=_longs(k[d[one]]), key=_longs(key[one]), o=_longs(o[one]), n=_longs(n), x=pa.nulls(len(one), pa.float64()), doc_id=pa.nulls(len(one), id_type))

    def run(batches):
        k = TaskContext.get().partitionId() << 33
        for batch in batches:
            for chunk in chunks(batch.column(0).cast(pa.large_binary())):
                yield from rows(shared.value, chunk, batch.column(1).slice(chunk.lo, chunk.n), np.arange(k, k + chunk.n))
                k += chunk.n
        release()

    return run


def stupid_backoff(docs: DataFrame, alpha: float = ALPHA, least: int = MIN_COUNT, words: int = FREQUENT_WORDS, pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_backoff, log_score (the sum over its words), mean_log_score.

    A word after w scores count(w, word) / count(w) if the pair's count in the whole corpus is at least `least` (1: no
    pair is pruned), else alpha * count(word) / number of words, as does (without alpha) a document's first word. Words
    are runs other than space and tab to carriage return, A-Z as a-z. A null, empty or blank text has no words and null
    scores; repeated rows count each; an empty table gives an empty one. docs is read three times and its rows are
    numbered in the order that tasks read them in: it should be a table, or derived from one without a shuffle.
    """
    spark, texts = docs.sparkSession, docs.select("text")
    words, pairs = min(words, 1 << SHIFT), min(pairs, 1 << SHIFT)
    counted = texts.mapInArrow(_count_words(pairs), "p bigint, w bigint, n bigint").groupBy("p", "w").agg(F.sum("n").alias("n"))
    counted = written(counted, "lm-counts")
    one = counted.where("p is null")
    total = one.agg(F.sum("n")).first()[0] or 0
    most = one.where(F.col("n") * words >= total).select("w", "n").toArrow()
    order = np.argsort(most["w"].to_numpy())
    frequent = Frequent(most["w"].to_numpy()[order], most["n"].to_numpy()[order], np.zeros(0, np.int64), np.zeros(0, np.int64))
    if total:
        two = counted.where(F.col("p").isNotNull() & (F.col("n") * pairs >= total)).select("p", "w").toArrow()
        p, w = frequent.codes(two["p"].to_numpy()), frequent.codes(two["w"].to_numpy())
        frequent.pairs = np.sort((p << SHIFT | w)[(p >= 0) & (w >= 0)])
        held = texts.mapInArrow(_count_pairs(spark.sparkContext.broadcast(frequent)), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        order = np.argsort(held["pair"].to_numpy())
        frequent.pairs, frequent.pair_counts = held["pair"].to_numpy()[order], held["n"].to_numpy()[order]

    kind = docs.select("doc_id").schema[0].dataType
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    explode = _explode(spark.sparkContext.broadcast(frequent), max(total, 1), alpha, least, id_type)
    grams = docs.select("text", "doc_id").mapInArrow(explode, f"k bigint, key bigint, o bigint, n bigint, x double, doc_id {kind.simpleString()}")
    rare = one.where(F.col("n") * words < total).select((-1 - F.col("w")).alias("key"), F.lit(_WORD).alias("o"), "n")
    dealt = grams.unionByName(rare, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "o")
    counts = dealt.withColumn("c", F.sum("n").over(Window.partitionBy("key", "o")))
    counts = counts.withColumn("own", F.sum(F.when(F.col("o") == _WORD, F.col("n"))).over(Window.partitionBy("key")))

    key, o, n = F.col("key"), F.col("o"), F.col("n")
    document, begins = key >= _DOCS, (key < 0) & (o == _FIRST)
    known = (F.col("c") >= least) & ~begins
    comes_second = o.bitwiseAND(1) == 1
    # a known pair is divided by the count of its first word, another scores its second
    other_counts = (key < 0) & (o < _FIRST) & (comes_second == known)
    need = F.when(document, None).when(key >= 0, F.when(known, F.shiftright(key, SHIFT)).otherwise(key.bitwiseAND((1 << SHIFT) - 1))).when(other_counts & (o >= 0), F.shiftright(o, 1))
    table = pa.table({"number": pa.array(np.arange(len(frequent.words)), pa.int64()), "count": pa.array(frequent.counts, pa.int64())})
    listed = F.broadcast(written(spark.createDataFrame(table), "lm-frequent"))  # at most `words` rows of 16 bytes
    joined = counts.where((key >= 0) | (o != _WORD)).withColumn("need", need).join(listed, F.col("need") == F.col("number"), "left")
    count = F.coalesce("count", "own")
    elsewhere = other_counts & (o < 0)  # the row of the pair's other word has the count
    backed = F.log(count) - math.log(max(total, 1)) + F.when(begins, 0.0).otherwise(math.log(alpha))
    part = F.when(document, F.col("x")).when(~elsewhere, n * F.when(known, F.log("c") - F.log(count)).otherwise(backed))
    n_backed = F.when(document, o).when(~elsewhere & ~known & ~begins, n).otherwise(0)
    parts = joined.select("k", "doc_id", F.when(document, n).alias("n_words"), n_backed.alias("backed"), part.alias("part"))
    summed = parts.groupBy("k").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("backed").alias("n_backoff"), F.sum("part").alias("sum"))
    score = F.when(F.col("n_words") > 0, F.col("sum"))
    return summed.select("doc_id", "n_words", "n_backoff", score.alias("log_score"), (score / F.col("n_words")).alias("mean_log_score"))


def op4_lm_scores(spark, sf_dir: str) -> DataFrame:
    scored = stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP4_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM texts
), placed AS (
  SELECT doc_id, pos, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM words
), singles AS (SELECT w, count(*) AS c FROM words GROUP BY w
), pairs AS (SELECT p, w, count(*) AS c FROM placed WHERE p IS NOT NULL GROUP BY p, w
), scored AS (
  SELECT k.doc_id, k.p IS NOT NULL AND b.c < 2 AS backed,
    CASE WHEN k.p IS NULL THEN ln(s.c / t.n) WHEN b.c >= 2 THEN ln(b.c / q.c) ELSE ln(s.c / t.n) + ln(0.4::DOUBLE) END AS x
  FROM placed k JOIN singles s ON s.w = k.w LEFT JOIN singles q ON q.w = k.p LEFT JOIN pairs b ON b.p = k.p AND b.w = k.w, (SELECT count(*) AS n FROM words) t
)
SELECT d.doc_id, count(x) AS n_words, count(*) FILTER (WHERE backed) AS n_backoff, round(sum(x), 4) AS log_score, round(sum(x) / count(x), 6) AS mean_log_score
FROM documents d LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
