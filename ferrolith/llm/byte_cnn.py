"""Quality classifier: a byte-level convolutional network, written and trained in numpy.

Filters read windows of raw bytes. Their responses are max-pooled over chunks of 512 bytes that overlap by half and
together cover the whole document; a hidden layer gives each chunk a logit, and a document's probability is the
logistic function of the mean over its chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.bytetext import Chunk, chunks
from ferrolith.llm.columns import with_text_columns
from ferrolith.llm.samples import held_out, labelled_sample
from ferrolith.llm.stages import written

SAMPLE_ROWS = 6_000
#: Bytes of chunks that reach the driver: rows are taken in hash order of their ids, each that still fits.
SAMPLE_BYTES = 48 << 20
#: Chunks of one text in the sample; of a longer text so many, spread evenly over the whole of it.
SAMPLE_CHUNKS = 64
#: Chunks of one text that a step of training draws.
STEP_CHUNKS = 8

HALF = 256  # bytes; a chunk is two halves
STRIDE = 2
WIDTH = 6
FILTERS = 16
HIDDEN = 16
_BLOCK = 1 << 14
_CHUNKS_AT_ONCE = 1024


@dataclass
class Network:
    """tables[j][b]: what byte b at place j of a window adds to each filter. Byte 0, which also pads, adds nothing."""

    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    w1: np.ndarray  # FILTERS x HIDDEN
    b1: np.ndarray  # HIDDEN
    w2: np.ndarray  # HIDDEN
    b2: np.ndarray  # 1

    def halves(self, padded: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each half chunk; padded has WIDTH bytes more than whole halves."""
        n = (len(padded) - WIDTH) // STRIDE
        a_half = HALF // STRIDE
        out = np.empty((n // a_half, FILTERS), np.float32)
        total, part = np.empty((_BLOCK, FILTERS), np.float32), np.empty((_BLOCK, FILTERS), np.float32)
        for lo in range(0, n, _BLOCK):
            hi = min(lo + _BLOCK, n)
            t, p = total[: hi - lo], part[: hi - lo]
            np.take(self.tables[0], padded[lo * STRIDE : hi * STRIDE : STRIDE], axis=0, out=t, mode="clip")
            for j in range(1, WIDTH):
                np.take(self.tables[j], padded[lo * STRIDE + j : hi * STRIDE + j : STRIDE], axis=0, out=p, mode="clip")
                t += p
            out[lo // a_half : hi // a_half] = t.reshape(-1, a_half, FILTERS).max(axis=1)
        return out

    def chunk_logits(self, pooled: np.ndarray) -> np.ndarray:
        x = np.maximum(pooled + self.bias, 0)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]

    def scores(self, chunk: Chunk) -> np.ndarray:
        """The probability of label 1 for each document of a chunk."""
        padded, n_halves, first = padded_halves(chunk)
        halves = self.halves(padded)
        # a chunk starts at each half that another half of its document follows, and at a document's only half
        lone = np.repeat(n_halves == 1, n_halves)
        last = np.zeros(len(halves), bool)
        last[first[1:] - 1] = True
        at = np.flatnonzero(~last | lone)
        other = np.where(lone[at], at, np.minimum(at + 1, len(halves) - 1))
        logits = self.chunk_logits(np.maximum(halves[at], halves[other]))
        doc = np.searchsorted(first, at, side="right") - 1
        mean = np.bincount(doc, logits, chunk.n) / np.bincount(doc, minlength=chunk.n)
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))


def padded_halves(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' bytes, each from a half of its own on, how many halves each has, and where its first one is. WIDTH
    zeros before each keep windows of the one before from reading its bytes, and WIDTH bytes follow the last half."""
    size = np.diff(chunk.offsets)
    n_halves = (WIDTH + size + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(n_halves)])
    padded = np.zeros(first[-1] * HALF + WIDTH, np.uint8)
    for k in range(chunk.n):
        at = first[k] * HALF + WIDTH
        padded[at : at + size[k]] = chunk.data[chunk.offsets[k] : chunk.offsets[k + 1]]
    return padded, n_halves, first


def constant(probability: float) -> Network:
    """The network that gives every text the same probability, for want of labels."""
    p = min(max(probability, 1e-3), 1 - 1e-3)
    zero = np.zeros
    return Network(zero((WIDTH, 256, FILTERS), np.float32), zero(FILTERS, np.float32), zero((FILTERS, HIDDEN), np.float32), zero(HIDDEN, np.float32), zero(HIDDEN, np.float32), np.array([np.log(p / (1 - p))], np.float32))


def training_pieces(chunk: Chunk, most: int = SAMPLE_CHUNKS) -> dict[str, object]:
    """The chunks of each document, cut as for scores, each with the WIDTH bytes that follow it: all of them, or most
    spread evenly from the first to the last; and their size in bytes."""
    padded, n_halves, first = padded_halves(chunk)
    out = []
    for k in range(chunk.n):
        count = max(1, n_halves[k] - 1)
        which = np.arange(count) if count <= most else np.round(np.linspace(0, count - 1, most)).astype(np.int64)
        rows = np.zeros((len(which), 2 * HALF + WIDTH), np.uint8)
        for i, at in enumerate((first[k] + which) * HALF):
            # a lone half is a chunk; what stands after it belongs to the next document
            piece = padded[at : at + (2 if n_halves[k] > 1 else 1) * HALF + WIDTH]
            rows[i, : len(piece)] = piece
        if n_halves[k] == 1:
            rows[:, HALF + WIDTH :] = 0
        out.append(rows.tobytes())
    return {"pieces": out, "size": np.array([len(x) for x in out], np.int64)}


def train(pieces: list[np.ndarray], y: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> Network:
    """Adam on the documents' logistic loss. pieces: the chunks of each document, one row each; y: 0 or 1."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.full(FILTERS, -1.0, np.float32), rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32), rng.normal(0, 0.3, HIDDEN).astype(np.float32), np.array([np.log(y.mean() / (1 - y.mean()))], np.float32),
    )
    net.tables[:, 0] = 0
    names = ["tables", "bias", "w1", "b1", "w2", "b2"]
    moment, square, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    epochs = -(-steps // -(-len(y) // batch))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            drawn = [pieces[d] if len(pieces[d]) <= STEP_CHUNKS else pieces[d][rng.choice(len(pieces[d]), STEP_CHUNKS, replace=False)] for d in docs]
            rows = np.concatenate(drawn)
            owner = np.repeat(np.arange(len(docs)), [len(x) for x in drawn])
            where, pooled = np.empty((len(rows), FILTERS), np.int64), np.empty((len(rows), FILTERS), np.float32)
            for at in range(0, len(rows), _CHUNKS_AT_ONCE):  # a long text has many chunks
                part = slice(at, at + _CHUNKS_AT_ONCE)
                response = sum(net.tables[j][rows[part, j : j + 2 * HALF : STRIDE]] for j in range(WIDTH))
                where[part] = response.argmax(axis=1)
                pooled[part] = response.max(axis=1)
            x = np.maximum(pooled + net.bias, 0)
            hidden = np.maximum(x @ net.w1 + net.b1, 0)
            logit = hidden @ net.w2 + net.b2[0]
            count = np.bincount(owner, minlength=len(docs))
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, logit, len(docs)) / count, -30, 30)))
            d_logit = ((p - y[docs]) / count / len(docs))[owner].astype(np.float32)
            d_hidden = d_logit[:, None] * net.w2 * (hidden > 0)
            d_x = d_hidden @ net.w1.T * (x > 0)
            grads = {"w2": hidden.T @ d_logit, "b2": d_logit.sum(keepdims=True), "w1": x.T @ d_hidden, "b1": d_hidden.sum(0), "bias": d_x.sum(0), "tables": np.zeros_like(net.tables)}
            for j in range(WIDTH):
                seen = np.take_along_axis(rows, where * STRIDE + j, axis=1)
                cell = seen.astype(np.int64) * FILTERS + np.arange(FILTERS)
                grads["tables"][j] = np.bincount(cell.ravel(), d_x.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads["tables"][:, 0] = 0
            step += 1
            for k in names:
                moment[k] = 0.9 * moment[k] + 0.1 * grads[k]
                square[k] = 0.999 * square[k] + 0.001 * grads[k] ** 2
                a = getattr(net, k)
                a -= (rate * (1 - epoch / epochs) * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Trained on at most rows labelled documents that aren't held out, whose chunks reach the driver: most_bytes at
    most, whatever the size of the tables and of single texts. A document that doesn't fit any more is left out, and
    the next ones in hash order of their ids are tried."""
    sample = labelled_sample(docs, labels, label, rows, ["doc_id", "text"])
    sample = with_text_columns(sample, lambda: training_pieces, {"pieces": "binary", "size": "bigint"}, ["doc_id", "y"])
    sample = written(sample, "quality-sample")
    chosen, left = [], most_bytes
    # one pair of numbers for each of at most `rows` documents
    for r in sample.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["size"] <= left:
            chosen.append((r.doc_id,))
            left -= r["size"]
    if not chosen:
        return constant(0.5)
    kept = docs.sparkSession.createDataFrame(chosen, sample.select("doc_id").schema)
    found = sorted(sample.join(F.broadcast(kept), "doc_id").collect(), key=lambda r: r.doc_id)
    return train([np.frombuffer(r.pieces, np.uint8).reshape(-1, 2 * HALF + WIDTH) for r in found], np.array([r.y for r in found], float))


def classify(docs: DataFrame, network: Network, keep: list[str] | None = None) -> DataFrame:
    """docs, or only the columns in keep, with score (double, 0 to 1; replaces a column so named).

    Every byte of every text is read. Null and empty texts get the score of a chunk of padding. The network (under
    200 KB at any size of the input) goes with the task.
    """
    return with_text_columns(docs, lambda: lambda chunk: {"score": network.scores(chunk)}, {"score": "double"}, keep)


def score_texts(network: Network, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([network.scores(c) for c in chunks(pa.array(texts, pa.binary()))])


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classify(docs, network, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
