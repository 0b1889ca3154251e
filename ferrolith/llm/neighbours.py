"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into balanced parts, and a small classifier learns to
predict the parts of a vector's neighbours. Every row is indexed in its most probable part; a query is routed to
several most probable ones, as many as the sample needs for the recall asked for, and reranked there exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample: SAMPLE_A_PART for each part, within these bounds (65,536 rows of 64 doubles are 33 MB).
LEAST_SAMPLE, MOST_SAMPLE, SAMPLE_A_PART = 4096, 1 << 16, 64
PARTS = 16
GRAPH_DEGREE = 10
RECALL = 0.95
#: Rows, and queries, of a part that meet in one task at most.
BLOCK_ROWS = 4096


@dataclass
class Router:
    """A classifier with one hidden layer; without weights there is one part."""

    weights: list[np.ndarray]
    parts: int
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(x), 1))
        w1, b1, w2, b2 = self.weights
        z = np.maximum(_unit(x) @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    """Directions, and half the size of the largest component against overflow, so that any scale routes alike."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The degree nearest other rows of each row, exactly, a block of rows at a time."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), degree), np.int64)
    for lo in range(0, len(x), 512):
        d = square[lo : lo + 512, None] + square - 2 * (x[lo : lo + 512] @ x.T)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out[lo : lo + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05, seed: int = 11) -> np.ndarray:
    """A part for each row: balanced k-means to begin with, then rows move to the part of most of their neighbours
    while it has room, which lowers the number of cut edges."""
    rng = np.random.default_rng(seed)
    room = int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)]
    part = np.zeros(len(x), np.int64)
    for _ in range(6):
        d = (centres * centres).sum(axis=1) - 2 * x @ centres.T
        left = np.full(parts, room)
        gap = np.sort(d, axis=1)
        for row in np.argsort(gap[:, 0] - gap[:, 1]):
            for p in np.argsort(d[row]):
                if left[p]:
                    left[p] -= 1
                    part[row] = p
                    break
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else x[rng.integers(len(x))] for p in range(parts)])
    votes_of = [[] for _ in range(len(x))]
    for a, row in enumerate(graph):
        for b in row:
            votes_of[a].append(b)
            votes_of[b].append(a)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for row in rng.permutation(len(x)):
            votes = np.bincount(part[votes_of[row]], minlength=parts)
            votes = np.where(size < room, votes, -1)
            best, own = int(votes.argmax()), part[row]
            if best != own and votes[best] > np.count_nonzero(part[votes_of[row]] == own):
                size[own] -= 1
                size[best] += 1
                part[row] = best
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, targets: np.ndarray, hidden: int = 128, epochs: int = 60, batch: int = 256, rate: float = 3e-3, seed: int = 5) -> list[np.ndarray]:
    """Adam on the cross-entropy with soft targets: the share of each part among a row and its neighbours."""
    rng = np.random.default_rng(seed)
    x, parts = _unit(x), targets.shape[1]
    w = [rng.normal(0, 1, (x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.normal(0, 1, (hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    m, v, step = [0.0] * 4, [0.0] * 4, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - targets[rows]) / len(rows)
            dh = dz @ w[2].T * (h > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ dz + 1e-4 * w[2], dz.sum(axis=0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    return w


def fit_router(sample: np.ndarray, parts: int = PARTS, recall: float = RECALL, degree: int = GRAPH_DEGREE) -> Router:
    """From a sample's rows. The last quarter is kept from training; its rows, as queries for their exact neighbours
    in all of the sample, tell how many parts must be probed."""
    x = np.unique(sample, axis=0) if len(sample) else sample
    if len(x) < 8 * parts or len(x) <= 4 * degree:
        return Router([], 1, 1)
    x = x[np.random.default_rng(3).permutation(len(x))]
    fitted = x[: 3 * len(x) // 4]
    graph = neighbour_graph(fitted, degree)
    part = balanced_parts(fitted, graph, parts)
    targets = np.eye(parts)[part] * 2.0
    for k in range(degree):
        targets += np.eye(parts)[part[graph[:, k]]]
    router = Router(train_router(fitted, targets / targets.sum(axis=1, keepdims=True)), parts, parts)
    own = router.probabilities(x).argmax(axis=1)
    held = np.arange(len(fitted), len(x))
    near = neighbour_graph(x, degree)[held]
    order = np.argsort(np.argsort(-router.probabilities(x[held]), axis=1), axis=1)
    place = np.take_along_axis(order, own[near], axis=1)
    for probes in range(1, parts + 1):
        if (place < probes).mean() >= recall:
            return Router(router.weights, parts, probes)
    return router


def parts_for(rows: int) -> int:
    """The number of parts grows with the square root of the rows, up to what the largest sample can tell apart."""
    return max(PARTS, min(MOST_SAMPLE // SAMPLE_A_PART, int(rows**0.5) // 14))


def _rank_block(k: int):
    def rank(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of each query, by exact distance and then vec_id."""
        out = []
        if len(queries) and len(rows):
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy())
            square = (x * x).sum(axis=1)
            for lo in range(0, len(queries), 256):
                qid, q = queries["vec_id"].to_numpy()[lo : lo + 256], np.stack(queries["v"].to_numpy()[lo : lo + 256])
                d = square + (q * q).sum(axis=1)[:, None] - 2 * (q @ x.T)
                d[qid[:, None] == ids] = np.inf
                last = min(k, len(ids)) - 1
                # all that may be among the k nearest or tie with the last: a margin covers the rounding of d
                limit = np.partition(d, last, axis=1)[:, last] + 1e-9 * (square.max() + 1)
                for i in range(len(qid)):
                    at = np.flatnonzero((d[i] <= limit[i]) & (ids != qid[i]))
                    exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[at], exact))[:k]
                    out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[at][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return lambda key, a, b: rank(a, b)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: with an id, without nulls, NaN or infinities, not zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda c: c != 0))


def nearest(vectors: DataFrame, is_query, k: int = 10, sample_rows: int | None = None, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """For each row of vectors (vec_id, embedding) where is_query holds: query_id, rank from 1, vec_id, score.

    The k nearest other rows found, by Euclidean distance in double precision; ties go to the smaller vec_id; fewer if
    there are fewer. Unusable vectors (see usable) take no part. Distances are between vectors of one length: those of
    the commonest length are routed, the vectors of each other length are one more part, which is searched whole. Rows
    that repeat a vec_id are never each other's neighbours but each may be found, and as queries they have one ranking
    together. The router is fitted on a bounded sample (see LEAST_SAMPLE) of the rows; all rows are indexed.
    """
    rows = usable(vectors)
    lengths = {r.n: r.rows for r in rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    common = min(lengths, key=lambda n: (-lengths[n], n)) if lengths else 0
    parts = parts or parts_for(lengths.get(common, 0))
    sample_rows = sample_rows or min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLE_A_PART * parts))
    sample = rows.where(F.size("v") == common).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()
    router = fit_router(np.array([r.v for r in sample], float), parts, recall)

    def route(probes: int):
        def run(frames):
            for frame in frames:
                size = frame["v"].map(len)
                same = frame[size == common]
                if len(same):
                    p = router.probabilities(np.stack(same["v"].to_numpy()))
                    top = np.argsort(-p, axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"vec_id": np.repeat(same["vec_id"].to_numpy(), probes), "v": np.repeat(same["v"].to_numpy(), probes), "part": top.reshape(-1)})
                if len(same) < len(frame):
                    yield frame[size != common].assign(part=-size[size != common])

        return run

    schema = "vec_id bigint, v array<double>, part int"
    indexed, asked = rows.mapInPandas(route(1), schema), rows.where(is_query).mapInPandas(route(router.probes), schema)
    # one row a part comes to the driver: how many rows and queries it holds
    held = {r.part: r.n for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r.part: r.n for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def blocks(counts: dict[int, int]):
        if not counts:
            return F.lit(1)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p, n in counts.items() for x in (p, max(1, -(-n // BLOCK_ROWS)))]), F.col("part")), F.lit(1))

    def dealt(table: DataFrame, own: str, own_blocks, other: str, other_blocks) -> DataFrame:
        one = table.withColumn(own, F.pmod(F.xxhash64("vec_id"), own_blocks).cast("int"))
        return one.withColumn(other, F.explode(F.sequence(F.lit(0), other_blocks - 1)))

    queries = dealt(asked, "q", blocks(wanted), "r", blocks(held))
    # rows of parts that no query is routed to need not meet any
    targets = dealt(indexed.where(F.col("part").isin(*wanted)) if wanted else indexed.limit(0), "r", blocks(held), "q", blocks(wanted))
    keys = ["part", "q", "r"]
    found = queries.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(_rank_block(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
