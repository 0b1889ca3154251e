"""Union-find grouping of links into connected components, without gathering a component anywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.stages import written

MOST_ROUNDS = 40


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of some links, root being a component's smallest node; roots have no row."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    left, right = codes[: len(a)], codes[len(a) :]
    while True:  # hook the larger root onto the smaller, then halve paths, for all links at once
        x, y = parent[left], parent[right]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]
    low = parent != np.arange(len(nodes))
    return nodes[low], nodes[parent[low]]


def _contracted(links: DataFrame) -> DataFrame:
    """Each partition's links replaced by its own forest; a batch of links at a time bounds memory."""

    def run(frames):
        for frame in frames:
            node, root = forest(frame["a"].to_numpy(), frame["b"].to_numpy())
            yield pd.DataFrame({"a": root, "b": node})

    return links.mapInPandas(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b bigint), component being the smallest node that it reaches.

    Union-find contracts what meets in one batch; then large-star and small-star rounds, each two aggregations by node
    and joins, run until every node points at a root. A hub's rows are reduced by min, never gathered.
    """
    links = written(_contracted(links.where("a <> b")).distinct(), "links")
    for _ in range(MOST_ROUNDS):
        children = links.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        loose = links.join(children.select(F.col("b").alias("r")), links["a"] == F.col("r"), "left_semi").limit(1).count() + children.where("n > 1").limit(1).count()
        if not loose:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        star = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        links = written(_contracted(star.where("a <> b").distinct()).distinct(), "links")
    else:
        raise RuntimeError(f"components: not settled after {MOST_ROUNDS} rounds")
    nodes = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
