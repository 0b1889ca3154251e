"""Inverted index and scored search. docs: doc_id, name, description, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions.text import tokens


def postings(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """(token, key): each distinct token of the columns."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    return docs.select(key, F.explode(tokens(text)).alias("token"))


def document_frequency(index: DataFrame) -> DataFrame:
    """(token, n_docs). A map of token to documents would hold a frequent token's documents in one row; counts don't."""
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


#: Rows of query tokens up to which they are broadcast to the postings; beyond, both are dealt by token.
BROADCAST_TOKENS = 500_000


def scored_search(queries: DataFrame, docs: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Per query (query_id, query) the best documents: each of its tokens in the index counts 3 if it is within the name,
    else 2 within the description, else 1; ties by key. Columns: query_id, key, score, n_matched, place.

    A token's weight is settled where its document is read, so that only (token, key, weight) meets the queries. Where
    the queries' tokens can be counted to fit a broadcast, postings are not shuffled, and a frequent token not gathered.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token"))
    if asked.count() <= BROADCAST_TOKENS:
        asked = F.broadcast(asked)
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "description", "content")])
    low = docs.select(key, F.lower("name").alias("_n"), F.lower("description").alias("_d"), tokens(text).alias("_t"))
    index = low.select(key, "_n", "_d", F.explode("_t").alias("token"))
    weight = F.when(F.col("_n").contains(F.col("token")), 3).when(F.col("_d").contains(F.col("token")), 2).otherwise(1)
    hits = index.select(key, "token", weight.alias("w")).join(asked, "token")
    scores = hits.groupBy("query_id", key).agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("n_matched"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scores.withColumn("place", place).where(F.col("place") <= most)


def by_name(skills: DataFrame, name: str) -> DataFrame:
    """The skill of a name: exactly, else the first that holds it or that it holds."""
    low, want = F.lower("name"), name.lower()
    rank = F.when(low == want, 0).when(low.contains(want), 1).when(F.lit(want).contains(low), 2)
    return skills.withColumn("_r", rank).where("_r is not null").orderBy("_r", "name").limit(1).drop("_r")


def by_tag(skills: DataFrame, tag: str) -> DataFrame:
    return skills.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
