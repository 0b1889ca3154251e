"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by their id alone; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: list[str], text: str = "text") -> DataFrame:
    """At most rows rows of docs (in hash order of the id) that have a label and aren't held out: keep, and label as y.

    The ids are at most rows many, so that broadcasting them is bounded whatever the size of the tables; and of rows
    that repeat an id one, of the smallest text, is taken. A document with several labels counts with the smallest.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = docs.drop("y").join(F.broadcast(chosen), "doc_id")
    # of an id's rows the smallest is kept as they are met, so that repeats never stand together
    others = [F.col(k) for k in keep if k not in ("doc_id", text)]
    first = found.groupBy("doc_id").agg(F.min_by(F.struct(F.col(text).alias(text), "y", *others), F.struct(F.sha2(text, 256))).alias("_s"))
    return first.select(*[F.col("doc_id") if k == "doc_id" else F.col(f"_s.{k}").alias(k) for k in keep], F.col("_s.y").alias("y"))
