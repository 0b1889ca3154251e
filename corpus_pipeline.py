"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents that it keeps.

All stages but the last return the columns of documents, and any others that docs has, whatever their names; the last
returns sampled segmentations with their ids. An empty table stays empty. A null text counts as empty, which the first
stage rejects. Rows without doc_id are documents of their own, which no label or near duplicate touches; repeated rows
are each cut and taken alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm import line_dedup, mixing, near_duplicates, quality_rules, segmentations
from ferrolith.llm.stages import written


#: Stages take five words and 80 %; only the registered query of the operator is defined on four words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the learned decision list keep."""
    rules = quality_rules.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.quality_filter(docs, rules)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that at least ten documents hold; n_chars follows the text."""
    left = line_dedup.dedup_lines(docs)
    return left.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates: NEAR_WORDS-word shingles, similarity
    NEAR_PERCENT % or more. Rows of one doc_id are one document; rows without doc_id stay."""
    found = near_duplicates.near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT)
    gone = written(found.where("not kept").select("doc_id").distinct(), "near-gone")
    return near_duplicates.without_ids(docs, gone)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources come near their target weights."""
    return mixing.mixed_documents(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document, with their ids."""
    import public_tokenizers

    return segmentations.sampled_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", lines_stage),
    ("near dedup", near_stage),
    ("source mixing", mix_stage),
    ("sentencepiece", pieces_stage),
]

#: The learned rules, the signatures and the sampled pieces can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
