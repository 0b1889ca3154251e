"""Mixing sources to target weights, by nested hash thresholds.

Every document has a 60-bit hash of its id. Per source, a histogram of sizes over the leading bits finds the bucket in
which the budget ends; only that bucket is divided again by the next bits, until the threshold is a full hash. Then one
filter by hash takes the documents: nothing is sorted, and a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm.stages import written

HASH_BITS = 60
STEP_BITS = 12
MOST_COPIES = 3
#: Sources (rows of under 100 bytes) up to which their thresholds are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000

#: The weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)


def id_hash(doc_id: Column) -> Column:
    """The leading 60 bits of the MD5 of the id as text; of the empty text for a null id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def _ranked(known: DataFrame) -> DataFrame:
    """known with its number from 0 in order of source, by code point, null last: ranges of sources are numbered where
    they are, from how many the ranges before hold; one number a range comes to the driver."""
    order = F.col("source").asc_nulls_last()
    dealt = written(known.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, held = 0, {}
    for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        held[r.part], before = before, before + r.n
    if not held:
        return dealt.select("source", "source_size", F.lit(0).cast("bigint").alias("number"))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in held.items() for x in kv]), F.col("part"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.select("source", "source_size", (start + within).cast("bigint").alias("number"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, have the weights in turn and share the total. A target stops at most times its
    source's size, and the excess is shared again by weight among the rest: target = min(most * size, level * weight)
    for the one level at which targets sum to the total. The level rises from total / weights: each round adds up the
    sources that it stops, and shares what they leave among the others, until no more are stopped.
    """
    known = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    known = written(known.select("source", "source_size", weight.cast("bigint").alias("weight")), "mix-weights")
    cap = most * F.col("source_size")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        over = F.lit(stopped >= 0) & (F.lit(level) * F.col("weight") > cap)
        r = known.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if r[0] == stopped:
            break
        stopped, level = r[0], (total - (r[1] or 0)) / r[2]
    return (
        known.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))
        .withColumn("copies", F.coalesce(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    )


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with threshold: the hash below which a source's documents are taken once more than copies times.

    sizes: (source, hash, size). Each step divides the one bucket of each source in which the sum of sizes passes
    rest; the documents of one hash are taken together if that comes nearer to rest than leaving them.
    """
    state = targets.select(F.col("source").alias("_s"), "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        bucket = F.shiftright("hash", shift)
        if shift == HASH_BITS - STEP_BITS:
            # every document is in the first bucket: sum first, and join the sums
            found = sizes.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n")).join(state, F.col("source").eqNullSafe(F.col("_s")))
        else:
            inside = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", shift + STEP_BITS) == F.col("prefix"))
            found = sizes.join(state, inside).groupBy("_s", "rest", "before", bucket.alias("b")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("_s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        passed = found.withColumn("after", F.col("before") + F.sum("n").over(upto)).where((F.col("after") > F.col("rest")) & (F.col("after") - F.col("n") <= F.col("rest")))
        state = passed.select("_s", "rest", F.col("b").alias("prefix"), (F.col("after") - F.col("n")).alias("before"), "after")
    limit = state.select("_s", (F.col("prefix") + (F.col("before") + F.col("after") <= 2 * F.col("rest")).cast("bigint")).alias("threshold"))
    return targets.join(limit, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def mix(docs: DataFrame, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs (with columns source and hash) with source_size, target and copies, the times that each row is taken.

    sizes: a written table (source, hash, size) of the same rows. Rows of size 0 are taken as their hash says; a null
    source is a source of its own; repeated ids share a hash and are taken together; an empty table stays empty.
    """
    found = written(thresholds(sizes, source_targets(sizes, weights, most)).withColumnRenamed("source", "_source"), "mix-thresholds")
    if found.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    joined = docs.join(found, F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("copies", F.col("copies") + (F.col("hash") < F.col("threshold")).cast("bigint")).drop("_source", "threshold")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "source", "text")}
    sized = plain.withColumn("source", F.col(at["source"])).withColumn("hash", id_hash(F.col(at["doc_id"])))
    sizes = written(sized.select("source", "hash", word_count(F.col(at["text"])).alias("size")), "mix-sizes")
    taken = mix(sized, sizes).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(plain.columns).toDF(*docs.columns)


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = written(docs.select("doc_id", "source", id_hash(F.col("doc_id")).alias("hash"), word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sizes, sizes.select("source", "hash", "size")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS hash,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), known AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM known
), placed AS (
  SELECT *, row_number() OVER w AS place,
    (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
      / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lvl
  FROM ranked WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
), levelled AS (
  SELECT *, arg_min(lvl, place) FILTER (WHERE lvl * weight <= 3 * source_size) OVER () AS level FROM placed
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM levelled
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets
), summed AS (
  SELECT s.*, source_size, target, copies, target - copies * source_size AS rest,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS after,
    CAST(sum(size) OVER (PARTITION BY s.source, hash) AS BIGINT) AS own
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, size * (copies + CASE WHEN 2 * after - own <= 2 * rest THEN 1 ELSE 0 END) AS taken FROM summed
"""
