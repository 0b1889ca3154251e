"""Interval and as-of operators: nearest preceding start, covering range, merging, greedy budgets, overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preceding_start(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, name: str) -> DataFrame:
    """points with name: that of the last start at or before them in the same key, null if there is none. One sort by
    key and place instead of a range join; of equal starts the smallest name holds."""
    only = starts.groupBy(key, F.col(start).alias(at)).agg(F.min(name).alias(name)).withColumn("_point", F.lit(0))
    both = points.withColumn("_point", F.lit(1)).unionByName(only, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("_point = 1").drop("_point")


def covering_range(points: DataFrame, ranges: DataFrame, key: str, at: str, bin_size: int = 64) -> DataFrame:
    """points with name: the range (name, line_start, line_end) of smallest start that covers them, else UNKNOWN. Ranges
    may nest and overlap: they are put into bins of lines, so that a point meets only those of its own bin."""
    spread = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("line_start") / bin_size), F.floor(F.col("line_end") / bin_size))))
    hit = points.withColumn("_bin", F.floor(F.col(at) / bin_size)).join(spread, [key, "_bin"]).where(F.col(at).between(F.col("line_start"), F.col("line_end")))
    best = hit.groupBy(key, at).agg(F.min_by("name", F.struct("line_start", "name")).alias("name"))
    return points.join(best, [key, at], "left").withColumn("name", F.coalesce("name", F.lit("UNKNOWN")))


def overlapping(a: DataFrame, b: DataFrame, key: str, bin_size: int = 64) -> DataFrame:
    """Pairs of ranges of one key that overlap: both are put into bins of lines, joined by (key, bin), and a pair
    counts in the first bin they share. a and b: key, name, line_start, line_end."""

    def binned(t: DataFrame, s: str) -> DataFrame:
        t = t.select(key, F.col("name").alias(f"name_{s}"), F.col("line_start").alias(f"start_{s}"), F.col("line_end").alias(f"end_{s}"))
        return t.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"start_{s}") / bin_size), F.floor(F.col(f"end_{s}") / bin_size))))

    both = binned(a, "a").join(binned(b, "b"), [key, "bin"])
    both = both.where("start_a <= end_b and start_b <= end_a").where(F.col("bin") == F.floor(F.greatest("start_a", "start_b") / bin_size))
    return both.drop("bin")


def merge_windows(windows: DataFrame, key: str, expand: int = 0, last: Column | None = None) -> DataFrame:
    """Windows (key, start_line, end_line, score, reason) grown by expand on both sides (not below 1 nor above last),
    merged where they overlap or touch, with the highest score and its reason (of equal ones the smallest)."""
    start = F.greatest(F.lit(1), F.col("start_line") - expand)
    end = F.col("end_line") + expand
    grown = windows.withColumn("start_line", start).withColumn("end_line", end if last is None else F.least(end, last))
    order = Window.partitionBy(key).orderBy("start_line", "end_line", "reason")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = grown.withColumn("_new", (reach.isNull() | (F.col("start_line") > reach + 1)).cast("int"))
    marked = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), F.min_by("reason", F.struct(-F.col("score"), "reason")).alias("reason")
    ).drop("island")


def gap_before(windows: DataFrame, key: str) -> DataFrame:
    """windows with omitted: the lines between a window and the one before."""
    before = F.lag("end_line", 1, 0).over(Window.partitionBy(key).orderBy("start_line"))
    return windows.withColumn("omitted", F.col("start_line") - before - 1)


def select_in_budget(items: DataFrame, key: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The items of each key taken greedily in order while their costs fit the budget; one that doesn't fit is passed
    over and later ones may still fit. A running sum can't express that, so each key's items are folded as an array."""
    ranked = items.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("_k", F.col(cost).cast("bigint").alias("c"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("taken"))

    def take(s: Column, r: Column) -> Column:
        fits = s["used"] + r["c"] <= budget
        return F.struct(F.when(fits, s["used"] + r["c"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["taken"], F.array(r["_k"]))).otherwise(s["taken"]).alias("taken"))

    chosen = ranked.groupBy(key).agg(F.aggregate(rows, start, take)["taken"].alias("t")).select(key, F.explode("t").alias("_k"))
    return ranked.join(chosen, [key, "_k"], "left_semi").drop("_k")


def greedy_batches(items: DataFrame, key: str, order: str, cost: str, budget: int, most: int) -> DataFrame:
    """items with batch, from 0: a new one begins when the next item would pass the budget or the batch has most items;
    an item over the budget is a batch alone."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(cost).cast("bigint").alias("c"))))
    start = F.expr(f"named_struct('batch', 0, 'used', 0L, 'n', 0, 'out', cast(array() as array<struct<{order}:{dict(items.dtypes)[order]},batch:int>>))")

    def put(s: Column, r: Column) -> Column:
        new = (s["n"] > 0) & ((s["used"] + r["c"] > budget) | (s["n"] >= most))
        batch = s["batch"] + new.cast("int")
        return F.struct(
            batch.alias("batch"), (F.when(new, F.lit(0)).otherwise(s["used"]) + r["c"]).cast("bigint").alias("used"), (F.when(new, F.lit(0)).otherwise(s["n"]) + 1).alias("n"),
            F.concat(s["out"], F.array(F.struct(r[order].alias(order), batch.alias("batch")))).alias("out"),
        )

    dealt = items.groupBy(key).agg(F.aggregate(rows, start, put)["out"].alias("o")).select(key, F.explode("o").alias("r")).select(key, f"r.{order}", "r.batch")
    return items.join(dealt, [key, order])


def fixed_batches(items: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return items.withColumn("batch", F.floor((k - 1) / size).cast("bigint"))


def overlap_windows(items: DataFrame, total: str, length: int, overlap: int) -> DataFrame:
    """items with start_line and end_line of windows of length lines that overlap, up to the last line."""
    stride = length - overlap
    starts = F.when(F.col(total) <= length, F.array(F.lit(1).cast("bigint"))).otherwise(F.sequence(F.lit(1).cast("bigint"), F.col(total) - overlap, F.lit(stride).cast("bigint")))
    return items.select("*", F.explode(starts).alias("start_line")).withColumn("end_line", F.least(F.col("start_line") + length - 1, F.col(total)))
