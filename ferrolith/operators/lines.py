"""Line-level operators: texts to numbered lines, flags, fixed columns, continuations, header ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files are taken together until they have so many lines or bytes.
BATCH_LINES, BATCH_BYTES = 1 << 16, 1 << 24


def explode_lines(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, line_no from 1, text): split at \\n; a null content counts as one empty line."""
    parts = F.split(F.coalesce(F.col(content), F.lit("")), "\n", -1)
    return files.select(key, F.posexplode(parts).alias("at", "text")).select(key, (F.col("at") + 1).cast("bigint").alias("line_no"), "text")


def dealt(rows: DataFrame, key: str, rows_a_part: int = 4000) -> DataFrame:
    """rows dealt by key into parts of about rows_a_part. Keys from which whole texts are written come from few small file
    splits; dealt before that, the texts' lines lie by key already for all windows, groups and joins by it that follow.
    A number of parts that is asked for isn't merged again by the sizes of the keys."""
    return rows.repartition(max(1, -(-rows.count() // rows_a_part)), key)


def filed(rows: DataFrame, key: str = "file_id", order: list[str] = ("line_no",)) -> DataFrame:
    """rows with _n, their number in their file: the files of a partition stand one after another, each in order, as
    whole_files() takes them."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of filed(), as they come in Arrow batches, in batches of whole files; a file begins where _n is 1."""
    held, lines, size = [], 0, 0
    for batch in batches:
        starts = np.flatnonzero(batch.column("_n").to_numpy() == 1)
        if held and len(starts) and (lines >= BATCH_LINES or size >= BATCH_BYTES):
            if starts[0]:
                held.append(batch.slice(0, starts[0]))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, lines, size, batch = [], 0, 0, batch.slice(starts[0])
        if batch.num_rows:
            held.append(batch)
            lines, size = lines + batch.num_rows, size + batch.get_total_buffer_size()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fixed_code(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Column 7 and the code of lines of fixed-column source, as fixed_format() has them; a line that ends before column 7 has
    an empty mark."""
    return pc.utf8_slice_codeunits(text, 6, 7), pc.utf8_rtrim(pc.utf8_slice_codeunits(text, 7, 72), " ")


def join_lines(lines: DataFrame, key: str = "file_id", text: str = "text", order: str = "line_no") -> DataFrame:
    """(key, content): the lines of each file in order, joined by \\n."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return lines.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r[text], F.lit(""))), "\n").alias("content"))


def flag_lines(lines: DataFrame, key: str = "file_id", long: int = 200) -> DataFrame:
    """lines with is_blank, is_long, and is_repeated: another line of the file has the same text and isn't blank.

    Copies are counted by (file, text) and joined back, so that no file is held in one task.
    """
    blank = F.trim("text") == ""
    times = lines.where(~blank).groupBy(key, "text").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return lines.join(times, [key, "text"], "left").select(*lines.columns, blank.alias("is_blank"), (F.length("text") > long).alias("is_long"), F.col("_n").isNotNull().alias("is_repeated"))


def strip_left(text: Column, columns: int) -> Column:
    """The text without its first columns, if it is longer than they are."""
    return F.when(F.length(text) >= columns, F.substring(text, columns + 1, 1 << 30)).otherwise(text)


def strip_right(text: Column, column: int) -> Column:
    """The text cut after column, without trailing blanks."""
    return F.rtrim(F.substring(text, 1, column))


def strip_block_comments(text: Column, start: str = "/*", end: str = "*/") -> Column:
    quote = lambda s: "".join(f"\\{c}" if not c.isalnum() else c for c in s)
    return F.regexp_replace(text, f"(?s){quote(start)}.*?{quote(end)}", "")


def mask_quoted(text: Column) -> Column:
    """Every quoted literal as empty quotes."""
    return F.regexp_replace(F.regexp_replace(text, '"[^"\\n]*"', '""'), "'[^'\\n]*'", "''")


def fixed_format(lines: DataFrame) -> DataFrame:
    """lines of fixed-column source with indicator (column 7), area_a (8-11), area_b (12-72), code and flags."""
    padded = F.rpad(F.coalesce("text", F.lit("")), 72, " ")
    mark = F.substring(padded, 7, 1)
    return (
        lines.withColumn("indicator", mark)
        .withColumn("area_a", F.substring(padded, 8, 4))
        .withColumn("area_b", F.rtrim(F.substring(padded, 12, 61)))
        .withColumn("code", F.rtrim(F.substring(padded, 8, 65)))
        .withColumn("is_comment", mark.isin("*", "/"))
        .withColumn("is_debug", mark.isin("D", "d"))
        .withColumn("is_continuation", mark == "-")
        .withColumn("is_blank", F.trim(F.substring(padded, 8, 65)) == "")
    )


def islands(rows: DataFrame, starts: Column, key: list[str], order: str) -> DataFrame:
    """rows with island: the number of rows so far, in order within key, at which starts holds."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(w))


def merge_continuations(lines: DataFrame, key: str = "file_id", keep: list[str] = ()) -> DataFrame:
    """Logical lines of fixed_format(): a continuation is appended to the last code line before it; within a literal
    that the line left open, the repeated quote goes. Comments and blank lines drop out. Columns to keep are the same in
    all parts of a logical line."""
    code = lines.where(~F.col("is_comment") & ~F.col("is_blank"))
    grouped = islands(code, ~F.col("is_continuation"), [key], "line_no")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "is_continuation", "code")))

    def append(so_far: Column, r: Column) -> Column:
        piece = F.ltrim(r["code"])
        open_ = F.size(F.split(so_far, "'", -1)) % 2 == 0
        return F.when(so_far.isNull(), r["code"]).when(open_, F.concat(so_far, F.regexp_replace(piece, "^['\"]", ""))).otherwise(F.concat(so_far, F.lit(" "), piece))

    text = F.aggregate(parts, F.lit(None).cast("string"), append)
    return grouped.groupBy(key, "island").agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("last_line"), text.alias("text"), *[F.first(c).alias(c) for c in keep]).drop("island")


def header_ranges(headers: DataFrame, ends: DataFrame, key: str = "file_id") -> DataFrame:
    """headers (key, name, line_no) as ranges (key, name, line_start, line_end): up to the line before the next header
    of the file, the last one up to the file's last line (ends: key, last_line). Joined by sort and merge: sizes that are
    estimated from texts say nothing of the number of their lines, so a broadcast may be far larger than it seems."""
    nxt = F.lead("line_no").over(Window.partitionBy(key).orderBy("line_no"))
    ranged = headers.select(key, "name", F.col("line_no").alias("line_start"), (nxt - 1).alias("_end"))
    return ranged.join(ends.hint("merge"), key).select(key, "name", "line_start", F.coalesce("_end", "last_line").alias("line_end"))


def last_code_line(lines: DataFrame, is_code: Column, key: str = "file_id") -> DataFrame:
    return lines.where(is_code).groupBy(key).agg(F.max("line_no").alias("last_line"))


def slice_lines(lines: DataFrame, ranges: DataFrame, key: str = "file_id") -> DataFrame:
    """The lines of each named range: an equi join by file, never a broadcast one, then the bounds."""
    return lines.join(ranges.hint("merge"), key).where("line_no between line_start and line_end").select(key, "name", "line_no", "text")


def bodies(lines: DataFrame, ranges: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, name, body): the text of each named range."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return slice_lines(lines, ranges, key).groupBy(key, "name").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("body"))
