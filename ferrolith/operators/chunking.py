"""Cutting files into chunks within a token budget."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOK_BACK = 50

#: Lines that begin a definition, before which a chunk may end.
DEFINITION = r"^\s*(?:def |class |function |procedure |sub |[A-Z0-9-]+ (?:SECTION|DIVISION)\.)"


def needs_chunking(tokens: Column, budget: int) -> Column:
    return tokens > budget


def chunk_ends(lines: list[str], budget_chars: int, definition: str = DEFINITION) -> list[int]:
    """The last line (from 1) of each chunk: as many lines as fit, then back at most LOOK_BACK lines to a blank line,
    after which it ends, passing boundaries before definition lines on the way. At least one line a chunk."""
    starts, out, at = re.compile(definition, re.I), [], 0
    while at < len(lines):
        used, end = len(lines[at]), at + 1
        while end < len(lines) and used + 1 + len(lines[end]) <= budget_chars:
            used += 1 + len(lines[end])
            end += 1
        stop = end
        if end < len(lines):
            for k in range(end - 1, max(at, end - 1 - LOOK_BACK) - 1, -1):
                if not lines[k].strip():
                    stop = k + 1
                    break
                if starts.match(lines[k]):
                    stop = k
            if stop <= at:
                stop = end
        out.append(stop)
        at = stop
    return out


def chunk_files(files: DataFrame, budget_tokens: int, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, seq, start_line, end_line, tokens, chunk): each file is cut by itself, whole files at a time in a task."""

    def run(frames):
        for frame in frames:
            rows = []
            for k, text in zip(frame[key], frame[content]):
                lines = (text or "").split("\n")
                start = 0
                for seq, end in enumerate(chunk_ends(lines, 4 * budget_tokens + 3)):
                    body = "\n".join(lines[start:end])
                    rows.append((k, seq, start + 1, end, len(body) // 4, body))
                    start = end
            yield pd.DataFrame(rows, columns=[key, "seq", "start_line", "end_line", "tokens", "chunk"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"{key} {kind}, seq bigint, start_line bigint, end_line bigint, tokens bigint, chunk string")


def source_windows(n_lines: Column, most_prompt: int) -> tuple[Column, Column]:
    """The length and the overlap of windows for a summary by parts."""
    length = F.greatest(F.lit(100), F.floor(F.floor((F.lit(most_prompt) - 1500) * 3.5) / 72))
    return F.least(length, n_lines), F.greatest(F.lit(10), F.floor(length * 0.1))


def excerpt(lines: DataFrame, key: str, budget: Column) -> DataFrame:
    """The first lines of each file that fit a budget of tokens, by a running sum."""
    from pyspark.sql import Window

    upto = F.sum(F.floor((F.length("text") + 1) / 4)).over(Window.partitionBy(key).orderBy("line_no"))
    return lines.withColumn("_t", upto).where(F.col("_t") <= budget).drop("_t")


def hint_windows(hints: DataFrame, starts: DataFrame, around: int = 10) -> DataFrame:
    """(file_id, start_line, end_line, score, reason) of what hints (file_id, lines, sections, names) point at: cited lines
    (1.0), the first lines of named sections (0.9) and of definitions of names (0.7), each with the lines around. starts:
    file_id, kind (section or name), name, line_no."""
    cited = hints.select("file_id", F.explode("lines").alias("line_no"), F.lit(1.0).alias("score"), F.lit("line").alias("reason"))

    def found(column: str, kind: str, score: float) -> DataFrame:
        asked = hints.select("file_id", F.explode(F.array_distinct(F.transform(column, F.upper))).alias("name"))
        at = starts.where(F.col("kind") == kind).select("file_id", F.upper("name").alias("name"), F.col("line_no").cast("bigint").alias("line_no"))
        return asked.join(at, ["file_id", "name"]).select("file_id", "line_no", F.lit(score).alias("score"), F.lit(kind).alias("reason"))

    points = cited.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(found("sections", "section", 0.9)).unionByName(found("names", "name", 0.7)).distinct()
    return points.select("file_id", F.greatest(F.lit(1), F.col("line_no") - around).alias("start_line"), (F.col("line_no") + around).alias("end_line"), "score", "reason")


def hashed_window(files: DataFrame, budget: int, key: str = "file_id", least: int = 10) -> DataFrame:
    """files (key, n_lines, n_tokens) with one window (start_line, end_line) that fits a budget of tokens, at a place
    that the key's hash alone decides, so that reruns agree."""
    share = F.when(F.col("n_tokens") > 0, F.lit(budget) / F.col("n_tokens")).otherwise(1.0)
    length = F.least(F.col("n_lines"), F.greatest(F.lit(least), F.floor(F.col("n_lines") * share)))
    start = F.lit(1) + F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.greatest(F.col("n_lines") - length + 1, F.lit(1)))
    return files.withColumn("start_line", start.cast("bigint")).withColumn("end_line", F.least("n_lines", F.col("start_line") + length - 1).cast("bigint"))


def prompt_reductions(outline: Column, source: Column, previous: Column, copybooks: Column, budget: Column) -> Column:
    """What a prompt over its budget gives up next, by the sizes of its parts in tokens: outline, source, previous,
    copybooks, or null if it fits or nothing is left."""
    over = outline + source + previous + copybooks > budget
    return F.when(over, F.when(outline > 0, "outline").when(source > 0, "source").when(previous > 0, "previous").when(copybooks > 0, "copybooks"))
