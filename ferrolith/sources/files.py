"""Scans of source trees: files with their type, decoded content, inventories and include look-up."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Source types by lower-case extension.
EXTENSIONS = {
    ".cbl": "cobol", ".cob": "cobol", ".cobol": "cobol", ".cpy": "copybook", ".copy": "copybook", ".jcl": "jcl", ".prc": "jcl", ".proc": "jcl",
    ".bms": "bms", ".ddl": "db2_ddl", ".sql": "db2_ddl", ".py": "python", ".dc": "datacard", ".ctl": "datacard",
}

#: Folders that are never read.
SKIPPED_FOLDERS = [".git", ".svn", ".hg", "__pycache__", "node_modules", ".venv"]

FILE_NAME_GLOBS = {"*SORT*": "datacard", "*.sortcard": "datacard"}


def glob_regex(glob: str) -> str:
    """A glob as a regular expression that Java reads too: without the flags and anchors that Python writes."""
    body = fnmatch.translate(glob)
    return "^" + body.removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z") + "$"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are that, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def decoded_ebcdic(content: Column) -> Column:
    """Bytes of code page 037, byte by byte, as characters."""
    page = bytes(range(256)).decode("cp037")
    latin = "".join(map(chr, range(256)))
    return F.translate(F.decode(content, "ISO-8859-1"), latin, page)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def source_type(path: Column, globs_first: bool = False) -> Column:
    """By extension, or null; with globs_first, globs on the file name win over it."""
    by_extension = F.lit(None).cast("string")
    for e, t in EXTENSIONS.items():
        by_extension = F.when(extension(path) == e, t).otherwise(by_extension)
    if not globs_first:
        return by_extension
    name, out = F.regexp_extract(path, "([^/]+)$", 1), by_extension
    for g, t in reversed(FILE_NAME_GLOBS.items()):
        out = F.when(name.rlike(glob_regex(g)), t).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, excluded: list[str] = ()) -> DataFrame:
    """file_id (path below the root), source_type, n_bytes, content of every file below root that isn't excluded by a
    glob or a skipped folder. Each file is one row, read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + glob_regex(root.rstrip("/"))[1:-1] + "/", "")
    rows = files.select(below.alias("file_id"), source_type(F.col("path")).alias("source_type"), F.col("length").alias("n_bytes"), decoded(F.col("content")).alias("content"))
    for folder in SKIPPED_FOLDERS:
        rows = rows.where(~F.concat(F.lit("/"), "file_id").contains(f"/{folder}/"))
    for g in excluded:
        rows = rows.where(~F.col("file_id").rlike(glob_regex(g)) & ~F.regexp_extract("file_id", "([^/]+)$", 1).rlike(glob_regex(g)))
    return rows


def inventory(files: DataFrame) -> DataFrame:
    """(source_type, n_files, n_bytes) of all types, those without files too."""
    spark = files.sparkSession
    kinds = spark.createDataFrame([(t,) for t in sorted({*EXTENSIONS.values()})], "source_type string")
    counts = files.groupBy("source_type").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    return kinds.join(counts, "source_type", "full").fillna(0, ["n_files", "n_bytes"])


def guess_type(content: Column) -> Column:
    """By words in the first 2000 characters."""
    head = F.upper(F.substring(content, 1, 2000))
    return (
        F.when(head.rlike(r"IDENTIFICATION\s+DIVISION|PROCEDURE\s+DIVISION"), "cobol")
        .when(head.rlike(r"(?m)^//[A-Z0-9$#@]+\s+(JOB|EXEC|PROC)\b"), "jcl")
        .when(head.rlike(r"\bDFHMSD\b|\bDFHMDI\b"), "bms")
        .when(head.rlike(r"\bCREATE\s+(TABLE|VIEW|INDEX)\b"), "db2_ddl")
        .when(head.rlike(r"(?m)^\s+\d\d\s+[A-Z0-9-]+.*\bPIC\b"), "copybook")
        .otherwise("other")
    )


def includes(files: DataFrame, folders: list[str] = (), extensions: tuple[str, ...] = (".cpy", ".copy", "")) -> DataFrame:
    """(name, file_id): the file that each include name stands for: by order of folders, then of extensions, then path."""
    place = F.lit(len(folders))
    for k, f in reversed(list(enumerate(folders))):
        place = F.when(F.col("file_id").startswith(f.rstrip("/") + "/"), k).otherwise(place)
    rank = F.lit(None).cast("int")
    for k, e in reversed(list(enumerate(extensions))):
        rank = F.when(extension(F.col("file_id")) == e, k).otherwise(rank)
    named = files.select(stem(F.col("file_id")).alias("name"), "file_id", place.alias("p"), rank.alias("r")).where("r is not null")
    best = Window.partitionBy("name").orderBy("p", "r", "file_id")
    return named.withColumn("k", F.row_number().over(best)).where("k = 1").select("name", "file_id")
