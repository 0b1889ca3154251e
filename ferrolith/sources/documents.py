"""Scans of documentation JSON: one file a document, its sections as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.functions import json_schema

#: The sections of a documentation file.
DOCUMENT = """
header STRUCT<program_id: STRING, file_name: STRING, file_type: STRING, analyzed_by: STRING, analyzed_at: STRING, iteration_count: INT, final_status: STRING>,
purpose STRUCT<summary: STRING, business_context: STRING, program_type: STRING, citations: ARRAY<BIGINT>>,
inputs ARRAY<STRUCT<name: STRING, io_type: STRING, description: STRING, copybook: STRING, citation: ARRAY<BIGINT>>>,
outputs ARRAY<STRUCT<name: STRING, io_type: STRING, description: STRING, copybook: STRING, citation: ARRAY<BIGINT>>>,
called_programs ARRAY<STRUCT<program_name: STRING, call_type: STRING, purpose: STRING, parameters: ARRAY<STRING>, citation: BIGINT>>,
business_rules ARRAY<STRUCT<rule_id: STRING, description: STRING, logic_summary: STRING, conditions: ARRAY<STRING>, citation: ARRAY<BIGINT>>>,
copybooks_used ARRAY<STRUCT<copybook_name: STRING, purpose: STRING, location: STRING, citation: BIGINT>>,
paragraphs ARRAY<STRUCT<paragraph_name: STRING, summary: STRING, purpose: STRING, called_by: ARRAY<STRING>, calls: ARRAY<STRING>, citation: ARRAY<BIGINT>, is_dead_code: BOOLEAN, dead_code_reason: STRING>>
"""


def scan_documents(spark: SparkSession, root: str, glob: str = "*.doc.json") -> DataFrame:
    """file_id and the sections of every file below root that matches glob; files that aren't such JSON are skipped.
    Lists may be null, and so are fields of another type than they should be. Each file is one row, read by the executors."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    is_object = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    return texts.where(is_object).select(name.alias("file_id"), F.from_json("value", DOCUMENT).alias("d")).select("file_id", "d.*")


def scan_values(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """(file_id, text) of every JSON file below root that matches glob, one row a file, read by the executors."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return texts.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file_id"), F.col("value").alias("text"))


def checked(texts: DataFrame, schema: dict, text: str = "text") -> DataFrame:
    """texts with value (a VARIANT, null if the text is no JSON) and problems, an array of (path, problem) that is empty if
    the value keeps the schema. A null or broken text has the one problem "not JSON" at the root. A text is read once."""
    parsed = texts.withColumn("value", F.try_parse_json(text))
    no_json = F.array(F.struct(F.lit("").alias("path"), F.lit("not JSON").alias("problem")))
    return parsed.withColumn("problems", F.coalesce(json_schema.schema_problems(F.col("value"), schema), no_json))


def valid(texts: DataFrame, schema: dict, text: str = "text") -> DataFrame:
    """texts that keep the schema, with value."""
    return checked(texts, schema, text).where(F.size("problems") == 0).drop("problems")


def problems(texts: DataFrame, schema: dict, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, path, problem): a row for each place at which a text breaks the schema."""
    rows = checked(texts.select(key, text), schema, text).select(key, F.explode("problems").alias("p"))
    return rows.select(key, "p.path", "p.problem")


@dataclass(frozen=True)
class Criterion:
    """What a document of a type must say: the section, by its path, and how much that matters."""

    file_type: str
    name: str
    section: str
    priority: str = "HIGH"


def failed_criteria(documents: DataFrame, criteria: list[Criterion], key: str = "file_id", value: Column | None = None) -> DataFrame:
    """(key, name, section, priority) of the criteria that documents (key, file_type, value: VARIANT) fail. Types without
    criteria, and null types, fail none; a null value fails all of its type. Sections are read once for all types."""
    value = F.col("value") if value is None else value
    places = sorted({c.section for c in criteria})
    if not criteria:
        return documents.select(key, *[F.lit("").alias(c) for c in ("name", "section", "priority")]).limit(0)
    told = documents.select(key, "file_type", *[json_schema.section_is_documented(value, place).alias(f"_s{k}") for k, place in enumerate(places)])
    rows = [
        F.when((F.col("file_type") == c.file_type) & ~F.col(f"_s{places.index(c.section)}"), F.struct(F.lit(c.name).alias("name"), F.lit(c.section).alias("section"), F.lit(c.priority).alias("priority")))
        for c in criteria
    ]
    return told.select(key, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("c")).select(key, "c.*")


def section(documents: DataFrame, name: str) -> DataFrame:
    """(file_id, ord, the fields) of a section's entries."""
    rows = documents.select("file_id", F.posexplode(name).alias("ord", "e"))
    return rows.select("file_id", "ord", "e.*")


def summaries(documents: DataFrame) -> DataFrame:
    """(file_id, program_id, program_type, summary, status, n_paragraphs, n_rules, n_dead): a row a document."""
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("bigint")
    dead = F.filter("paragraphs", lambda p: F.coalesce(p["is_dead_code"], F.lit(False)))
    return documents.select(
        "file_id", F.col("header.program_id").alias("program_id"), F.col("purpose.program_type").alias("program_type"), F.col("purpose.summary").alias("summary"), F.col("header.final_status").alias("status"),
        count("paragraphs").alias("n_paragraphs"), count("business_rules").alias("n_rules"), count(dead).alias("n_dead"),
    )


def without_summary(documents: DataFrame, stub: str = "[") -> DataFrame:
    """(file_id, paragraph_name) of paragraphs whose summary is missing, blank or still begins as a stub does."""
    text = F.trim(F.coalesce("summary", F.lit("")))
    return section(documents, "paragraphs").where((text == "") | text.startswith(stub)).select("file_id", "paragraph_name")
