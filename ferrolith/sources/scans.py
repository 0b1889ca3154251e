"""Scans of saved JSON and of skill files: graphs, chunks, tickets; each file is one row, read by the executors, and one
that isn't such JSON gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.functions import extract
from ferrolith.operators.tickets import loaded

_PLACE = "STRUCT<file_path: STRING, line_start: INT, line_end: INT>"

#: The parts of a saved graph, of a chunk and of a ticket store.
GRAPH = f"""
version STRING, source_root STRING,
artifacts MAP<STRING, STRUCT<id: STRING, artifact_type: STRING, category: STRING, canonical_name: STRING, aliases: ARRAY<STRING>, defined_in: {_PLACE}, language: STRING>>,
relationships ARRAY<STRUCT<id: STRING, from_artifact: STRING, to_artifact: STRING, relationship_type: STRING, location: {_PLACE}, evidence_text: STRING, confidence: DOUBLE, resolution_method: STRING, is_resolved: BOOLEAN>>,
unresolved ARRAY<STRUCT<reference_text: STRING, expected_type: STRING, location: {_PLACE}, containing_artifact: STRING, candidates: ARRAY<STRING>, best_score: DOUBLE, reason: STRING>>
"""
CHUNK = """
batch_idx INT, total_batches INT, saved_at STRING,
template STRUCT<purpose: STRUCT<summary: STRING>, paragraphs: ARRAY<STRUCT<paragraph_name: STRING, summary: STRING, purpose: STRING>>>
"""
TICKETS = """
current_cycle INT,
tickets ARRAY<STRUCT<ticket_id: STRING, ticket_type: STRING, state: STRING, file_name: STRING, program_id: STRING, cycle_number: INT, worker_id: STRING, parent_ticket_id: STRING, decision: STRING, created_at: STRING, updated_at: STRING, metadata: MAP<STRING, STRING>>>
"""


def _objects(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    is_object = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    return texts.where(is_object).select(name.alias("file_id"), F.from_json("value", schema).alias("d")).select("file_id", "d.*")


def scan_graphs(spark: SparkSession, root: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (artifact_id, type, category, name, aliases, file_id, line_start, line_end, language), edges (src, dst, type,
    file_id, line, evidence, confidence, method) and unresolved references of saved graphs."""
    graphs = _objects(spark, root, glob, GRAPH)
    a = graphs.select(F.explode("artifacts").alias("artifact_id", "a"))
    nodes = a.select(
        "artifact_id", F.col("a.artifact_type").alias("type"), "a.category", F.col("a.canonical_name").alias("name"), "a.aliases", F.col("a.defined_in.file_path").alias("file_id"),
        F.col("a.defined_in.line_start").alias("line_start"), F.col("a.defined_in.line_end").alias("line_end"), "a.language",
    )
    r = graphs.select(F.explode("relationships").alias("r"))
    edges = r.select(
        F.col("r.from_artifact").alias("src"), F.col("r.to_artifact").alias("dst"), F.col("r.relationship_type").alias("type"), F.col("r.location.file_path").alias("file_id"),
        F.col("r.location.line_start").alias("line"), F.col("r.evidence_text").alias("evidence"), "r.confidence", F.col("r.resolution_method").alias("method"),
    )
    u = graphs.select(F.explode("unresolved").alias("u"))
    return nodes, edges, u.select(F.col("u.reference_text").alias("raw_text"), "u.expected_type", F.col("u.containing_artifact").alias("containing_id"), F.col("u.location.line_start").alias("line"), "u.candidates", "u.best_score", "u.reason")


def scan_chunks(spark: SparkSession, root: str, glob: str = "chunk_*.json") -> DataFrame:
    """(place, batch_idx, total_batches, purpose, paragraphs, saved_at): a row a chunk, by batch and then file; of its
    paragraphs the named ones."""
    chunks = _objects(spark, root, glob, CHUNK)
    named = F.filter("template.paragraphs", lambda p: F.coalesce(p["paragraph_name"], F.lit("")) != "")
    batch = F.coalesce("batch_idx", F.lit(0))
    rows = chunks.select("file_id", batch.alias("batch_idx"), F.coalesce("total_batches", F.lit(0)).alias("total_batches"), F.col("template.purpose.summary").alias("purpose"), F.coalesce(named, F.expr("array()")).alias("paragraphs"), "saved_at")
    return rows.orderBy("batch_idx", "file_id").drop("file_id")


def scan_tickets(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Tickets of saved stores: rows without id, type, state or file are skipped, work that nobody goes on with is
    created again and has no worker, times that don't parse are null; of an id the last update counts."""
    t = _objects(spark, root, glob, TICKETS).select(F.explode("tickets").alias("t")).select("t.*")
    t = t.where("ticket_id is not null and ticket_type is not null and state is not null and file_name is not null")
    again = F.col("state").isin("claimed", "in_progress", "blocked")
    t = t.withColumn("worker_id", F.when(~again, F.col("worker_id"))).withColumn("cycle_number", F.coalesce("cycle_number", F.lit(1)))
    t = loaded(t).withColumns({c: extract.parsed_time(F.col(c)) for c in ("created_at", "updated_at")})
    last = Window.partitionBy("ticket_id").orderBy(F.col("updated_at").desc_nulls_last())
    return t.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def scan_skills(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(file_id, name, description, tags, content) of skill files: front matter and what follows it. The name is the
    file's without one; tags are a list of lines, in brackets, or parted by commas."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="{SKILL,skill}.md")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    front = F.regexp_extract("value", "(?s)\\A---\\s*\\n(.*?)\\n---\\s*(?:\\n|\\z)", 1)
    field = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(front, f"(?m)^{k}:[ \\t]*(.+?)[ \\t]*$", 1), "^([\"'])(.*)\\1$", "$2"), F.lit(""))
    listed = F.regexp_extract_all(F.regexp_extract(front, "(?m)^tags:[ \\t]*\\n((?:[ \\t]*-[^\\n]*\\n?)+)", 1), F.lit("-[ \\t]*([^\\n]+)"), 1)
    inline = F.split(F.regexp_replace(field("tags"), "^\\[|\\]$", ""), ",")
    tags = F.filter(F.transform(F.coalesce(inline, listed), lambda x: F.trim(x)), lambda x: x != "")
    content = F.regexp_replace("value", "(?s)\\A---\\s*\\n.*?\\n---\\s*(?:\\n|\\z)", "")
    return texts.select(
        path.alias("file_id"), F.coalesce(field("name"), F.regexp_extract(path, "([^/]+)\\.[^./]+$", 1)).alias("name"), F.coalesce(field("description"), F.lit("")).alias("description"),
        tags.alias("tags"), F.trim(content).alias("content"),
    )
