"""Graphs and tables as text: CSV, DOT, Cypher and Mermaid lines, JSON rows, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions.text import cypher_escape, dot_escape, mermaid_id, mermaid_label, safe_file_name


def csv_field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("[\",\\n\\r]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One column line; arrays are joined by ;"""
    kinds = dict(rows.dtypes)
    parts = [csv_field(F.array_join(c, ";") if kinds[c].startswith("array") else F.col(c)) for c in columns]
    return rows.select(F.concat_ws(",", *parts).alias("line"))


def dot_node(node: Column, label: Column) -> Column:
    return F.concat(F.lit('  "'), dot_escape(node), F.lit('" [label="'), dot_escape(label), F.lit('"];'))


def dot_edge(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat(F.lit('  "'), dot_escape(src), F.lit('" -> "'), dot_escape(dst), F.lit('" [label="'), dot_escape(kind), F.lit('"];'))


def cypher_node(node: Column, kind: Column, name: Column) -> Column:
    return F.concat(F.lit("CREATE (:"), F.initcap(kind), F.lit(" {id: '"), cypher_escape(node), F.lit("', name: '"), cypher_escape(name), F.lit("'});"))


def cypher_edge(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat(F.lit("MATCH (a {id: '"), cypher_escape(src), F.lit("'}), (b {id: '"), cypher_escape(dst), F.lit("'}) CREATE (a)-[:"), F.upper(kind), F.lit("]->(b);"))


def mermaid_edge(src: Column, dst: Column, label: Column, dotted: Column | None = None) -> Column:
    arrow = F.lit(" -->|") if dotted is None else F.when(dotted, F.lit(" -.->|")).otherwise(F.lit(" -->|"))
    return F.concat(F.lit("    "), mermaid_id(src), arrow, mermaid_label(label), F.lit("| "), mermaid_id(dst))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes the column line as text files; each task writes its own."""
    lines.select("line").write.mode("overwrite").text(path)


def write_bodies(bodies: DataFrame, path: str) -> None:
    """Writes the body of each paragraph (program, name, body) as text below program=.../paragraph=..., safe names."""
    named = bodies.select("program", safe_file_name(F.col("name")).alias("paragraph"), F.col("body").alias("value"))
    named.write.mode("overwrite").partitionBy("program", "paragraph").text(path)


def document_lines(documents: DataFrame) -> DataFrame:
    """(file_id, place, line): documentation (as of scan_documents) as Markdown: purpose, inputs, outputs, calls, rules and
    paragraphs, each section only where it holds something."""
    named = lambda rows, name, text: F.transform(rows, lambda r: F.concat(F.lit("- **"), F.coalesce(r[name], F.lit("?")), F.lit("**: "), F.coalesce(r[text], F.lit(""))))
    part = lambda head, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(""), F.lit(f"## {head}"), F.lit("")), rows)).otherwise(F.array().cast("array<string>"))
    purpose = F.when(F.col("purpose.summary").isNotNull(), F.array(F.col("purpose.summary"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.coalesce("header.program_id", "file_id"))), part("Purpose", purpose), part("Inputs", named("inputs", "name", "description")), part("Outputs", named("outputs", "name", "description")),
        part("Calls", named("called_programs", "program_name", "purpose")), part("Rules", named("business_rules", "rule_id", "description")), part("Paragraphs", named("paragraphs", "paragraph_name", "summary")),
    )
    return documents.select("file_id", F.posexplode(lines).alias("place", "line"))


def linked_lines(lines: DataFrame, links: DataFrame, key: str = "file_id") -> DataFrame:
    """lines (key, line_no, text) with a link line after each heading that names one of links (key, name, target), unless
    it stands there already; line numbers run anew."""
    heading = F.upper(F.trim(F.regexp_replace(F.regexp_extract("text", "^#{2,6}\\s+(.+?)\\s*$", 1), "`", "")))
    after = F.lead("text").over(Window.partitionBy(key).orderBy("line_no"))
    known = links.select(key, F.upper("name").alias("_h"), "target").dropDuplicates([key, "_h"])
    joined = lines.withColumn("_h", heading).withColumn("_next", after).join(known, [key, "_h"], "left")
    link = F.concat(F.lit("[Source]("), F.col("target"), F.lit(")"))
    missing = F.col("target").isNotNull() & ~F.coalesce(F.col("_next") == link, F.lit(False))
    rows = joined.select(key, "line_no", F.posexplode(F.when(missing, F.array(F.col("text"), link)).otherwise(F.array("text"))).alias("_k", "text"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line_no", "_k")).cast("bigint").alias("line_no"), "text")
