"""Orders, diagrams and reports of graphs as tables of lines. edges: src, dst, type; every diagram is a set of lines with
their key and place, so that a large one is written by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions.text import mermaid_id, mermaid_label
from ferrolith.operators.components import _inner, _outer, condensed_edges, depths, entered, strong_components
from ferrolith.operators.graph import reachable
from ferrolith.sources.shared import written

#: More than any path is long: the depth of what a cycle can be reached from.
ENDLESS = 1 << 60


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, level): 0 for nodes that call nothing, else one more than the highest that they call; null for
    those on a cycle or calling into one."""
    marks, by_src = entered(nodes, edges)
    nodes, edges = _inner(marks, by_src)
    parts = written(strong_components(nodes, edges), "components")
    alone = edges.where("src = dst").select(F.col("src").alias("artifact_id")).join(nodes, "artifact_id", "left_semi").select(F.col("artifact_id").alias("component"))
    rings = parts.groupBy("component").count().where("count > 1").select("component").unionByName(alone).distinct().withColumn("ring", F.lit(True))
    base = parts.select("component").distinct().join(rings, "component", "left").select(F.col("component").alias("node"), F.when(F.col("ring"), F.lit(ENDLESS)).otherwise(F.lit(0)).alias("least"))
    found = depths(base, condensed_edges(parts, edges)).select(F.col("node").alias("component"), "depth")
    inner = written(parts.join(found, "component").select("artifact_id", "depth"), "levels")
    outer = _outer(marks, by_src, inner.withColumnRenamed("artifact_id", "dst"), F.max("depth").alias("depth"))
    every = inner.unionByName(outer.select(F.col("node").alias("artifact_id"), F.coalesce(F.col("depth") + 1, F.lit(0).cast("bigint")).alias("depth")))
    return every.select("artifact_id", F.when(F.col("depth") < ENDLESS, F.col("depth")).alias("level"))


def exit_names(names: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, name): upper-case names that end with -EXIT and share what stands before it with another name of the key,
    which begins with that and a hyphen. An equi join on the beginnings at hyphens."""
    upper = names.select(key, F.upper("name").alias("name")).distinct()
    parts = F.split("name", "-")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    others = upper.where(F.size(parts) > 1).select(key, F.explode(begins).alias("prefix"), F.col("name").alias("other"))
    exits = upper.where(F.col("name").endswith("-EXIT") & (F.length("name") > 5)).withColumn("prefix", F.substring("name", F.lit(1), F.length("name") - 5))
    return exits.join(others, [key, "prefix"]).where("other <> name").select(key, "name").distinct()


def call_edges(paragraphs: DataFrame) -> DataFrame:
    """(file_id, src, dst): what the paragraphs (file_id, name, calls array of name and relation) of outlines perform."""
    return paragraphs.select("file_id", F.col("name").alias("src"), F.explode("calls").alias("c")).where("c.relation = 'performs'").select("file_id", "src", F.col("c.name").alias("dst"))


def flow_lines(nodes: DataFrame, edges: DataFrame, key: str, start: DataFrame | None = None) -> DataFrame:
    """(key, place, line) of a flow chart for each key: its nodes (key, name), edges between them (key, src, dst, type)
    solid and to others dotted, the others rounded; with start (column start: ids key/name) only what it reaches."""
    known = nodes.select(key, "name").distinct()
    e = edges.select(key, "src", "dst", "type").distinct().join(known.withColumnRenamed("name", "src"), [key, "src"], "left_semi")
    inner = known.select(key, F.col("name").alias("dst"), F.lit(True).alias("inner"))
    e = e.join(inner, [key, "dst"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    if start is not None:
        ids = e.select(F.concat_ws("/", key, "src").alias("src"), F.concat_ws("/", key, "dst").alias("dst"))
        reached = reachable(ids, start).select(F.col("node").alias("_id")).distinct()
        known = known.withColumn("_id", F.concat_ws("/", key, "name")).join(reached, "_id", "left_semi").drop("_id")
        e = e.withColumn("_id", F.concat_ws("/", key, "src")).join(reached, "_id", "left_semi").drop("_id")
    node = F.concat(F.lit("    "), mermaid_id(F.col("name")))
    heads = known.select(key).distinct().select(key, F.lit(0).alias("part"), F.lit("flowchart TD").alias("line"))
    inside = known.select(key, F.lit(1).alias("part"), F.concat(node, F.lit('["'), mermaid_label(F.col("name")), F.lit('"]')).alias("line"))
    outside = e.where("not inner").select(key, F.col("dst").alias("name")).distinct().select(key, F.lit(2).alias("part"), F.concat(node, F.lit('(["'), mermaid_label(F.col("name")), F.lit('"])')).alias("line"))
    arrow = F.when(F.col("inner"), F.lit(" -->|")).otherwise(F.lit(" -.->|"))
    arrows = e.select(key, F.lit(3).alias("part"), F.concat(F.lit("    "), mermaid_id(F.col("src")), arrow, mermaid_label(F.col("type")), F.lit("| "), mermaid_id(F.col("dst"))).alias("line"))
    lines = heads.unionByName(inside).unionByName(outside).unionByName(arrows)
    return lines.withColumn("place", (F.row_number().over(Window.partitionBy(key).orderBy("part", "line")) - 1).cast("bigint")).select(key, "place", "line")


def sequence_lines(paths: DataFrame, labels: DataFrame | None = None, most_variables: int = 3) -> DataFrame:
    """(start, place, line) of a sequence diagram for each path (start, path): its participants, then an arrow for each
    step. labels (src, dst, inputs, outputs): variables on the arrows, the first most_variables of each."""
    head = paths.select("start", F.lit(0).alias("part"), F.lit(0).alias("k"), F.lit("sequenceDiagram").alias("line"))
    who = paths.select("start", F.posexplode(F.array_distinct("path")).alias("k", "name")).select("start", F.lit(1).alias("part"), "k", F.concat(F.lit("    participant "), mermaid_id(F.col("name")), F.lit(" as "), mermaid_label(F.col("name"))).alias("line"))
    steps = paths.where(F.size("path") > 1).select("start", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("src"), F.slice("path", F.lit(2), F.size("path") - 1).alias("dst"))).alias("k", "s")).select("start", "k", "s.src", "s.dst")
    said = F.lit("calls")
    if labels is not None:
        steps = steps.join(labels.dropDuplicates(["src", "dst"]), ["src", "dst"], "left")

        def listed(c: str):
            more = F.when(F.size(c) > most_variables, F.lit(", ...")).otherwise(F.lit(""))
            return F.when(F.size(c) > 0, F.concat(F.array_join(F.slice(c, 1, most_variables), ", "), more))

        said = F.coalesce(F.nullif(F.concat_ws(" -> ", listed("inputs"), listed("outputs")), F.lit("")), F.lit("calls"))
    arrows = steps.select("start", F.lit(2).alias("part"), "k", F.concat(F.lit("    "), mermaid_id(F.col("src")), F.lit("->>"), mermaid_id(F.col("dst")), F.lit(": "), mermaid_label(said)).alias("line"))
    lines = head.unionByName(who).unionByName(arrows)
    return lines.withColumn("place", (F.row_number().over(Window.partitionBy("start").orderBy("part", "k")) - 1).cast("bigint")).select("start", "place", "line")


def report_lines(programs: DataFrame) -> DataFrame:
    """(section, place, line): a Markdown report of system_calls: a heading and a table row for each program, by kind."""
    heads = programs.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("kind").alias("section"), F.lit(0).alias("part"), F.concat(F.lit("## "), F.initcap(F.translate("kind", "_", " ")), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    rows = programs.select(F.col("kind").alias("section"), F.lit(1).alias("part"), F.concat(F.lit("| "), F.replace("name", F.lit("|"), F.lit("\\|")), F.lit(" | "), F.col("n_calls").cast("string"), F.lit(" | "), F.col("n_called_by").cast("string"), F.lit(" |")).alias("line"))
    lines = heads.unionByName(rows)
    return lines.withColumn("place", (F.row_number().over(Window.partitionBy("section").orderBy("part", "line")) - 1).cast("bigint")).select("section", "place", "line")


def summary_lines(statistics: DataFrame, width: int = 24) -> DataFrame:
    """(kind, line): a fixed-width text report of graph.statistics."""
    return statistics.select("kind", F.concat(F.rpad("type", width, "."), F.lpad(F.format_number("n", 0), 14, " ")).alias("line"))
