"""Typed directed graphs as node and edge tables. nodes: artifact_id, type, name, file_id. edges: src, dst, type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators.components import entered, walk_parts
from ferrolith.sources.shared import settled, written


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row an artifact_id: the first one with a place (line_start), else the first; by column ord."""
    w = Window.partitionBy("artifact_id").orderBy(F.col("line_start").isNull(), "ord")
    return nodes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def split_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between known nodes (a source may also be a file::), and the others."""
    known = nodes.select("artifact_id").distinct()
    src, dst = (known.withColumnRenamed("artifact_id", c) for c in ("src", "dst"))
    files = edges.where(F.col("src").startswith("file::"))
    good = edges.where(~F.col("src").startswith("file::")).join(src, "src", "left_semi").unionByName(files).join(dst, "dst", "left_semi").select(edges.columns)
    # both ends are looked up once; asked for by number, parts aren't merged by the sizes of their blocks, in which alike
    # names take far less room than in a sort
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = edges.repartition(parts, "dst").join(dst.withColumn("_to", F.lit(True)).hint("merge"), "dst", "left")
    seen = to.join(src.withColumn("_from", F.lit(True)).hint("merge"), "src", "left")
    lost = seen.where("_to is null or (_from is null and not coalesce(startswith(src, 'file::'), true))").select(edges.columns)
    return good, lost


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with n_out and n_in (bigint)."""
    out = edges.groupBy(F.col("src").alias("artifact_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("artifact_id")).agg(F.count(F.lit(1)).alias("n_in"))
    both = nodes.join(out, "artifact_id", "left").join(into, "artifact_id", "left")
    return both.fillna(0, ["n_out", "n_in"])


def statistics(nodes: DataFrame, edges: DataFrame, n_unresolved: Column | int = 0) -> DataFrame:
    """(kind, type, n): nodes and edges by type, their totals and the percentage of references resolved."""
    by_node = nodes.groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    by_edge = edges.groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("edge").alias("kind"), "type", "n")
    total = by_node.unionByName(by_edge).groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("all").alias("type"), "n")
    rate = edges.agg(F.count(F.lit(1)).alias("e")).select(F.lit("rate").alias("kind"), F.lit("resolved").alias("type"), F.when(F.col("e") + n_unresolved == 0, 100.0).otherwise(F.round(100.0 * F.col("e") / (F.col("e") + n_unresolved), 4)).alias("n"))
    return by_node.unionByName(by_edge).unionByName(total).unionByName(rate)


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n): nodes without edges, edges that repeat, edges of unknown nodes."""
    _, lost = split_edges(edges, nodes)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("artifact_id")).distinct()
    alone = nodes.join(ends, "artifact_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("isolated").alias("problem"), "n")
    again = edges.groupBy("src", "dst", "type").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("problem"), "n")
    orphans = lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan").alias("problem"), "n")
    return alone.unionByName(again).unionByName(orphans)


def dead_nodes(nodes: DataFrame, edges: DataFrame, entry_types: list[str]) -> DataFrame:
    """Nodes that nothing points at and whose type isn't an entry by itself, with a reason."""
    dead = nodes.where(~F.col("type").isin(entry_types)).join(edges.select(F.col("dst").alias("artifact_id")), "artifact_id", "left_anti")
    return dead.withColumn("reason", F.concat(F.lit("no reference to this "), F.col("type")))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("artifact_id")).distinct(), "artifact_id", "left_anti")


def leaf_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("artifact_id")), "artifact_id", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, targets): the distinct targets in order."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def k_hop(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, distance): what each start (column start) reaches in at most hops steps, by the shortest way.
    Each step joins only the new frontier."""
    step = edges.select("src", "dst").distinct()
    seen = frontier = starts.select("start", F.col("start").alias("node"), F.lit(0).cast("bigint").alias("distance"))
    step, seen = settled(step), settled(seen)
    frontier = seen
    for k in range(1, hops + 1):
        found = frontier.join(step, frontier["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = settled(found.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(k).cast("bigint")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): everything that a start reaches. Rounds go on until none finds anything new; each writes what it
    found to the shared folder, and is compared with what the rounds before wrote."""
    step = written(edges.select("src", "dst").distinct(), "reach-edges")
    rounds = [written(starts.select("start", F.col("start").alias("node")).distinct(), "reached")]
    while True:
        found = rounds[-1].join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        for seen in rounds:
            found = found.join(seen, ["start", "node"], "left_anti")
        found = written(found, "reached")
        if not found.limit(1).count():
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(found)
        if len(rounds) > 16:
            rounds = [written(reduce(DataFrame.unionByName, rounds[:-1]), "reached"), found]


def simple_paths(edges: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """(path): all paths of 1 to longest edges from the starts (column start) that visit no node twice."""
    step = settled(edges.select("src", "dst").distinct())
    paths = starts.select(F.array("start").alias("path"))
    out = None
    for _ in range(longest):
        grown = paths.join(step, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = settled(grown.select(F.concat("path", F.array("dst")).alias("path")))  # else each length would repeat all shorter ones
        out = paths if out is None else out.unionByName(paths)
        if paths.isEmpty():
            break
    return out


def call_chains(edges: DataFrame, nodes: DataFrame, deepest: int = 10) -> DataFrame:
    """(path): the paths from entry points to leaves of at most deepest nodes.

    No edge leads back to an entry point: chains grow from the nodes behind those, over the edges between nodes that are
    entered, and the edges of entry points, most of all, are joined once with the chains that their ends begin."""
    marks, by_src = entered(nodes, edges)
    if deepest < 2:
        return by_src.limit(0).select(F.array("src").alias("path"))
    first = by_src.where("not entered").select("src", "dst")
    step = by_src.where("entered").select("src", "dst")
    second = written(first.select(F.col("dst").alias("start")).distinct(), "second-nodes")
    leads = by_src.where("entered").select(F.col("src").alias("node")).distinct()
    ends = marks.where("known and entered").join(leads, "node", "left_anti").select(F.col("node").alias("end"))
    paths = second.select(F.array("start").alias("path"))
    if deepest > 2:
        paths = paths.unionByName(simple_paths(step, second, deepest - 2))
    paths = paths.join(ends, F.element_at("path", -1) == F.col("end"), "left_semi")
    tails = written(paths.select(F.col("path")[0].alias("dst"), "path"), "tails")
    return first.join(tails.hint("merge"), "dst").select(F.concat(F.array("src"), "path").alias("path"))


def longest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start, path): the longest path from each entry point that leads anywhere, of equal ones the smallest, whatever
    its length. A cycle is one step of it, named by its smallest node. No edge enters an entry point: its path is
    itself and the path from where it goes on to, which is gathered once for all that go there."""
    first, _, walks = walk_parts(nodes, edges, entry_points(nodes, edges).select(F.col("artifact_id").alias("start")))
    paths = walks.groupBy(F.col("start").alias("next")).agg(F.array_sort(F.collect_list(F.struct("place", "component"))).alias("steps"))
    return first.join(paths, "next").select("start", F.concat(F.array("start"), F.col("steps.component")).alias("path"))


def neighbourhood(edges: DataFrame, centre: DataFrame, hops: int) -> DataFrame:
    """The edges among the nodes within hops of the centres (column start), in either direction."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = k_hop(edges, centre, hops).select("node").unionByName(k_hop(back, centre, hops).select("node")).distinct()
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select(edges.columns)


def incremental(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of changed files (column file_id), and the new ones."""
    return nodes.join(changed, "file_id", "left_anti").unionByName(new_nodes), edges.join(changed, "file_id", "left_anti").unionByName(new_edges)


def dead_paragraphs(paragraphs: DataFrame, targets: DataFrame, thru: DataFrame, key: str = "file_id") -> DataFrame:
    """Paragraphs that no PERFORM or GO TO names (targets: key, name), that stand in no THRU range (thru: key, first, last;
    all from the one to the other by place in the file, whichever stands first), and aren't a file's first. Names and
    ranges are gathered by file and met there, so each of the three inputs is computed once and nothing is broadcast."""
    others = [c for c in paragraphs.columns if c not in (key, "name")]
    files = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_start", "name", *[c for c in others if c != "line_start"]))).alias("p"))
    named = targets.groupBy(key).agg(F.collect_set("name").alias("named"))
    spans = thru.groupBy(key).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    files = files.join(named.hint("merge"), key, "left").join(spans.hint("merge"), key, "left").withColumn("n", F.col("p")["name"])
    back, size = F.reverse("n"), F.size("n")

    def within(s: Column) -> Column:
        lo = F.least(F.array_position("n", s["first"]), F.array_position("n", s["last"]))
        hi = size + 1 - F.least(F.array_position(back, s["first"]), F.array_position(back, s["last"]))
        return F.when(F.array_contains("n", s["first"]) & F.array_contains("n", s["last"]), F.slice("n", lo.cast("int"), (hi - lo + 1).cast("int"))).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    spanned = F.coalesce(F.flatten(F.transform("spans", within)), none)
    files = files.withColumn("dead", F.array_except("n", F.array_union(F.coalesce("named", none), spanned)))
    rows = files.where(F.size("dead") > 0).select(key, F.explode(F.filter(F.slice("p", 2, size), lambda x: F.array_contains("dead", x["name"]))).alias("r"))
    return rows.select(key, *[F.col("r")[c].alias(c) for c in ["name", *others]])
