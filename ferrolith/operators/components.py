"""Strongly connected components, levels and longest paths of directed graphs, one row a node.

Rounds end when nothing is left to do, however deep the graph is, and each writes what is left to the shared folder.
What would take a round a step goes by pointer doubling: a chain of n nodes takes about log n rounds.

Nodes that no edge enters are on no cycle, and often hold most edges. They are set apart first: rounds work on the rest
alone, and what the others come to follows from it with one join of their edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.sources.shared import written


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def entered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ends of graphs (node, known, entered: whether it is one of nodes, and whether an edge leads to it), one row
    each, and the distinct edges (src, dst, entered: of src) but those whose src is neither. Edges are shuffled once."""
    known = nodes.select(F.col("artifact_id").alias("node")).where("node is not null").distinct().withColumn("known", F.lit(True))
    led = edges.select(F.col("dst").alias("node")).where("node is not null").distinct().withColumn("entered", F.lit(True))
    marks = known.hint("merge").join(led.hint("merge"), "node", "full_outer").select("node", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("entered", F.lit(False)).alias("entered"))
    marks = written(marks, "ends")
    by_src = edges.select("src", "dst").join(marks.select(F.col("node").alias("src"), "entered").hint("merge"), "src").distinct()
    return marks, written(by_src, "edges-by-source")


def _inner(marks: DataFrame, by_src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The known nodes (artifact_id) that edges lead to, and the edges (src, dst) from these."""
    return marks.where("known and entered").select(F.col("node").alias("artifact_id")), by_src.where("entered").select("src", "dst")


def _outer(marks: DataFrame, by_src: DataFrame, values: DataFrame, *found) -> DataFrame:
    """(node, aggregates found): one row for each known node that no edge enters, with aggregates over the values
    (dst, ..) of what its edges lead to; null for those whose edges lead to nothing known."""
    met = by_src.where("not entered").select("src", "dst").join(values.hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(*found)
    return marks.where("known and not entered").select("node").join(met.hint("merge"), "node", "left")


def _known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct edges between nodes, without those of a node to itself."""
    known = nodes.select("artifact_id").distinct()
    e = edges.where("src <> dst").select("src", "dst").distinct()
    return e.join(known.withColumnRenamed("artifact_id", "src"), "src", "left_semi").join(known.withColumnRenamed("artifact_id", "dst"), "dst", "left_semi")


def _through(edges: DataFrame) -> DataFrame:
    """(node, prev, next) of nodes that one edge enters and one edge leaves."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("prev")).where("n = 1").drop("n")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("next")).where("n = 1").drop("n")
    return into.join(out, "node")


def _ends(through: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For nodes in chains the nodes before and behind the chain (node, prev, next); for those on rings of such nodes
    alone (node, component), the smallest of the ring. Pointers double until they leave the chains."""
    state = through.withColumn("least", F.col("node"))
    most, rounds = through.count(), 0
    while True:
        back, on = state.select(F.col("node").alias("_p"), F.col("prev").alias("_prev")), state.select(F.col("node").alias("_n"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        met = state.join(back, F.col("prev") == F.col("_p"), "left").join(on, F.col("next") == F.col("_n"), "left")
        inside = F.col("_p").isNotNull() | F.col("_n").isNotNull()
        state = met.select("node", F.coalesce("_prev", "prev").alias("prev"), F.coalesce("_next", "next").alias("next"), F.least("least", "_least").alias("least"), inside.alias("inside"))
        state = written(state, "chains")
        rounds += 1
        # a ring never leaves; after so many doublings every pointer of it has been all around
        if not state.where("inside").limit(1).count() or 2 ** (rounds - 1) > most:
            return state.where("not inside").select("node", "prev", "next"), state.where("inside").select("node", F.col("least").alias("component"))


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of some components: each node takes the smallest node that reaches it as its colour, and what
    reaches that node again within its colour is its component."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colour = written(nodes.withColumn("colour", F.col("node")), "colours")
    moved = colour
    while True:
        sent = moved.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("_to")).agg(F.min("colour").alias("_colour"))
        step = written(colour.join(sent, F.col("node") == F.col("_to"), "left").select("node", F.least("colour", "_colour").alias("colour"), (F.col("_colour") < F.col("colour")).alias("_moved")), "colours")
        colour, moved = step.select("node", "colour"), step.where("_moved").select("node", "colour")
        if not moved.limit(1).count():
            break
    a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
    within = written(edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("component")), "colour-edges")
    rounds = [written(colour.where("node = colour").select("node", F.col("colour").alias("component")), "component")]
    while True:
        back = rounds[-1].select(F.col("node").alias("dst")).join(within, "dst").select(F.col("src").alias("node"), "component").distinct()
        found = written(back.join(_all(rounds), "node", "left_anti"), "component")
        if not found.limit(1).count():
            return _all(rounds)
        rounds.append(found)


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, component): for each node the smallest node of its strongly connected component; itself for one
    that is on no cycle. Edges of unknown nodes, and repeated ones, change nothing.

    Each round drops nodes without a way in or out, takes chains and rings out of the middle, and, where neither helps,
    finds components by colours. A node of a chain belongs to the component that holds both ends of the chain, if one
    does; that is settled from the last round to the first.
    """
    every = written(nodes.select("artifact_id").distinct(), "component-nodes")
    left = written(_known_edges(every, edges), "component-edges")
    found, later = [], []
    while (before := left.count()) > 0:
        inner = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
        left = written(left.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi"), "component-edges")
        through = written(_through(left), "chains")
        if through.limit(1).count():
            chains, rings = _ends(through)
            later.append(chains)
            found.append(rings)
            gone = through.select("node")
            rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
            left = written(rest.unionByName(chains.where("prev <> next").select(F.col("prev").alias("src"), F.col("next").alias("dst"))).distinct(), "component-edges")
        elif left.count() == before:
            some = written(_coloured(left), "component")
            found.append(some)
            gone = some.select("node")
            left = written(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "component-edges")
    for chains in reversed(later):
        known = _all(found).select("node", "component")
        a, b = known.select(F.col("node").alias("prev"), F.col("component").alias("_a")), known.select(F.col("node").alias("next"), F.col("component").alias("_b"))
        met = chains.join(a, "prev", "left").join(b, "next", "left").withColumn("_a", F.coalesce("_a", "prev")).where(F.col("_a") == F.coalesce("_b", "next"))
        held = met.select(F.explode(F.array("node", "_a")).alias("node"), F.col("_a").alias("component")).distinct()
        found.append(written(held.join(known, "node", "left_anti"), "component"))
    if not found:
        return every.select("artifact_id", F.col("artifact_id").alias("component"))
    known = _all(found)
    named = known.join(known.groupBy("component").agg(F.min("node").alias("least")), "component").select(F.col("node").alias("artifact_id"), "least")
    return every.join(named, "artifact_id", "left").select("artifact_id", F.coalesce("least", "artifact_id").alias("component"))


def depths(base: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth) for every node of base (node, least), of a graph without cycles (src, dst): the largest of its own
    least and one more than the depth of each node that it leads to.

    What a node with one edge is worth is max(least, weight + depth of the other end); these functions compose, so
    pointers along such nodes double, and edges to them go on to where they end. Nodes without edges are done; edges to
    them become values. Edges between the same two nodes merge, and so nodes with one edge come up again.
    """
    worth = written(base.select("node", F.col("least").cast("bigint").alias("c")), "depth-nodes")
    left = written(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).cast("bigint").alias("w")).distinct(), "depth-edges")
    done, later = [], []
    while worth.limit(1).count():
        single = left.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"), F.max("w").alias("w")).where("n = 1").drop("n")
        jump = written(single.join(worth.withColumnRenamed("node", "u"), "u"), "depth-jumps")
        while jump.limit(1).count():
            on = jump.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("w").alias("_w"), F.col("c").alias("_c"))
            met = jump.join(on, F.col("v") == F.col("_u"), "left")
            jump = met.select("u", F.coalesce("_v", "v").alias("v"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.greatest("c", F.col("w") + F.col("_c")).alias("c"), F.col("_u").isNotNull().alias("open"))
            jump = written(jump, "depth-jumps")
            if not jump.where("open").limit(1).count():
                later.append(jump.drop("open"))
                break
        jump = jump.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("w").alias("_w"), F.col("c").alias("_c"))
        many = left.join(jump.select(F.col("_u").alias("u")), "u", "left_anti")
        moved = many.join(jump, F.col("v") == F.col("_u"), "left")
        moved = written(moved.select("u", F.coalesce("_v", "v").alias("v"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), (F.col("w") + F.col("_c")).alias("c")), "depth-edges")
        gained = moved.where("c is not null").groupBy(F.col("u").alias("node")).agg(F.max("c").alias("g"))
        rest = worth.join(jump.select(F.col("_u").alias("node")), "node", "left_anti").join(gained, "node", "left")
        rest = written(rest.select("node", F.greatest("c", "g").alias("c")), "depth-nodes")
        ends = written(rest.join(moved.select(F.col("u").alias("node")).distinct(), "node", "left_anti"), "depths")
        done.append(ends.withColumnRenamed("c", "depth"))
        into = moved.join(ends.select(F.col("node").alias("v"), F.col("c").alias("e")), "v", "left")
        gained = into.where("e is not null").groupBy(F.col("u").alias("node")).agg(F.max(F.col("w") + F.col("e")).alias("g"))
        worth = written(rest.join(ends.select("node"), "node", "left_anti").join(gained, "node", "left").select("node", F.greatest("c", "g").alias("c")), "depth-nodes")
        left = written(into.where("e is null").groupBy("u", "v").agg(F.max("w").alias("w")), "depth-edges")
    for jump in reversed(later):
        end = _all(done).select(F.col("node").alias("v"), F.col("depth").alias("d"))
        done.append(written(jump.join(end, "v").select(F.col("u").alias("node"), F.greatest("c", F.col("w") + F.col("d")).alias("depth")), "depths"))
    return _all(done) if done else worth.withColumnRenamed("c", "depth")


def condensed_edges(components: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) between different components."""
    a, b = (components.select(F.col("artifact_id").alias(c), F.col("component").alias(f"_{c}")) for c in ("src", "dst"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def _inner_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parts = written(strong_components(nodes, edges), "components")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    found = depths(parts.select(F.col("component").alias("node"), F.lit(0).alias("least")).distinct(), condensed_edges(parts, edges))
    return written(parts.join(found.select(F.col("node").alias("component"), F.col("depth").alias("level")), "component").join(sizes, "component").select("artifact_id", "component", "size", "level"), "levels")


def component_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, component, size, level): level is the number of edges of the longest path from a node's component
    to one that leads nowhere, 0 for that; size is the number of nodes of the component."""
    marks, by_src = entered(nodes, edges)
    inner = _inner_levels(*_inner(marks, by_src))
    outer = _outer(marks, by_src, inner.select(F.col("artifact_id").alias("dst"), "level"), F.max("level").alias("level"))
    level = F.coalesce(F.col("level") + 1, F.lit(0).cast("bigint")).alias("level")
    return inner.unionByName(outer.select(F.col("node").alias("artifact_id"), F.col("node").alias("component"), F.lit(1).cast("bigint").alias("size"), level))


def walk_parts(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The longest walks from starts in parts: (start, next) of starts that no edge enters, with the component that they
    go on to or null; (start, component) of the others; and the walks (start, place, component) from all components that
    these two name.

    A component goes on to its smallest neighbour one level below; where 2^k steps lead is known by doubling, and each
    step takes the places that are known 2^k on, from the highest k down.
    """
    marks, by_src = entered(nodes, edges)
    inner_nodes, inner_edges = _inner(marks, by_src)
    known = _inner_levels(inner_nodes, inner_edges)
    of, level = known.select("artifact_id", "component"), known.select("component", "level").distinct()
    a, b = level.select(F.col("component").alias("src"), F.col("level").alias("la")), level.select(F.col("component").alias("dst"), F.col("level").alias("lb"))
    step = condensed_edges(of, inner_edges).join(a, "src").join(b, "dst").where("la = lb + 1").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))
    jumps = [written(step, "steps")]
    while jumps[-1].limit(1).count():
        last = jumps[-1]
        jumps.append(written(last.join(last.select(F.col("node").alias("next"), F.col("next").alias("_next")), "next").select("node", F.col("_next").alias("next")), "steps"))
    asked = starts.select(F.col("start").alias("node")).where("node is not null").distinct()
    best = F.min(F.struct((-F.col("level")).alias("l"), "component")).alias("best")
    first = _outer(marks, by_src, known.select(F.col("artifact_id").alias("dst"), "level", "component"), best)
    first = written(first.join(asked.hint("merge"), "node", "left_semi").select(F.col("node").alias("start"), F.col("best.component").alias("next")), "first-steps")
    others = written(asked.withColumnRenamed("node", "start").join(of.withColumnRenamed("artifact_id", "start"), "start"), "inner-starts")
    begun = first.where("next is not null").select(F.col("next").alias("start")).unionByName(others.select(F.col("component").alias("start"))).distinct()
    walks = written(begun.select("start", F.lit(0).cast("bigint").alias("place"), F.col("start").alias("component")), "walks")
    for k in range(len(jumps) - 2, -1, -1):
        on = walks.join(jumps[k], F.col("component") == F.col("node")).select("start", (F.col("place") + 2**k).alias("place"), F.col("next").alias("component"))
        walks = written(walks.unionByName(on), "walks")
    return first, others, walks


def longest_walks(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, place, component): the longest path over components from each start (column start), of equal ones the
    smallest, one row a step from place 0. Without cycles components are the nodes themselves."""
    first, others, walks = walk_parts(nodes, edges, starts)
    walks = walks.withColumnRenamed("start", "_from")
    begin = first.select("start", F.lit(0).cast("bigint").alias("place"), F.col("start").alias("component"))
    after = first.join(walks, F.col("next") == F.col("_from")).select("start", (F.col("place") + 1).alias("place"), walks["component"])
    inside = others.withColumnRenamed("component", "_own").join(walks, F.col("_own") == F.col("_from")).select("start", "place", "component")
    return begin.unionByName(after).unionByName(inside)
