import random

import pytest

from ferrolith.operators import components as co
from ferrolith.operators import diagrams, graph


def make(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "artifact_id string"), spark.createDataFrame(edges or [("?", "?")], "src string, dst string")


def brute(nodes, edges):
    """Components, levels and smallest longest paths, from reachability."""
    out = {n: {b for a, b in edges if a == n and b in nodes and b != n} for n in nodes}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for m in out[todo.pop()]:
                if m not in reach[n]:
                    reach[n].add(m)
                    todo.append(m)
    part = {n: min([n] + [m for m in reach[n] if n in reach[m]]) for n in nodes}
    down = {p: {part[m] for n in nodes if part[n] == p for m in out[n]} - {p} for p in part.values()}

    def walk(p):
        return [p] + min(([walk(q) for q in down[p]] or [[]]), key=lambda w: (-len(w), w))

    return part, {n: len(walk(part[n])) - 1 for n in nodes}, {n: walk(part[n]) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([3, 8, 14])
    nodes = [f"n{i}" for i in range(n)]
    edges = [(rng.choice(nodes + ["?"]), rng.choice(nodes)) for _ in range(rng.choice([n // 2, n, n + 4, 2 * n]))]
    part, level, walk = brute(nodes, edges)
    frames = make(spark, nodes, edges * 2)
    got = {r.artifact_id: (r.component, r.level, r.size) for r in co.component_levels(*frames).collect()}
    assert got == {m: (part[m], level[m], sum(p == part[m] for p in part.values())) for m in nodes}
    starts = frames[0].withColumnRenamed("artifact_id", "start")
    rows = sorted(tuple(r) for r in co.longest_walks(*frames, starts).collect())
    assert rows == sorted((m, k, c) for m in nodes for k, c in enumerate(walk[m]))
    # no level for what leads into a cycle or a node that calls itself
    known = {m for m in nodes if (m, m) in edges or sum(p == part[m] for p in part.values()) > 1}
    deep = {m: None if known & ({m} | {x for x in nodes if x in reachable(m, edges, nodes)}) else level[m] for m in nodes}
    assert {r.artifact_id: r.level for r in diagrams.topological_levels(*frames).collect()} == deep


def reachable(n, edges, nodes):
    seen, todo = set(), [n]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b in nodes and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    nodes = spark.range(n).selectExpr("format_string('n%05d', id) as artifact_id")
    edges = spark.range(n - 1).selectExpr("format_string('n%05d', id) as src", "format_string('n%05d', id + 1) as dst")
    (row,) = graph.longest_paths(edges, nodes).collect()
    assert row.start == "n00000" and row.path == [f"n{i:05d}" for i in range(n)]


def test_a_ladder_of_sixty_diamonds(spark):
    edges = [e for k in range(60) for e in ((f"{k:02d}a", f"{k:02d}b"), (f"{k:02d}a", f"{k:02d}c"), (f"{k:02d}b", f"{k + 1:02d}a"), (f"{k:02d}c", f"{k + 1:02d}a"))]
    nodes, edges = make(spark, sorted({x for e in edges for x in e}), edges)
    (row,) = graph.longest_paths(edges, nodes).collect()
    assert row.path == [x for k in range(60) for x in (f"{k:02d}a", f"{k:02d}b")] + ["60a"]


def test_a_ring_and_a_long_way_round(spark):
    ring = [(f"r{i:04d}", f"r{(i + 1) % 2000:04d}") for i in range(2000)]
    nodes, edges = make(spark, ["a", "b"] + [x for x, _ in ring], ring + [("a", "r0007"), ("r0500", "r0001"), ("r1999", "b")])
    got = {r.artifact_id: (r.component, r.level) for r in co.component_levels(nodes, edges).collect()}
    assert got["a"] == ("a", 2) and got["b"] == ("b", 0) and {v for k, v in got.items() if k[0] == "r"} == {("r0000", 1)}
    assert graph.reachable(edges.limit(60), make(spark, ["r0000"], [])[0].withColumnRenamed("artifact_id", "start")).count() == 61


def test_nothing(spark):
    nodes, edges = make(spark, ["a"], [])
    assert [tuple(r) for r in co.component_levels(nodes, edges).collect()] == [("a", "a", 1, 0)]
    assert co.component_levels(nodes.limit(0), edges).count() == 0 and graph.longest_paths(edges, nodes).count() == 0


def test_nodes_that_no_edge_enters_are_set_apart(spark):
    """Rounds see no edge of such nodes; loops, repeated edges and unknown ends change nothing."""
    many = [(f"o{i}", f"c{i % 3}") for i in range(30)] * 2
    nodes, edges = make(spark, [f"o{i}" for i in range(31)] + ["c0", "c1", "c2", "n", "l"], many + [("c0", "n"), ("c1", "n"), ("l", "l"), ("l", "n"), ("?", "n"), ("o1", "??")])
    inner_nodes, inner_edges = co._inner(*co.entered(nodes, edges))
    assert sorted(tuple(r) for r in inner_edges.collect()) == [("c0", "n"), ("c1", "n"), ("l", "l"), ("l", "n")] and inner_nodes.count() == 5
    got = {r.artifact_id: r.level for r in co.component_levels(nodes, edges).collect()}
    assert got == {**{f"o{i}": 1 if i % 3 == 2 else 2 for i in range(30)}, "o30": 0, "c0": 1, "c1": 1, "c2": 0, "n": 0, "l": 1}
    chains = [r.path for r in graph.call_chains(edges, nodes, 3).collect()]
    assert sorted(chains) == sorted([[f"o{i}", f"c{i % 3}"] + ["n"] * (i % 3 < 2) for i in range(30)])
    assert sorted(r.path for r in graph.call_chains(edges, nodes, 2).collect()) == sorted([f"o{i}", "c2"] for i in range(2, 30, 3))
