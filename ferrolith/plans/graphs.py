"""Queries over the star schema as a typed graph: parts supplied by suppliers of nations of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.operators import aggregates, components, graph, render
from ferrolith.plans.registry import Registry, table

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql


def _id(kind: str, column: str):
    return F.concat(F.lit(kind + "::"), F.col(column).cast("string"))


def nodes(spark, d) -> DataFrame:
    """All parts, suppliers, nations, regions, customers and orders."""
    out = None
    for kind, name, key in (("part", "part", "p_partkey"), ("supplier", "supplier", "s_suppkey"), ("nation", "nation", "n_nationkey"), ("region", "region", "r_regionkey"), ("customer", "customer", "c_custkey"), ("order", "orders", "o_orderkey")):
        one = table(spark, d, name).select(_id(kind, key).alias("artifact_id"), F.lit(kind).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark, d) -> DataFrame:
    """part -> supplier (supplied_by, one for each line), order -> customer, customer and supplier -> nation -> region."""
    line = table(spark, d, "lineitem").select(_id("part", "l_partkey").alias("src"), _id("supplier", "l_suppkey").alias("dst"), F.lit("supplied_by").alias("type"))
    rest = [
        table(spark, d, "orders").select(_id("order", "o_orderkey").alias("src"), _id("customer", "o_custkey").alias("dst"), F.lit("placed_by").alias("type")),
        table(spark, d, "customer").select(_id("customer", "c_custkey").alias("src"), _id("nation", "c_nationkey").alias("dst"), F.lit("lives_in").alias("type")),
        table(spark, d, "supplier").select(_id("supplier", "s_suppkey").alias("src"), _id("nation", "s_nationkey").alias("dst"), F.lit("lives_in").alias("type")),
        table(spark, d, "nation").select(_id("nation", "n_nationkey").alias("src"), _id("region", "n_regionkey").alias("dst"), F.lit("part_of").alias("type")),
    ]
    for e in rest:
        line = line.unionByName(e)
    return line


NODES = """nodes AS (SELECT 'part::' || p_partkey AS artifact_id, 'part' AS type FROM part UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'nation::' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'region::' || r_regionkey, 'region' FROM region UNION ALL SELECT 'customer::' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'order::' || o_orderkey, 'order' FROM orders)"""
EDGES = """edges AS (SELECT 'part::' || l_partkey AS src, 'supplier::' || l_suppkey AS dst, 'supplied_by' AS type FROM lineitem UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, 'placed_by' FROM orders
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, 'lives_in' FROM customer UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'lives_in' FROM supplier UNION ALL SELECT 'nation::' || n_nationkey, 'region::' || n_regionkey, 'part_of' FROM nation)"""
GEO = "geo AS (SELECT src, dst FROM edges WHERE type IN ('lives_in', 'part_of') AND (src LIKE 'supplier::%' OR src LIKE 'nation::%'))"


@registry.add(f"WITH {EDGES} SELECT src, dst, type, count(*) AS n FROM edges GROUP BY src, dst, type")
def edges_build(spark, d):
    return edges(spark, d).groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))


@registry.add(f"""WITH {NODES}, {EDGES}, o AS (SELECT src, count(*) AS n FROM edges GROUP BY src), i AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst)
SELECT artifact_id, type, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM nodes LEFT JOIN o ON src = artifact_id LEFT JOIN i ON dst = artifact_id""")
def degree_stats(spark, d):
    return graph.degrees(nodes(spark, d), edges(spark, d))


@registry.add(f"""WITH {NODES}, {EDGES}, c AS (SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type)
SELECT kind, type, n::DOUBLE AS n FROM c UNION ALL SELECT kind, 'all', sum(n)::DOUBLE FROM c GROUP BY kind UNION ALL SELECT 'rate', 'resolved', round(100.0::DOUBLE * count(*) / (count(*) + 1000), 4) FROM edges""")
def graph_statistics(spark, d):
    return graph.statistics(nodes(spark, d), edges(spark, d), 1000)


@registry.add(f"""WITH {NODES}, {EDGES}, ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
SELECT 'isolated' AS problem, count(*) AS n FROM nodes WHERE artifact_id NOT IN (SELECT id FROM ends)
UNION ALL SELECT 'duplicate', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM edges)))::BIGINT FROM edges
UNION ALL SELECT 'orphan', count(*) FROM edges WHERE src NOT IN (SELECT artifact_id FROM nodes) OR dst NOT IN (SELECT artifact_id FROM nodes)""")
def graph_validate(spark, d):
    return graph.problems(nodes(spark, d), edges(spark, d))


def _half(spark, d) -> DataFrame:
    """Nodes without every third customer, so that some edges have lost an end."""
    return nodes(spark, d).where("not (type = 'customer' and cast(substring_index(artifact_id, '::', -1) as bigint) % 3 = 0)")


@registry.add(f"""WITH {NODES}, {EDGES}, known AS (SELECT artifact_id FROM nodes WHERE NOT (type = 'customer' AND split_part(artifact_id, '::', 2)::BIGINT % 3 = 0))
SELECT src, dst, type FROM edges WHERE src NOT IN (SELECT artifact_id FROM known) OR dst NOT IN (SELECT artifact_id FROM known)""")
def orphan_edges(spark, d):
    return graph.split_edges(edges(spark, d), _half(spark, d))[1]


@registry.add(f"WITH {NODES}, {EDGES} SELECT artifact_id, type, 'no reference to this ' || type AS reason FROM nodes WHERE type NOT IN ('order', 'part') AND artifact_id NOT IN (SELECT dst FROM edges WHERE type <> 'placed_by' OR split_part(src, '::', 2)::BIGINT % 20 = 0)")
def dead_nodes(spark, d):
    """Of orders only every twentieth is left as an edge, so that customers die."""
    e = edges(spark, d).where("type <> 'placed_by' or cast(substring_index(src, '::', -1) as bigint) % 20 = 0")
    return graph.dead_nodes(nodes(spark, d), e, ["order", "part"])


@registry.add(f"WITH {NODES}, {EDGES} SELECT artifact_id, type FROM nodes WHERE artifact_id NOT IN (SELECT dst FROM edges)")
def entry_points(spark, d):
    return graph.entry_points(nodes(spark, d), edges(spark, d))


@registry.add(f"WITH {NODES}, {EDGES} SELECT artifact_id, type FROM nodes WHERE artifact_id NOT IN (SELECT src FROM edges)")
def leaf_nodes(spark, d):
    return graph.leaf_nodes(nodes(spark, d), edges(spark, d))


@registry.add(f"WITH {EDGES} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS targets FROM edges GROUP BY src")
def adjacency_lists(spark, d):
    return graph.adjacency(edges(spark, d)).select("src", F.array_join("targets", " ").alias("targets"))


@registry.add(f"""WITH {EDGES}, {GEO}, one AS (SELECT DISTINCT src AS start, dst AS node FROM geo WHERE src LIKE 'supplier::%'), two AS (SELECT DISTINCT start, dst AS node FROM one JOIN geo ON src = node)
SELECT DISTINCT src AS start, src AS node, 0::BIGINT AS distance FROM geo WHERE src LIKE 'supplier::%' UNION ALL SELECT start, node, 1 FROM one UNION ALL SELECT start, node, 2 FROM two""")
def khop_neighbors(spark, d):
    starts = table(spark, d, "supplier").select(_id("supplier", "s_suppkey").alias("start"))
    return graph.k_hop(edges(spark, d), starts, 2)


@registry.add(f"""WITH RECURSIVE {EDGES}, u AS (SELECT DISTINCT src, dst FROM edges UNION SELECT 'region::' || r_regionkey, 'region::' || (r_regionkey + 1) % 5 FROM region), r AS (SELECT 'customer::' || c_custkey AS start, 'customer::' || c_custkey AS node FROM customer UNION SELECT start, dst FROM r JOIN u ON src = node) SELECT start, node FROM r""")
def reachable_set(spark, d):
    """The whole graph, in which the regions also call each other in a ring."""
    ring = table(spark, d, "region").select(_id("region", "r_regionkey").alias("src"), F.concat(F.lit("region::"), ((F.col("r_regionkey") + 1) % 5).cast("string")).alias("dst"), F.lit("calls").alias("type"))
    return graph.reachable(edges(spark, d).unionByName(ring), table(spark, d, "customer").select(_id("customer", "c_custkey").alias("start")))


@registry.add(f"""WITH {EDGES}, {GEO}, one AS (SELECT src AS a, dst AS b FROM geo WHERE src LIKE 'supplier::%') SELECT a || '>' || b AS path FROM one UNION ALL SELECT a || '>' || b || '>' || dst FROM one JOIN geo ON src = b""")
def simple_paths(spark, d):
    starts = table(spark, d, "supplier").select(_id("supplier", "s_suppkey").alias("start"))
    return graph.simple_paths(edges(spark, d), starts, 3).select(F.array_join("path", ">").alias("path"))


CHAINS = f"""{EDGES}, u AS (SELECT DISTINCT src, dst FROM edges),
chains AS (SELECT DISTINCT a.src AS start, a.src || '>' || a.dst || coalesce('>' || b.dst, '') || coalesce('>' || c.dst, '') AS path, [a.dst, b.dst, c.dst] AS p, 2 + (b.dst IS NOT NULL)::INT + (c.dst IS NOT NULL)::INT AS n
  FROM u a LEFT JOIN u b ON b.src = a.dst LEFT JOIN u c ON c.src = b.dst WHERE a.src NOT IN (SELECT dst FROM u))"""


@registry.add(f"WITH {CHAINS} SELECT path FROM chains")
def call_chains(spark, d):
    return graph.call_chains(edges(spark, d), nodes(spark, d), 6).select(F.array_join("path", ">").alias("path"))


@registry.add(f"WITH {CHAINS} SELECT start, path FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, p) AS k FROM chains) WHERE k = 1")
def longest_path(spark, d):
    return graph.longest_paths(edges(spark, d), nodes(spark, d)).select("start", F.array_join("path", ">").alias("path"))


def _regions_calling(spark, d) -> DataFrame:
    """All edges, and two regions that also call each other."""
    ring = table(spark, d, "region").where("r_regionkey < 2").select(_id("region", "r_regionkey").alias("src"), F.concat(F.lit("region::"), (1 - F.col("r_regionkey")).cast("string")).alias("dst"), F.lit("calls").alias("type"))
    return edges(spark, d).unionByName(ring)


@registry.add(f"""WITH {NODES}, {EDGES}, lines AS (SELECT DISTINCT src FROM edges WHERE type = 'supplied_by')
SELECT artifact_id, CASE WHEN artifact_id = 'region::1' THEN 'region::0' ELSE artifact_id END AS component, CASE WHEN artifact_id IN ('region::0', 'region::1') THEN 2 ELSE 1 END::BIGINT AS size,
 CASE type WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'order' THEN 3 WHEN 'part' THEN CASE WHEN src IS NULL THEN 0 ELSE 3 END ELSE 2 END::BIGINT AS level FROM nodes LEFT JOIN lines ON src = artifact_id""")
def component_levels(spark, d):
    """The whole graph, in which two regions call each other and are one component."""
    return components.component_levels(nodes(spark, d), _regions_calling(spark, d))


@registry.add(f"""WITH {CHAINS.replace("SELECT DISTINCT src, dst FROM edges", "SELECT DISTINCT src, replace(dst, 'region::1', 'region::0') AS dst FROM edges")},
best AS (SELECT start, [start] || p AS path FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, p) AS k FROM chains) WHERE k = 1)
SELECT start, place, path[place + 1] AS component FROM best, range(4) r(place) WHERE path[place + 1] IS NOT NULL""")
def longest_walks(spark, d):
    """The longest way from each entry that leads anywhere through the same graph, one row a step."""
    e = _regions_calling(spark, d)
    return components.longest_walks(nodes(spark, d), e, e.select(F.col("src").alias("start")).join(e.select(F.col("dst").alias("start")).distinct(), "start", "left_anti"))


@registry.add(f"""WITH {EDGES}, near AS (SELECT 'nation::3' AS id UNION SELECT src FROM edges WHERE dst = 'nation::3' UNION SELECT dst FROM edges WHERE src = 'nation::3')
SELECT src, dst, type, count(*) AS n FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near) GROUP BY src, dst, type""")
def neighborhood_subgraph(spark, d):
    centre = table(spark, d, "nation").where("n_nationkey = 3").select(_id("nation", "n_nationkey").alias("start"))
    return graph.neighbourhood(edges(spark, d), centre, 1).groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))


@registry.add(f"""WITH {EDGES}, o AS (SELECT src AS name, list_sort(list(DISTINCT dst)) AS c FROM edges GROUP BY src), i AS (SELECT dst AS name, list_sort(list(DISTINCT src)) AS c FROM edges GROUP BY dst)
SELECT coalesce(o.name, i.name) AS name, coalesce(len(o.c), 0)::BIGINT AS n_calls, coalesce(array_to_string(o.c[1:3], ' '), '') AS calls, coalesce(len(i.c), 0)::BIGINT AS n_called_by, coalesce(array_to_string(i.c[1:3], ' '), '') AS called_by FROM o FULL JOIN i ON o.name = i.name""")
def program_context(spark, d):
    both = aggregates.group_programs(edges(spark, d))
    return both.withColumns({c: F.array_join(c, " ") for c in ("calls", "called_by")})


@registry.add(f"""WITH {EDGES} SELECT DISTINCT '  "' || src || '" -> "' || dst || '" [label="' || type || '"];' AS line FROM edges""")
def dot_lines(spark, d):
    return edges(spark, d).distinct().select(render.dot_edge(F.col("src"), F.col("dst"), F.col("type")).alias("line"))


@registry.add(f"""WITH {EDGES} SELECT DISTINCT '    ' || replace(src, ':', '_') || CASE WHEN type = 'supplied_by' THEN ' -.->|' ELSE ' -->|' END || type || '| ' || replace(dst, ':', '_') AS line FROM edges""")
def mermaid_lines(spark, d):
    return edges(spark, d).distinct().select(render.mermaid_edge(F.col("src"), F.col("dst"), F.col("type"), F.col("type") == "supplied_by").alias("line"))


@registry.add(f"""WITH {NODES} SELECT 'CREATE (:' || upper(type[1]) || type[2:] || ' {{id: ''' || artifact_id || ''', name: ''' || artifact_id || '''}});' AS line FROM nodes""")
def cypher_lines(spark, d):
    return nodes(spark, d).select(render.cypher_node(F.col("artifact_id"), F.col("type"), F.col("artifact_id")).alias("line"))
