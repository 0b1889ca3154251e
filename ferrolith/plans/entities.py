"""Queries over parts, customers, orders and events: resolution, merging, tickets, renderings of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions import text as tx
from ferrolith.operators import aggregates, render, resolve, tickets
from ferrolith.plans.registry import Registry, table

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql


def _artifacts(spark, d) -> DataFrame:
    """Suppliers and customers under their names, customers also under a short one."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("table::"), "s_name").alias("artifact_id"), F.lit("table").alias("type"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    c = table(spark, d, "customer").select(F.concat(F.lit("program::"), "c_name").alias("artifact_id"), F.lit("program").alias("type"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string"))).alias("aliases"))
    return s.unionByName(c)


def _refs(spark, d) -> DataFrame:
    """A reference from each order to its customer, written in one of four ways, one of which resolves to nothing."""
    o = table(spark, d, "orders")
    key = F.col("o_custkey")
    padded = F.concat(F.lit("customer#"), F.lpad(key.cast("string"), 9, "0"))
    raw = F.when(F.col("o_orderkey") % 4 == 0, padded).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("cust-"), key.cast("string"))).when(F.col("o_orderkey") % 4 == 2, F.upper(padded)).otherwise(F.concat(F.lit("NOBODY."), key.cast("string")))
    return o.select(F.col("o_orderkey").alias("ref_id"), raw.alias("raw_text"), F.when(F.col("o_orderkey") % 3 > 0, "program").alias("expected_type"))


RESOLVED = """a AS (SELECT 'table::' || s_name AS artifact_id, 'table' AS type, lower(s_name) AS key, 0 AS rk FROM supplier
  UNION ALL SELECT 'program::' || c_name, 'program', lower(c_name), 0 FROM customer UNION ALL SELECT 'program::' || c_name, 'program', 'cust-' || c_custkey, 1 FROM customer),
r AS (SELECT o_orderkey AS ref_id, CASE o_orderkey % 4 WHEN 0 THEN 'customer#' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'cust-' || o_custkey WHEN 2 THEN upper('customer#' || lpad(o_custkey::VARCHAR, 9, '0')) ELSE 'NOBODY.' || o_custkey END AS raw_text,
  CASE WHEN o_orderkey % 3 > 0 THEN 'program' END AS expected_type FROM orders),
h AS (SELECT r.*, (SELECT arg_min({'id': artifact_id, 'rk': rk}, {'rk': rk, 'id': artifact_id}) FROM a WHERE a.key = lower(r.raw_text) AND (r.expected_type IS NULL OR a.type = r.expected_type)) AS hit FROM r)"""


@registry.add(f"""WITH {RESOLVED} SELECT ref_id, raw_text, expected_type, hit.id AS artifact_id, CASE hit.rk WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' END AS method, CASE WHEN hit IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM h""")
def exact_resolve(spark, d):
    return resolve.resolve(_refs(spark, d), _artifacts(spark, d))


@registry.add(f"WITH {RESOLVED} SELECT coalesce(CASE hit.rk WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' END, 'unresolved') AS method, count(*) AS n FROM h GROUP BY 1")
def resolution_stats(spark, d):
    found = resolve.resolve(_refs(spark, d), _artifacts(spark, d))
    return found.groupBy(F.coalesce("method", F.lit("unresolved")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


@registry.add("""WITH r AS (SELECT p_partkey AS ref_id, replace(p_brand, '#', '-') || '-REC' AS raw_text FROM part), b AS (SELECT DISTINCT p_brand FROM part)
SELECT ref_id, raw_text, 'table' AS expected_type, 'table::' || p_brand AS artifact_id, CASE WHEN p_brand IS NOT NULL THEN 'transformation' END AS method, CASE WHEN p_brand IS NOT NULL THEN 0.75::DOUBLE END AS confidence
FROM r LEFT JOIN b ON upper(replace(replace(p_brand, '#', '-'), '-', '')) = upper(replace(replace(raw_text, '-REC', ''), '-', ''))""")
def transform_resolve(spark, d):
    """Names with a record suffix and hyphens, found after both are taken off."""
    part = table(spark, d, "part")
    brands = part.select("p_brand").distinct().select(F.concat(F.lit("table::"), "p_brand").alias("artifact_id"), F.lit("table").alias("type"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("name"), F.array().cast("array<string>").alias("aliases"))
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("-REC")).alias("raw_text"), F.lit("table").alias("expected_type"))
    rules = [resolve.AliasRule("table", ("upper", "remove_hyphens"), 0.85), resolve.AliasRule("table", ("upper", "remove_common_suffixes", "remove_hyphens"), 0.75)]
    return resolve.resolve(refs, brands, rules)


@registry.add("""WITH n AS (SELECT DISTINCT p_name AS name, p_type FROM part), e AS (SELECT a.name AS id, b.name AS target_id, levenshtein(a.name, b.name) AS edits, a.p_type FROM n a JOIN n b ON a.p_type = b.p_type AND a.name <> b.name),
r AS (SELECT id, p_type, target_id, edits, row_number() OVER (PARTITION BY p_type, id ORDER BY edits, target_id) AS place FROM e WHERE edits <= 5)
SELECT p_type || '/' || id AS id, target_id, edits, place FROM r WHERE place <= 5""")
def fuzzy_candidates_top5(spark, d):
    n = table(spark, d, "part").select(F.col("p_name").alias("name"), "p_type").distinct()
    left = n.select(F.concat("p_type", F.lit("/"), "name").alias("id"), "name", "p_type")
    right = n.select(F.col("name").alias("target_id"), F.col("name").alias("target"), "p_type")
    pairs = resolve.edit_candidates(left, right, "p_type", 5, 6)
    rest = pairs.where(F.concat(F.substring_index("id", "/", 1), F.lit("/"), "target_id") != F.col("id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("edits", "target_id")).cast("bigint")
    return rest.withColumn("place", place).where("place <= 5")


def likeness_sql(pairs: str) -> str:
    """Common table expressions that end with alike (name, target, score) over the pairs (name, target) of a query: a
    longest common subsequence is a fold of one row of its table over the characters of the left text."""
    words = "list_sort(list_distinct(list_filter(string_split_regex(lower({}), '[-_\\s]+'), lambda w: w <> '')))"
    return f"""p AS (SELECT name, target, {words.format("name")} AS x, {words.format("target")} AS y FROM ({pairs})),
w AS (SELECT *, list_filter(x, lambda w: list_contains(y, w)) AS z, list_filter(x, lambda w: NOT list_contains(y, w)) AS u, list_filter(y, lambda w: NOT list_contains(x, w)) AS v FROM p WHERE len(x) > 0 AND len(y) > 0),
t AS (SELECT *, array_to_string(z, ' ') AS c, array_to_string(z || u, ' ') AS l, array_to_string(z || v, ' ') AS r FROM w),
k AS (SELECT *, list_transform(string_split(r, ''), lambda q: ord(q)) AS rc, list_reduce(
    list_prepend(list_transform(range(length(r) + 1), lambda q: 0::BIGINT), list_transform(string_split(l, ''), lambda q: [ord(q)::BIGINT])),
    lambda row, q: list_prepend(0::BIGINT, list_transform(range(1, length(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i + 1], row[i] + CASE WHEN ord(r[i]) = q[1] THEN 1 ELSE 0 END)))))) AS held FROM t),
alike AS (SELECT name, target, round(CASE WHEN len(z) > 0 AND (len(u) = 0 OR len(v) = 0) THEN 1.0 ELSE
    greatest(2.0 * held[-1] / (length(l) + length(r)), CASE WHEN len(z) > 0 THEN 2.0 * length(c) / (length(c) + least(length(l), length(r))) ELSE 0 END) END::DOUBLE, 6) AS score FROM k)"""


PART_NAMES = "n AS (SELECT DISTINCT p_name AS name FROM part)"


@registry.add(f"""WITH {PART_NAMES}, {likeness_sql("SELECT a.name, b.name AS target FROM n a, n b")},
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, target) AS place FROM alike WHERE score >= 0.8)
SELECT name AS id, target AS target_id, score, place FROM r WHERE place <= 5""")
def fuzzy_names(spark, d):
    """Part names that are alike as sets of words."""
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return resolve.fuzzy_candidates(n.select(F.col("name").alias("id"), "name"), n.select(F.col("name").alias("target_id"), F.col("name").alias("target")), 0.8, 5)


MISSPELT = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'a', '') WHEN 2 THEN split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1) || 's'
 WHEN 3 THEN 'X' || p_name || '_' || p_type ELSE 'QZ' || p_partkey % 7 END"""


@registry.add(f"""WITH {PART_NAMES}, refs AS (SELECT p_partkey AS ref_id, {MISSPELT} AS raw_text, CASE WHEN p_partkey % 3 > 0 THEN 'table' END AS expected_type FROM part),
d AS (SELECT DISTINCT raw_text AS name FROM refs WHERE lower(raw_text) NOT IN (SELECT lower(name) FROM n)), {likeness_sql("SELECT d.name, n.name AS target FROM d, n")},
b AS (SELECT name, arg_min({{'target': target, 'score': score}}, {{'less': -score, 'id': 'table::' || target}}) AS best FROM alike WHERE score >= 0.8 GROUP BY name)
SELECT ref_id, raw_text, expected_type, 'table::' || coalesce(e.name, best.target) AS artifact_id, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN best IS NOT NULL THEN 'fuzzy' END AS method,
 CASE WHEN e.name IS NOT NULL THEN 1.0 ELSE best.score END::DOUBLE AS confidence
FROM refs LEFT JOIN n e ON lower(raw_text) = lower(e.name) LEFT JOIN b ON raw_text = b.name""")
def fuzzy_resolve(spark, d):
    """Part names, some misspelt, turned round or with words of their own, answered by the likest name."""
    part = table(spark, d, "part")
    names = part.select("p_name").distinct().select(F.concat(F.lit("table::"), "p_name").alias("artifact_id"), F.lit("table").alias("type"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return resolve.resolve(part.select(F.col("p_partkey").alias("ref_id"), F.expr(MISSPELT).alias("raw_text"), F.expr("CASE WHEN p_partkey % 3 > 0 THEN 'table' END").alias("expected_type")), names, [])



@registry.add("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)")
def unresolved_anti(spark, d):
    good = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(good, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@registry.add("""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def keep_first_merge(spark, d):
    first = aggregates.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"])
    return first.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))


@registry.add("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber::BIGINT))), ',') AS citations FROM lineitem GROUP BY l_orderkey")
def citation_union(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("citations"))
    return aggregates.union_lists(rows, ["l_orderkey"], "citations").select("l_orderkey", F.array_join("citations", ",").alias("citations"))


@registry.add("""SELECT event_type, user_id % 10 AS bucket, count(DISTINCT user_id) AS n_users, array_to_string(list_sort(list(DISTINCT user_id))[1:5], ',') AS first_users FROM events GROUP BY 1, 2""")
def cross_group(spark, d):
    e = table(spark, d, "events").withColumn("bucket", F.col("user_id") % 10)
    found = aggregates.first_values(e, ["event_type", "bucket"], "user_id", 5)
    return found.select("event_type", "bucket", F.col("n").alias("n_users"), F.array_join("firsts", ",").alias("first_users"))


@registry.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    return aggregates.last_write_wins(table(spark, d, "events"), ["user_id"], ["event_type", "value"], ["ts", "event_id"])


TICKETS = """t AS (SELECT user_id AS ticket_id, event_type AS ticket_type, CASE event_id % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'claimed' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'completed' ELSE 'blocked' END AS state,
  day(ts) % 3 AS cycle, CASE WHEN event_id % 5 = 3 THEN CASE WHEN value > 10 THEN 'accept' ELSE 'revise' END END AS decision, ts, event_id, props FROM events)"""


def _tickets(spark, d) -> DataFrame:
    """Events as a log of tickets: a user's rows are one ticket's."""
    k = F.col("event_id") % 5
    state = F.element_at(F.array(*map(F.lit, ("created", "claimed", "in_progress", "completed", "blocked"))), (k + 1).cast("int"))
    decision = F.when(k == 3, F.when(F.col("value") > 10, "accept").otherwise("revise"))
    return table(spark, d, "events").select(F.col("user_id").alias("ticket_id"), F.col("event_type").alias("ticket_type"), state.alias("state"), (F.dayofmonth("ts") % 3).cast("bigint").alias("cycle"), decision.alias("decision"), "ts", "event_id", "props")


@registry.add(f"WITH {TICKETS} SELECT ticket_type, state, cycle, decision, count(*) AS n FROM t GROUP BY GROUPING SETS ((ticket_type, state), (state), (cycle, state), (decision), ())")
def ticket_summary(spark, d):
    return aggregates.ticket_summary(_tickets(spark, d))


LATEST = f"""{TICKETS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY ts DESC, event_id DESC) AS n FROM t)"""


@registry.add(f"""WITH {LATEST}, m AS (SELECT ticket_id, arg_max(props, (ts, event_id)) AS props FROM t GROUP BY ticket_id)
SELECT k.ticket_id, state, CASE WHEN state IN ('claimed', 'in_progress', 'blocked') THEN 'created' ELSE state END AS reloaded, CASE state WHEN 'created' THEN 'open' WHEN 'completed' THEN 'closed' WHEN 'blocked' THEN 'blocked' ELSE 'in_progress' END AS coarse, m.props AS last_props
FROM k JOIN m ON m.ticket_id = k.ticket_id WHERE n = 1""")
def ticket_latest(spark, d):
    log = _tickets(spark, d).select("ticket_id", "ts", F.col("event_id").alias("seq"), "state", F.lit(None).cast("string").alias("worker"), F.create_map(F.lit("props"), F.col("props")).alias("metadata"))
    last = tickets.latest(log)
    loaded = tickets.loaded(last.withColumn("kept", F.col("state"))).withColumnRenamed("state", "reloaded").withColumnRenamed("kept", "state")
    return loaded.select("ticket_id", "state", "reloaded", tickets.coarse_state(F.col("state")).alias("coarse"), F.col("metadata")["props"].alias("last_props"))


@registry.add(f"""WITH {LATEST}, c AS (SELECT ticket_type, count(*) FILTER (WHERE state = 'created') AS a, count(*) FILTER (WHERE state IN ('claimed', 'in_progress')) AS b, count(*) FILTER (WHERE state = 'completed') AS c, count(*) FILTER (WHERE state = 'blocked') AS e FROM k WHERE n = 1 GROUP BY ticket_type)
SELECT ticket_type, CASE WHEN a + b + c + e = 0 THEN 'empty' WHEN a > 0 AND b = 0 AND c = 0 THEN 'not started' WHEN b > 0 THEN 'working' WHEN e > 0 AND a = 0 THEN 'stuck' WHEN a > 0 THEN 'waiting' ELSE 'complete' END AS phase,
  CASE WHEN a + b + c + e = 0 THEN 100.0::DOUBLE ELSE round(100.0::DOUBLE * c / (a + b + c + e), 2) END AS done FROM c""")
def phase_inference(spark, d):
    last = aggregates.keep_first(_tickets(spark, d), ["ticket_id"], [F.desc("ts"), F.desc("event_id")])
    is_ = lambda *s: F.count_if(F.col("state").isin(*s))
    c = last.groupBy("ticket_type").agg(is_("created").alias("a"), is_("claimed", "in_progress").alias("b"), is_("completed").alias("c"), is_("blocked").alias("e"))
    total = F.col("a") + F.col("b") + F.col("c") + F.col("e")
    return c.select("ticket_type", aggregates.phase(*map(F.col, "abce")).alias("phase"), aggregates.percentage(F.col("c"), total).alias("done"))


@registry.add(f"WITH {TICKETS} SELECT ticket_id, event_id, row_number() OVER (PARTITION BY ticket_id ORDER BY ts, event_id) = 1 AS won FROM t WHERE state = 'claimed'")
def ticket_claims(spark, d):
    claims = _tickets(spark, d).where("state = 'claimed'").withColumn("seq", F.col("event_id"))
    return tickets.won_claims(claims).select("ticket_id", "event_id", "won")


@registry.add("""WITH RECURSIVE c AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, k, before, after, errors, trips, opened) AS (
  SELECT user_id, 0::BIGINT, 'closed', 'closed', 0, 0, NULL::TIMESTAMP FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, k, bef,
    CASE WHEN bef NOT IN ('closed', 'half_open') THEN bef WHEN ok THEN 'closed' WHEN bef = 'half_open' OR errors + 1 >= 2 THEN 'open' ELSE 'closed' END,
    CASE WHEN bef NOT IN ('closed', 'half_open') THEN errors WHEN ok OR bef = 'half_open' OR errors + 1 >= 2 THEN 0 ELSE errors + 1 END,
    CASE WHEN bef NOT IN ('closed', 'half_open') THEN trips WHEN ok THEN CASE WHEN bef = 'half_open' THEN 0 ELSE trips END WHEN bef = 'half_open' OR errors + 1 >= 2 THEN trips + 1 ELSE trips END,
    CASE WHEN bef IN ('closed', 'half_open') AND NOT ok AND (bef = 'half_open' OR errors + 1 >= 2) THEN ts ELSE opened END
  FROM (SELECT c.user_id, c.k, c.ts, c.ok, r.errors, r.trips, r.opened, CASE WHEN r.trips >= 50 THEN 'fatal' WHEN r.after = 'open' AND epoch(c.ts) - epoch(r.opened) >= 3600 * least(2 ** (r.trips - 1), 8) THEN 'half_open' ELSE r.after END AS bef
    FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1))
SELECT c.user_id, c.event_id AS seq, c.ts, c.ok, r.before AS state_before, r.after AS state_after FROM c JOIN r ON r.user_id = c.user_id AND r.k = c.k""")
def circuit_breaker_states(spark, d):
    """Each user's calls through a breaker of their own: every state depends on the one before."""
    calls = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("ok"))
    return tickets.circuit_breaker(calls, "user_id", 2, 3600.0)


@registry.add("""WITH RECURSIVE c AS (SELECT user_id, event_id, event_id % 3 AS worker, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, k, holder, since, granted) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, true FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, k, CASE WHEN good THEN worker ELSE holder END, CASE WHEN good THEN ts ELSE since END, good
  FROM (SELECT c.user_id, c.k, c.worker, c.ts, r.holder, r.since, r.holder IS NULL OR r.holder = c.worker OR epoch(c.ts) - epoch(r.since) > 86400 AS good FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1))
SELECT c.user_id AS resource, c.worker, c.ts, c.event_id AS seq, r.granted FROM c JOIN r ON r.user_id = c.user_id AND r.k = c.k""")
def lock_leases(spark, d):
    """Each user's events as requests of workers for one lock with a lease of a day."""
    asked = table(spark, d, "events").select(F.col("user_id").alias("resource"), (F.col("event_id") % 3).alias("worker"), "ts", F.col("event_id").alias("seq"))
    return tickets.leases(asked, 86_400)


@registry.add("""WITH old AS (SELECT o_orderkey, o_custkey, o_totalprice, o_custkey % 100 AS file_id FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT o_orderkey, o_custkey, o_totalprice, o_custkey % 100 AS file_id FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 100 < 10)
SELECT * FROM old WHERE file_id NOT IN (SELECT file_id FROM new) UNION ALL SELECT * FROM new""")
def incremental_update(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_custkey") % 100).alias("file_id"), "o_orderstatus")
    new = rows.where("o_orderstatus = 'P' and file_id < 10").drop("o_orderstatus")
    return rows.where("o_orderstatus <> 'P'").drop("o_orderstatus").join(new.select("file_id").distinct(), "file_id", "left_anti").select(new.columns).unionByName(new)


@registry.add("""SELECT c_custkey || ',' || c_name || ',' || coalesce(c_nationkey::VARCHAR, '') || ',' || c_mktsegment AS line FROM customer""")
def export_csv_rows(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name", F.col("c_nationkey").cast("string").alias("n"), "c_mktsegment")
    return render.csv_lines(rows, ["k", "c_name", "n", "c_mktsegment"])


@registry.add("""SELECT p_partkey, substr(sha256(p_name || '~' || p_brand), 1, 16) AS id, CASE WHEN p_retailprice >= 1024 THEN 'x' ELSE 'y' END AS size_class FROM part""")
def content_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.content_hash(F.col("p_name"), F.col("p_brand")).alias("id"), F.when(F.col("p_retailprice") >= 1024, "x").otherwise("y").alias("size_class"))
