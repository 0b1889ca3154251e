"""A Merkle manifest of a table: one tree a group, and one tree over the groups' roots, by windows of eight.

Nodes of a level are numbered from 0 within their group. A window over (group, number div 8) collects the digests of a
whole run, in order: joined they are the parent's preimage, and without a node's own digest its siblings. One row of
each run goes on as the parent. Only digests move between tasks, never texts.

A hot group is numbered by ranges: rows are dealt by (group, order), numbered where they are, and moved by what the
ranges before hold of the same group; so no task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.llm.stages import written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value with its length in UTF-8 bytes, so that no two rows have one preimage; - for null."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, the number of each from 0 within its group in the given order, and n, the rows of the group.

    Nulls come first. Rows that are equal in group and order are numbered in any order.
    """
    spot = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", spot)
    dealt = written(dealt, "merkle-ranges")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    held = dealt.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min(inside).alias("_first"))
    whole = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("_g", "_p", (before - F.col("_first")).alias("_move"), F.sum("_n").over(whole).alias("n"))
    met = dealt.join(held, (part == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*rows.columns, (inside + F.col("_move")).cast("bigint").alias("idx"), F.col("n").cast("bigint").alias("n"))


def _runs(nodes: DataFrame, group: str) -> DataFrame:
    """(group, idx, n, run, digest) of the parents of nodes (group, idx, n, digest): each run once, in order."""
    whole = Window.partitionBy(group, "_parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = nodes.withColumn("_parent", F.floor(F.col("idx") / ARITY)).withColumn("run", F.collect_list("digest").over(whole))
    once = seen.where(F.col("idx") % ARITY == 0)
    return once.select(group, F.col("_parent").alias("idx"), F.ceil(F.col("n") / ARITY).alias("n"), "run", F.sha2(F.array_join("run", ""), 256).alias("digest"))


def levels(nodes: DataFrame, group: str, name: str) -> list[DataFrame]:
    """The levels above nodes (group, idx, n, digest), lowest first; a group is in all levels until one node is left."""
    found = []
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        nodes = written(_runs(nodes.where("n > 1"), group), f"{name}-{len(found)}")
        found.append(nodes)
    return found


def siblings(run: Column, idx: Column) -> Column:
    """What stands before and after a node in its run."""
    own = (idx % ARITY).cast("int")
    return F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("before"), F.array_join(F.slice(run, own + 2, F.lit(ARITY)), "").alias("after"))


def with_paths(nodes: DataFrame, above: list[DataFrame], group: str) -> DataFrame:
    """nodes (group, idx, ...) with path: the siblings on each level, from the node's own run up to its group's root.

    Paths are made from the top: a run's path goes to its at most eight members, so each level sends only its own.
    """
    path = None
    for level in reversed(above):
        runs = level.select(F.col(group).alias("_g"), F.col("idx").alias("_i"), "run")
        if path is not None:
            met = F.col("_g").eqNullSafe(F.col("_pg")) & (F.col("_i") == F.col("_pi"))
            runs = runs.join(path.select(F.col("_g").alias("_pg"), F.col("_i").alias("_pi"), "path"), met, "left").drop("_pg", "_pi")
        else:
            runs = runs.withColumn("path", F.lit(None).cast(STEP))
        top = F.coalesce("path", F.array().cast(STEP))
        if level is above[0]:
            path = runs.select("_g", "_i", "run", top.alias("path"))
            break
        at = F.posexplode("run").alias("_k", "_d")
        member = runs.select("_g", "_i", "run", top.alias("path"), at).withColumn("_idx", F.col("_i") * ARITY + F.col("_k"))
        path = member.select("_g", F.col("_idx").alias("_i"), F.concat(F.array(siblings(F.col("run"), F.col("_idx"))), "path").alias("path"))
    if path is None:
        return nodes.withColumn("path", F.array().cast(STEP))
    met = nodes.join(path, nodes[group].eqNullSafe(F.col("_g")) & (F.floor(nodes["idx"] / ARITY) == F.col("_i")), "left")
    own = F.concat(F.array(siblings(F.col("run"), F.col("idx"))), "path").cast(STEP)
    return met.select(*[nodes[c] for c in nodes.columns], F.when(F.col("run").isNotNull(), own).otherwise(F.array().cast(STEP)).alias("path"))


def manifest(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows (with columns leaf, group and order, and any others) with subroot, root and path.

    Leaves of a group ascend by order, then leaf, nulls first; groups by their bytes, null first, a group of its own.
    path is the siblings (before, after) on every level from the leaf to root, through the group's root: all that is
    needed to recompute root from the leaf. An empty table has no root and gives no rows.
    """
    leaves = written(numbered(written(rows, "merkle-leaves"), group, [order, "leaf"]), "merkle-numbered")
    below = leaves.select(group, "idx", "n", F.col("leaf").alias("digest"))
    own = levels(below, group, "merkle-level")
    roots = [x.where("n = 1").select(group, "digest") for x in [below, *own]]
    tops = roots[0]
    for r in roots[1:]:
        tops = tops.unionByName(r)
    tops = numbered(tops.withColumn("_all", F.lit(0)), "_all", [group])
    tops = written(tops.select("_all", F.col(group).alias("_lang"), "idx", "n", "digest"), "merkle-groups")
    upper = levels(tops.select("_all", "idx", "n", "digest"), "_all", "merkle-top")
    found = (upper[-1] if upper else tops).select("digest").first()
    root = F.lit(found[0] if found else None).cast("string")
    tops = with_paths(tops, upper, "_all").select("_lang", F.col("digest").alias("subroot"), F.col("path").alias("_upper"))
    met = with_paths(leaves, own, group)
    met = met.join(tops, met[group].eqNullSafe(F.col("_lang")))
    return met.select(*[c for c in rows.columns], "subroot", root.alias("root"), F.concat("path", "_upper").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda held, step: digest(step.before, held, step.after))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step.before, step.after)), ""), 256)


def document_leaf(text: Column) -> Column:
    """The leaf of a row of documents with the given text."""
    return digest(*[framed(text if c == "text" else F.col(c)) for c in FIELDS])


def document_manifest(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, leaf, altered (its leaf if A-Z of the text were lower-cased, for ids whose crc32
    3 divides, else null), subroot and root, of the trees by lang, and path. Nothing else of the rows is kept.

    Nulls in any column are framed as -; null ids come first in their language and are never altered; rows of one id
    follow each other by leaf, and equal rows are leaves of their own. Columns besides the five change nothing.
    """
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    altered = F.when(changed, document_leaf(F.translate("text", LETTERS, LETTERS.lower())))
    leaves = docs.select("doc_id", "lang", document_leaf(F.col("text")).alias("leaf"), altered.alias("altered"))
    return manifest(leaves, "lang", "doc_id").drop("lang")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    found = document_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))
    found = found.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = """
with recursive
crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))),
framed as (
  select doc_id, lang, text, lower(text) as low,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as changed,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0, false) as hit
  from documents, crc_table),
leaves as materialized (
  select doc_id, lang, leaf, case when hit then altered else leaf end as altered,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n
  from (select *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) as altered from framed)),
nodes as (
  select 0 as lvl, lang, idx, n, leaf as digest from leaves
  union all
  select lvl + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by idx))
  from nodes where n > 1 group by lvl, lang, idx // 8, n),
tops as materialized (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from nodes where n = 1),
upper_nodes as (
  select 0 as lvl, idx, n, digest from tops
  union all
  select lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by idx)) from upper_nodes where n > 1 group by lvl, idx // 8, n),
steps as (
  select p.lang, p.lvl, p.idx, coalesce(string_agg(o.digest, '' order by o.idx) filter (o.idx < p.idx), '') as before,
    coalesce(string_agg(o.digest, '' order by o.idx) filter (o.idx > p.idx), '') as after
  from nodes p join nodes o on p.lvl = o.lvl and p.lang is not distinct from o.lang and p.idx // 8 = o.idx // 8
  where p.n > 1 group by all),
upper_steps as (
  select p.lvl, p.idx, coalesce(string_agg(o.digest, '' order by o.idx) filter (o.idx < p.idx), '') as before,
    coalesce(string_agg(o.digest, '' order by o.idx) filter (o.idx > p.idx), '') as after
  from upper_nodes p join upper_nodes o on p.lvl = o.lvl and p.idx // 8 = o.idx // 8 where p.n > 1 group by all),
depth as (select lang, max(lvl) + 1 as d from steps group by lang),
paths as materialized (
  select l.lang, l.idx, s.lvl, s.before, s.after from leaves l join steps s on l.lang is not distinct from s.lang and s.idx = l.idx // (8 ** s.lvl)::bigint
  union all
  select l.lang, l.idx, coalesce(d.d, 0) + s.lvl, s.before, s.after
  from leaves l join tops t on l.lang is not distinct from t.lang left join depth d on l.lang is not distinct from d.lang
    join upper_steps s on s.idx = t.idx // (8 ** s.lvl)::bigint),
folds as (
  select lang, idx, 0 as lvl, altered as digest from leaves
  union all
  select f.lang, f.idx, f.lvl + 1, sha256(p.before || f.digest || p.after)
  from folds f join paths p on f.lang is not distinct from p.lang and f.idx = p.idx and f.lvl = p.lvl),
ends as (select lang, idx, arg_max(digest, lvl) as folded_root from folds group by all),
proofs as (select lang, idx, sha256(string_agg(before || after, '' order by lvl)) as proof_sha256 from paths group by all)
select l.doc_id, l.leaf, t.digest as subroot, r.digest as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = r.digest as verified
from leaves l join tops t on l.lang is not distinct from t.lang
  join (select digest from upper_nodes where n = 1) r on true
  join ends e on l.lang is not distinct from e.lang and l.idx = e.idx
  left join proofs p on l.lang is not distinct from p.lang and l.idx = p.idx
"""
