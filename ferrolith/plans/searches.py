"""Queries that search whole texts by an index of trigrams, and files by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.operators import regex_index
from ferrolith.plans.registry import Registry, table
from ferrolith.sources.shared import written

registry = Registry()
QUERIES, ORACLE_SQL = registry.queries, registry.sql

#: Patterns, and in SQL what a text must hold of each (low: the text with A-Z folded) to be a candidate.
ASKED = {
    "[Ll]icen[cs]e|Copyright": "contains(low, 'lic') AND contains(low, 'ice') AND contains(low, 'cen') AND (contains(low, 'enc') AND contains(low, 'nce') OR contains(low, 'ens') AND contains(low, 'nse'))"
    " OR contains(low, 'cop') AND contains(low, 'opy') AND contains(low, 'pyr') AND contains(low, 'yri') AND contains(low, 'rig') AND contains(low, 'igh') AND contains(low, 'ght')",
    "[0-9]{5,}": "true",
    "(?i)the (and|of) [a-z]*on": "contains(low, 'the') AND contains(low, 'he ') AND (contains(low, 'e a') AND contains(low, ' an') AND contains(low, 'and') AND contains(low, 'nd ') OR contains(low, 'e o') AND contains(low, ' of') AND contains(low, 'of '))",
    "zqxj+k": "contains(low, 'zqx') AND contains(low, 'qxj')",
}


def _files(spark, d) -> tuple[DataFrame, DataFrame]:
    """The documents and their index."""
    files = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return files, written(regex_index.postings(files, "doc_id"), "trigrams")


TEXTS = "SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents"


@registry.add(" UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id, line_no, md5(line) AS digest FROM ({TEXTS}) WHERE regexp_matches(line, '{p}')" for p in ASKED))
def regex_search(spark, d):
    files, index = _files(spark, d)
    rows = None
    for pattern in ASKED:
        found = regex_index.search(files, index, pattern, 0, key="doc_id").select(F.lit(pattern).alias("pattern"), "doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5(F.col("text").cast("binary")).alias("digest"))
        rows = found if rows is None else rows.unionByName(found)
    return rows


@registry.add(
    "WITH f AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents) "
    + " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, count(*) AS n_files, count(*) FILTER (WHERE {need}) AS n_read, count(*) FILTER (WHERE len(list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '{p}'))) > 0) AS n_found FROM f"
        for p, need in ASKED.items()
    )
)
def regex_search_report(spark, d):
    files, index = _files(spark, d)
    return regex_index.report(files, index, list(ASKED), "doc_id")


@registry.add("""WITH files AS (SELECT DISTINCT CASE l_suppkey % 4 WHEN 0 THEN 'P' || l_partkey || '.cbl' WHEN 1 THEN 'lib/p' || l_partkey || '.CPY' WHEN 2 THEN 'a/b/P' || l_partkey || '.cbl' ELSE 'P' || l_partkey || '.txt' END AS path, 'P' || l_partkey AS name,
  CASE l_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS place FROM lineitem)
SELECT name, arg_min(path, place) AS path FROM files JOIN part ON name = 'P' || p_partkey WHERE place IS NOT NULL GROUP BY name""")
def named_files(spark, d):
    k, s = F.col("l_partkey").cast("string"), F.col("l_suppkey") % 4
    path = F.when(s == 0, F.concat(F.lit("P"), k, F.lit(".cbl"))).when(s == 1, F.concat(F.lit("lib/p"), k, F.lit(".CPY"))).when(s == 2, F.concat(F.lit("a/b/P"), k, F.lit(".cbl"))).otherwise(F.concat(F.lit("P"), k, F.lit(".txt")))
    names = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    return regex_index.find_files(table(spark, d, "lineitem").select(path.alias("path")).distinct(), names, [".cpy", ".cbl"])
