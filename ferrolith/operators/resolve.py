"""Name resolution: a cascade of equi joins from references to artifacts, then fuzzy matches of the rest.

artifacts: artifact_id, type, name, aliases (array, may be null). refs: ref_id, raw_text, expected_type (may be null).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions.text import apply_transforms
from ferrolith.operators.likeness import likenesses
from ferrolith.sources.shared import written


@dataclass(frozen=True)
class AliasRule:
    """Names of target type may be written otherwise: after transforms the name is looked up again."""

    target: str
    transforms: tuple[str, ...]
    confidence: float


#: Fixed value: the likeness from which a name answers to another.
FUZZY = 0.8

#: The default rules, in rank order.
DEFAULT_RULES = [
    AliasRule("table", ("upper", "remove_hyphens"), 0.85),
    AliasRule("table", ("upper", "remove_hyphens", "remove_common_suffixes"), 0.75),
    AliasRule("file", ("last_qualifier", "upper"), 0.8),
    AliasRule("file", ("upper", "truncate_8"), 0.8),
    AliasRule("program", ("upper",), 0.9),
    AliasRule("copybook", ("upper",), 0.9),
    AliasRule("record_layout", ("upper", "remove_hyphens"), 0.85),
    AliasRule("map", ("upper", "truncate_8"), 0.9),
    AliasRule("screen", ("upper", "truncate_8"), 0.9),
    AliasRule("procedure", ("upper",), 0.9),
]


def name_keys(artifacts: DataFrame) -> DataFrame:
    """(key, artifact_id, type, by): each lower-case name and alias that artifacts answer to."""
    names = artifacts.select(F.lower("name").alias("key"), "artifact_id", "type", F.lit("exact").alias("by"))
    aliases = artifacts.select(F.explode("aliases").alias("a"), "artifact_id", "type").select(F.lower("a").alias("key"), "artifact_id", "type", F.lit("alias").alias("by"))
    return names.unionByName(aliases).where("key is not null and key <> ''").distinct()


def _answers(artifacts: DataFrame) -> DataFrame:
    """(key, expected_type, hit): what a lower-case key stands for, by type, and for a null type among all: the artifact
    of that name, else of that alias, the smallest of equals. One row a key and type."""
    keys = name_keys(artifacts)
    first = F.min_by(F.struct("artifact_id", "by"), F.struct((F.col("by") == "alias").cast("int"), "artifact_id")).alias("hit")
    typed = keys.groupBy("key", F.col("type").alias("expected_type")).agg(first).where("expected_type is not null")
    return written(typed.unionByName(keys.groupBy("key").agg(first).withColumn("expected_type", F.lit(None).cast("string")), allowMissingColumns=True), "answers")


def _asked(rows: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    """rows (with key and expected_type) with their hit, joined by key alone, which holds few types."""
    kept = answers.withColumnRenamed("key", "_key").withColumnRenamed("expected_type", "_expected")
    return rows.join(kept, (F.col("key") == F.col("_key")) & F.col("expected_type").eqNullSafe(F.col("_expected")), how).drop("_key", "_expected")


def resolve(refs: DataFrame, artifacts: DataFrame, rules: list[AliasRule] = DEFAULT_RULES, fuzzy: float = FUZZY) -> DataFrame:
    """refs with artifact_id, method (exact, alias, transformation, fuzzy) and confidence; null where nothing answers.

    Each step is one equi join by lower-case key, with one row a key and type: first of all references under their own
    names; then of the different names without an answer under each transformed name, with its rank in the cascade, the
    first that hits wins. What is left is answered by the artifact of its type whose name (no alias) is most alike, with
    a likeness >= fuzzy, the confidence.
    """
    answers = _answers(artifacts)
    own = refs.withColumn("key", F.lower("raw_text"))
    found = _asked(own, answers, "left").select(*refs.columns, F.col("hit.artifact_id").alias("artifact_id"), F.col("hit.by").alias("method"), F.when(F.col("hit").isNotNull(), 1.0).alias("confidence"))
    found = written(found, "resolved")
    names = written(found.where("artifact_id is null and raw_text is not null").select("raw_text", "expected_type").distinct(), "unresolved")
    ways = []
    for rank, rule in enumerate(rules, 1):
        fits = F.col("expected_type").isNull() | (F.col("expected_type") == rule.target)
        key = F.when(fits, F.lower(apply_transforms(F.col("raw_text"), list(rule.transforms))))
        ways.append(F.struct(F.lit(rank).alias("rank"), key.alias("key"), F.lit(rule.confidence).alias("base")))
    tried = names.select("raw_text", "expected_type", F.inline(F.filter(F.array(*ways), lambda w: w.key.isNotNull()))) if ways else None
    if tried is not None:
        hits = _asked(tried, answers, "inner").groupBy("raw_text", "expected_type").agg(F.min_by(F.struct("hit.artifact_id", F.col("base").alias("confidence")), "rank").alias("_hit"))
        same = lambda t: (F.col("raw_text") == t["_name"]) & F.col("expected_type").eqNullSafe(t["_type"])
        hits = hits.withColumnRenamed("raw_text", "_name").withColumnRenamed("expected_type", "_type")
        hits = written(names.join(hits, same(hits), "left").select("raw_text", "expected_type", "_hit"), "transformed")
    else:
        hits = names.withColumn("_hit", F.lit(None).cast("struct<artifact_id:string,confidence:double>"))
    rest = hits.where("_hit is null").select(F.col("raw_text").alias("name"), F.col("expected_type").alias("_type"))
    named = artifacts.select(F.lower("name").alias("target"), "artifact_id", "type").where("target <> ''")
    alike = rest.join(likenesses(rest.select("name"), named.select("target"), fuzzy), "name").join(named, "target").where("_type is null or _type = type")
    best = alike.groupBy(F.col("name").alias("raw_text"), F.col("_type").alias("expected_type")).agg(F.min_by(F.struct("artifact_id", F.col("score").alias("confidence")), F.struct(-F.col("score"), "artifact_id")).alias("_hit"))
    later = hits.where("_hit is not null").withColumn("method", F.lit("transformation")).unionByName(best.withColumn("method", F.lit("fuzzy")))
    later = later.select(F.col("raw_text").alias("_name"), F.col("expected_type").alias("_type"), "_hit", F.col("method").alias("_method"))
    open_ = found.where("artifact_id is null").drop("artifact_id", "method", "confidence")
    met = open_.join(later, (F.col("raw_text") == F.col("_name")) & F.col("expected_type").eqNullSafe(F.col("_type")), "left")
    met = met.select(*refs.columns, F.col("_hit.artifact_id").alias("artifact_id"), F.col("_method").alias("method"), F.col("_hit.confidence").alias("confidence"))
    return found.where("artifact_id is not null").unionByName(met)


def fuzzy_candidates(names: DataFrame, targets: DataFrame, least: float, most: int) -> DataFrame:
    """For each (id, name) up to most targets (target_id, target) with likeness >= least, best first.

    Distinct names are scored once. Columns: id, target_id, score, place.
    """
    found = names.join(likenesses(names.select("name"), targets.select("target"), least), "name").join(targets, "target")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "target_id"))
    return found.select("id", "target_id", "score", place.alias("place")).where(F.col("place") <= most)


def edit_candidates(names: DataFrame, targets: DataFrame, block: str, most_edits: int, most: int) -> DataFrame:
    """As fuzzy_candidates by Levenshtein distance within a block (a column of both)."""
    near = names.join(targets, block).withColumn("edits", F.levenshtein("name", "target", most_edits)).where("edits >= 0")
    place = F.row_number().over(Window.partitionBy("id").orderBy("edits", "target_id"))
    return near.select("id", "target_id", F.col("edits").cast("bigint").alias("edits"), place.cast("bigint").alias("place")).where(F.col("place") <= most)


def links(resolved: DataFrame, order: str = "ref_ord") -> DataFrame:
    """Edges of resolved references, the first of each (src, dst, type). resolved: containing_id, artifact_id,
    relationship_type, method, confidence and the order column."""
    w = Window.partitionBy("containing_id", "artifact_id", "relationship_type").orderBy(order)
    one = resolved.where("artifact_id is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return one.select(F.col("containing_id").alias("src"), F.col("artifact_id").alias("dst"), F.col("relationship_type").alias("type"), "confidence", "method")


def without_external(refs: DataFrame, external: list[str]) -> DataFrame:
    """refs that are neither known utilities nor dotted dataset names."""
    return refs.where(~F.upper("raw_text").isin([x.upper() for x in external])).where(~((F.col("expected_type") == "dataset") & F.col("raw_text").contains(".")) | F.col("expected_type").isNull())
