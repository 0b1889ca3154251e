"""Rule tables and their matches: extraction, coverage, required rules, ordered classification."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A regular expression of a category; group is the capture that names the match."""

    category: str
    name: str
    regex: str
    group: int = 0
    required: bool = False
    artifact_type: str | None = None
    relationship_type: str | None = None
    target_type: str | None = None
    flags: str = field(default="")


#: Rules for prose documents.
DOCUMENT_RULES = [
    Rule("contact", "email", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"),
    Rule("contact", "phone", r"\+?[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}"),
    Rule("legal", "license", r"[A-Z][A-Za-z]+ (?:General )?(?:Public )?[Ll]icense", required=True),
    Rule("legal", "rights", r"[Aa]ll rights reserved"),
    Rule("markup", "symbol_run", r"[#*$%&]{3}"),
    Rule("markup", "url", r"https?://[A-Za-z0-9./_-]+"),
    Rule("number", "long_number", r"[0-9]{5,}"),
    Rule("number", "decimal", r"[0-9]+\.[0-9]+"),
    Rule("sentence", "question", r"[A-Za-z]+\?", required=True),
    Rule("sentence", "stop", r"[A-Za-z]+\.", required=True),
]


def rule_problems(rules: list[Rule]) -> list[str]:
    """What is wrong with a rule table: names that repeat, expressions that don't compile, groups that don't exist."""
    import re

    out, seen = [], set()
    for r in rules:
        if (r.category, r.name) in seen:
            out.append(f"{r.category}.{r.name}: repeated")
        seen.add((r.category, r.name))
        try:
            if re.compile(r.regex).groups < r.group:
                out.append(f"{r.category}.{r.name}: no group {r.group}")
        except re.error as e:
            out.append(f"{r.category}.{r.name}: {e}")
    return out


def all_matches(text: Column, rules: list[Rule]) -> Column:
    """An array of (category, name, found) of all matches, by rule and then place; all in one pass over the row."""
    def found(r: Rule) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(r.flags + r.regex), r.group), lambda m: F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("name"), m.alias("found")))

    return F.concat(*map(found, rules))


def extract_matches(lines: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """A row for each match in a line: the columns of lines but the text, category, name, found."""
    kept = [c for c in lines.columns if c != text]
    return lines.select(*kept, F.explode(all_matches(F.col(text), rules)).alias("m")).select(*kept, "m.category", "m.name", "m.found")


def coverage(matches: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """Per key and category: n_matches, n_rules that matched, and their share of the category's rules in percent."""
    total = F.lit(None).cast("int")
    for c in {r.category for r in rules}:
        total = F.when(F.col("category") == c, len({r.name for r in rules if r.category == c})).otherwise(total)
    counts = matches.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct("name").alias("n_rules"))
    return counts.withColumn("coverage", F.round(100.0 * F.col("n_rules") / total, 2))


def rule_counts(texts: DataFrame, rules: list[Rule], key: str, text: str = "text") -> DataFrame:
    """(key, counts): how often each rule, in order, matches in the texts of a key; no match becomes a row. Lines or
    whole texts give the same where no rule's match crosses a line's end."""
    counted = texts.select(key, *[F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r.flags + r.regex)).cast("bigint").alias(f"r{i}") for i, r in enumerate(rules)])
    return counted.groupBy(key).agg(F.array(*[F.sum(f"r{i}") for i in range(len(rules))]).alias("counts"))


def coverage_of(counts: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """coverage() from rule_counts()."""
    rows = []
    for c in dict.fromkeys(r.category for r in rules):
        mine = [F.get("counts", i) for i, r in enumerate(rules) if r.category == c]
        hit = sum((F.when(m > 0, 1).otherwise(0) for m in mine), F.lit(0)).cast("bigint")
        rows.append(F.struct(F.lit(c).alias("category"), sum(mine, F.lit(0)).cast("bigint").alias("n_matches"), hit.alias("n_rules"), F.round(100.0 * hit / len({r.name for r in rules if r.category == c}), 2).alias("coverage")))
    found = counts.select(key, F.explode(F.filter(F.array(*rows), lambda x: x["n_matches"] > 0)).alias("x"))
    return found.select(key, "x.category", "x.n_matches", "x.n_rules", "x.coverage")


def required_without_count(counts: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """missing_required() from rule_counts() of all keys."""
    due = [F.when(F.get("counts", i) == 0, F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("name"))) for i, r in enumerate(rules) if r.required]
    return counts.select(key, F.explode(F.array_compact(F.array(*due))).alias("w")).select(key, "w.category", "w.name")


def missing_required(keys: DataFrame, matches: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, category, name) of required rules that nothing of the key matches."""
    wanted = F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("name")) for r in rules if r.required])
    due = keys.select(key, F.explode(wanted).alias("w")).select(key, "w.category", "w.name")
    return due.join(matches.select(key, "category", "name").distinct().hint("merge"), [key, "category", "name"], "left_anti")


def first_class(text: Column, classes: list[tuple[str, str]], other: str) -> Column:
    """The name of the first (name, regex) that a text matches."""
    out = F.lit(other)
    for name, regex in reversed(classes):
        out = F.when(text.rlike(regex), F.lit(name)).otherwise(out)
    return out


def in_scope(lines: DataFrame, header: str, key: str) -> DataFrame:
    """lines with scope: the last line at or before that matches header (its first group), for rules that hold only
    below certain headers."""
    from pyspark.sql import Window

    name = F.nullif(F.regexp_extract("text", header, 1), F.lit(""))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("scope", F.last(name, ignorenulls=True).over(w))


def context_lines(lines: DataFrame, pattern: str, before_after: int, key: str, most: int | None = None) -> DataFrame:
    """Lines that match pattern with the lines around them; with most, only the first so many of each key."""
    from pyspark.sql import Window

    around = Window.partitionBy(key).orderBy("line_no").rowsBetween(-before_after, before_after)
    found = lines.withColumn("context", F.collect_list("text").over(around)).where(F.col("text").rlike(pattern))
    if most is not None:
        found = found.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("_k") <= most).drop("_k")
    return found
