"""Documentation checked against what the source shows: citations, missing entries, evidence, verdicts, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a paragraph begins that no one has documented yet is a parameter; severities in their order.
SEVERITIES = ["BLOCKING", "IMPORTANT", "MINOR"]


def citation_findings(cited: DataFrame, truth: DataFrame) -> DataFrame:
    """(file_id, name, issue, original, corrected) of paragraphs whose citation is wrong.

    cited: file_id, name, citation (array of first and last line). truth: file_id, name, line_start, line_end, names in
    any case. MISSING: no citation, zeros or no lines; WRONG_RANGE: it doesn't overlap the truth; both with the true
    range. UNRESOLVABLE: no such paragraph. An overlap, and a lone number, is accepted. Files without truth are left out.
    """
    upper = truth.select("file_id", F.upper("name").alias("key"), "line_start", F.coalesce("line_end", "line_start").alias("line_end"))
    known = upper.groupBy("file_id", "key").agg(F.max_by(F.array("line_start", "line_end"), "line_start").alias("corrected"))
    due = cited.where(F.coalesce(F.col("name"), F.lit("")) != "").withColumn("key", F.upper("name")).join(truth.select("file_id").distinct(), "file_id", "left_semi")
    joined = due.join(known, ["file_id", "key"], "left")
    a, b = F.get("citation", 0), F.get("citation", 1)
    none = F.col("citation").isNull() | (F.size("citation") == 0)
    overlap = (a <= F.get("corrected", 1)) & (F.get("corrected", 0) <= b)
    issue = (
        F.when(F.col("corrected").isNull(), "UNRESOLVABLE").when(none, "MISSING").when(F.size("citation") < 2, None)
        .when(~F.coalesce((a > 0) & (b > 0), F.lit(False)), "MISSING").when(~overlap, "WRONG_RANGE")
    )
    original = F.when(issue.isin("UNRESOLVABLE", "WRONG_RANGE"), F.col("citation"))
    return joined.select("file_id", "name", issue.alias("issue"), original.alias("original"), "corrected").where("issue is not null")


def resolved_citations(cited: DataFrame, paragraphs: DataFrame, n_lines: DataFrame) -> DataFrame:
    """(file_id, name, line_start, line_end): a citation's own range if it is within the file (file_id, n_lines), else
    from the paragraph's start to before the next one's, nulls where there is none."""
    next_start = F.lead("line_start").over(Window.partitionBy("file_id").orderBy("line_start"))
    spans = paragraphs.join(n_lines, "file_id").withColumn("_end", F.coalesce(next_start - 1, F.col("n_lines")))
    spans = spans.groupBy("file_id", F.upper("name").alias("key")).agg(F.min_by(F.struct("line_start", "_end"), "line_start").alias("_s"))
    joined = cited.withColumn("key", F.upper("name")).join(n_lines, "file_id", "left").join(spans, ["file_id", "key"], "left")
    a, b = F.get("citation", 0), F.get("citation", 1)
    valid = F.coalesce((a >= 1) & (a <= b) & (b <= F.col("n_lines")), F.lit(False))
    return joined.select("file_id", "name", F.when(valid, a).otherwise(F.col("_s.line_start")).alias("line_start"), F.when(valid, b).otherwise(F.col("_s._end")).alias("line_end"))


def missing_entries(found: DataFrame, documented: DataFrame, key: list[str], section: str, severity: str, *excused: DataFrame) -> DataFrame:
    """(file_id, section, item, severity): rows of found (file_id and key) that neither documented nor excused hold,
    whatever the case. Items of several columns are joined by >."""
    upper = lambda t: t.where(F.forall(F.array(*key), lambda x: F.coalesce(x, F.lit("")) != "")).select("file_id", *[F.upper(k).alias(k) for k in key]).distinct()
    left = upper(found).join(upper(documented), ["file_id", *key], "left_anti")
    for other in excused:
        left = left.join(upper(other), ["file_id", *key], "left_anti")
    return left.select("file_id", F.lit(section).alias("section"), F.concat_ws(">", *key).alias("item"), F.lit(severity).alias("severity"))


def structural_precheck(
    paragraphs: DataFrame, calls: DataFrame, includes: DataFrame, documented: DataFrame, documented_calls: DataFrame,
    documented_includes: DataFrame, sections: DataFrame, dead: DataFrame, thru: DataFrame, stub: str,
) -> DataFrame:
    """(file_id, section, item, severity) of what the documentation lacks, in order of severity (column place).

    paragraphs, dead, thru: file_id, name. calls: file_id, name, target. includes: file_id, name. documented: file_id,
    name, purpose; a purpose that begins with stub is none. sections: file_id, section, filled. Calls count only for
    paragraphs that are documented.
    """
    stubs = documented.where(F.col("purpose").startswith(stub) & (F.col("name") != "")).select("file_id", F.lit("stub").alias("section"), F.upper("name").alias("item"), F.lit("BLOCKING").alias("severity"))
    known = documented.select("file_id", F.upper("name").alias("name")).distinct()
    own = calls.withColumn("name", F.upper("name")).join(known, ["file_id", "name"], "left_semi")
    empty = sections.where(~F.coalesce("filled", F.lit(False))).select("file_id", F.lit("empty").alias("section"), F.col("section").alias("item"), F.when(F.col("section") == "purpose", "BLOCKING").otherwise("IMPORTANT").alias("severity"))
    out = stubs.unionByName(missing_entries(paragraphs, documented, ["name"], "paragraphs", "BLOCKING", dead, thru))
    out = out.unionByName(missing_entries(own, documented_calls, ["name", "target"], "calls", "IMPORTANT"))
    out = out.unionByName(missing_entries(includes, documented_includes, ["name"], "copybooks_used", "IMPORTANT")).unionByName(empty)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy(rank, "section", "item")))


def evidence(claims: DataFrame, bundles: DataFrame, lines: DataFrame) -> DataFrame:
    """(claim_id, bundle_id, excerpt): the source of each bundle (bundle_id, file_id, line_start, line_end) that a claim
    (claim_id, bundle_ids) names, its lines in order; null where the bundle or its lines are unknown."""
    named = claims.select("claim_id", F.explode(F.array_distinct("bundle_ids")).alias("bundle_id"))
    wanted = bundles.select("bundle_id", "file_id", F.explode(F.sequence("line_start", "line_end")).alias("line_no"))
    text = wanted.join(lines, ["file_id", "line_no"]).groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_l"))
    return named.join(text, "bundle_id", "left").select("claim_id", "bundle_id", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("excerpt"))


def with_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims with verdict: the last one (by ord) of its id, UNVERIFIABLE without."""
    last = verdicts.groupBy("claim_id").agg(F.max_by("verdict", "ord").alias("verdict"))
    return claims.join(last, "claim_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNVERIFIABLE")))


def verdict_counts(judged: DataFrame, key: str) -> DataFrame:
    """(key, n_verified, n_refuted, n_unverifiable, acceptable): acceptable if nothing is refuted."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
    return judged.groupBy(key).agg(count("VERIFIED"), count("REFUTED"), count("UNVERIFIABLE"), (~F.bool_or(F.col("verdict") == "REFUTED")).alias("acceptable"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 1.0 of nothing."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(1.0))


def notes_by_file(notes: DataFrame) -> DataFrame:
    """(file_id, note_id): a row for each file that a note (note_id, affected) names; a note that names none is about
    all files and has one row without file_id, instead of one for each file there is."""
    return notes.select("note_id", F.explode_outer(F.array_distinct("affected")).alias("file_id")).select("file_id", "note_id")


def merged_feedback(tickets: DataFrame, feedback: DataFrame) -> DataFrame:
    """tickets (ticket_id, file_id, state, notes) after human feedback (file_id, action, note, ord): its notes come
    first; skip cancels, a completed ticket that is given a note opens again as rework."""
    given = feedback.groupBy("file_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("ord", "note")))), lambda x: x["note"]).alias("_notes"), F.bool_or(F.col("action") == "skip").alias("_skip")
    )
    none = F.array().cast("array<string>")
    joined = tickets.join(given, "file_id", "left").withColumn("_notes", F.coalesce("_notes", none))
    state = F.when(F.col("_skip"), "cancelled").when((F.col("state") == "completed") & (F.size("_notes") > 0), "rework").otherwise(F.col("state"))
    return joined.withColumns({"state": state, "notes": F.concat("_notes", F.coalesce("notes", none))}).drop("_notes", "_skip")
