"""Aggregates over matches, paragraphs, documentation chunks and tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complexity_class(n: Column, decisions: Column, loops: Column, errors: Column) -> Column:
    """simple, moderate or complex by a score of counts of matches."""
    score = F.least(F.floor(n / 5), F.lit(3)) + F.least(decisions, F.lit(3)) + F.when(loops > 0, 2).otherwise(0) + F.when(errors > 0, 1).otherwise(0)
    return F.when(score <= 2, "simple").when(score <= 5, "moderate").otherwise("complex")


def error_coverage(n: Column) -> Column:
    return F.when(n >= 5, "good").when(n >= 2, "moderate").when(n >= 1, "minimal").otherwise("none")


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def last_write_wins(rows: DataFrame, key: list[str], value: list[str], order: list[str]) -> DataFrame:
    """Per key the values of the row that is last by order."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("v")).select(*key, *[f"v.{c}" for c in value])


def union_lists(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """Per key the distinct members of an array or scalar column in order."""
    values = F.array_distinct(F.flatten(F.collect_list(column))) if dict(rows.dtypes)[column].startswith("array") else F.collect_set(column)
    return rows.groupBy(*key).agg(F.array_sort(values).alias(column))


def ticket_summary(tickets: DataFrame) -> DataFrame:
    """Counts by (type, state), (state), (cycle, state), (decision) and in all, in one pass with grouping sets."""
    return tickets.sparkSession.sql(
        "SELECT ticket_type, state, cycle, decision, count(*) AS n FROM {tickets} "
        "GROUP BY GROUPING SETS ((ticket_type, state), (state), (cycle, state), (decision), ())",
        tickets=tickets,
    )


def phase(created: Column, active: Column, completed: Column, blocked: Column) -> Column:
    """What a batch is doing, by its counts of tickets."""
    total = created + active + completed + blocked
    return (
        F.when(total == 0, "empty").when((created > 0) & (active == 0) & (completed == 0), "not started").when(active > 0, "working")
        .when((blocked > 0) & (created == 0), "stuck").when(created > 0, "waiting").otherwise("complete")
    )


def percentage(part: Column, whole: Column, of_none: float = 100.0) -> Column:
    return F.when(whole == 0, F.lit(of_none)).otherwise(F.round(100.0 * part / whole, 2))


def first_n(values: Column, n: int) -> Column:
    return F.slice(F.array_sort(values), 1, n)


def first_values(rows: DataFrame, key: str | list[str], value: str, most: int, order: list | None = None) -> DataFrame:
    """(key, n, firsts): how many different values each key has, and the first most of them in order. Values beyond are
    dropped by rank before they are gathered, so that no set of a frequent key is ever held."""
    key = [key] if isinstance(key, str) else key
    distinct = rows.groupBy(*key, value).agg(*[F.min(c).alias(c) for c in order]) if order else rows.select(*key, value).distinct()
    n = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*(order or [value])))
    firsts = distinct.withColumn("_k", place).where(F.col("_k") <= most).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(value).alias("v")))), lambda x: x["v"]).alias("firsts"))
    return n.join(firsts, key)


def group_programs(edges: DataFrame, most: int = 3) -> DataFrame:
    """Per node (name) what it calls and is called by, with counts and the first few names."""
    out = first_values(edges, "src", "dst", most).select(F.col("src").alias("name"), F.col("n").alias("n_calls"), F.col("firsts").alias("calls"))
    into = first_values(edges, "dst", "src", most).select(F.col("dst").alias("name"), F.col("n").alias("n_called_by"), F.col("firsts").alias("called_by"))
    both = out.join(into, "name", "full").fillna(0, ["n_calls", "n_called_by"])
    return both.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("calls", "called_by")})


def merge_chunks(rows: DataFrame, section_keys: dict[str, list[str]], doc: str = "doc_id", order: str = "chunk") -> dict[str, DataFrame]:
    """Sections of documentation that was written in chunks: of each section (rows where section = its name) the first
    entry of each key in order of chunks, with its number."""
    out = {}
    for section, key in section_keys.items():
        mine = keep_first(rows.where(F.col("section") == section), [doc, *key], [order, "ord"])
        out[section] = mine.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy(order, "ord")))
    return out


def merge_purposes(rows: DataFrame, doc: str = "doc_id", order: str = "chunk") -> DataFrame:
    """(doc, summary, business_context, program_type, citations) of rows with these columns and has_header: the purpose
    of the first chunk that holds a header and has one, else of the first that has one, citing what all cite."""
    none = F.array().cast("array<bigint>")
    given = rows.where(F.col("summary").isNotNull() | F.col("business_context").isNotNull() | F.col("program_type").isNotNull())
    first = F.min_by(F.struct("summary", "business_context", "program_type"), F.struct(F.when(F.col("has_header"), 0).otherwise(1).alias("h"), F.col(order).alias("o")))
    cited = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col("citations").cast("array<bigint>"), none)))))
    merged = given.groupBy(doc).agg(first.alias("p"), cited.alias("citations")).select(doc, "p.*", "citations")
    return rows.select(doc).distinct().join(merged, doc, "left").withColumn("citations", F.coalesce("citations", none))


def merge_cited(rows: DataFrame, key: list[str], doc: str = "doc_id", order: str = "chunk") -> DataFrame:
    """Inputs or outputs of chunks: the first entry of each key with the citations of all its entries in order; entries
    without citations keep none."""
    of = [doc, *key]
    cited = rows.where("citation is not null").groupBy(*of).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("citation")))).alias("_all"))
    first = keep_first(rows, of, [order, "ord"])
    held = cited.select(*[F.col(c).alias(f"_{c}") for c in of], "_all")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of]
    joined = first.join(held, same, "left")
    return joined.select(*[F.when(F.col("citation").isNotNull(), F.col("_all")).alias("citation") if c == "citation" else F.col(c) for c in rows.columns])


def merge_rules(rows: DataFrame, doc: str = "doc_id", order: str = "chunk") -> DataFrame:
    """Business rules of chunks: the first of each description, without case and outer blanks; numbered BR001 on."""
    keyed = rows.withColumn("_key", F.lower(F.trim(F.coalesce("description", F.lit("")))))
    first = keep_first(keyed, [doc, "_key"], [order, "ord"]).drop("_key")
    n = F.row_number().over(Window.partitionBy(doc).orderBy(order, "ord"))
    return first.withColumn("rule_id", F.concat(F.lit("BR"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


def merge_questions(rows: DataFrame) -> DataFrame:
    """Questions of chunks, all of them, each with the lines of its chunk."""
    span = F.concat(F.lit("[lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("] "))
    return rows.withColumn("question", F.concat(F.coalesce(span, F.lit("")), "question"))
