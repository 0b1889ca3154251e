"""What calls what: callouts of files and directories, callers of a name, statistics of files, program tables.

callouts: file_id, artifact (null for one of the file itself), target, relation, line. artifacts: file_id, name, type,
line_start, line_end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators.aggregates import first_values

#: Extensions that a target may carry beside its name.
TARGET_EXTENSIONS = [".cpy", ".copy", ".cbl", ".cob", ".cobol"]

#: How an edge of a type is called, and the languages that are also types of file; others count as CALL,
#: and have no type.
CALL_TYPES = {"calls": "CALL", "performs": "PERFORM", "invokes": "INVOKE", "executes": "EXEC", "includes": "COPY"}
FILE_TYPES = ["COBOL", "JCL", "COPYBOOK", "BMS", "SQL"]

#: Types of artifacts that are data or interfaces; all others are code.
DATA_TYPES = ["table", "view", "file", "record_layout", "column", "index", "segment", "dataset"]
INTERFACE_TYPES = ["transaction", "screen", "queue", "service", "map"]

#: Types of artifacts that a file is entered by, and relations that count as its main calls.
ENTRY_TYPES = ["program", "procedure", "function"]
MAIN_RELATIONS = ["calls", "executes", "performs"]

#: Beginnings of names of system programs, and of what comes with a library.
SYSTEM_PREFIXES = ["IEF", "IEB", "IEH", "IDC", "AMS", "DFH", "DSN", "CSQ", "IGY", "IGZ", "CEE", "DFS", "HEWL", "IEWL", "IGYCRCTL", "IKJEFT"]
LIBRARY_PREFIXES = ["LIB", "UTL", "CMN", "COM"]


def call_type(relation: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CALL_TYPES.items() for x in kv]), F.lower(relation)), F.lit("CALL"))


def file_type(language: Column) -> Column:
    return F.when(F.upper(language).isin(FILE_TYPES), F.upper(language))


def category(kind: Column) -> Column:
    return F.when(kind.isin(DATA_TYPES), "data").when(kind.isin(INTERFACE_TYPES), "interface").otherwise("code")


def program_type(name: Column) -> Column:
    """What a program without source probably is."""
    starts = lambda prefixes: F.upper(name).rlike("^(" + "|".join(prefixes) + ")")
    return F.when(starts(SYSTEM_PREFIXES), "system_utility").when(starts(LIBRARY_PREFIXES), "external_library").otherwise("missing_source")


def _without_extensions(name: Column) -> Column:
    """An array: the name without each extension that it ends with."""
    cut = [F.when(name.endswith(e), F.substring(name, F.lit(1), F.length(name) - len(e))) for e in TARGET_EXTENSIONS]
    return F.array_compact(F.array(*cut))


def callers(callouts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, file_id, artifact, relation, line): the callouts that mean each of names (column name).

    Whatever the case, a target means a name that equals it, or it without an extension, or its part after the last /;
    or that without an extension equals it. As one equi join: both sides have a row for each form, and two forms meet
    unless both were cut.
    """
    target, name = F.lower("target"), F.lower("name")
    cut = F.transform(_without_extensions(target), lambda x: F.struct(x.alias("form"), F.lit(False).alias("whole")))
    base = F.when(target.contains("/"), F.array(F.struct(F.substring_index(target, "/", -1).alias("form"), F.lit(False).alias("whole")))).otherwise(F.array().cast("array<struct<form:string,whole:boolean>>"))
    forms = F.array_distinct(F.concat(F.array(F.struct(target.alias("form"), F.lit(True).alias("whole"))), cut, base))
    left = callouts.where("target <> ''").select("file_id", "artifact", "relation", "line", F.explode(forms).alias("f")).select("*", "f.form", "f.whole").drop("f")
    named = F.array_distinct(F.concat(F.array(F.struct(name.alias("form"), F.lit(True).alias("whole"))), F.transform(_without_extensions(name), lambda x: F.struct(x.alias("form"), F.lit(False).alias("whole")))))
    right = names.select("name").distinct().select("name", F.explode(named).alias("f")).select("name", F.col("f.form").alias("form"), F.col("f.whole").alias("named"))
    return left.join(right, "form").where("whole or named").select("name", "file_id", "artifact", "relation", "line")


def file_stem(file_id: Column) -> Column:
    """The name of a file without folders and its last extension."""
    name = F.substring_index(file_id, "/", -1)
    return F.when(F.length(name) == F.length(F.regexp_replace(name, "\\.[^.]*$", "")), name).otherwise(F.regexp_replace(name, "(?<=.)\\.[^.]*$", ""))


def directory_callouts(callouts: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(from, to, type, line, resolved): callouts of files as coming from their stems, and whether the target is an
    artifact or a file's stem, whatever the case."""
    known = artifacts.select(F.lower("name").alias("key")).unionByName(files.select(F.lower(file_stem(F.col("file_id"))).alias("key"))).distinct().withColumn("known", F.lit(True))
    keyed = callouts.withColumn("key", F.lower(F.coalesce("target", F.lit("")))).join(known, "key", "left")
    return keyed.select(F.coalesce("artifact", file_stem(F.col("file_id"))).alias("from"), F.col("target").alias("to"), F.col("relation").alias("type"), "line", F.coalesce("known", F.lit(False)).alias("resolved"))


def compact_callouts(found: DataFrame) -> DataFrame:
    """Of directory_callouts the distinct (from_artifact, to_target, call_type) with both ends."""
    return found.where(F.coalesce(F.col("from"), F.lit("")) != "").where(F.coalesce(F.col("to"), F.lit("")) != "").select(F.col("from").alias("from_artifact"), F.col("to").alias("to_target"), F.col("type").alias("call_type")).distinct()


def executed_programs(edges: DataFrame) -> DataFrame:
    """(artifact_id): what jobs run."""
    return edges.where(F.col("type").isin("executes", "triggers")).select(F.col("dst").alias("artifact_id")).distinct()


def file_stats(lines: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(file_id, n_lines, n_artifacts, artifact_lines): counts of each file, from its lines."""
    n = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"))
    size = F.coalesce(F.col("line_end"), F.col("line_start")) - F.col("line_start") + 1
    held = artifacts.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_artifacts"), F.sum(size).cast("bigint").alias("artifact_lines"))
    return n.join(held, "file_id", "left").fillna(0, ["n_artifacts", "artifact_lines"])


def file_summary(files: DataFrame, artifacts: DataFrame, callouts: DataFrame) -> DataFrame:
    """(file_id, n_artifacts, entry_points, main_calls) of files (column file_id).

    Entry points are the first five programs, procedures and functions; but where a paragraph stands before any, it
    alone. Main calls are the first ten targets in order of artifacts' calls, executions and performs, and of the
    file's own calls and executions.
    """
    n = artifacts.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_artifacts"))
    may = artifacts.where(F.col("type").isin([*ENTRY_TYPES, "paragraph"])).withColumn("_p", F.row_number().over(Window.partitionBy("file_id").orderBy("line_start", "name")))
    first = may.where("_p = 1").select("file_id", (F.col("type") == "paragraph").alias("_alone"))
    entries = may.join(first, "file_id").where(F.when(F.col("_alone"), F.col("_p") == 1).otherwise(F.col("type") != "paragraph"))
    entries = first_values(entries, "file_id", "name", 5, ["_p"]).select("file_id", F.col("firsts").alias("entry_points"))
    main = callouts.where(F.col("relation").isin(MAIN_RELATIONS) & (F.col("artifact").isNotNull() | (F.col("relation") != "performs")))
    main = first_values(main, "file_id", "target", 10).select("file_id", F.col("firsts").alias("main_calls"))
    none = F.array().cast("array<string>")
    out = files.select("file_id").join(n, "file_id", "left").join(entries, "file_id", "left").join(main, "file_id", "left").fillna(0, ["n_artifacts"])
    return out.withColumns({"entry_points": F.coalesce("entry_points", none), "main_calls": F.coalesce("main_calls", none)})


def enriched(programs: DataFrame, docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """programs with the fields of their documentation where they have none themselves."""
    held = docs.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields]).dropDuplicates([key])
    joined = programs.join(held, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f) if f in programs.columns else F.lit(None), F.col(f"_d_{f}")) for f in fields}).drop(*[f"_d_{f}" for f in fields])


def program_categories(docs: DataFrame, most: int = 10) -> DataFrame:
    """(program_type, n, names): documents by type of program, UNKNOWN without one, with the first names."""
    typed = docs.withColumn("program_type", F.coalesce(F.nullif("program_type", F.lit("")), F.lit("UNKNOWN")))
    n = typed.groupBy("program_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(first_values(typed, "program_type", "name", most).select("program_type", F.col("firsts").alias("names")), "program_type")


def system_calls(edges: DataFrame, programs: DataFrame) -> DataFrame:
    """(name, kind, n_calls, n_called_by): all programs (column name) and what they call, from edges (src, dst): a
    program is an entry, a leaf, both or inner; what isn't one is dynamic, a system utility, from a library or missing."""
    e = edges.select(F.col("src").alias("caller"), F.regexp_replace(F.upper("dst"), "\\$+$", "").alias("callee")).distinct()
    out = e.groupBy(F.col("caller").alias("name")).agg(F.count(F.lit(1)).alias("n_calls"))
    into = e.groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("n_called_by"))
    own = programs.select("name").distinct().withColumn("own", F.lit(True))
    all_ = out.join(into, "name", "full").join(own, "name", "full").fillna(0, ["n_calls", "n_called_by"])
    inner = F.when((F.col("n_calls") == 0) & (F.col("n_called_by") == 0), "isolated").when(F.col("n_called_by") == 0, "entry").when(F.col("n_calls") == 0, "leaf").otherwise("inner")
    outer = F.when(F.col("name").rlike("\\([A-Z0-9-]+\\)"), "dynamic").otherwise(program_type(F.col("name")))
    return all_.select("name", F.when(F.col("own"), inner).otherwise(outer).alias("kind"), "n_calls", "n_called_by")
