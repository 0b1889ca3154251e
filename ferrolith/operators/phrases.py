"""Rules for statements as data: a rule is a phrase of COBOL words, kept in specification files, compiled to an expression
and tried only on statements that hold its letters.

A phrase is words between blanks: a word stands for itself in any case, (A|B) for one of several, @ for an operand, ~A for a
name that ends with -A, !A for no such word here (before @), .. for anything up to what follows, = for itself. A phrase that
begins with + is tried on a statement together with the next one of its sentence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolith.functions.json_schema import elements, member
from ferrolith.operators import lines as ln
from ferrolith.operators import regex_index, statements
from ferrolith.operators.patterns import Rule
from ferrolith.sources import documents

OPERAND = r"([^\s,;=]+)"
AHEAD, BEHIND = "(?![A-Za-z0-9-])", "(?<![A-Za-z0-9-])"

#: What a specification file must be.
SPECIFICATION = {
    "type": "object",
    "required": ["spec_id", "phrases"],
    "properties": {
        "spec_id": {"type": "string", "pattern": "^[a-z0-9_-]+$"},
        "extensions": {"type": "array", "items": {"type": "string", "minLength": 1}},
        "phrases": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["category", "name", "phrase"],
                "properties": {"category": {"type": "string", "minLength": 1}, "name": {"type": "string", "minLength": 1}, "phrase": {"type": "string", "minLength": 1}, "required": {"type": "boolean"}},
                "additionalProperties": False,
            },
        },
    },
}

#: Fixed values, the names of the analysis rules for COBOL and what each is about: their results are told apart by them.
COBOL_PHRASES = {
    "data_flow": {
        "move_simple": "MOVE @ TO @", "move_corresponding": "MOVE (CORRESPONDING|CORR) @ TO @", "compute": "COMPUTE @ .. =", "set_statement": "SET @ TO @", "initialize": "INITIALIZE @", "string_statement": "STRING .. INTO @",
        "unstring_statement": "UNSTRING @ .. INTO @", "add_statement": "ADD .. (TO|GIVING) @", "subtract_statement": "SUBTRACT .. FROM @", "multiply_statement": "MULTIPLY .. (BY|GIVING) @", "divide_statement": "DIVIDE .. (INTO|GIVING) @",
    },
    "control_flow": {
        "if_then": "IF @", "if_perform": "+IF .. PERFORM @", "evaluate_when": "EVALUATE @", "when_clause": "WHEN !OTHER @", "perform_until": "PERFORM .. UNTIL @", "perform_varying": "PERFORM .. VARYING @",
        "perform_times": "PERFORM .. @ TIMES", "perform_thru": "PERFORM @ (THRU|THROUGH) @", "go_to": "GO TO @", "go_to_depending": "GO TO .. DEPENDING ON @",
    },
    "error_handling": {
        "on_exception": "ON EXCEPTION", "not_on_exception": "NOT ON EXCEPTION", "file_status_check": "IF ~(STATUS|STAT) (=|NOT|EQUAL)", "invalid_key": "INVALID KEY", "not_invalid_key": "NOT INVALID KEY", "at_end": "AT END",
        "not_at_end": "NOT AT END", "on_size_error": "ON SIZE ERROR", "not_on_size_error": "NOT ON SIZE ERROR", "on_overflow": "ON OVERFLOW", "sqlcode_check": "IF SQLCODE (=|NOT|<|>|EQUAL)", "resp_check": "IF (EIBRESP|WS-RESP) (=|NOT|EQUAL)",
    },
}


def compiled(phrase: str) -> str:
    """The expression of a phrase, without its +; groups are its operands."""
    out, gap, first = "(?is)", False, True
    for word in phrase.removeprefix("+").split():
        if word == "..":
            gap = True
            continue
        between = r"\s*" if word == "=" else r"\s+"
        if gap:
            between = r"(?:\s.*?)?" + between
        out += "" if first else between
        if word == "=":
            out += "="
        elif word == "@":
            out += OPERAND
        elif word.startswith("!"):
            out += f"(?!{re.escape(word[1:])}{AHEAD})"
        else:
            ways = "|".join(map(re.escape, word.removeprefix("~").strip("()").split("|")))
            out += BEHIND + ("[A-Za-z0-9-]*-" if word.startswith("~") else "") + f"(?:{ways}){AHEAD}"
        # what a ! forbids stands where the next word begins
        gap, first = False, word.startswith("!")
    return out


def specification(spec_id: str, phrases: dict[str, dict[str, str]], extensions: list[str] = (), required: list[str] = ()) -> dict:
    """A specification as it stands in a file."""
    rows = [{"category": c, "name": n, "phrase": p, "required": n in required} for c, named in phrases.items() for n, p in named.items()]
    return {"spec_id": spec_id, "extensions": list(extensions), "phrases": rows}


def json_of(text: Column, file_id: Column) -> Column:
    """The JSON of a text, which of files named .yaml or .yml is YAML (null if it is broken), if its library is there."""

    @F.pandas_udf("string")
    def converted(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(yaml.safe_load(t), default=str)
            except yaml.YAMLError:
                return None

        return texts.map(one)

    return F.when(file_id.rlike(r"(?i)\.ya?ml$"), converted(text)).otherwise(text)


def scan_specifications(spark: SparkSession, roots: list[str], glob: str = "*.{json,yaml,yml}") -> tuple[DataFrame, DataFrame]:
    """(spec_id, version, file_id, extensions, value) of the specifications below roots, and (file_id, path, problem) of files
    that are none. Of files of one spec_id the one of the first root counts, there the first by name. version is a hash of
    the content, whatever its order and layout."""
    files = None
    for rank, root in enumerate(roots):
        found = documents.scan_values(spark, root, glob).withColumn("rank", F.lit(rank))
        files = found if files is None else files.unionByName(found)
    seen = documents.checked(files.withColumn("text", json_of(F.col("text"), F.col("file_id"))), SPECIFICATION)
    bad = seen.select("file_id", F.explode("problems").alias("p")).select("file_id", "p.path", "p.problem")
    good = seen.where(F.size("problems") == 0).select("file_id", "rank", "value", F.variant_get("value", "$.spec_id", "string").alias("spec_id"))
    first = F.row_number().over(Window.partitionBy("spec_id").orderBy("rank", "file_id"))
    ends = F.transform(elements(member(F.col("value"), "extensions")), lambda e: F.concat(F.lit("."), F.ltrim(F.lower(e.cast("string")), F.lit("."))))
    kept = good.withColumn("_k", first).where("_k = 1")
    return kept.select("spec_id", F.substring(F.sha2(F.to_json("value"), 256), 1, 16).alias("version"), "file_id", F.coalesce(ends, F.array().cast("array<string>")).alias("extensions"), "value"), bad


def rules_of(specifications: DataFrame, spec_id: str) -> list[Rule]:
    """The rules of a specification in their order. They come to the driver to be compiled; a file holds them all."""
    rows = specifications.where(F.col("spec_id") == spec_id).select(F.posexplode(elements(member(F.col("value"), "phrases"))).alias("at", "p"))
    part = lambda name, kind="string": F.variant_get("p", f"$.{name}", kind).alias(name)
    found = rows.select("at", part("category"), part("name"), part("phrase"), part("required", "boolean")).orderBy("at").collect()
    return [Rule(r.category, r.name, ("+" if r.phrase.startswith("+") else "") + compiled(r.phrase), required=bool(r.required)) for r in found]


def may_hold(low: Column, regex: str) -> Column | None:
    """Whether a folded text may match, by the letters that a match must hold; None if that is always so."""

    def tree(part: tuple | str) -> Column:
        if isinstance(part, str):
            return low.contains(part)
        out = tree(part[1][0])
        for other in part[1][1:]:
            out = out & tree(other) if part[0] == "and" else out | tree(other)
        return out

    need = regex_index.needed(regex)
    return None if need is None else tree(need)


def same_in_python(regex: str) -> bool:
    """Whether Python surely reads an expression as Spark does, as it does those of compiled() with ASCII classes."""
    escapes = re.findall(r"(?s)\\(.)", regex)
    if not regex.startswith("(?is)") or regex_index.OTHERWISE.search(regex) or "$" in regex or any(c.isalnum() and c not in "sSdDwW" for c in escapes):
        return False
    try:
        re.compile(regex, re.A)
    except re.error:
        return False
    return True


def _counter(rules: list[Rule]) -> Callable[[str, str], list[int]]:
    """How often each rule matches, from a statement and what it is with the next one."""
    parts = [(r.regex.startswith("+"), r.regex.removeprefix("+")) for r in rules]
    asked = [(two, re.compile(regex, re.A), regex_index.needed(regex)) for two, regex in parts]
    fold = str.maketrans(regex_index.UPPER, regex_index.UPPER.lower())

    def holds(low: str, part: tuple | str) -> bool:
        if isinstance(part, str):
            return part in low
        return (all if part[0] == "and" else any)(holds(low, p) for p in part[1])

    def counts(text: str, both: str) -> list[int]:
        low, low_both = text.translate(fold), both.translate(fold)
        return [sum(1 for _ in regex.finditer(both if two else text)) if need is None or holds(low_both if two else low, need) else 0 for two, regex, need in asked]

    return counts


_LITERAL = re.compile("'[^']*'|\"[^\"]*\"")


def _bare(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, str, str]]:
    """Statements in whole files without the insides of literals: number of the file in the batch, paragraph, line_start, text,
    and the text with that of the next one of its sentence."""
    known: dict[str, str] = {}
    last = None
    for file, paragraph, begin, line_no, _, text, ended in statements.statements_in(batch):
        bare = known.get(text)
        if bare is None:
            bare = known[text] = _LITERAL.sub("''", text)
        if last is not None:
            yield *last[1], last[1][3] if last[2] or last[0] != (file, begin) else f"{last[1][3]} {bare}"
        last = (file, begin), (file, paragraph, line_no, bare), ended
    if last is not None:
        yield *last[1], last[1][3]


def _in_files(source: DataFrame, schema: T.StructType, rows: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """What rows makes of the lines of whole files: number of the file in the batch first, which becomes file_id."""

    def run(batches):
        for batch in ln.whole_files(batches):
            files = batch.column("file_id").take(pa.array(np.flatnonzero(batch.column("_n").to_numpy() == 1)))
            owner, *columns = rows(batch)
            yield pa.RecordBatch.from_arrays([files.take(owner), *columns], names=schema.names)

    kept = source.where("line_no is not null").select("file_id", F.col("line_no").cast("bigint").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"))
    return ln.filed(kept).mapInArrow(run, schema)


def _schema(source: DataFrame, columns: str) -> T.StructType:
    return T.StructType([source.schema["file_id"], *T._parse_datatype_string(columns)])


def phrase_matches(source: DataFrame, rules: list[Rule]) -> DataFrame:
    """(file_id, paragraph, line_no, category, name, found): a row for each match of a rule in a statement of the procedure
    division; line_no is where the statement begins, found its text without the insides of literals.

    Files go whole to Python, where equal statements are searched once a batch. Rules that Python may read otherwise are
    searched by Spark instead."""
    regular = all(same_in_python(r.regex.removeprefix("+")) for r in rules)
    columns = "paragraph string, line_no bigint, " + ("category string, name string, found string" if regular else "text string, _two string")
    numbers, labels = (pa.int64(), pa.string())

    def matches(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, known, rows = _counter(rules), {}, []
        for file, paragraph, line_no, text, both in _bare(batch):
            hits = known.get((text, both))
            if hits is None:
                hits = known[text, both] = [k for k, n in enumerate(counts(text, both)) for _ in range(n)]
            rows += [(file, paragraph, line_no, k, text) for k in hits]
        file, paragraph, line_no, rule, text = zip(*rows) if rows else [()] * 5
        rule = pa.array(rule, numbers)
        named = [pa.array([getattr(r, c) for r in rules], labels).take(rule) for c in ("category", "name")]
        return [pa.array(file, numbers), pa.array(paragraph, labels), pa.array(line_no, numbers), *named, pa.array(text, labels)]

    def stated(batch: pa.RecordBatch) -> list[pa.Array]:
        found = list(zip(*_bare(batch))) or [()] * 5
        return [pa.array(x, kind) for x, kind in zip(found, (numbers, labels, numbers, labels, labels))]

    kind = source.schema["line_no"].dataType
    rows = _in_files(source, _schema(source, columns), matches if regular else stated).withColumn("line_no", F.col("line_no").cast(kind))
    if regular:
        return rows
    rows = rows.withColumns({"_low": regex_index.folded(F.col("text")), "_low_two": regex_index.folded(F.col("_two"))})
    found = []
    for r in rules:
        text, low, regex = ("_two", "_low_two", r.regex[1:]) if r.regex.startswith("+") else ("text", "_low", r.regex)
        may = may_hold(F.col(low), regex)
        n = F.regexp_count(text, F.lit(regex))
        count = n if may is None else F.when(may, n).otherwise(0)
        found.append(F.array_repeat(F.struct(F.lit(r.category).alias("category"), F.lit(r.name).alias("name")), count))
    each = rows.select("file_id", "paragraph", "line_no", F.explode(F.concat(*found)).alias("m"), F.col("text").alias("found"))
    return each.select("file_id", "paragraph", "line_no", "m.category", "m.name", "found")


def phrase_counts(source: DataFrame, rules: list[Rule]) -> DataFrame:
    """(file_id, counts) of every file: how often each rule, in order, matches in its statements, as rows for
    patterns.coverage_of() and required_without_count()."""
    if not all(same_in_python(r.regex.removeprefix("+")) for r in rules):
        hit = lambda r: F.when((F.col("category") == r.category) & (F.col("name") == r.name), 1).otherwise(0).cast("bigint")
        found = phrase_matches(source, rules).select("file_id", *[hit(r).alias(f"r{i}") for i, r in enumerate(rules)])
        every = found.unionByName(source.where("line_no is not null").select("file_id", *[F.lit(0).cast("bigint").alias(f"r{i}") for i in range(len(rules))]))
        return every.groupBy("file_id").agg(F.array(*[F.sum(f"r{i}") for i in range(len(rules))]).alias("counts"))

    def counted(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, known = _counter(rules), {}
        n = int((batch.column("_n").to_numpy() == 1).sum())
        sums = np.zeros((n, len(rules)), np.int64)
        for file, _, _, text, both in _bare(batch):
            hits = known.get((text, both))
            if hits is None:
                hits = known[text, both] = [(k, c) for k, c in enumerate(counts(text, both)) if c]
            for k, c in hits:
                sums[file, k] += c
        offsets = pa.array(np.arange(n + 1) * len(rules), pa.int32())
        return [pa.array(np.arange(n)), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))]

    return _in_files(source, _schema(source, "counts array<bigint>"), counted)
