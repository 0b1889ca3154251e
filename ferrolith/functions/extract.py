"""What single texts hold, as column expressions: questions, diagrams, JSON, references, names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First words of diagrams.
DIAGRAM_TYPES = [
    "graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "stateDiagram-v2", "erDiagram", "journey", "gantt", "pie", "gitGraph", "mindmap", "timeline",
    "sankey", "block-beta", "xychart-beta", "quadrantChart", "requirementDiagram", "C4Context", "C4Container", "C4Component", "C4Deployment", "packet-beta", "kanban", "architecture-beta",
]

#: What a failed connection's message holds.
CONNECTION_WORDS = [
    "connection error", "connection refused", "connection reset", "connection timed out", "connect timeout", "connection aborted", "name resolution", "name or service not known",
    "no route to host", "network is unreachable", "timed out", "timeout", "eof occurred", "broken pipe", "ssl", "certificate",
]


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, "\\A\\s+|\\s+\\z", "")


def columns_in(text: Column, pattern: str, group: int = 1) -> Column:
    """The columns that a match names: all finds of the pattern's group, upper case, distinct, by place."""
    return F.array_distinct(F.transform(_all(text, pattern, group), F.upper))


def unmasked(text: Column, masked: Column) -> Column:
    """text with each placeholder __STR_n__ replaced by element n (from 0) of masked, one occurrence each."""
    step = lambda done, k: F.when(
        F.instr(done, F.concat(F.lit("__STR_"), k.cast("string"), F.lit("__"))) > 0,
        F.concat(
            F.split_part(done, F.concat(F.lit("__STR_"), k.cast("string"), F.lit("__")), F.lit(1)), F.get(masked, k),
            F.substring(done, F.instr(done, F.concat(F.lit("__STR_"), k.cast("string"), F.lit("__"))) + F.length(F.concat(F.lit("__STR_"), k.cast("string"), F.lit("__"))), F.length(done)),
        ),
    ).otherwise(done)
    return F.when(F.size(masked) > 0, F.aggregate(F.sequence(F.lit(0), F.size(masked) - 1), text, step)).otherwise(text)


#: Patterns of control statements that must match alike for equal references.
DATA_SET_PATTERNS = [r"(?i)DSN=([A-Z0-9@#$.]+)", r"(?i)DSN='([A-Z0-9@#$.()+-]+)'"]
DD_NAME_PATTERNS = [r"(?i)INFILE\(([A-Z0-9@#$]+)\)", r"(?i)OUTFILE\(([A-Z0-9@#$]+)\)"]
TABLE_PATTERNS = [r"(?i)FROM\s+([A-Z0-9_]+\.[A-Z0-9_]+)", r"(?i)INTO\s+([A-Z0-9_]+\.[A-Z0-9_]+)"]


def data_references(text: Column) -> Column:
    """The data sets and DD names that control statements name, distinct, sorted."""
    sets = F.concat(*[_all(text, p, 1) for p in DATA_SET_PATTERNS])
    dd = F.transform(F.concat(*[_all(text, p, 1) for p in DD_NAME_PATTERNS]), lambda x: F.concat(F.lit("DD:"), x))
    return F.array_sort(F.array_distinct(F.concat(sets, dd)))


def table_references(text: Column) -> Column:
    """The qualified tables after FROM and INTO, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[_all(text, p, 1) for p in TABLE_PATTERNS])))


def definition_kind(line: Column, name: Column, templates: list[tuple[str, str]]) -> Column:
    """The kind of the first template (kind, pattern with {name}) by which a line defines a name, whatever the case."""
    quoted = F.concat(F.lit("\\Q"), name, F.lit("\\E"))
    out = F.lit(None).cast("string")
    for kind, template in reversed(templates):
        before, _, after = template.partition("{name}")
        out = F.when(F.rlike(line, F.concat(F.lit("(?i)" + before), quoted, F.lit(after))), kind).otherwise(out)
    return out


#: Fixed value: what counts as the name of a field.
FIELD_PATTERN = r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+\b"


def target_fields(*texts: Column, most: int = 8) -> Column:
    """Upper-case names with hyphens, of at least four characters, by first place; the first most of them."""
    text = F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in texts])
    return F.slice(F.array_distinct(F.filter(_all(text, FIELD_PATTERN), lambda x: F.length(x) >= 4)), 1, most)


def variable_names(text: Column, reserved: list[str]) -> Column:
    """Names of data, upper case, by first place: not reserved, not all digits, and not one of the letters A P S V X."""
    found = F.transform(_all(text, r"[A-Za-z0-9][A-Za-z0-9_-]*"), F.upper)
    fit = F.filter(found, lambda x: x.rlike("[A-Z]") & ~x.rlike("-$") & ~x.isin(["X", "A", "V", "S", "P"]))
    return F.array_except(F.array_distinct(fit), F.array(*[F.lit(r.upper()) for r in reserved]))


def diagrams(markdown: Column) -> Column:
    """An array of (body, valid) of fenced diagrams; valid if the first line that isn't blank or %% begins with a type."""

    def checked(body: Column) -> Column:
        lines = F.filter(F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("%%"))
        word = F.split_part(F.regexp_replace(F.get(lines, 0), "\\s", " "), F.lit(" "), F.lit(1))
        return F.struct(body.alias("body"), F.coalesce(word.isin(DIAGRAM_TYPES), F.lit(False)).alias("valid"))

    return F.transform(_all(markdown, "(?s)```mermaid[ \\t]*\\r?\\n(.*?)```", 1), checked)


def without_bad_diagrams(markdown: Column, instead: str = "*diagram left out*") -> Column:
    """markdown with each fenced diagram whose first word is no type replaced."""
    types = "|".join("\\Q" + t + "\\E" for t in DIAGRAM_TYPES)
    bad = f"(?s)```mermaid[ \\t]*\\r?\\n(?!(?:[ \\t]*(?:%%[^\\n]*)?\\n)*[ \\t]*(?:{types})(?:\\s|```))(?:(?!```).)*```"
    return F.regexp_replace(markdown, bad, instead)


def inline_questions(markdown: Column, marker: str = "❓\\s*QUESTION:\\s*") -> Column:
    """An array of (question_id, context, question): what follows a marker up to the line's end, under the last heading
    before it, General without."""
    heading = "^#{1,6}\\s+(.+?)\\s*$"
    lines = F.transform(F.split(markdown, "\n"), lambda x: F.struct(F.nullif(F.regexp_extract(x, heading, 1), F.lit("")).alias("h"), F.nullif(F.trim(F.regexp_extract(x, marker + "(.+)$", 1)), F.lit("")).alias("q")))
    start = F.struct(F.lit("General").alias("h"), F.array().cast("array<struct<question_id:string,context:string,question:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        number = F.concat(F.lit("Q"), F.lpad((F.size(s["out"]) + 1).cast("string"), 3, "0"))
        one = F.struct(number.alias("question_id"), s["h"].alias("context"), x["q"].alias("question"))
        return F.struct(F.coalesce(x["h"], s["h"]).alias("h"), F.when(x["q"].isNotNull(), F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda s: s["out"])


def json_in(text: Column) -> Column:
    """The JSON object or array in a text around it: fenced, or from the first bracket to the last of its kind; null if
    that doesn't parse."""
    fenced = F.nullif(F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1), F.lit(""))
    body = F.trim(F.coalesce(fenced, text))
    thing = F.coalesce(F.nullif(F.regexp_extract(body, "(?s)^[^\\[{]*(\\{.*\\})", 1), F.lit("")), F.nullif(F.regexp_extract(body, "(?s)^[^\\[{]*(\\[.*\\])", 1), F.lit("")))
    return F.when(F.try_parse_json(thing).isNotNull(), thing)


def path_get(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null if there is none."""
    return F.get_json_object(json, "$." + path)


def parsed_time(text: Column) -> Column:
    """ISO times with or without T, fractions and zone; null for others."""
    plain = F.regexp_replace(text, "Z$", "+00:00")
    return F.when(plain.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,9})?)?([+-]\\d{2}:?\\d{2})?)?$"), F.try_to_timestamp(plain))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def labels(pairs: dict[str, Column]) -> Column:
    """key:value for each value that isn't null or empty."""
    return F.array_compact(F.array(*[F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(k + ":"), v.cast("string"))) for k, v in pairs.items()]))


def label_value(labelled: Column, key: str) -> Column:
    """The value of the last label of a key; it may hold colons itself."""
    mine = F.filter(labelled, lambda x: x.startswith(key + ":"))
    return F.substring(F.try_element_at(mine, F.lit(-1)), len(key) + 2, 1 << 30)


def capped_cells(markdown: Column, most: int = 200) -> Column:
    """Cells of table lines (those that begin with |) of more than most characters cut, with '...'."""

    def line(x: Column) -> Column:
        cells = F.transform(F.split(x, "\\|", -1), lambda c: F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c))
        return F.when(F.ltrim(x).startswith("|"), F.array_join(cells, "|")).otherwise(x)

    return F.array_join(F.transform(F.split(markdown, "\n", -1), line), "\n")


def is_auth_error(kind: Column, status: Column, message: Column) -> Column:
    return F.coalesce(status == 401, F.lit(False)) | F.coalesce(kind.contains("AuthenticationError"), F.lit(False)) | F.coalesce(message.contains("401"), F.lit(False))


#: Names of errors that count as lost connections.
CONNECTION_ERRORS = ["connectionerror", "connecttimeout", "timeout", "timeouterror", "connecterror", "apierror", "apiconnectionerror", "remotedisconnected", "readtimeout", "socketerror", "sslerror"]


def is_connection_error(kind: Column, message: Column) -> Column:
    return F.coalesce(F.lower(kind).isin(CONNECTION_ERRORS), F.lit(False)) | F.coalesce(F.lower(message).rlike("|".join(CONNECTION_WORDS)), F.lit(False))


def field_kind(level: Column, picture: Column) -> Column:
    """condition (level 88), elementary (with a picture) or group."""
    return F.when(level == 88, "condition").when(F.coalesce(picture, F.lit("")) != "", "elementary").otherwise("group")


def section_text(markdown: Column, heading: str) -> Column:
    """What stands under a heading of any level up to the next one of any, trimmed; null if the heading is missing."""
    return F.nullif(_strip(F.regexp_extract(markdown, f"(?ism)^#+\\s+[^\\n]*{heading}[^\\n]*\\n(.*?)(?=^#|\\z)", 1)), F.lit(""))


def first_paragraphs(text: Column, most: int = 3) -> Column:
    parts = F.filter(F.transform(F.split(text, "\n\\s*\n"), _strip), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, most), "\n\n")


def markdown_summary(markdown: Column) -> Column:
    """(title, paragraph): the first heading of level one, and the first paragraph that is no code, badge, list, quote,
    rule, table, heading or front matter."""
    body = F.regexp_replace(F.regexp_replace(markdown, "(?s)\\A---\\n.*?\\n---\\n", ""), "(?s)```.*?(```|\\z)", "")
    title = F.nullif(F.trim(F.regexp_extract(body, "(?m)^# +(.+)$", 1)), F.lit(""))
    fit = F.filter(F.transform(F.split(body, "\n\\s*\n"), _strip), lambda x: (x != "") & ~x.rlike("^(#|\\[?!\\[|[-*+] |[0-9]+\\. |>|\\||---|\\*\\*\\*|___)"))
    return F.struct(title.alias("title"), F.regexp_replace(F.get(fit, 0), "\\s+", " ").alias("paragraph"))


def numbered(items: Column, prefix: str) -> Column:
    """items (structs with id and text) with the ids that are missing given by place: R1, R2 and so on."""
    return F.transform(items, lambda x, i: F.struct(F.coalesce(F.nullif(x["id"], F.lit("")), F.concat(F.lit(prefix), (i + 1).cast("string"))).alias("id"), x["text"].alias("text")))


def numbered_lines(text: Column, most: int) -> Column:
    """The first most lines, each with its number, for a reader; what is left out is said in a last line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    shown = F.transform(F.slice(lines, 1, most), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 6, " "), F.lit("  "), x))
    rest = F.size(lines) - most
    return F.array_join(F.when(rest > 0, F.concat(shown, F.array(F.concat(F.lit("... "), rest.cast("string"), F.lit(" more lines"))))).otherwise(shown), "\n")


def relevance_hints(text: Column, stop: list[str]) -> Column:
    """(lines, ranges, identifiers) that a question names: line numbers after line, pairs of them, and upper-case names
    but those in stop; each distinct and sorted."""
    pairs = F.array_sort(F.array_distinct(_all(text, "(?i)lines?\\s+(\\d+\\s*(?:-|to)\\s*\\d+)", 1)))
    numbers = F.array_sort(F.array_distinct(F.transform(_all(text, "(?i)lines?\\s+(\\d+)", 1), lambda x: x.try_cast("bigint"))))
    names = F.array_sort(F.array_except(F.array_distinct(_all(text, "\\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*\\b")), F.array(*[F.lit(s) for s in stop])))
    return F.struct(numbers.alias("lines"), pairs.alias("ranges"), F.filter(names, lambda x: F.length(x) >= 3).alias("identifiers"))
