"""Scalar text functions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Overheads of a prompt, in tokens.
SYSTEM_TOKENS, SCHEMA_TOKENS, INSTRUCTION_TOKENS = 2000, 1500, 500

#: Suffixes that names of records carry, in the order in which they are tried.
COMMON_SUFFIXES = ["-REC", "-RECORD", "-LAYOUT", "-CPY", "-COPY", "_REC", "_RECORD"]

#: File extensions that a slug loses, in the order in which they are stripped.
SLUG_EXTENSIONS = [".cbl", ".cob", ".cpy", ".jcl", ".prc", ".bms", ".ddl", ".sql", ".dc", ".md"]


def name_transform(name: Column, spec: str) -> Column:
    """One step of a name rule: upper, lower, remove_hyphens, hyphens_to_underscores, underscores_to_hyphens,
    remove_underscores, truncate_N, add_prefix:X, add_suffix:X, remove_prefix:X, remove_suffix:X, last_qualifier,
    remove_common_suffixes."""
    kind, _, value = spec.partition(":")
    if kind.startswith("truncate_"):
        return F.substring(name, 1, int(kind.rpartition("_")[2]))
    if kind == "remove_common_suffixes":
        hit = F.lit(None).cast("string")
        for s in reversed(COMMON_SUFFIXES):
            hit = F.when(name.endswith(s), F.expr(f"'{s}'")).otherwise(hit)
        return F.when(hit.isNull(), name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(hit)))
    plain = {
        "upper": lambda: F.upper(name),
        "lower": lambda: F.lower(name),
        "remove_hyphens": lambda: F.replace(name, F.lit("-"), F.lit("")),
        "remove_underscores": lambda: F.replace(name, F.lit("_"), F.lit("")),
        "hyphens_to_underscores": lambda: F.translate(name, "-", "_"),
        "underscores_to_hyphens": lambda: F.translate(name, "_", "-"),
        "last_qualifier": lambda: F.substring_index(name, ".", -1),
        "add_prefix": lambda: F.concat(F.lit(value), name),
        "add_suffix": lambda: F.concat(name, F.lit(value)),
        "remove_prefix": lambda: F.when(name.startswith(value), F.substring(name, len(value) + 1, 1 << 30)).otherwise(name),
        "remove_suffix": lambda: F.when(name.endswith(value), F.substring(name, F.lit(1), F.length(name) - len(value))).otherwise(name),
    }
    if kind not in plain:
        raise ValueError(f"unknown name transformation: {spec}")
    return plain[kind]()


def apply_transforms(name: Column, specs: list[str]) -> Column:
    return reduce(name_transform, specs, name)


def slug(name: Column, longest: int = 64) -> Column:
    """Known extensions off (each once, in order), lower case, _ and blanks to -, others dropped, - squeezed, cut."""
    out = F.lower(name)
    for e in SLUG_EXTENSIONS:
        out = F.regexp_replace(out, f"\\{e}$", "")
    out = F.regexp_replace(F.regexp_replace(out, "[_ ]", "-"), "[^a-z0-9-]", "")
    out = F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(out, 1, longest), "-$", "")


def slug_problem(name: Column, longest: int = 64) -> Column:
    """Why a slug isn't valid; null if it is."""
    return (
        F.when(name.isNull() | (name == ""), F.lit("empty"))
        .when(F.length(name) > longest, F.lit("too long"))
        .when(name.rlike("[^a-z0-9-]"), F.lit("bad character"))
        .when(name.rlike("^-|-$"), F.lit("hyphen at an end"))
        .when(name.contains("--"), F.lit("double hyphen"))
    )


def truncate_words(text: Column, most: int) -> Column:
    """Texts of more than most characters cut at the last blank before most - 3, with '...'."""
    head = F.substring(text, 1, most - 3)
    at_blank = F.regexp_extract(head, "(?s)^(.*) ", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(at_blank == "", head).otherwise(at_blank), F.lit("...")))


def is_cobol(text: Column) -> Column:
    upper = F.upper(text)
    return upper.contains("IDENTIFICATION DIVISION") | upper.contains("PROCEDURE DIVISION") | F.substring(F.trim(text), 1, 6).rlike("^[0-9]{6}$")


def token_estimate(text: Column) -> Column:
    """Characters over 4, or over 3.5 for COBOL, as a whole number; 0 for null."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(F.coalesce(is_cobol(text), F.lit(False)), F.floor(n / 3.5)).otherwise(F.floor(n / 4)).cast("bigint")


def available_tokens(source: Column, most: int, other: Column | None = None) -> Column:
    """What a prompt of most tokens leaves after its overheads and the source, at least 0."""
    used = F.lit(SYSTEM_TOKENS + SCHEMA_TOKENS + INSTRUCTION_TOKENS) + source + (F.lit(0) if other is None else other)
    return F.greatest(F.lit(0), F.lit(most) - used).cast("bigint")


def tokens(text: Column) -> Column:
    """Distinct words of letters, digits and _ in any script, lower case, by first place."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), 0))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), "_+", "_")


def dot_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def cypher_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def mermaid_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def mermaid_label(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit('"'), F.lit("'")), "[\\[\\]{}<>|]", " ")


def yaml_scalar(text: Column) -> Column:
    """Quoted where plain YAML would read it as something else."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when((text == "") | text.rlike("[:#\\[\\]{}&*!|>'\"%@`,\\n]|^[\\s?-]|\\s$"), quoted).otherwise(text)


def format_bytes(size: Column) -> Column:
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / 1024**power)).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return (
        F.when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60), F.lit("m "), s % 60, F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s % 3600 / 60), F.lit("m")))
    )


def looks_truncated(text: Column) -> Column:
    """A text that ends within a sentence, a list or a fenced block."""
    fences = F.size(F.split(text, "```", -1)) - 1
    return text.isNotNull() & (F.length(F.trim(text)) > 0) & ((fences % 2 == 1) | ~F.rtrim(text).rlike("[.!?:;)\\]}`\"'|>*_-]$"))


def is_meaningful(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def optional_int(text: Column) -> Column:
    """The first whole number in a text, or null."""
    return F.nullif(F.regexp_extract(text, "-?[0-9]+", 0), F.lit("")).try_cast("bigint")


def int_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), 0), lambda x: x.try_cast("bigint"))


def content_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("~", *parts), 256), 1, length)
