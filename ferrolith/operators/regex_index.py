"""Regex search over lines by an index of trigrams: what a pattern's matches must hold decides which files are read, and
those are searched with the pattern itself, so that no match is lost.

The index is built where texts are read: each partition's postings are sorted by trigram and written without a shuffle, so
a frequent trigram is in no one task, and a look-up skips row groups by their bounds. Letters A-Z are folded, others not.
"""

from __future__ import annotations

import re
import warnings
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators import lines as ln
from ferrolith.operators import patterns

GRAM = 3
#: How many strings a part of a pattern may stand for before the part is taken to stand for any.
MOST_STRINGS = 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Syntax that Python reads otherwise than Spark does: nested or combined classes, \v, Unicode folding.
OTHERWISE = re.compile(r"\[\^?\]?(?:[^\]\\]|\\.)*(?:\[|&&)|\\v|\(\?[a-zA-Z-]*[uU]")


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's lines, A-Z folded."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(f"(?=([^\\n]{{{GRAM}}}))"), 1))


def postings(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """(gram, key), sorted by gram within partitions; null and short texts have none. Write it before it is searched."""
    return files.select(F.explode(trigrams(F.col(content))).alias("gram"), key).sortWithinPartitions("gram")


def _of_strings(strings: frozenset[str]) -> tuple | None:
    """What a text that holds one of the strings must hold; None: nothing is known."""
    ways = []
    for s in sorted(strings):
        if len(s) < GRAM or "\n" in s:
            return None
        ways.append(("and", tuple(sorted({s[i : i + GRAM] for i in range(len(s) - GRAM + 1)}))))
    return ways[0] if len(ways) == 1 else ("or", tuple(ways))


def _both(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else ("and", (a, b))


def _either(parts: list) -> tuple | None:
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _sequence(nodes) -> tuple[frozenset[str] | None, tuple | None]:
    """The strings that a sequence stands for, if they are few, and what else its matches must hold."""
    strings, needs, whole = frozenset({""}), None, True
    for node in nodes:
        found, inner = _part(node)
        needs = _both(needs, inner)
        if found is not None and len(strings) * len(found) <= MOST_STRINGS:
            strings = frozenset(a + b for a, b in product(strings, found))
            continue
        needs, whole = _both(needs, _of_strings(strings)), False
        strings = found if found is not None else frozenset({""})
    return (strings, needs) if whole else (None, _both(needs, _of_strings(strings)))


def _part(node) -> tuple[frozenset[str] | None, tuple | None]:
    name, value = str(node[0]), node[1]
    one = lambda c: chr(c).translate(str.maketrans(UPPER, UPPER.lower()))
    if name == "LITERAL":
        return frozenset({one(value)}), None
    if name == "IN":
        chars = set()
        for kind, held in value:
            if str(kind) == "LITERAL":
                chars.add(one(held))
            elif str(kind) == "RANGE" and held[1] - held[0] < MOST_STRINGS:
                chars |= {one(c) for c in range(held[0], held[1] + 1)}
            else:
                return None, None
        return (frozenset(chars), None) if len(chars) <= MOST_STRINGS else (None, None)
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "ATOMIC_GROUP":
        return _sequence(value)
    if name == "BRANCH":
        ways = [_sequence(way) for way in value[1]]
        if all(found is not None and needs is None for found, needs in ways) and sum(len(found) for found, _ in ways) <= MOST_STRINGS:
            return frozenset().union(*[found for found, _ in ways]), None
        return None, _either([needs if found is None else _both(needs, _of_strings(found)) for found, needs in ways])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        found, needs = _sequence(inner)
        if int(least) == 0:
            return (found | {""}, None) if int(most) == 1 and found is not None and needs is None else (None, None)
        repeated = frozenset({""})
        for _ in range(min(int(least), GRAM) if found is not None else 0):
            if len(repeated) * len(found) > MOST_STRINGS:
                return None, needs
            repeated = frozenset(a + b for a, b in product(repeated, found))
        if found is not None and least == most and int(least) <= GRAM:
            return repeated, needs
        return None, _both(needs, _of_strings(repeated) if found is not None else None)
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return frozenset({""}), None
    return None, None


def needed(pattern: str) -> tuple | None:
    """What every line that matches a pattern holds, as a tree of ("and" | "or", parts) over folded trigrams; None if the
    pattern says nothing about that, or is of a syntax that isn't surely understood."""
    if OTHERWISE.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = re._parser.parse(pattern)
    except (re.error, Warning, OverflowError):
        return None
    strings, needs = _sequence(tree)
    return needs if strings is None else _both(needs, _of_strings(strings))


def grams_of(tree: tuple | str) -> set[str]:
    return {tree} if isinstance(tree, str) else set().union(*[grams_of(part) for part in tree[1]])


def holds(tree: tuple | str, grams: Column) -> Column:
    """Whether an array of trigrams holds what a tree asks for."""
    if isinstance(tree, str):
        return F.array_contains(grams, tree)
    out = None
    for part in tree[1]:
        inner = holds(part, grams)
        out = inner if out is None else (out & inner if tree[0] == "and" else out | inner)
    return out


def candidates(index: DataFrame, pattern: str, key: str = "file_id") -> DataFrame | None:
    """The keys whose files may hold a match; None if all may. Only the pattern's own trigrams leave the index, at most one
    row each a file."""
    tree = needed(pattern)
    if tree is None:
        return None
    held = index.where(F.col("gram").isin(sorted(grams_of(tree)))).groupBy(key).agg(F.collect_set("gram").alias("g"))
    return held.where(holds(tree, F.col("g"))).select(key)


def search(files: DataFrame, index: DataFrame, pattern: str, context: int = 3, names: str | None = None, most: int | None = None, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, line_no, text, context) of the lines that match a pattern, in the files whose key matches the regex names, if there
    is one; the first most of each file. The same rows as a scan of all files, as long as index is of these files."""
    read = files.select(key, content)
    if names is not None:
        read = read.where(F.col(key).cast("string").rlike(names))
    may = candidates(index, pattern, key)
    if may is not None:
        read = read.join(may, key, "left_semi")
    return patterns.context_lines(ln.explode_lines(read, key, content), pattern, context, key, most).select(key, "line_no", "text", "context")


def report(files: DataFrame, index: DataFrame, asked: list[str], key: str = "file_id", content: str = "content") -> DataFrame:
    """(pattern, n_files, n_read, n_found): of each pattern how many files there are, were candidates, and hold a match."""
    rows = None
    for pattern in asked:
        may = candidates(index, pattern, key)
        every = files.select(key, content).withColumn("_read", F.lit(True)) if may is None else files.select(key, content).join(may.distinct().withColumn("_read", F.lit(True)), key, "left")
        is_read = F.coalesce("_read", F.lit(False))
        found = is_read & F.exists(F.split(F.coalesce(content, F.lit("")), "\n"), lambda t: t.rlike(pattern))
        row = every.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(is_read).alias("n_read"), F.count_if(found).alias("n_found")).select(F.lit(pattern).alias("pattern"), "n_files", "n_read", "n_found")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def find_files(files: DataFrame, names: DataFrame, extensions: list[str], deepest: int = 1) -> DataFrame:
    """(name, path): for each name the file (path, relative) whose stem is it, in any case: first by the place of its extension
    in extensions (lower case, "" for none), then by the same case, then by depth, which is at most deepest, then by path.
    Names without such a file have no row."""
    base = F.regexp_extract("path", "([^/]+)$", 1)
    ending = F.lower(F.regexp_extract(base, r"[^.](\.[^.]*)$", 1))
    stem = F.substr(base, F.lit(1), F.length(base) - F.length(ending))
    place = F.array_position(F.array(*[F.lit(e) for e in extensions]), ending)
    known = files.select("path", stem.alias("_stem"), place.alias("_place"), (F.size(F.split("path", "/")) - 1).alias("_depth")).where((F.col("_place") > 0) & (F.col("_depth") <= deepest))
    asked = names.select("name").where("name is not null").distinct()
    met = asked.join(known, F.upper("name") == F.upper("_stem"))
    best = F.row_number().over(Window.partitionBy("name").orderBy("_place", (F.col("_stem") != F.col("name")), "_depth", "path"))
    return met.withColumn("_k", best).where("_k = 1").select("name", "path")
