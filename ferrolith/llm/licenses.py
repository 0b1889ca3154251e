"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates
the and / or / with expressions that follow the tags."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.bytetext import Chunk
from ferrolith.llm.columns import with_text_columns

#: Phrases (as words, lower case) that count as base places, and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: More phrases and their labels.
NOTICE_PHRASES = {
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "isc license": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}

IDENTIFIER_TAG = "spdx license identifier"

#: How freely a work under a licence may be used, by the first part of its name; others count as UNKNOWN.
PERMISSIVENESS = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "0bsd": 1.0, "bsl": 1.0, "apache": 0.95, "unlicense": 1.0, "cc0": 1.0, "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.5
EXCEPTION_GAIN = 0.3

_WORD = np.ones(256, bool)
_WORD[:0x80] = False
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[~_WORD[_NORMAL]] = 0x20

_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
_TAG_END = re.compile(rb"[ \t:]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def permissiveness(name: str) -> float:
    """Of the licence, by the longest key that its name starts with."""
    name = name.lower()
    keys = [k for k in PERMISSIVENESS if name == k or name.startswith((k + "-", k + "+"))]
    return PERMISSIVENESS[max(keys, key=len)] if keys else UNKNOWN


def complete_prefix(tokens: Iterable[str]) -> tuple[list[str], int]:
    """Shunting-yard: the postfix of the longest prefix that parses, and how many tokens it has. with binds tighter than
    and, and than or; all associate to the left. Tokens are taken up to the first that fits nothing."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # one is due
    depth = size = 0
    whole: tuple[int, list[str]] = (0, [])  # of the longest: the length of out and what is still on the stack
    for n, token in enumerate(tokens, 1):
        word = token.lower()
        if token == "(":
            if not operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in _BINDS:
            if operand:
                break
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            operand = False
        if not operand and not depth:  # at most three operators are on the stack here
            size, whole = n, (len(out), stack[::-1])
    return out[: whole[0]] + whole[1], size


def to_postfix(tokens: list[str]) -> list[str] | None:
    """The postfix of all tokens, None if they don't parse."""
    postfix, size = complete_prefix(tokens)
    return postfix if size and size == len(tokens) else None


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """The licences named (lower case, without exceptions) and the permissiveness of the whole: the best choice of an
    or, the strictest part of an and; an exception adds EXCEPTION_GAIN."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(({token.lower()}, permissiveness(token)))
            continue
        (right, r), (left, value) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, min(1.0, value + EXCEPTION_GAIN)))
        else:
            left, right = (left, right) if len(left) >= len(right) else (right, left)
            left |= right
            stack.append((left, max(value, r) if token == "or" else min(value, r)))
    return stack[0]


def _tokens(text: bytes, at: int, stop: int) -> Iterator[str]:
    """The tokens from a place on; what is none, such as a line's end, ends them."""
    while m := _TOKEN.match(text, at, stop):
        yield m[1].decode("ascii")
        at = m.end()


def expression(text: bytes, at: int = 0, stop: int | None = None) -> tuple[set[str], float] | None:
    """The longest expression at a place in a text, within the line, that parses."""
    postfix, size = complete_prefix(_tokens(text, at, len(text) if stop is None else stop))
    return evaluate(postfix) if size else None


def scanner():
    """A function from a Chunk to the columns of scan()."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, label in [*BASE_PHRASES.items(), *NOTICE_PHRASES.items(), (IDENTIFIER_TAG, None)]:
        automaton.add_word(phrase, (len(phrase), phrase in BASE_PHRASES, label))
    automaton.make_automaton()

    def scan_chunk(chunk: Chunk) -> dict[str, object]:
        normal = _NORMAL[chunk.data]
        start, _, doc = chunk.runs(_WORD[normal])
        first_of_doc = np.searchsorted(doc, np.arange(chunk.n))
        space = normal == 0x20
        kept = np.ones(len(normal), bool)
        kept[1:] = ~(space[1:] & space[:-1])
        at = np.flatnonzero(kept)
        text = normal[at].tobytes().decode("latin-1")
        n = chunk.n
        base: list[list[int]] = [[] for _ in range(n)]
        base_labels: list[set[str]] = [set() for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        values: list[list[float]] = [[] for _ in range(n)]
        bounds = chunk.offsets
        raw = None  # the bytes of all texts, for expressions
        for end, (size, is_base, label) in automaton.iter(text):
            lo, hi = int(at[end - size + 1]), int(at[end]) + 1
            d = int(np.searchsorted(bounds, lo, side="right")) - 1
            stop = int(bounds[d + 1])
            if hi > stop or (lo > bounds[d] and normal[lo - 1] != 0x20) or (hi < stop and normal[hi] != 0x20):
                continue
            if label is None:
                raw = chunk.data.tobytes() if raw is None else raw
                if found := expression(raw, _TAG_END.match(raw, hi, stop).end(), stop):
                    labels[d] |= found[0]
                    values[d].append(found[1])
                continue
            labels[d].add(label)
            values[d].append(permissiveness(label))
            if is_base:
                base[d].append(int(np.searchsorted(start, lo)) - int(first_of_doc[d]))
                base_labels[d].add(label)
        return {
            "n_words": list(map(int, chunk.per_doc(doc))),
            "n_base": [len(x) for x in base],
            "first_word": [min(x, default=None) for x in base],
            "last_word": [max(x, default=None) for x in base],
            "base_labels": [",".join(sorted(x)) for x in base_labels],
            "labels": [",".join(sorted(x)) for x in labels],
            "score": [min(x, default=0.0) for x in values],
        }

    return scan_chunk


SCAN_COLUMNS = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs, or only the columns in keep, with SCAN_COLUMNS (replacing columns so named).

    Words are runs of digits, a-z (A-Z counts as a-z) and non-ASCII characters. n_base: places where the words of a
    base phrase stand consecutively; first_word, last_word: their smallest and largest start, null without any.
    labels: those of all phrases and the names in identifier expressions, distinct, sorted, joined by commas; empty
    without any. score: the permissiveness of all that was found together (the strictest), 0 without any. A null text
    counts as empty; repeated rows are scanned each for itself.
    """
    return with_text_columns(docs, scanner, SCAN_COLUMNS, keep)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), "text")
    return scan(docs, ["doc_id"])
