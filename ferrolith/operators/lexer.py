"""A lexer of comments and quoted strings, and maps from cleaned text back to its source.

A syntax becomes a finite automaton over bytes. It runs over all texts of a batch at once: texts are cut into blocks, a
step takes the same place of every block and every state that the block may begin in, the states in which blocks really
begin follow from block to block, and a second pass gives the state after each byte. So no step is taken per byte of a
text, and a text of any length is lexed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
#: Bytes of texts that are lexed together; a longer text is lexed alone.
BATCH_BYTES = 1 << 21


@dataclass(frozen=True)
class Syntax:
    """Delimiters of strings (one character each), whether three of them open a long string, the escape character or
    none, whether a doubled delimiter stands for one, what begins comments that end with the line, and pairs that
    comments stand between. All ASCII. Strings may go over lines; one that nothing ends goes to the end of the text."""

    strings: tuple[str, ...] = ('"', "'")
    triple: bool = False
    escape: str = ""
    doubled: bool = True
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()


def _overlap(text: str, ends: list[str]) -> str:
    """The longest end of text that some of ends begins with."""
    return next((text[k:] for k in range(len(text)) if any(e.startswith(text[k:]) for e in ends)), "")


def _step(syntax: Syntax, state: tuple, c: str) -> tuple:
    kind = state[0]
    if kind == "code":
        if c in syntax.strings:
            return ("open", c)
        seen = state[1] + c
        for opener in sorted([*syntax.line, *[b for b, _ in syntax.block]], key=len, reverse=True):
            if seen.endswith(opener):
                return ("line", len(opener)) if opener in syntax.line else ("block", len(opener), next(e for b, e in syntax.block if b == opener), "")
        return ("code", _overlap(seen, [*syntax.line, *[b for b, _ in syntax.block]]))
    if kind == "line":
        return ("code", "") if c == "\n" else state
    if kind == "block":
        seen = state[3] + c
        return ("code", "") if seen.endswith(state[2]) else (*state[:3], _overlap(seen, [state[2]]))
    d = state[1]
    if kind in ("escaped", "long escaped"):
        return ("string", d) if kind == "escaped" else ("long", d, 0)
    if kind == "long":
        if c == syntax.escape:
            return ("long escaped", d)
        return ("long", d, 0) if c != d else ("code", "") if state[2] == 2 else ("long", d, state[2] + 1)
    if kind in ("end", "empty"):
        if c == d and kind == "empty" and syntax.triple:
            return ("long", d, 0)
        return ("string", d) if c == d and syntax.doubled else _step(syntax, ("code", ""), c)
    if c == syntax.escape:
        return ("escaped", d)
    return ("string", d) if c != d else ("empty", d) if kind == "open" else ("end", d)


@lru_cache(maxsize=64)
def automaton(syntax: Syntax) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The states, the class of each byte (class 0: none, which changes nothing), and the next state by state and class."""
    letters = sorted({*syntax.strings, *syntax.escape, "\n", *"".join(syntax.line), *"".join(b + e for b, e in syntax.block)})
    classes = np.ones(257, np.uint8)
    classes[256] = 0
    for k, c in enumerate(letters):
        classes[ord(c)] = k + 2
    states, table = [("code", "")], []
    for state in states:  # grows as states are found
        row = [state] + [_step(syntax, state, c) for c in ["\x00", *letters]]
        for s in row:
            if s not in states:
                states.append(s)
        table.append(row)
    return states, classes, np.array([[states.index(s) for s in row] for row in table], np.uint8)


def states_of(syntax: Syntax, texts: list[bytes]) -> list[np.ndarray]:
    """For each text the number of the state after each byte."""
    states, classes, table = automaton(syntax)
    blocks = np.array([-(-len(t) // BLOCK) for t in texts])
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.full(int(first[-1]) * BLOCK, 256, np.int16)
    for t, at in zip(texts, first):
        padded[at * BLOCK : at * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    kind = classes[padded].reshape(-1, BLOCK)
    ends = np.repeat(np.arange(len(states), dtype=np.uint8)[None], len(kind), 0)
    for k in range(BLOCK):
        ends = table[ends, kind[:, k : k + 1]]
    begin = np.zeros(len(kind), np.uint8)
    for k in range(1, int(blocks.max(initial=0))):
        at = first[:-1][blocks > k] + k
        begin[at] = ends[at - 1, begin[at - 1]]
    out = np.empty(kind.shape, np.uint8)
    for k in range(BLOCK):
        begin = table[begin, kind[:, k]]
        out[:, k] = begin
    flat = out.reshape(-1)
    return [flat[a * BLOCK : a * BLOCK + len(t)] for t, a in zip(texts, first)]


def spans_of(syntax: Syntax, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """For each text its strings and comments as (kind, start, end) in bytes, in order."""
    states = automaton(syntax)[0]
    group = np.array([{"code": 0, "line": 2, "block": 2}.get(s[0], 1) for s in states])
    opens = np.array([s[0] == "open" for s in states])
    lead = np.array([s[1] if s[0] in ("line", "block") else 1 for s in states])
    # what ends at its own last byte, rather than before the byte that shows the end
    closed = np.array([s[0] in ("long", "block") for s in states])
    out = []
    for seq in states_of(syntax, texts):
        now = group[seq]
        before = np.concatenate([[0], now[:-1]])
        change = np.flatnonzero((now != before) | opens[seq])
        found = []
        for i in change.tolist():
            if before[i]:
                found[-1][2] = i + 1 if closed[seq[i - 1]] and not (now[i] or opens[seq[i]]) else i
            if now[i]:
                found.append(["string" if now[i] == 1 else "comment", i + 1 - int(lead[seq[i]]), len(seq)])
        out.append([tuple(x) for x in found])
    return out


def _cleaned(text: str, syntax: Syntax, spans: list[tuple[str, int, int]], at: np.ndarray) -> tuple:
    """Clean text, strings, number of comments, and runs (clean, original, held), in characters."""
    parts, masked, runs, n_comments, done, length = [], [], [], 0, 0, 0
    for kind, a, b in [(k, int(at[x]), int(at[y])) for k, x, y in spans] + [("end", len(text), len(text))]:
        if a > done:
            runs.append((length, done, False))
            parts.append(text[done:a])
            length += a - done
        if kind == "string":
            held = f"__STR_{len(masked)}__"
            runs.append((length, a, True))
            parts.append(held)
            masked.append(text[a:b])
            length += len(held)
        n_comments += kind == "comment"
        done = b
    return "".join(parts), masked, n_comments, runs


def lexed(files: DataFrame, syntax: Syntax, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, clean, masked, n_comments, runs) for each file: its text without comments and with __STR_n__ for each
    string, the strings as they stood (n from 0), and the map back. A run (clean, original, held) says that characters
    from clean on stood from original on, one by one, or all at original where held (a placeholder). Null texts count
    as empty."""
    kind = files.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t if isinstance(t, str) else "" for t in f[content]]
            rows, group, size = [], [], 0
            for t in [*texts, None]:
                if group and (t is None or size + len(t) > BATCH_BYTES):
                    data = [x.encode("utf-8", "surrogatepass") for x in group]
                    for x, d, spans in zip(group, data, spans_of(syntax, data)):
                        at = np.cumsum(np.concatenate([[0], (np.frombuffer(d, np.uint8) & 0xC0) != 0x80]))
                        # the characters before each byte; a span's edges are ASCII, so whole characters
                        rows.append(_cleaned(x, syntax, spans, at))
                    group, size = [], 0
                if t is not None:
                    group.append(t)
                    size += len(t)
            yield pd.DataFrame({key: f[key].to_numpy(), **{c: [r[i] for r in rows] for i, c in enumerate(("clean", "masked", "n_comments", "runs"))}})

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, clean string, masked array<string>, n_comments int, runs array<struct<clean:int,original:int,held:boolean>>")


def matches_at(texts: DataFrame, pattern: str, key: str, text: str) -> DataFrame:
    """(key, at, found): every match of a pattern, which may go over lines, with the characters before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = texts.select(key, F.posexplode(F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("found"))).alias("k", "m"))
    upto = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.length("m.gap") + F.length("m.found")).over(upto)
    return gaps.select(key, (ends - F.length("m.found")).cast("int").alias("at"), F.col("m.found").alias("found"))


def _last_before(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """points with value, that of the last start at or before at: one ordered pass over both sides of a key."""
    both = points.withColumn("_start", F.lit(None).cast("int")).unionByName(starts.select(key, F.col(start).alias("_start"), value), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.coalesce("_start", at), F.col("_start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_start is null").drop("_start")


def original_places(points: DataFrame, clean: DataFrame, files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """points (key, at in the clean text, others) with original, line and column (from 1): where they stood in files.

    Two as-of look-ups: of the run that holds a place, then of the line that begins at or before its original."""
    runs = clean.select(key, F.explode("runs").alias("run")).withColumn("_from", F.col("run.clean"))
    met = _last_before(points, runs, key, "at", "_from", "run")
    met = met.withColumn("original", (F.col("run.original") + F.when(F.col("run.held"), 0).otherwise(F.col("at") - F.col("run.clean"))).cast("int")).drop("run")
    lines = files.select(key, F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), "\n", -1)).alias("_n", "_text"))
    before = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.withColumn("_from", F.coalesce(F.sum(F.length("_text") + 1).over(before), F.lit(0)).cast("int")).withColumn("_line", F.struct((F.col("_n") + 1).alias("n"), "_from"))
    met = _last_before(met, starts, key, "original", "_from", "_line")
    return met.select(*[c for c in met.columns if c != "_line"], F.col("_line.n").alias("line"), (F.col("original") - F.col("_line._from") + 1).alias("column"))
