"""Periodic runs of words, by branching tandem repeats in suffix trees (Stoye and Gusfield).

A suffix tree of each document is laid out in numpy for all documents of a chunk at once: words of different documents
have different numbers, so no node holds suffixes of two documents. Leaves are the sorted suffixes; an inner node is an
interval of leaves with the depth of their common prefix. Every node visits the leaves of all its children but the
largest one, n log n visits in all, and asks whether the leaf depth words before or after is below the same node: that
is a tandem repeat, and a branching one if the word behind it breaks the period. Rotating it to the left, word by word
in growing blocks, gives the one maximal run that ends there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.bytetext import Chunk, mix, span_hashes
from ferrolith.llm.columns import with_text_columns

LEAST_WORDS = 12
WORD = "[^\\x20\\x09-\\x0D]+"


def numbered(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for each different word of each document."""
    return np.unique(mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_inverse=True)[1]


def sorted_suffixes(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in order, the place of each in it, and the common prefix of each with the one before it.

    end: for each word, the end of its document. Prefixes are doubled; only suffixes that still share one are sorted.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = words[order[1:]] == words[order[:-1]]
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    levels, width = [place.astype(np.int32)], 1
    shared = same.copy()
    open_ = _shared_slots(same)
    while len(open_):
        at = order[open_]
        behind = at + width
        key = place[at] * (n + 1) + np.where(behind < end[at], place[np.minimum(behind, n - 1)] + 1, 0)
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[open_] = at
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        place[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        same[open_] = ~first
        levels.append(place.astype(np.int32))
        open_ = open_[_shared_slots(~first)]
        width *= 2
    common = np.zeros(n, np.int64)
    slots = np.flatnonzero(shared)
    a, b = order[slots - 1], order[slots]
    stop_a, stop_b, length = end[a], end[b], np.zeros(len(slots), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        level = levels.pop()
        inside = (x < stop_a) & (y < stop_b)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        length += np.where(inside & (level[x] == level[y]), 1 << k, 0)
    common[slots] = length
    return order, place, common


def _shared_slots(same: np.ndarray) -> np.ndarray:
    """Where a group of more than one stands, when same tells who belongs to the group of the one before."""
    after = np.zeros(len(same), bool)
    after[:-1] = same[1:]
    return np.flatnonzero(same | after)


def _nearest(common: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For each place, the next one in the direction of step whose value is smaller (or equal, unless strict)."""
    n = len(common)
    out = np.arange(n) + step
    todo = np.flatnonzero(common > 0)
    while len(todo):
        seen = out[todo]
        found = np.where((seen < 0) | (seen >= n), -1, common[np.clip(seen, 0, n - 1)])
        far = found >= common[todo] if strict else found > common[todo]
        todo = todo[far]
        out[todo] = out[out[todo]]
    return out


def branching_repeats(words: np.ndarray, end: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat, each once."""
    n = len(words)
    order, place, common = sorted_suffixes(words, end)
    slots = np.flatnonzero(common)
    if not len(slots):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, before_same = _nearest(common, -1, True), _nearest(common, -1, False)
    after, after_same = _nearest(common, 1, True), _nearest(common, 1, False)
    heads = slots[before[slots] == before_same[slots]]
    # children: one from each boundary of a node, and the one before its first boundary
    lo = np.concatenate([slots, before[heads]])
    hi = np.concatenate([after_same[slots], heads])
    owner = np.concatenate([slots, heads])
    node = before[owner] * (n + 1) + after[owner]
    turn = np.lexsort((lo - hi, node))
    largest = np.ones(len(turn), bool)
    largest[1:] = node[turn[1:]] != node[turn[:-1]]
    small = turn[~largest]
    size = hi[small] - lo[small]
    leaf = order[np.repeat(lo[small] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    which = np.repeat(owner[small], size)
    depth, left, right = common[which], before[which], after[which]
    starts, periods = [], []
    for first in (leaf, leaf - depth):
        second = first + depth
        other = second if first is leaf else first
        held = (first >= begin[leaf]) & (second < end[leaf])
        first, second, other, q, l, r = (x[held] for x in (first, second, other, depth, left, right))
        inside = place[other]
        held = (inside >= l) & (inside < r)
        first, second, q = first[held], second[held], q[held]
        behind = second + q
        open_ = behind < end[first]
        held = ~open_ | (words[np.minimum(behind, n - 1)] != words[second])
        starts.append(first[held])
        periods.append(q[held])
    found = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(periods))
    return found // (n + 1), found % (n + 1)


def _rotated(words: np.ndarray, begin: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat moves to the left while the word before it equals the one a period later."""
    at, first, todo, block = start.copy(), begin[start], np.arange(len(start)), 1
    while len(todo):
        size = np.minimum(block, at[todo] - first[todo])
        todo, size = todo[size > 0], size[size > 0]
        if not len(todo):
            break
        edge = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(edge, size)
        there = np.repeat(at[todo], size) - 1 - step
        equal = words[there] == words[there + np.repeat(period[todo], size)]
        good = np.minimum.reduceat(np.where(equal, np.int64(1) << 62, step), edge)
        moved = np.minimum(good, size)
        at[todo] -= moved
        todo = todo[moved == size]
        block *= 2
    return at


def maximal_runs(words: np.ndarray, end: np.ndarray, begin: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every run of at least two periods and least words, by start and period.

    Repeats that end at one word are taken by rising period: one is left out if a run of a divisor covers it, as then
    the divisor is a period of its whole run.
    """
    start, period = branching_repeats(words, end, begin)
    stop = start + 2 * period
    turn = np.lexsort((period, stop))
    start, period, stop = start[turn], period[turn], stop[turn]
    out = []
    while len(start):
        head = np.ones(len(stop), bool)
        head[1:] = stop[1:] != stop[:-1]
        group = np.cumsum(head) - 1
        s, q, e = _rotated(words, begin, start[head], period[head]), period[head], stop[head]
        out.append(np.stack([s, e - s, q]))
        rest = ~head & ~((period % q[group] == 0) & (start >= s[group]))
        start, period, stop = start[rest], period[rest], stop[rest]
    s, length, q = np.concatenate([np.zeros((3, 0), np.int64), *out], axis=1)
    kept = length >= least
    s, length, q = s[kept], length[kept], q[kept]
    turn = np.lexsort((q, s))
    return s[turn], length[turn], q[turn]


def _chunk_runs(chunk: Chunk, least: int) -> dict[str, list]:
    begin, stop, doc = chunk.words()
    edges = np.searchsorted(doc, np.arange(chunk.n + 1))
    first, last = edges[doc], edges[doc + 1]
    body = chunk.data.tobytes()
    start, length, period = maximal_runs(numbered(span_hashes(chunk.data, begin, stop), doc), last, first, least)
    # words that some run holds after its first period
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    whose = doc[start]
    at = np.searchsorted(whose, np.arange(chunk.n + 1))
    out = {"run_starts": [], "run_lengths": [], "run_periods": [], "collapsed": _joined(body, begin[kept], stop[kept], doc[kept], chunk.n)}
    for d in range(chunk.n):
        held = slice(at[d], at[d + 1])
        out["run_starts"].append(start[held] - edges[d])
        out["run_lengths"].append(length[held])
        out["run_periods"].append(period[held])
    return out


def _joined(body: bytes, begin: np.ndarray, stop: np.ndarray, doc: np.ndarray, n: int) -> list[str]:
    """The words of each document, joined by one space."""
    size = stop - begin + 1
    data = np.frombuffer(body + b" ", np.uint8)
    edge = np.cumsum(size) - size
    flat = data[np.repeat(begin - edge, size) + np.arange(int(size.sum()))]
    flat[edge + size - 1] = 32
    held = flat.tobytes()
    ends = np.concatenate([edge, [len(held)]])
    at = ends[np.searchsorted(doc, np.arange(n + 1))].tolist()
    return [held[a : b - 1].decode() if b > a else "" for a, b in zip(at, at[1:])]


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST_WORDS, text: str = "text") -> DataFrame:
    """docs (or its columns in keep) with runs, an array of (start, length, period) by start and period, and collapsed,
    the text without what repeats: words that a run holds after its first period are dropped, the others joined by one
    space.

    Words are runs of bytes other than space and tab to carriage return, numbered from 0. A run is a stretch with
    smallest period q, at least max(least, 2 * q) words long, which no neighbouring word extends. A null or empty text
    has no runs and collapses to an empty one. Rows stay as they are, repeated ones included; columns of the names
    runs, collapsed, run_starts, run_lengths and run_periods are replaced. Memory: a document's words times the
    logarithm of the longest repeat in it, as numbers.
    """
    columns = {"run_starts": "array<bigint>", "run_lengths": "array<bigint>", "run_periods": "array<bigint>", "collapsed": "string"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in columns and c != "runs"]
    found = with_text_columns(docs, lambda: lambda chunk: _chunk_runs(chunk, least), columns, kept, text)
    runs = F.arrays_zip(F.col("run_starts").alias("start"), F.col("run_lengths").alias("length"), F.col("run_periods").alias("period"))
    named = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return found.select(*[found[c] for c in kept], runs.cast(named).alias("runs"), "collapsed")


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """text, or for one id in ten its words with a tail that repeats: h = crc32(id), g = h div 10; if h % 10 = 0 each
    word from a = g % n on is word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Null ids and empty texts stay."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs.select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text")), ["doc_id"])
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), (-F.col("b.less")).alias("length"), F.col("b.period").alias("period"),
        F.floor(-1000 * F.col("b.less") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
