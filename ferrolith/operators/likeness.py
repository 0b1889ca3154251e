"""Similarity join of names as sets of words, without loss: prefix filters by rare words and rare runs of characters.

The likeness of two names is the largest of: 1, if the words of one are among those of the other; what the common words
alone make of either name; and 2 L / S of both names with the common words in front, L their longest common subsequence
and S the sum of their lengths m and n. A pair of likeness t or more therefore shares

* common words of a joined length of at least t m / (2 - t) of one name, or
* at least (2 q - 1) t S / 2 - (q - 1) (S - 1) runs of q characters (S - m and S - n bounded by the same t): a character
  outside L breaks q runs where it is and q - 1 where it is not. With a blank at both ends, runs of two characters are
  the same in whatever order the words stand; so are single characters, which take over where that bound is not positive.

Either way names meet by the rarest of their words or runs only, as many as one of those shared must be among. Rare is
by the product of how many names and targets hold a key: one that a side never holds comes first and makes no pair. How
many runs that are depends on both lengths, so runs meet by key and both lengths: names that can't be alike never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.sources.shared import written

#: Pairs that one step of the subsequence search compares.
STEP_PAIRS = 4096
#: Lengths up to this are told apart; those of one bucket beyond it differ by less than this factor.
EXACT, BUCKET = 32, 1.06
#: Different runs up to this are broadcast with their counts.
BROADCAST_KEYS = 1 << 19


def words_of(name: str) -> list[str]:
    """The different words of a name, sorted: lower case, parted by white space, - and _."""
    return sorted(set(name.lower().replace("-", " ").replace("_", " ").split()))


def runs_of(words: list[str], q: int) -> list[int]:
    """The runs of q (1 or 2) characters of the joined words, padded by blanks, each with its number among equal ones:
    one integer for both characters and the number, different for different runs."""
    points = list(map(ord, " " * (q - 1) + " ".join(words) + " " * (q - 1)))
    seen, out = {}, []
    for k in range(len(points) - q + 1):
        run = points[k] << 21 | (points[k + 1] if q == 2 else 0)
        seen[run] = seen.get(run, -1) + 1
        out.append(run << 21 | seen[run])
    return out


def _codes(texts: list[str], fill: int) -> np.ndarray:
    """A row of code points for each text."""
    width = max(map(len, texts), default=0)
    out = np.full((len(texts), width), fill, np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def common_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair, a step of all pairs for each character of the left."""
    order = np.argsort([len(x) + len(y) for x, y in zip(left, right)], kind="stable")
    out = np.zeros(len(left), np.int64)
    for lo in range(0, len(order), STEP_PAIRS):
        at = order[lo : lo + STEP_PAIRS]
        a, b = _codes([left[i] for i in at], -1), _codes([right[i] for i in at], -2)
        row = np.zeros((len(at), b.shape[1] + 1), np.int32)
        for k in range(a.shape[1]):
            np.maximum(row[:, 1:], row[:, :-1] + (b == a[:, k : k + 1]), out=row[:, 1:])
            np.maximum.accumulate(row, axis=1, out=row)
        out[at] = row[:, -1]
    return out


def token_set_ratios(names: list[str], targets: list[str]) -> np.ndarray:
    """The likeness, 0 to 1, of each pair."""
    known = {n: words_of(n) for n in {*names, *targets}}
    best, left, right = np.zeros(len(names)), [], []
    for i, (a, b) in enumerate(zip(names, targets)):
        x, y = known[a], known[b]
        other = set(y)
        both = [w for w in x if w in other]
        rest = [w for w in x if w not in other], [w for w in y if w not in set(x)]
        left.append(" ".join(both + rest[0]))
        right.append(" ".join(both + rest[1]))
        if both:
            held = len(" ".join(both))
            best[i] = 1.0 if not all(rest) else 2 * held / (held + min(len(left[-1]), len(right[-1])))
    open_ = np.flatnonzero(best < 1)
    size = np.array([len(left[i]) + len(right[i]) for i in open_], float)
    best[open_] = np.maximum(best[open_], 2 * common_lengths([left[i] for i in open_], [right[i] for i in open_]) / np.maximum(size, 1))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The likeness, 0 to 1, of two names."""
    return float(token_set_ratios([a], [b])[0])


def _keyed(names: DataFrame, targets: DataFrame, q: int) -> DataFrame:
    """(text, a, b, words, runs) of all distinct names (a) and targets (b)."""
    every = names.select(F.col("name").alias("text"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(targets.select(F.col("target").alias("text"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    once = every.where("text is not null").groupBy("text").agg(F.max("a").alias("a"), F.max("b").alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words = f["text"].map(words_of)
            yield f.assign(words=words, runs=words.map(lambda w: runs_of(w, q) if w else []))[words.map(len) > 0]

    return written(once.mapInPandas(run, "text string, a int, b int, words array<string>, runs array<bigint>"), "names")


def _by_rarity(keyed: DataFrame, column: str) -> DataFrame:
    """(text, a, b, m, keys, none): the keys of each text, those that make the fewest pairs first; the first none of
    them make no pair at all."""
    m = F.length(F.array_join("words", " "))
    rows = keyed.select("text", "a", "b", m.alias("m"), F.explode(column).alias("key"))
    counts = written(rows.groupBy("key").agg((F.sum("a") * F.sum("b")).alias("cost")), "key-counts")
    # common keys are few and each is in most texts: their rows aren't gathered by key
    counts = counts.hint("broadcast" if counts.count() <= BROADCAST_KEYS else "merge")
    ordered = rows.join(counts, "key").groupBy("text", "a", "b", "m").agg(F.array_sort(F.collect_list(F.struct("cost", "key"))).alias("o"))
    return ordered.select("text", "a", "b", "m", F.col("o.key").alias("keys"), F.size(F.filter("o", lambda x: x["cost"] == 0)).alias("none"))


def _joined_length(words: Column) -> Column:
    return F.aggregate(words, F.lit(-1), lambda n, w: n + F.length(w) + 1)


def _by_words(keyed: DataFrame, t: float) -> DataFrame:
    """Pairs whose common words are long enough, found by the rarest words of one of the two."""
    held = _by_rarity(keyed, "words")
    need = F.lit(t / (2 - t)) * F.col("m")
    # a word is among the rare ones if it and the words after it are long enough
    rare = F.filter("keys", lambda w, i: (i >= F.col("none")) & (_joined_length(F.slice("keys", i + 1, F.size("keys"))) >= need))
    met = F.slice("keys", F.col("none") + 1, F.size("keys"))
    held = written(held.withColumn("rare", rare).withColumn("keys", met).where("size(keys) > 0").drop("none"), "names-by-words")

    def side(flag: str, name: str, key: str) -> DataFrame:
        return held.where(f"{flag} = 1").select(F.col("text").alias(name), F.col("keys").alias(f"{name}_words"), F.col("m").alias(f"{name}_m"), F.explode(key).alias("key"))

    common = F.array_intersect("name_words", "target_words")
    found = []
    for x, y, m in (("rare", "keys", "name_m"), ("keys", "rare", "target_m")):
        met = side("a", "name", x).join(side("b", "target", y), "key")
        # the pair is made by its first common word alone
        met = met.where((F.element_at(common, 1) == F.col("key")) & (_joined_length(common) >= F.lit(t / (2 - t)) * F.col(m)))
        found.append(met.select("name", "target"))
    return found[0].unionByName(found[1])


def _bucket(length: Column) -> Column:
    return F.when(length <= EXACT, F.floor(length)).otherwise(EXACT + 1 + F.floor(F.log(length / (EXACT + 1)) / np.log(BUCKET))).cast("int")


def _shared(size: Column, t: float, q: int) -> Column:
    """How many runs a pair of that joined length must share."""
    return F.greatest(F.ceil(F.lit((2 * q - 1) * t / 2 - q + 1) * size + F.lit(q - 1 - 1e-9)), F.lit(1))


def _meeting(keyed: DataFrame, t: float, q: int) -> tuple[DataFrame, DataFrame]:
    """The rare runs of names and of targets (key, ab, bb, text, m, codes, i; ab and bb the buckets of the lengths of
    both) that the other side has among its rare ones too."""
    held = _by_rarity(keyed, "runs")
    held = written(held.where("size(keys) > none").withColumn("own", _bucket(F.col("m"))), "names-by-runs")

    def met_by(flag: str, other: str) -> DataFrame:
        """(key, own, far, text, m, codes, i): the rare runs of one side, for each bucket of lengths near enough that the
        other side has."""
        lengths = held.where(f"{other} = 1").groupBy(F.col("own").alias("far")).agg(F.min("m").alias("_m"), F.max("m").alias("_most"))
        near = held.where(f"{flag} = 1").join(F.broadcast(lengths), (F.col("_most") >= F.col("m") * F.lit(t / (2 - t)) - 1e-6) & (F.col("_m") <= F.col("m") * F.lit((2 - t) / t) + 1e-6))
        # the least that the smallest of the bucket would have to share; those that make no pair stand first
        least = F.greatest(F.col("_m"), F.ceil(F.col("m") * F.lit(t / (2 - t)) - 1e-6))
        count = F.size("keys") - _shared(F.col("m") + least, t, q) + 1
        rare = F.sequence(F.col("none"), (count - 1).cast("int"))
        return near.where(count > F.col("none")).select("own", "far", "text", "m", F.col("keys").alias("codes"), F.explode(rare).alias("i")).withColumn("key", F.element_at("codes", F.col("i") + 1))

    a = met_by("a", "b").withColumnsRenamed({"own": "ab", "far": "bb"})
    b = met_by("b", "a").withColumnsRenamed({"own": "bb", "far": "ab"})
    # only keys that are among the rare ones of both sides bring their texts along
    both = written(a.select("key", "ab", "bb").distinct().join(b.select("key", "ab", "bb").distinct(), ["key", "ab", "bb"]), "run-keys")
    both = both.hint("broadcast" if both.count() <= BROADCAST_KEYS else "merge")
    return tuple(x.join(both, ["key", "ab", "bb"], "left_semi") for x in (a, b))


def _by_runs(keyed: DataFrame, t: float, q: int) -> DataFrame:
    """Pairs that may share enough runs, found by the rarest ones of both, with lengths near enough."""
    a, b = _meeting(keyed, t, q)
    a = a.select("key", "ab", "bb", F.col("text").alias("name"), F.col("m").alias("am"), F.col("i").alias("ai"), F.col("codes").alias("acodes"))
    b = b.select("key", "ab", "bb", F.col("text").alias("target"), F.col("m").alias("bm"), F.col("i").alias("bi"), F.col("codes").alias("bcodes"))
    size = F.col("am") + F.col("bm")
    left = F.least(F.size("acodes") - F.col("ai"), F.size("bcodes") - F.col("bi"))
    met = a.join(b, ["key", "ab", "bb"]).where((2 * F.least("am", "bm") >= F.lit(t) * size) & (left >= _shared(size, t, q)))
    common = F.array_intersect("acodes", "bcodes")
    return met.where(F.size(common) >= _shared(size, t, q)).select("name", "target")


def likenesses(names: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """(name, target, score) of all pairs of distinct names and targets (one column each) with likeness >= least > 0.

    Names without a word, and null, are like nothing. Scores have six digits. Pairs that the filters leave are scored
    once, in numpy over batches.
    """
    t = least - 1e-6
    q = 2 if least >= 0.7 else 1
    keyed = _keyed(names, targets, q)
    pairs = _by_words(keyed, t).unionByName(_by_runs(keyed, t, q)).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scored = f.assign(score=np.round(token_set_ratios(f["name"].tolist(), f["target"].tolist()), 6))
            yield scored[scored["score"] >= least]

    return pairs.mapInPandas(run, "name string, target string, score double")
