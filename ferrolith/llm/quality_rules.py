"""Quality rules: text statistics, and a decision list learned from labelled statistics by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.bytetext import Chunk, mix, span_hashes, windows
from ferrolith.llm.columns import with_text_columns
from ferrolith.llm.samples import labelled_sample

SAMPLE_ROWS = 20_000
REPEAT_WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits", "n_bytes"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def count_statistics(chunk: Chunk) -> dict[str, np.ndarray]:
    """COUNTS for each document of a chunk."""
    data, n = chunk.data, chunk.n
    start, end, doc = chunk.words()
    hashes = span_hashes(data, start, end)

    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])

    def total(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]

    salt = mix(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(20))
    line_start, line_end, line_doc = chunk.lines()
    word_line = np.searchsorted(line_start, start, side="right") - 1 if len(start) else np.zeros(0, np.int64)
    # empty documents have lines that start where the next document starts: no word is theirs
    with_word = np.zeros(len(line_start), bool)
    with_word[word_line] = True
    keys = span_hashes(data, line_start[with_word], line_end[with_word]) ^ salt[line_doc[with_word]]
    _, first = np.unique(keys, return_index=True)
    n_word_lines = chunk.per_doc(line_doc[with_word])
    n_distinct_lines = chunk.per_doc(line_doc[with_word][first])

    _, first_word = np.unique(hashes ^ salt[doc], return_index=True)
    at, shingle = windows(hashes, doc, REPEAT_WINDOW)
    _, inverse, times = np.unique(shingle ^ salt[doc[at]], return_inverse=True, return_counts=True)
    repeated = at[times[inverse] > 1]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    return {
        "n_words": chunk.per_doc(doc),
        "word_chars": chunk.per_doc(doc, points[end] - points[start]),
        "n_symbols": total(_SYMBOL),
        "n_dup_lines": n_word_lines - n_distinct_lines,
        "n_repeat_words": chunk.per_doc(doc[covered]),
        "n_lines": chunk.per_doc(line_doc),
        "n_distinct_words": chunk.per_doc(doc[first_word]),
        "n_upper": total(_UPPER),
        "n_marks": total(_MARK),
        "n_digits": total(_DIGIT),
        "n_bytes": np.diff(chunk.offsets),
    }


def text_statistics(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs, or only the columns in keep, with the bigint columns of COUNTS (replacing columns so named).

    Words are runs other than space and tab to carriage return; lines are split at \\n. word_chars: code points in
    words. n_symbols: characters of #*$%&|<>. n_dup_lines: lines with a word that equal an earlier line.
    n_repeat_words: words in 8-word windows that the text holds twice or more. A null text counts as empty (one empty
    line, all other counts 0); repeated rows are counted each for itself.
    """
    return with_text_columns(docs, lambda: count_statistics, dict.fromkeys(COUNTS, "bigint"), keep, text)


def features() -> dict[str, Column]:
    """The statistics that rules test, as expressions over COUNTS; each is 0 for a text without words."""
    words, size = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_bytes"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "symbols_a_word": F.col("n_symbols") / words,
        "chars_a_word": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct_words") / words,
        "upper_share": F.col("n_upper") / size,
        "marks_a_word": F.col("n_marks") / words,
        "digit_share": F.col("n_digits") / size,
        "words_a_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 % of the words in repeated 8-word windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject if every test holds; a test is (feature, '>=' or '<', threshold)."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def holds(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.tests:
            x = features()[name]
            out = out & (x >= value if sign == ">=" else x < value)
        return out

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return _mask(self.tests, x, names)


def _mask(tests, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, value in tests:
        col = x[:, names.index(name)]
        out &= col >= value if sign == ">=" else col < value
    return out


def learn_rules(x: np.ndarray, y: np.ndarray, names: list[str], max_rules: int = 12, max_tests: int = 4, least_precision: float = 0.95, least_covered: int = 5, cuts: int = 64) -> list[Rule]:
    """A decision list for y == 0 by sequential covering: grow a conjunction on two thirds of the rows that no rule
    covers yet, prune it on the last third, keep it while it is precise on both, and go on with the uncovered rows."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        grow, prune = left & ~third, left & third
        tests = _grown(x[grow], y[grow] == 0, names, max_tests, cuts)
        if not tests:
            break
        tests = _pruned(tests, x[prune], y[prune] == 0, names)
        hit = _mask(tests, x, names) & left
        bad, n = int((y[hit] == 0).sum()), int(hit.sum())
        if n < least_covered or bad / n < least_precision:
            break
        rules.append(Rule(tuple(tests), bad / n, n))
        left &= ~hit
    return rules


def _grown(x: np.ndarray, bad: np.ndarray, names: list[str], max_tests: int, cuts: int) -> list[tuple[str, str, float]]:
    """Adds the test of highest information gain until no good row is covered or nothing is gained."""
    tests: list[tuple[str, str, float]] = []
    live = np.ones(len(x), bool)
    while len(tests) < max_tests and bad[live].any() and not bad[live].all():
        p0, n0 = bad[live].sum(), live.sum()
        best, found = 1e-9, None
        for k, name in enumerate(names):
            col = x[live, k]
            mine = bad[live]
            values = np.unique(np.concatenate([np.quantile(col, np.linspace(0, 1, cuts)), np.quantile(col[mine], np.linspace(0, 1, cuts))]))
            values = (values[1:] + values[:-1]) / 2
            order = np.argsort(col, kind="stable")
            sums = np.concatenate([[0], np.cumsum(mine[order])])
            below = np.searchsorted(col[order], values, side="left")
            for sign, p, n in (("<", sums[below], below), (">=", sums[-1] - sums[below], len(col) - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((p > 0) & (n > 0), p * (np.log(p / n) - np.log(p0 / n0)), -1.0)
                if len(gain) and gain.max() > best:
                    at = int(gain.argmax())
                    best, found = float(gain[at]), (name, sign, float(values[at]))
        if not found:
            break
        tests.append(found)
        live &= _mask([found], x, names)
    return tests


def _pruned(tests, x: np.ndarray, bad: np.ndarray, names: list[str]):
    """Drops last tests while (bad - good) / covered on the pruning rows doesn't fall."""

    def worth(some) -> float:
        hit = _mask(some, x, names)
        return (2.0 * bad[hit].sum() - hit.sum()) / hit.sum() if hit.any() else -1.0

    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules that reject documents like those with label 0, from at most rows labelled documents that aren't held out.

    Only the sample's statistics (ten numbers a row) come to the driver. No labels, or only one class: no rules.
    """
    sample = labelled_sample(docs, labels, label, rows, ["doc_id", "text"])
    table = text_statistics(sample, ["doc_id", "y"]).where(~base_failed())
    found = table.select("doc_id", "y", *[v.alias(k) for k, v in features().items()]).toPandas().sort_values("doc_id")
    names = list(features())
    return learn_rules(found[names].to_numpy(float), found["y"].to_numpy(), names) if len(found) else []


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: the first rule that holds rejects, else kept."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.holds(), False)
    return out.otherwise(True)


def quality_filter(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that base limits and rules keep, with the columns of docs, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return text_statistics(plain, text=f"c{docs.columns.index('text')}").where(verdict(rules)).select(plain.columns).toDF(*docs.columns)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = fit_rules(docs, labels)
    return text_statistics(docs, ["doc_id"]).select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), verdict(rules).alias("kept"))
