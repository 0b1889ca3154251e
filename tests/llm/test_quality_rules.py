import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ferrolith.llm import quality_rules as q
from tests.llm.cases import AWKWARD, documents, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_statistics_equal_brute_force(spark):
    texts = AWKWARD + ["a b c d e f g h " * 2, "one two three four five six seven eight nine\n" * 2, "# * $ <é>\n\n# * $ <é>"]
    found = q.text_statistics(documents(spark, texts), ["doc_id"]).collect()
    assert {r.doc_id: tuple(r[c] for c in q.COUNTS[:5]) for r in found} == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_learn_thresholds_and_keep_the_rest(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = np.where((x[:, 0] > 0.8) & (x[:, 1] < 0.5), 0, 1)
    rules = q.learn_rules(x, y, ["a", "b"])
    hit = np.any([r.mask(x, ["a", "b"]) for r in rules], axis=0)
    assert (hit == (y == 0)).mean() > 0.97 and (y[hit] == 0).mean() > 0.95
    assert q.learn_rules(np.zeros((0, 2)), np.zeros(0), ["a", "b"]) == []
    assert q.learn_rules(x, np.ones(600), ["a", "b"]) == []


def test_filter_keeps_columns_even_if_they_clash(spark):
    good = " ".join(f"word{i}" for i in range(40))
    junk = " ".join(f"w{i}###" for i in range(40))
    docs = with_clashes(documents(spark, [good, junk, None, good, good]), "n_words", "n_symbols", "kept")
    rules = [q.Rule((("symbols_a_word", ">=", 0.5),), 1.0, 1)]
    left = q.quality_filter(docs, rules)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [0, 3, 4]
    assert left.first().n_words == "clash"
    assert q.quality_filter(docs.limit(0), rules).count() == 0


def test_fit_on_tables_finds_junk_and_leaves_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = q.fit_rules(docs, labels)
    table = q.text_statistics(docs, ["doc_id"]).where(~q.base_failed()).withColumn("kept", q.verdict(rules)).join(labels, "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in table.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[(1, True)]
    assert counts[(0, False)] >= 0.8 * (counts[(0, False)] + counts.get((0, True), 0))
    assert q.fit_rules(docs, labels.limit(0)) == []
    assert table.where(F.col("kept").isNull()).count() == 0
