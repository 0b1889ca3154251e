import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrolith.operators import likeness as lk


def common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 2 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def definition(a, b):
    """From the definition, with the common words in front."""
    x, y = (set(n.lower().replace("-", " ").replace("_", " ").split()) for n in (a, b))
    both, p, q = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (p and q):
        return 1.0
    left, right = (" ".join(filter(None, [both, r])) for r in (p, q))
    return max(ratio(left, right), ratio(both, left), ratio(both, right))


@given(st.lists(st.tuples(st.text("abC-_ é", max_size=12), st.text("abC-_ é", max_size=12)), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_ratios_equal_the_definition(pairs):
    assert lk.token_set_ratios(*map(list, zip(*pairs))) == pytest.approx([definition(a, b) for a, b in pairs])


def test_some_ratios():
    assert lk.token_set_ratio("abc", "abd") == pytest.approx(2 / 3) and lk.token_set_ratio("a-b", "B_A") == 1.0
    assert lk.token_set_ratio("", "x") == 0.0 and lk.token_set_ratio("REC", "CUST-REC") == 1.0


def random_names(rng, n):
    hot = ["rec", "file", "cust", "a"]
    one = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
    return ["-".join(rng.choice(hot) if rng.random() < 0.5 else one() for _ in range(rng.randrange(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("least", [0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
def test_join_equals_brute_force(spark, least):
    rng = random.Random(6)
    names = ["PAY-X1", "X1-PAY", "A-B", "B_A", "abc", "ac", "", "-", "a", "REC", None] + random_names(rng, 140)
    names += ["".join(rng.choice("abcA-_ ") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    targets = ["abC", "CUST_REC", "custrec", "MAINT", "A"] + random_names(rng, 140)
    one = lambda rows, c: spark.createDataFrame([(n,) for n in rows], f"{c} string")
    got = sorted(tuple(r) for r in lk.likenesses(one(names, "name"), one(targets, "target"), least).collect())
    want = {(a, b, round(definition(a, b), 6)) for a in names if a is not None for b in targets}
    assert got == sorted(x for x in want if x[2] >= least) and len(got) > 10


def test_unlike_names_make_no_pairs(spark):
    """Names that differ in what most of them hold, beside as many targets of about their length: no pair is scored."""
    names = spark.range(3000).select(F.format_string("nobody.%d", F.col("id") + 10_000).alias("name"))
    targets = spark.range(3000).select(F.format_string("customer#%09d", "id").alias("target"))
    keyed = lk._keyed(names, targets, 2)
    assert lk._by_runs(keyed, 0.8, 2).count() == 0 and lk._by_words(keyed, 0.8).count() == 0
    # a hot word alone doesn't make names meet
    names, targets = (spark.range(3000).select(F.concat(F.lit("record-"), F.substring(F.md5(F.concat(F.lit(c), "id")), 1, 16)).alias(c)) for c in ("name", "target"))
    keyed = lk._keyed(names, targets, 2)
    assert lk._by_words(keyed, 0.8).count() == 0 and lk._by_runs(keyed, 0.8, 2).distinct().count() < 3000 * 3000 / 50


def test_unlike_names_never_meet(spark):
    """The join itself has no pair to look at, however long the numbers are that both sides share digits with."""
    names = spark.range(3000).select(F.format_string("nobody.%d", F.col("id") * 7 + 1_234_567).alias("name"))
    targets = spark.range(3000).select(F.format_string("customer#%09d", F.col("id") * 7 + 1_234_567).alias("target"))
    assert [x.count() for x in lk._meeting(lk._keyed(names, targets, 2), 0.8, 2)] == [0, 0]


def test_empty_sides(spark):
    none = spark.createDataFrame([], "name string")
    assert lk.likenesses(none, spark.createDataFrame([("x",)], "target string"), 0.8).count() == 0
