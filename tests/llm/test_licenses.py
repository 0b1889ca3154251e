import random
import re

import pytest

from ferrolith.llm import licenses as li
from tests.llm.cases import AWKWARD, documents, with_clashes


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in li.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = AWKWARD + [
    "Under the MIT License.", "mit", "license", "permit license", "mit licenses", "MIT--License mit\nlicense", "the apache license and GNU Lesser General Public License",
    "éMIT license", "MIT licenseé", "mit license" * 2, "license mit license general public license " * 50, "MİT License", "mit\x00license", "x" * 3_000_000 + " mit license",
]


def test_base_equals_brute_force(spark):
    found = li.scan(with_clashes(documents(spark, TEXTS), "labels", "n_words"), ["doc_id"]).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    for r in found:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert li.scan(documents(spark, TEXTS).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, names, value",
    [
        ("MIT", {"mit"}, 1.0),
        ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 1.0),
        ("MIT and GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.3),
        ("MIT OR Apache-2.0 AND AGPL-3.0", {"mit", "apache-2.0", "agpl-3.0"}, 1.0),
        ("(MIT OR Apache-2.0) AND AGPL-3.0", {"mit", "apache-2.0", "agpl-3.0"}, 0.1),
        ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2.0"}, 0.6),
        ("MIT OR", {"mit"}, 1.0),
        ("MIT Apache-2.0", {"mit"}, 1.0),
        ("(MIT", None, None),
        ("or MIT", None, None),
        ("", None, None),
    ],
)
def test_expressions(text, names, value):
    found = li.expression(text.encode())
    assert found == ((names, pytest.approx(value)) if names else None)


def test_identifier_tags_add_labels(spark):
    texts = ["// SPDX-License-Identifier: MIT OR (GPL-2.0 WITH Classpath-exception-2.0)\nint x;", "spdx license identifier", "Redistribution and use in source and binary forms"]
    rows = sorted(li.scan(documents(spark, texts)).collect())
    assert [r.labels for r in rows] == ["gpl-2.0,mit", "", "bsd"] and [r.score for r in rows] == [1.0, 0.0, 1.0]


def test_long_expressions_are_read_to_the_end_of_the_line(spark):
    names = ["Name%03d-Licence-1.0" % i for i in range(100)]
    line = "SPDX-License-Identifier: " + " AND ".join([*names, "AGPL-3.0-only"])
    rows = sorted(li.scan(documents(spark, [line + "\nAND Next-1.0", line + " AND (", "(" * 500 + "MIT" + ")" * 500, "SPDX-License-Identifier:" + "(" * 500 + "MIT" + ")" * 500])).collect())
    want = ",".join(sorted(n.lower() for n in [*names, "AGPL-3.0-only"]))
    assert [r.labels for r in rows] == [want, want, "", "mit"] and [r.score for r in rows] == [0.1, 0.1, 0.0, 1.0]


def test_one_pass_finds_the_longest_prefix_that_parses():
    rng = random.Random(4)
    for _ in range(3000):
        tokens = [rng.choice(["(", ")", "and", "OR", "with", "MIT", "gpl-2.0", "x"]) if rng.random() < 0.5 else rng.choice([["MIT", "and"], ["(", "x", "or"], ["y", ")"]][rng.randrange(3)]) for _ in range(rng.randrange(12))]
        postfix, size = li.complete_prefix(tokens)
        parses = [n for n in range(1, len(tokens) + 1) if grammar(tokens[:n])]
        assert size == max(parses, default=0) and (not size or li.to_postfix(tokens[:size]) == postfix)


def grammar(tokens):
    """Whether all tokens are one expression, by rewriting."""
    kinds = "".join({"(": "(", ")": ")"}.get(t, "o" if t.lower() in ("and", "or", "with") else "n") for t in tokens)
    while (less := kinds.replace("non", "n").replace("(n)", "n")) != kinds:
        kinds = less
    return kinds == "n"
