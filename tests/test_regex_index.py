import random
import re

from pyspark.sql import functions as F

from ferrolith.operators import regex_index as ri


def held(tree, line):
    grams = {line[i : i + 3] for i in range(len(line) - 2)}
    if tree is None or isinstance(tree, str):
        return tree is None or tree in grams
    return (all if tree[0] == "and" else any)(held(part, line) for part in tree[1])


def drawn(draw, depth):
    if depth == 0 or draw.random() < 0.3:
        return draw.choice(["a", "b", "A", "ab", "aba", "Bab", ".", "[ab]", "[^a]", "\\w", "[a-c]", "é", "\\b", "bca"])
    kind = draw.randrange(6)
    inner = lambda: drawn(draw, depth - 1)
    if kind < 2:
        return inner() + inner()
    if kind == 2:
        return f"(?:{inner()}|{inner()})"
    if kind == 3:
        return f"({inner()}){draw.choice(['?', '*', '+', '{2}', '{2,}', '{3,4}', '{0,2}', '+?'])}"
    return f"(?={inner()}){inner()}" if kind == 4 else f"(?i:{inner()}{inner()})"


def test_no_match_is_lost():
    draw = random.Random(5)
    lines = ["".join(draw.choices("abcABé ", k=draw.randint(0, 14))) for _ in range(300)]
    lower = str.maketrans(ri.UPPER, ri.UPPER.lower())
    told = 0
    for _ in range(1500):
        pattern = drawn(draw, 4)
        tree = ri.needed(pattern)
        told += tree is not None
        if tree is not None:
            assert all(held(tree, line.translate(lower)) for line in lines if re.search(pattern, line)), pattern
    assert told > 300


def test_what_patterns_need():
    assert ri.needed("Hello") == ("and", ("ell", "hel", "llo"))
    assert ri.needed("licen[cs]e") == ("or", (("and", ("cen", "enc", "ice", "lic", "nce")), ("and", ("cen", "ens", "ice", "lic", "nse"))))
    assert ri.needed("abc.*xyz") == ("and", (("and", ("abc",)), ("and", ("xyz",))))
    assert ri.needed("(abc|de).*") is None and ri.needed("(abc)?") is None and ri.needed(".*") is None
    assert ri.needed("(?:abcd)+") == ("and", ("abc", "bcd")) and ri.needed("x(?:ab){2}") == ("and", ("aba", "bab", "xab"))
    for unsure in ["[a-z&&[abc]]def", "[a[bc]]def", "\\vabc", "(?iu)abc", "\\p{L}abc", "\\Qabc\\E", "(?<n>abc)"]:
        assert ri.needed(unsure) is None


def test_search_equals_a_scan(spark, tmp_path):
    draw = random.Random(2)
    texts = ["\n".join("".join(draw.choices("abcx ", k=draw.randint(0, 12))) for _ in range(draw.randint(0, 6))) for _ in range(80)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(100, None, "c"), (101, "", "c"), (102, "ABC ab" * 3000 + "\nxabcx", "c"), (103, "Abc\nabC", "c"), (104, "𝒜bc abc", "c")]
    files = spark.createDataFrame(rows, "file_id int, content string, gram string")
    ri.postings(files).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for pattern in ["abc", "(?i)abc", "a[bx]c|xxa", "b+", "cab.*bca", "𝒜bc", "zzz"]:
        found = sorted((r.file_id, r.line_no, r.text) for r in ri.search(files, index, pattern, 0).collect())
        assert found == sorted((k, n, line) for k, t, _ in rows for n, line in enumerate((t or "").split("\n"), 1) if re.search(pattern, line)), pattern
    assert {r.file_id for r in ri.search(files, index, "abc", names="^10[34]$").collect()} == {104}
    counts = {r.pattern: r for r in ri.report(files, index, ["abc", "b+", "zzz"]).collect()}
    assert counts["zzz"].n_read == 0 and counts["b+"].n_read == len(rows) and counts["abc"].n_found <= counts["abc"].n_read < len(rows)
    assert ri.search(files.where("false"), index.where("false"), "abc").count() == 0


def test_find_files(spark):
    paths = ["PAY.cbl", "sub/pay.cob", "a/b/Pay.cbl", "tax.CBL", "Tax.cbl", "notes", "notes.txt", ".cbl", "x.y.cbl", "lib/TAX.cbl"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    names = spark.createDataFrame([("pay",), ("Tax",), ("TAX",), ("notes",), ("x.y",), ("none",), (None,), ("pay",)], "name string")
    found = {r.name: r.path for r in ri.find_files(files, names, [".cob", ".cbl", ""]).collect()}
    assert found == {"pay": "sub/pay.cob", "Tax": "Tax.cbl", "TAX": "lib/TAX.cbl", "notes": "notes", "x.y": "x.y.cbl"}
    assert ri.find_files(files, names.where("false"), [".cbl"]).select(F.count("name")).first()[0] == 0
