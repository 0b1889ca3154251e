import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrolith.operators import lexer as lx

FORMS = {
    "plain": lx.Syntax(),
    "no doubling": lx.Syntax(doubled=False),
    "escape": lx.Syntax(escape="\\", doubled=False, line=("//",), block=(("/*", "*/"),)),
    "long strings": lx.Syntax(triple=True, escape="\\", doubled=False, line=("#",)),
    "sql": lx.Syntax(strings=("'",), line=("--",), block=(("/*", "*/"),)),
    "markup": lx.Syntax(block=(("<!--", "-->"),)),
    "two line forms": lx.Syntax(line=("*>", "*"), strings=('"',)),
    "overlapping ends": lx.Syntax(strings=(), block=(("((", "))"), ("<-<-", "-<>"))),
    "only strings, doubled and long": lx.Syntax(triple=True),
}


def brute(syntax, text):
    """One character after another, with look-ahead."""
    out, i, n = [], 0, len(text)
    while i < n:
        start, c = i, text[i]
        openers = sorted([*syntax.line, *[b for b, _ in syntax.block]], key=len, reverse=True)
        opener = next((o for o in openers if text.startswith(o, i)), None)
        if c in syntax.strings:
            if syntax.triple and text.startswith(c * 3, i):
                i += 3
                while i < n and not text.startswith(c * 3, i):
                    i += 2 if text[i] == syntax.escape else 1
                i = min(i + 3, n)
            else:
                i += 1
                while i < n:
                    if text[i] == syntax.escape:
                        i += 2
                    elif text[i] != c:
                        i += 1
                    elif syntax.doubled and text.startswith(c * 2, i):
                        i += 2
                    else:
                        i += 1
                        break
                i = min(i, n)
            out.append(("string", start, i))
        elif opener in syntax.line and opener is not None:
            end = text.find("\n", i)
            i = n if end < 0 else end
            out.append(("comment", start, i))
        elif opener:
            end = text.find(dict(syntax.block)[opener], i + len(opener))
            i = n if end < 0 else end + len(dict(syntax.block)[opener])
            out.append(("comment", start, i))
        else:
            i += 1
    return out


@pytest.mark.parametrize("form", [f for f in FORMS if f not in ("two line forms", "overlapping ends", "only strings, doubled and long")])
@given(texts=st.lists(st.text("ab\"'\\/*#-<>!\n ", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_spans_equal_a_plain_lexer(form, texts):
    found = lx.spans_of(FORMS[form], [t.encode() for t in texts])
    assert found == [brute(FORMS[form], t) for t in texts]


def one(form, text):
    return [(k, text[a:b]) for k, a, b in lx.spans_of(FORMS[form], [text.encode()])[0]]


def test_awkward_forms():
    assert one("two line forms", 'a *> x "no"\n* y\n"s*>"') == [("comment", '*> x "no"'), ("comment", "* y"), ("string", '"s*>"')]
    assert one("overlapping ends", "a((x)))b<-<-<-y-<->z-<>w") == [("comment", "((x))"), ("comment", "<-<-<-y-<->z-<>")]
    assert one("only strings, doubled and long", '"""a"b""" "c""d" ""') == [("string", '"""a"b"""'), ("string", '"c""d"'), ("string", '""')]
    long = ('x "a' + "y" * 3000 + '" -- "') * 50
    assert lx.spans_of(FORMS["sql"], [long.encode()]) == [brute(FORMS["sql"], long)]
    assert lx.spans_of(FORMS["plain"], [b"", b'"']) == [[], [("string", 0, 1)]]


def test_clean_text_and_the_way_back(spark):
    text = "é x = 'a--''b' -- cut 'this'\nCALL\n  'P1' /* gone\n gone */ + 'two\nlines' END\n"
    files = spark.createDataFrame([("f", text), ("empty", ""), ("none", None)], "file_id string, content string")
    clean = lx.lexed(files, FORMS["sql"])
    rows = {r.file_id: r for r in clean.collect()}
    assert rows["f"].clean == "é x = __STR_0__ \nCALL\n  __STR_1__  + __STR_2__ END\n" and rows["f"].masked == ["'a--''b'", "'P1'", "'two\nlines'"]
    assert (rows["f"].n_comments, rows["empty"].clean, rows["none"].runs) == (2, "", [])
    # a rule over two lines, and each placeholder, at their own lines
    found = lx.original_places(lx.matches_at(clean, r"CALL\s+__STR_\d+__|__STR_\d+__|END", "file_id", "clean"), clean, files)
    got = sorted((r.original, r.found, r.line, r.column) for r in found.collect())
    assert got == [(6, "__STR_0__", 1, 7), (29, "CALL\n  __STR_1__", 2, 1), (text.index("'two"), "__STR_2__", 4, 12), (text.index("END"), "END", 5, 8)]
