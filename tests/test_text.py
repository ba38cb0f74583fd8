"""Text functions on hand-made cases, against Python's own."""

import re
import string
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import text, unicode
from loomwright.functions.porter import stem, stemmed
from loomwright.functions.unicode import category, clean_text, nfkc

CASES = ["", " ", "a", "  a  b ", "a\u200bb\ufeff", "x\ufffdy\ufffc", "a\x85b", "a\u1680b", "a\x0bb\x0c", "\u0416 \u4e2d\u6587a\u4e2d b", "\u0130STANBUL", "\u039f\u0394\u039f\u03a3", "\ufb01n", "l1\r\nl2\n\n  l3 \t\n", "a_b-c!d", "\u3000x\u2028y", "\x1cx\x1f", "\u00bfque?", "Don't stop."]


def values(spark, column, cases=CASES):
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, s string").coalesce(1)
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_strip_split_and_punctuation(spark):
    assert values(spark, text.pystrip(F.col("s"))) == [x.strip() for x in CASES]
    assert values(spark, text.words(F.col("s"))) == [x.split() for x in CASES]
    table = str.maketrans({c: " " for c in string.punctuation})
    assert values(spark, text.without_punctuation(F.col("s"))) == [x.translate(table) for x in CASES]


def test_tokens(spark):
    table = str.maketrans({c: " " for c in string.punctuation})
    plain = [x for x in CASES if "\u0130" not in x]
    assert values(spark, text.tokens(F.col("s")), plain) == [x.translate(table).lower().split() for x in plain]


def python_clean(s, newline=False):
    white = set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85")
    out = ""
    for c in unicodedata.normalize("NFKC", s):
        kind = unicodedata.category(c)
        if c in white or kind in ("Zl", "Zp") or kind == "Zs" and c != "\u1680":
            out += "\n" if c == "\n" and not newline else " "
        elif kind not in ("Cc", "Cf") and c not in "\ufffc\ufffd":
            out += c
    return out


@pytest.mark.parametrize("newline", [False, True])
def test_clean_text(spark, newline):
    assert values(spark, clean_text(F.col("s"), replace_newline=newline)) == [python_clean(x, newline) for x in CASES]
    assert values(spark, nfkc("s")) == [unicodedata.normalize("NFKC", x) for x in CASES]


def test_cjk_spacing(spark):
    got = values(spark, clean_text(F.col("s"), space_cjk=True), ["\u4e2d\u6587", "a\u4e2d", "a \u4e2d b", "\u4e2d"])
    assert got == [" \u4e2d \u6587 ", "a \u4e2d ", "a \u4e2d  b", " \u4e2d "]


def test_categories_by_rule():
    assert len(category("Zs")) == 17 and len(category("Cc")) == 65 and category("Zl") == ["\u2028"] and category("Zp") == ["\u2029"]


def test_strip_lines(spark):
    got = values(spark, text.stripped_lines(F.col("s")), ["", "a", " a \n\n b\t\n", "x\r\ny", "\n \n"])
    assert got == ["\n", "a\n", "a\nb\n", "x\ny\n", "\n"]


def test_latex(spark):
    cases = ["a\\b", "~^", "50% & $x_1 #{}", "a\u00a0b\u200bc", "x<latex>\\frac{1}{2}</latex>_y", "_<latex>$a_b", "<latex></latex>", "<latex>a</latex><latex>b</latex>&"]
    assert values(spark, text.latex_escaped(F.col("s")), cases) == [
        "a\\textbackslashb", "\\textasciitilde\\textasciicircum", "50\\% \\& \\$x\\_1 \\#\\{\\}", "a bc", "x\\frac{1}{2}\\_y", "\\_$a_b", "", "ab\\&",
    ]


def test_paths(spark):
    assert values(spark, text.ellipsis_path(F.col("s"), 8), ["/a/b", "/long/path/to"]) == ["/a/b", "...th/to"]
    assert values(spark, text.ellipsis_path(F.col("s")), ["/long/path/to"]) == ["/long/path/to"]
    paths = ["a.py", "a.txt", "b.py", "c"]
    strict = values(spark, text.path_ignored(F.col("s"), ["^a"], [r"\.py$"]), paths)
    loose = values(spark, text.path_ignored(F.col("s"), ["^a"], [r"\.py$"], include_wins=True), paths)
    assert strict == [True, True, False, True] and loose == [False, True, False, False]
    assert values(spark, text.path_ignored(F.col("s")), paths) == [False] * 4


def test_replies(spark):
    assert values(spark, text.ranking_reply(F.col("s")), ["Ranking: [a, b]", "Ranking: [x] y", "no Ranking: [a]", "Ranking: a"]) == [["a", " b"], ["x"], None, None]
    names = F.array(F.lit("m.1"), F.lit("m2"))
    got = values(spark, text.preferred_name(F.col("s"), names), ["", "take m.1", "mx1", "m2 over m.1", "m2 m2"])
    assert got == [None, "m.1", None, None, None]


def test_prompt_values_are_not_searched(spark):
    got = values(spark, text.filled("A {x} B {y}", x=F.col("s"), y=F.lit("{x}")), ["{y}"])
    assert got == ["A {y} B {x}"]


def test_falsy_and_errors(spark):
    assert values(spark, text.falsy_coalesce(F.col("s"), F.lit("g")), ["", "0", "a", None]) == ["g", "g", "a", "g"]
    assert values(spark, text.error_text(F.col("s")), ["oops", "", None]) == ["oops", "Unknown error", "Unknown error"]
    assert values(spark, text.punctuated(F.col("s")), ["abc", "a$", "\u00bf", "\u00e9"]) == [False, True, True, False]


def test_porter_examples(spark):
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "enjoy": "enjoy", "news": "news", "dying": "die", "dies": "die", "died": "die", "tried": "tri", "flies": "fli", "by": "by", "say": "say", "possibly": "possibl", "carefully": "care", "archaeology": "archaeolog", "proceed": "proceed", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: stem(w) for w in want} == want
    assert values(spark, stemmed(F.split("s", " ")), ["running cats", "a"]) == [["run", "cat"], ["a"]]
    assert stem("y" * 5000 + "ed") and stem("yb" * 3000 + "ing") and stem("a" + "alli" * 2000)  # long tokens neither recurse nor fail


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cn", "Co"), max_codepoint=0x2FFF), max_size=20), min_size=1, max_size=20))
def test_strip_of_any_text(spark, cases):
    assert values(spark, text.pystrip(F.col("s")), cases) == [x.strip() for x in cases]
    assert all(re.fullmatch(r"\S+", w) for ws in values(spark, text.words(F.col("s")), cases) for w in ws)


def test_nfkc_of_stable_and_other_texts(spark):
    """Stable characters are left alone, one by one and side by side; all others come out as in Python."""
    inside = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", unicode.STABLE) + "]")
    stable = [c for c in map(chr, range(0x2000)) if inside.match(c)]
    assert len(stable) == 436 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)
    assert unicodedata.normalize("NFKC", "".join(stable)) == "".join(stable) and unicodedata.normalize("NFKC", "".join(stable[::-1])) == "".join(stable[::-1])
    texts = ["".join(stable[1:]), "plain", "", None, "e\u0301", "\ufb01ne", "x\u00a0y", "\u1100\u1161", "Ti\u00ea\u0301ng Vi\u1ec7t", "\u0133", "\u2460"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", unicode.nfkc("t").alias("t")).orderBy("i").collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
