"""Column functions on inline rows, each expected value from the rule itself."""

import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import text as T
from millrace.operators import corpus
from millrace.profiles import LATIN, TAMIL


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f("t").alias("v")).first()[0]


@pytest.mark.parametrize(
    ("text", "f", "expected"),
    [
        ("கி.மீ abc 3.14 , x!", lambda c: T.extract_words(c, TAMIL), ["கி.மீ", "3.14", ",", "!"]),
        ("அ . ஆ", lambda c: T.extract_words(c, TAMIL), ["அ", "ஆ"]),
        ("கxக", lambda c: T.extract_words(c, TAMIL), ["க", "க"]),
        ("கxக", lambda c: T.extract_words(c, TAMIL, fuse=True), ["கக"]),
        ("it is e.g. 3.5 % | x", T.extract_words, ["it", "is", "e.g", "3.5", "%", "x"]),
        (None, T.extract_words, []),
        ("[[A|அ]] [[ஆ]]", T.clean_wiki, "அ ஆ"),
        ("[https://e.com அ][https://e.com]", T.clean_wiki, "அ"),
        ("{{a{{b}}c}}அ", T.clean_wiki, "அ"),
        ('<ref name="x"/>அ<ref>b</ref>ஆ', T.clean_wiki, "ஆ"),
        ("'''அ''' <!-- x\ny --> <b>ஆ</b>", T.clean_wiki, "அ  ஆ"),
        ("== அ ==\nஆ", T.clean_wiki, "அ\nஆ"),
        (None, T.clean_wiki, ""),
        ("x[[a|]]y[[]]z[[|b]]", T.clean_wiki, "xyzb"),
        ("[http://a]b [c]", T.clean_wiki, "[c"),
        ("[http://a b]c [https://d ]e", T.clean_wiki, "bc e"),
        ("x\n\n==\ny", T.clean_wiki, "x\ny"),
        ("a '''@b'' c", T.clean_wiki, "a @b c"),
        ("see https://a.b/c d &amp; e &#65; f &#x41; g", T.clean_web, "see d e f g"),
        ("x https://a.b/c y", T.clean_web, "x y"),
        ("write me@x.org now", T.literary_words, ["write", "now"]),
        ("a@b.co.uk;நான்", lambda c: T.literary_words(c, TAMIL), ["நான்"]),
        ("(க@x.com,உண்டு)", lambda c: T.literary_words(c, TAMIL), ["க", ",", "உண்டு"]),
        ("p@q.rs_t@u.vw x@y.1 @z.com", T.literary_words, ["x", "y", "1", "z.com"]),
        ("a. b! c\n\nd", T.chunks, ["a.", "b!", "c", "d"]),
        ("a b c d\u0085e\u001cf", T.tokens, ["a", "b", "c", "d", "e", "f"]),
        (" \u001c a  ", T.strip, "a"),
        ("அ 1 2 3", lambda c: T.content_ratio(c, TAMIL), 0.25),
        ("", T.content_ratio, 0.0),
        ("அ(b)", lambda c: T.disallowed_chars(c, TAMIL), 3),
        ("a1,+ b", T.non_alpha_chars, 3),
        ("ி", T.orphaned_mark, True),
        ("க ி", T.orphaned_mark, True),
        ("கி", T.orphaned_mark, False),
        ("க‌ி", T.orphaned_mark, True),
        ("� ி", T.anomaly, "replacement char"),
        ("a ி", T.anomaly, "orphaned mark"),
        ("abc", T.anomaly, None),
        (",,, ... '' -- !!", T.collapse_punctuation, ", . ' - !!"),
        ("a , b . c !", T.tighten_punctuation, "a, b. c!"),
        ("é", T.nfc, "é"),
        ("  é,, ", T.normalise, "é,"),
        ("க்ஷ", T.graphemes, ["க்", "ஷ"]),
        ("அ ிக", lambda c: F.transform(T.graphemes(c), F.length), [1, 2, 1]),
        ("அ", lambda c: T.has_script(c, TAMIL), True),
        ("அ", T.has_script, False),
    ],
)
def test_functions(spark, text, f, expected):
    assert value(spark, text, f) == expected


def test_white_space_is_that_of_python(spark):
    chars = [chr(i) for i in [*range(0x21), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    rows = spark.createDataFrame([(c, f"a{c}b") for c in chars], "c string, t string").select("c", F.size(T.tokens("t")).alias("n"), F.length(T.strip(F.concat("c", F.lit("a"), "c"))).alias("m"))
    for c, n, m in rows.collect():
        assert n == len(f"a{c}b".split()), hex(ord(c))
        assert m == len(f"{c}a{c}".strip()), hex(ord(c))


def test_threshold_is_below_when_less(spark):
    lines = spark.createDataFrame([("s", 0, "அ 1 2"), ("s", 1, "அ 1 2 3"), ("s", 2, "")], "source string, line_no long, line string")
    got = corpus.route_ratio(lines, TAMIL).orderBy("line_no").collect()
    assert [r["verdict"] for r in got] == ["above", "below", "below"]
    assert LATIN.name == "latin"


ODD = [None, "", " ", "\u001c\u0085　", "கி.மீ abc 3.14 , x!", "அ . ஆ", "கxக", "a.b..c. .d 1.2.3 \"'-%", "அ b\u001dஆ1.5கd", "ÿé×÷ß", "𝒜 अ é é ௦௧ 12௦", "அ" * 200 + "x." + "1" * 200, "x" * 5000, "a\rb\x0bc​d e﻿\x00f", "cat dog cat cat dog"]


@pytest.mark.parametrize("profile", [TAMIL, LATIN])
def test_words_and_ratio_are_those_of_the_functions(spark, profile):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = rows.select("t", T.words_and_ratio("t", profile).alias("f"), T.joined(T.extract_words("t", profile)).alias("words"), T.content_ratio("t", profile).alias("ratio")).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert tuple(r.f) == (r.words, r.ratio), r.t


def test_tokens_are_remembered_within_bounds(monkeypatch):
    known, long = T._Tokens(TAMIL, str.maketrans({"d": "கள்"})), "d" * 65
    first = {"d1x", "x", long}
    known.meet(first)
    assert known.words == {"d1x": "கள் 1", "x": "", long: "கள்" * 65} and known.real == {"d1x", long}
    known.forget(first)
    assert known.words == {"d1x": "கள் 1", "x": ""} and known.real == {"d1x"}
    monkeypatch.setattr(known, "strip", None)  # what is known isn't looked at again
    with pytest.raises(AttributeError):
        known.meet({"y"})
    monkeypatch.undo()
    monkeypatch.setattr(T, "REMEMBERED", 1)
    known.meet({"d"})
    assert known.words == {"d": "கள்"} and known.real == {"d"}
    known.meet(set())
    assert known.words == {"d": "கள்"}


def test_a_line_is_shown_and_split_once(spark, sf):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert plan(catalog.queries()["tamil_words"](spark, sf)).count("translate(") <= 1
    assert plan(spark.createDataFrame([("a",)], "t string").select(T.content_ratio("t").alias("r"))).count("split(coalesce(t") == 1


def test_tamil_letters_are_the_same_in_python(spark):
    text = "aeioukctpnmrlysd is SAD ஸ"
    assert value(spark, text, catalog._tamil) == text.translate(catalog._TO_TAMIL)
