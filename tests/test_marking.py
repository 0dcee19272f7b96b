import random

from pyspark.sql import functions as F

from millrace.functions import marking as M

CHARS = "அஆஇஈஉஐகளல்்ிுாகதடப 1௧aé \u001c"
WORDS = ["கள்", "இல்", "வடக்கு", "கண்", "உடன்", "ஆம் நாள்", "மற்று", "த்து", "கொள்", "இந்த"]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_cuts_are_united_over_rules_on_the_source(spark):
    rows = _frame(spark, ["கடவுள்அருள்", "கடவுள் அருள்", "இஇஇ", "", None, "plain", "இந்த பள்ளி"])
    got = {r.t: r.c for r in rows.select("t", M.boundaries("t").alias("c")).collect()}
    assert got == {"கடவுள்அருள்": [6], "கடவுள் அருள்": [], "இஇஇ": [1], "": [], None: [], "plain": [], "இந்த பள்ளி": []}
    marked = {r.t: r.m for r in rows.select("t", M.mark("t").alias("m"), M.mark("t", F.lit("en")).alias("e")).collect()}
    assert marked["கடவுள்அருள்"] == "கடவுள்⟂அருள்" and marked["கடவுள் அருள்"] == "கடவுள் அருள்"
    assert rows.where(M.mark("t", F.lit("en")) != F.coalesce("t", F.lit(""))).count() == 0


def test_two_implementations_agree_and_marks_come_off(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(WORDS) if rng.random() < 0.3 else rng.choice(CHARS) for _ in range(rng.randrange(30))) for _ in range(600)]
    rules = M.CORE + M.AGGRESSIVE
    rows = _frame(spark, texts).select("t", M.boundaries("t", rules).alias("a"), M.built_in_boundaries("t", rules).alias("b"), M.unmark(M.mark("t", None, rules)).alias("back"), M.spans("t", rules).alias("spans"))
    for r in rows.collect():
        assert r.a == r.b, r.t
        assert r.back == r.t
        assert "".join(s.token for s in r.spans) == r.t
        assert all(r.t[s.start : s.end] == s.token for s in r.spans)


def test_all_doubled_consonants_are_cut(spark):
    text = " ".join(f"{c}்{c}" for c in "கஙசஞடணதநபமயரலவழளறன")
    got = _frame(spark, [text, "க்க ச்ச ல்ல ன்ன ம்ம"]).select("i", M.boundaries("t", M.AGGRESSIVE).alias("c")).orderBy("i").collect()
    assert got[0].c == [4 * k + 2 for k in range(18)] and got[1].c == [2, 6, 10, 14, 18]


def test_a_long_line_is_linear(spark):
    text = "கடவுள்அருள் " * 40_000
    got = _frame(spark, [text]).select(F.length(M.mark("t")).alias("n")).first().n
    assert got == len(text) + 40_000


def test_placeholders_round_trip(spark):
    lines = spark.createDataFrame([("கிகீ க்ஷ",), ("plain",), ("",)], "line string")
    table = M.placeholder_map(lines)
    assert list(table) == sorted(table) and all(len(k) > 1 for k in table)
    shown = lines.select("line", M.substitute("line", table).alias("s"))
    for r in shown.select("line", "s", M.restore("s", table).alias("back")).collect():
        assert r.back == r.line
        assert len(r.s.split()) == len(r.line.split())


def test_variants(spark):
    import pytest

    assert len(M.variants()) == 12 and list(M.variants("01_metaspace_codepoint_bpe")) == ["01_metaspace_codepoint_bpe"]
    with pytest.raises(ValueError):
        M.preprocessor("none of these")
    rows = _frame(spark, ["கடவுள்அருள்"])
    plain, both = M.preprocessor("01_metaspace_codepoint_bpe"), M.preprocessor("04_sandhi_grapheme_unigram", {"வு": ""})
    saved = M.preprocessor("04_sandhi_grapheme_unigram", {"வு": ""}, saved=True)
    assert rows.select(plain("t").alias("a"), both("t").alias("b"), saved("t").alias("c")).first() == ("கடவுள்அருள்", "கடள்⟂அருள்", "கடவுள்⟂அருள்")


def test_table_functions(spark):
    from millrace.functions import tables

    tables.register(spark)
    got = spark.sql("SELECT token, start, end FROM boundary_spans('கடவுள்அருள் x')").collect()
    assert [tuple(r) for r in got] == [("கடவுள்", 0, 6), ("அருள்", 6, 11), (" ", 11, 12), ("x", 12, 13)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM html_lines('<body><p>a</p>b<!-- c --></body>')").collect()] == [(0, "a"), (1, "b")]
    assert spark.sql("SELECT * FROM boundary_spans(cast(null as string))").count() == 0


def test_equal_runs_are_cut_as_the_text_is_and_pieces_tile_it():
    rng = random.Random(5)
    texts = ["".join(rng.choice(WORDS) if rng.random() < 0.4 else rng.choice(CHARS + "😀.") for _ in range(rng.randrange(25))) for _ in range(2000)] + [""]
    for rules in (M.CORE, M.AGGRESSIVE, M.CORE + M.AGGRESSIVE):
        cuts, patterns = M.cutter(rules), [M._python(r) for r in rules]
        assert [cuts(t) for t in texts] == [sorted({m.start("r") for p in patterns for m in p.finditer(t)}) for t in texts]
        got = M._tiled(texts, cuts).to_pylist()
        assert [[(x["token"], x["start"], x["end"]) for x in one] for one in got] == [M.pieces(t, cuts(t)) for t in texts]
