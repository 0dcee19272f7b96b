import pytest
from pyspark.sql import functions as F

from millrace.operators import modeldata as N, tokenizers as Z

MODEL = Z.Model("bpe", {t: i for i, t in enumerate([*Z.SPECIALS, *map(chr, range(97, 123))])})


def cut(a, b, room):
    a, b = list(a), list(b)
    while len(a) + len(b) > room:
        (a if len(a) > len(b) else b).pop()
    return a, b


def test_longest_first(spark):
    pairs = [(list(range(x)), list(range(y))) for x in range(9) for y in range(9)]
    for room in (5, 6):
        df = spark.createDataFrame(pairs, "a array<int>, b array<int>")
        one, two = N.longest_first("a", "b", room)
        for r in df.select("a", "b", one.alias("x"), two.alias("y")).collect():
            assert (r.x, r.y) == cut(r.a, r.b, room), (r.a, r.b)


def test_rows_pairs_padding(spark):
    rows = spark.createDataFrame([(0, [5] * 9, "t"), (0, [6], "u")], "batch long, ids array<int>, text string")
    out = N.padded(N.model_rows(rows, MODEL, 6), MODEL).orderBy(F.size("input_ids")).collect()
    assert sorted(r.input_ids for r in out) == [[1, 5, 5, 5, 5, 2], [1, 6, 2, 3, 3, 3]]
    assert sorted(sum(r.attention_mask) for r in out) == [3, 6] and "text" not in out[0].asDict()
    pair = N.pair_rows(spark.createDataFrame([([5] * 9, [6] * 9)], "ids1 array<int>, ids2 array<int>"), MODEL, limit=8).first()
    assert pair.input_ids == [1, 5, 5, 5, 2, 6, 6, 2] and pair.num_tokens == 8 and pair.truncated


def test_masking(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(9), 50), F.array(F.lit(2))).alias("input_ids"))
    once, again = N.masked(rows, MODEL).orderBy("doc_id").collect(), N.masked(rows.repartition(3), MODEL).orderBy("doc_id").collect()
    assert once == again and once != N.masked(rows, MODEL, epoch=1).orderBy("doc_id").collect()
    kinds = {"mask": 0, "same": 0, "other": 0}
    for r in once:
        assert r.input_ids[0] == 1 and r.input_ids[-1] == 2 and r.labels[0] == r.labels[-1] == -100
        for x, y in zip(r.input_ids, r.labels):
            if y == -100:
                assert x in (1, 2, 9)
            else:
                kinds["mask" if x == 4 else "same" if x == 9 else "other"] += 1
    total = sum(kinds.values())
    assert 0.13 < total / 20_000 < 0.17 and 0.75 < kinds["mask"] / total < 0.85 and 0.06 < kinds["same"] / total < 0.16


def test_schedule():
    assert N.schedule(65, 16, 4, 2) == {"steps_per_epoch": 2, "total_steps": 4, "warm_up_steps": 0}


def test_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0), (1, 1)], "y int, p int")
    r = N.classification_metrics(df, "y", "p").first()
    assert r.accuracy == 0.6 and r.f1_0 == 0.5 and r.f1_1 == pytest.approx(4 / 6) and r.f1_2 == 0.0
    assert r.macro_f1 == pytest.approx((0.5 + 4 / 6) / 3)
    assert N.classification_metrics(df.limit(0), "y", "p").first().accuracy == 0.0
    logits = spark.createDataFrame([([0.1, 0.9, 0.9],), ([3.0],)], "x array<double>")
    assert [r[0] for r in logits.select(N.argmax("x")).collect()] == [1, 0]


def test_logs(spark):
    rows = [(1, 3.0), (2, None), (3, 2.0), (4, 2.5), (5, 2.0), (6, 1.0)]
    h = spark.createDataFrame([("r", 1.0, s, x) for s, x in rows], "run string, best_metric double, step long, eval_loss double")
    assert N.best_evaluation(h).first() == (1.0, 6)
    assert [r.step for r in N.last_evaluations(h, 2).collect()] == [6, 5]
    assert [r.step for r in N.evaluations(h).where("best").collect()] == [6]
    run = N.running_best(h.where("eval_loss is not null"), "eval_loss", "step", "run", patience=2).orderBy("step").collect()
    assert [(r.best, r.since_best, r.stopped) for r in run] == [(3.0, 0, False), (2.0, 0, False), (2.0, 1, False), (2.0, 2, True), (1.0, 0, True)]


def test_pairs_and_vectors(spark):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "a")], "conv_id long, turn long, text string")
    pairs = N.turn_pairs(turns)
    assert sorted((r.sentence1, r.sentence2) for r in pairs.collect()) == [("a", "b"), ("b", "c")]
    held = spark.createDataFrame([("a", "b")], "sentence1 string, sentence2 string")
    assert [r.sentence1 for r in N.without_pairs(pairs, held).collect()] == ["b"]
    words = spark.createDataFrame([("(a), [b]. a: ...",), (None,)], "t string")
    assert sorted(r.token for r in N.bare_words(words, "t").collect()) == ["a", "b"]
    vectors = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, None), (4, [float("inf")]), (5, [None])], "i int, embedding array<double>")
    assert sorted(r.i for r in N.unsound_vectors(vectors).collect()) == [2, 3, 4, 5]


def test_similarity(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0]), ([], [])], "v array<array<double>>, m array<int>")
    got = df.select(N.mean_pooled("v", "m").alias("a"), N.mean_pooled("v").alias("b")).collect()
    assert [r.a for r in got] == [[2.0, 3.0], None, None] and got[1].b == [1.0, 1.0]
    pairs = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in pairs.select(N.cosine("a", "b")).collect()] == [0.96, 0.0]
    ties = spark.createDataFrame([(1, 5.0), (2, 5.0), (2, 7.0), (3, None), (9, 8.0)], "x int, y double")
    assert {r.x: r["rank"] for r in N.ranks(ties, "x").collect()} == {1: 1.0, 2: 2.5, 3: 4.0, 9: 5.0}
    assert N.spearman(ties, "x", "y").first() == (pytest.approx(0.833333, abs=1e-6), 4)
