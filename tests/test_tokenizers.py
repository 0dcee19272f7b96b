import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import marking
from millrace.operators import metrics, tokenizers as Z

LINES = ["the cat sat on the mat", "the  hat, the bat", "cats and hats", "", "  ", None, "a,,b ... the the the", "the⟂cat"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES * 3], "line string")


@pytest.fixture(scope="module")
def words(lines):
    return Z.word_counts(lines).cache()


def slow_bpe(words, room, join, first):
    """The definition: count all pairs anew for each merge."""
    tokens, merges = [], []
    words = [(first(w), n) for w, n in words]
    counts = Counter()
    for s, n in words:
        for x in s:
            counts[x] += n
    tokens = sorted(counts, key=lambda x: (-counts[x], x))[:room]
    while len(tokens) < room:
        pairs = Counter()
        for s, n in words:
            for p in zip(s, s[1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        new = join(*best)
        merges.append(best)
        if new not in tokens:
            tokens.append(new)
        out = []
        for s, n in words:
            t, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == best:
                    t.append(new)
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            out.append((t, n))
        words = out
    return tokens, merges


def test_words_and_pairs(lines, words):
    want = Counter()
    for x in LINES * 3:
        x = " ".join((x or "").strip().split("\n")).replace(",,", ",").replace("...", ".")
        if x:
            want.update("▁" + w for w in x.split(" "))
    assert {r.word: r.n for r in words.collect()} == want
    pairs = Counter()
    for w, n in want.items():
        for p in zip(w, w[1:]):
            pairs[p] += n
    assert {(r.left, r.right): r.n for r in Z.pair_counts(words).collect()} == pairs


@pytest.mark.parametrize("family", ["bpe", "bert"])
def test_merges_follow_the_definition(words, family):
    held = sorted((r.word, r.n) for r in words.collect())
    model = Z.train(family, words, 45, unused=2)
    if family == "bpe":
        tokens, merges = slow_bpe(held, 45 - 7, lambda a, b: a + b, list)
    else:
        tokens, merges = slow_bpe(held, 45 - 7, lambda a, b: a + b.removeprefix("##"), lambda w: [w[0], *("##" + c for c in w[1:])])
    assert model.tokens == ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "[unused0]", "[unused1]", *tokens]
    assert list(model.merges) == merges


@pytest.mark.parametrize("family, options", [("bpe", {}), ("bert", {}), ("bert", {"score": "likelihood"})])
def test_words_dealt_over_tasks_give_the_same_merges(spark, monkeypatch, family, options):
    rng = random.Random(4)
    words = spark.createDataFrame([("▁" + "".join(rng.choices("aaabbcdé😀", k=rng.randrange(9))) + str(i % 7), 1 + i % 5) for i in range(400)], "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    alone = Z.train(family, words, 80, unused=2, **options)
    monkeypatch.setattr(Z, "DRIVER_SYMBOLS", 0)
    monkeypatch.setattr(Z, "TASK_WORDS", 100)
    assert Z.train(family, words, 80, unused=2, **options) == alone and len(alone.merges) > 50
    assert Z.train(family, words, 12, unused=2, **options) == Z.Model(family, dict(list(alone.vocab.items())[:12]))


def test_likelihood_prefers_what_stands_together(spark):
    words = spark.createDataFrame([("ab", 9), ("ac", 9), ("qz", 2)], "word string, n long")
    first = Z.train_wordpiece(words, 12, unused=1, score="likelihood").merges[0]
    assert first == ("q", "##z")
    with pytest.raises(ValueError):
        Z.train_wordpiece(words, 12, score="other")
    with pytest.raises(ValueError):
        Z.train("other", words)
    with pytest.raises(ValueError):
        Z.train_bpe(words, 12, most=2)


def test_expectation_is_over_all_segmentations(spark):
    scores = {"a": math.log(0.2), "b": math.log(0.3), "ab": math.log(0.4), "ba": math.log(0.1)}
    word, n = "aabba", 3
    want, total = Counter(), 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in scores for p in parts):
            p = math.exp(sum(scores[x] for x in parts))
            total += p
            for x in parts:
                want[x] += p
    got = {r.piece: r.n for r in Z.expected_counts(spark.createDataFrame([(word, n)], "word string, n long"), scores).collect()}
    assert got == pytest.approx({k: n * v / total for k, v in want.items()})
    best = max(([word[a:b] for a, b in zip(e, e[1:])] for c in itertools.product([0, 1], repeat=4) for e in [[0, *(i + 1 for i, x in enumerate(c) if x), 5]]), key=lambda ps: sum(scores.get(p, -99) for p in ps))
    assert sum(scores[p] for p in Z.viterbi(word, scores)) == pytest.approx(sum(scores[p] for p in best))


@pytest.mark.parametrize("family", Z.FAMILIES)
def test_encode_decode_and_metrics(spark, lines, words, family, tmp_path):
    model = Z.train(family, words, 40, unused=2, **({"seed_size": 200} if family == "unigram" else {}))
    assert len(model.vocab) <= 40
    coder = Z.Encoder(model)
    coded = Z.encode(lines.where("line is not null"), model).distinct().collect()
    for r in coded:
        pieces = [] if not r.line.strip() else ["▁" + w for w in r.line.strip().replace(",,", ",").replace("...", ".").split(" ")]
        assert r.ids == [i for w in pieces for i in coder(w)]
        if family == "bpe":  # one endless word and a short one by the same rule
            for w in pieces:
                s = list(w)
                while True:
                    found = [(coder.rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in coder.rank]
                    if not found:
                        break
                    i = min(found)[1]
                    s[i : i + 2] = [s[i] + s[i + 1]]
                assert [model.vocab.get(x, 0) for x in s] == coder(w)
    stats = Z.evaluate(lines, model).first()
    full = [x for x in LINES * 3 if x and x.strip()]
    ids = [i for r in Z.encode(spark.createDataFrame([(x,) for x in full], "line string"), model).collect() for i in r.ids]
    assert stats.words == sum(len(x.split()) for x in full) and stats.tokens == len(ids)
    assert stats.fertility == pytest.approx(len(ids) / stats.words) and stats.oov_rate == pytest.approx(100 * ids.count(0) / len(ids))
    text = Z.decode(Z.encode(spark.createDataFrame([("the cat sat",)], "line string"), model), model).first().text
    assert text.replace("  ", " ") == "the cat sat"
    Z.save(spark, model, str(tmp_path / family))
    assert Z.load(spark, str(tmp_path / family)) == model
    again = Z.from_json(Z.as_json(model))
    assert (again.family, again.vocab, again.merges, again.scores) == (model.family, model.vocab, model.merges, model.scores)
    empty = Z.evaluate(lines.limit(0), model).first()
    assert (empty.words, empty.tokens, empty.fertility, empty.oov_rate) == (0, 0, 0.0, 0.0)


def test_endless_words():
    model = Z.Model("bpe", {"[UNK]": 0, "a": 1, "b": 2, "ab": 3, "abab": 4}, (("a", "b"), ("ab", "ab")))
    assert Z.Encoder(model)("ab" * 40_000) == [4] * 20_000
    piece = Z.Model("bert", {"[UNK]": 0, "a": 1, "##a": 2})
    assert Z.Encoder(piece)("aaa") == [1, 2, 2] and Z.Encoder(piece)("ab") == [0] and Z.Encoder(piece)("a" * 101) == [0]
    with pytest.raises(ValueError):
        Z.Encoder(Z.Model("bpe", {"a": 0}))


def test_templates_and_markers(spark):
    model = Z.Model("bpe", {t: i for i, t in enumerate([*Z.SPECIALS, "▁a", "⟂b", "▁⟂", "⟂"])}, (("▁", "a"), ("⟂", "b"), ("▁", "⟂")))
    row = spark.createDataFrame([([5, 6], [7])], "a array<int>, b array<int>")
    out = row.select(Z.templated("a", model).alias("one"), Z.templated("a", model, "b").alias("two"), Z.type_ids("a", "b").alias("kinds")).first()
    assert (out.one, out.two, out.kinds) == ([1, 5, 6, 2], [1, 5, 6, 2, 7, 2], [0, 0, 0, 0, 1, 1])
    usage = Z.marker_usage(spark.createDataFrame([("a⟂b ⟂ a⟂",)], "line string"), model).first()
    assert (usage.isolated, usage.fused) == (2, 1)
    assert model.relabelled({"xy": "b"}).vocab["⟂xy"] == 6
    assert marking.MARK == "⟂"


def test_mtld_against_its_definition(spark):
    def one(tokens):
        seen, count, factors = set(), 0, 0.0
        for t in tokens:
            seen.add(t)
            count += 1
            if len(seen) / count <= 0.72:
                factors, seen, count = factors + 1, set(), 0
        if count:
            factors += (1 - len(seen) / count) / (1 - 0.72)
        return len(tokens) / factors if factors else 0.0

    assert metrics.mtld_pass("a b a a c".split()) == one("a b a a c".split()) == 5.0
    rng = random.Random(1)
    rows = [(s, d, n, " ".join(rng.choices("abcdefg", k=rng.randrange(12)))) for s in "xyz" for d in range(6) for n in range(4)]
    got = {r.source: r.mtld for r in metrics.mtld(spark.createDataFrame(rows, "source string, doc_id long, line_no long, line string")).collect()}
    for s in "xyz":
        tokens = [t for r in sorted(rows) if r[0] == s for t in r[3].split()]
        assert got[s] == pytest.approx((one(tokens) + one(tokens[::-1])) / 2)


@pytest.mark.parametrize("head", [0, 3, 60, 4096])
def test_mtld_in_parts_is_the_fold(spark, head):
    rng = random.Random(2)
    kinds = {"a": lambda i: f"w{rng.randrange(40)}", "b": lambda i: f"w{i}", "c": lambda i: f"w{i if 300 < i < 900 else i % 3}", "d": lambda i: "same", None: lambda i: f"w{rng.randrange(400)}"}
    rows = [(s, d, 0, " ".join(make(9 * d + j) for j in range(9))) for s, make in kinds.items() for d in range(200)] + [("e", 0, 0, "")]
    got = {r.source: r.mtld for r in metrics.mtld(spark.createDataFrame(rows, "source string, doc_id long, line_no long, line string"), head=head).collect()}
    for s in (*kinds, "e"):
        tokens = [t for r in rows if r[0] == s for t in r[3].split()]
        assert got[s] == pytest.approx((metrics.mtld_pass(tokens) + metrics.mtld_pass(tokens[::-1])) / 2)


def test_hygiene_of_nothing(spark):
    lines = spark.createDataFrame([("s", 0, 0, "")], "source string, doc_id long, line_no long, line string")
    row = metrics.hygiene(lines).first()
    assert (row.total_lines, row.total_chars, row.contamination_rate, row.duplicate_ratio, row.invalid_line_rate) == (1, 0, 0.0, 0.0, 100.0)
    assert metrics.hygiene(lines.limit(0)).count() == 0
    assert lines.select(F.lit(1)).count() == 1


CONFIG = """
# a family
model_type: "wordpiece"
relabel_vocab_after_save: false   # not for this one

variants:
  - name: "01_metaspace_codepoint_bert"
    use_sandhi: false
    use_grapheme: false
  - name: '04_sandhi_grapheme_unigram'
    model_type: unigram
    relabel_vocab_after_save: true
    use_sandhi: true
    use_grapheme: true
"""


def test_configurations():
    from millrace.plans import config

    one, two = config.variants(CONFIG)
    assert one == {"model_type": "wordpiece", "relabel_vocab_after_save": False, "name": "01_metaspace_codepoint_bert", "use_sandhi": False, "use_grapheme": False}
    assert two["model_type"] == "unigram" and two["relabel_vocab_after_save"] is True
    assert config.variants(CONFIG, "04_sandhi_grapheme_unigram") == [two]
    assert config.variants('{"model_type": "bpe", "variants": [{"name": "x"}]}') == [{"model_type": "bpe", "name": "x"}]
    for text, only in ((CONFIG, "none"), ("model_type: x\nvariants:\n  - name: y", None), ("  a: 1", None), ("- a: 1", None), ("words", None)):
        with pytest.raises(ValueError):
            config.variants(text, only)


def test_a_configuration_is_learnt_from_the_command_line(spark, tmp_path, capsys):
    import json

    from millrace.__main__ import main

    (tmp_path / "c.yaml").write_text(CONFIG)
    (tmp_path / "t.txt").write_text("கி கீ கடவுள்அருள் கி\n" * 5)
    main(["train", "--config", str(tmp_path / "c.yaml"), "--train", str(tmp_path / "t.txt"), "--test", str(tmp_path / "t.txt"), "--out", str(tmp_path / "out"), "--vocab-size", "1030", "--sample", "கி"])
    reports = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [r["variant"] for r in reports] == ["01_metaspace_codepoint_bert", "04_sandhi_grapheme_unigram"]
    assert all(r["unknown"] == 0 and r["sample_text"]["raw"] == "கி" for r in reports)
    assert json.loads((tmp_path / "out" / "01_metaspace_codepoint_bert" / "metrics.json").read_text())["fertility"] == reports[0]["fertility"]
    tokens = Z.from_json((tmp_path / "out" / "04_sandhi_grapheme_unigram" / "tokenizer.json").read_text()).vocab
    assert not any(0xE000 <= ord(c) < 0xF900 for t in tokens for c in t)  # put back
    main(["queries"])
    assert "hygiene_by_source" in capsys.readouterr().out.split()


def test_a_published_tokenizer_is_measured_alike(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["the cat sat", "", None, "  ", "on the mat, on the mat", "x" * 50]
    path = public.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    tokens = sum(len(model.encode(t.strip(), add_special_tokens=False).ids) for t in texts if t and t.strip())
    got = Z.evaluate_other(spark.createDataFrame([(t,) for t in texts], "line string"), path).first()
    assert (got.words, got.tokens, got.unknown) == (10, tokens, 0) and got.fertility == pytest.approx(tokens / 10)
    assert tuple(Z.evaluate_other(spark.createDataFrame([], "line string"), path).first()) == (0, 0, 0, 0.0, 0.0)


def test_metrics_of_distinct_words_are_those_of_the_lines(spark):
    lines = spark.createDataFrame([(t,) for t in (None, "", "  ", "the cat,, the\tcat", "a\u0085b  the", " the\u2003x é", "x" * 120, "\u001cthe..")], "line string")
    words = Z.word_counts(lines)
    for family in Z.FAMILIES:
        model = Z.train(family, words, 40, unused=0)
        small = Z.Model(family, {t: i for i, t in enumerate(model.tokens[:12])}, model.merges, {t: s for t, s in model.scores.items() if t in model.tokens[:12]})
        for m in (model, small):
            assert Z.evaluate_counts(words, m).first() == Z.evaluate(lines, m).first()
    assert Z.evaluate_counts(words.limit(0), model).first() == Z.evaluate(lines.limit(0), model).first()


def test_a_written_table_of_words_is_dealt_over_tasks(spark, tmp_path):
    spark.range(5000).selectExpr("concat('w', id) AS word", "id + 1 AS n").coalesce(1).write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    assert words.rdd.getNumPartitions() == 1
    dealt = Z._spread(words)
    assert dealt.rdd.getNumPartitions() == min(5, Z._slots(spark)) and dealt.count() == 5000
    assert Z._spread(words.limit(10)).rdd.getNumPartitions() == 1


def test_variants_share_their_tables_of_words(spark, monkeypatch):
    made = []
    counts = Z.word_counts
    monkeypatch.setattr(Z, "word_counts", lambda lines: made.append(1) or counts(lines))
    assert catalog.queries()["grid_reports"](spark, "/root/testdata/sf0.001").count() == 12
    assert len(made) == 4
