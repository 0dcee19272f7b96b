import binascii
import math

import numpy as np
import pytest

from millrace.llm import arrays as A, ctw, quality_model, toxicity

from . import cases

LABELLED = "/root/testdata/sf0.01"


def remainder(i, mod):
    return binascii.crc32(str(i).encode()) % mod


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1.0
    for v in np.unique(s):
        order[s == v] = order[s == v].mean()
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("model", "label", "mod", "out", "least"), [(quality_model, "quality", 5, 0, 0.9), (toxicity, "toxic", 4, 2, 0.8)])
def test_held_out_rows(spark, model, label, mod, out, least):
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    got = model.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [remainder(i, mod) == out for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    assert auc(both[label].to_numpy(), both.score.to_numpy()) > least


@pytest.mark.parametrize(("model", "label"), [(quality_model, "quality"), (toxicity, "toxic")])
def test_edges_of_classifiers(spark, model, label):
    docs = cases.edge(spark)
    schema = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, 1, "clash"), (1, 1, 1, "clash"), (2, 0, 0, None), (5, None, None, ""), (None, 1, 1, ""), (7, 0, 0, ""), (6, 1, 1, ""), (9, 1, 1, "")], schema)
    got = model.classify(docs, labels)
    cases.same_ids(got)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert model.classify(cases.empty(spark), labels).count() == 0
    assert model.classify(docs, labels.limit(0)).count() == len(cases.TEXTS)
    assert {r.score for r in model.classify(docs, labels.where("quality = 1")).collect()} == {1.0} or label == "toxic"


def test_attention_gradients_lower_the_loss():
    rng = np.random.default_rng(1)
    good, bad = (" ".join(rng.choice(w, 200)) for w in (["plain", "words", "here"], ["##", "!!", "$$$"]))
    model = quality_model.fit([good, good + " x", bad, bad + " y"] * 5, [1, 1, 0, 0] * 5, {1: 10, 0: 10})
    x, owner = quality_model.passages(*A.flat(__import__("pyarrow").array([good, bad, ""])))
    s = model.score(x, owner, 3)
    assert s[0] > 0.9 and s[1] < 0.1 and 0 <= s[2] <= 1


def slow_kernel(x, y):
    """Common three-letter subsequences, each weighted by 0.7 to the stretch in either, over at most eleven characters."""

    def vector(s):
        code = lambda c: ord(c) - 96 if c.isascii() and c.isalpha() else 0
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + 11)):
                    if code(s[i]) and code(s[j]) and code(s[k]):
                        t = (s[i], s[j], s[k])
                        out[t] = out.get(t, 0) + 0.7 ** (k - i + 1)
        return out

    u, v = vector(x), vector(y)
    return sum(w * v.get(t, 0) for t, w in u.items()) / math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in v.values()))


def test_kernel_tolerates_gaps():
    for x, y in (("idiot", "id*iot"), ("idiot", "i d i o t"), ("idiot", "patriot"), ("abcabc", "cabcab")):
        assert toxicity.kernel(x, y) == pytest.approx(slow_kernel(x, y))
    assert toxicity.kernel("idiot", "i-d-i-o-t") > toxicity.kernel("idiot", "wonder")


def slow_ctw(train, texts, depth):
    """Counts in dictionaries, weights by the recursion, mixtures as they are defined."""
    counts = {}
    strings = lambda t: [(bytes(depth) + t + b"\0")[i : i + depth + 1] for i in range(len(t) + 1)]
    for t in train:
        for g in strings(t):
            for d in range(depth + 1):
                for j in range(8):
                    key = (g[depth - d : depth], (1 << j) | (g[-1] >> (8 - j)))
                    counts.setdefault(key, [0, 0])[(g[-1] >> (7 - j)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}
    for d in range(depth, -1, -1):
        for (c, node), (a, b) in counts.items():
            if len(c) == d:
                own = kt(a, b)
                if d == depth:
                    weighted[c, node] = own
                else:
                    below = sum(weighted[e] for x in range(256) if (e := (bytes([x]) + c, node)) in counts)
                    weighted[c, node] = np.logaddexp(own, below) - math.log(2)

    def one(c, node, bit):
        if (c[len(c) :], node) not in counts:
            return 0.5
        d = max(d for d in range(depth + 1) if (c[len(c) - d :], node) in counts)
        p = None
        for e in range(d, -1, -1):
            key = (c[len(c) - e :], node)
            a, b = counts[key]
            est = ((a, b)[bit] + 0.5) / (a + b + 1)
            share = 1.0 if p is None else math.exp(kt(a, b) - weighted[key] - math.log(2))
            p = est if p is None else share * est + (1 - share) * p
        return p

    return [sum(math.log10(one(g[:-1], (1 << j) | (g[-1] >> (8 - j)), (g[-1] >> (7 - j)) & 1)) for g in strings(t) for j in range(8)) for t in texts]


@pytest.mark.parametrize(("chunk_bytes", "subtree"), [(1 << 20, 1 << 20), (40, 3), (7, 1)])
def test_context_trees_against_the_recursion(spark, chunk_bytes, subtree):
    texts = ["abracadabra", "the cat sat on the mat", "The  cat\nThe CAT", None, "", "zzz été \U0001f600", "the mat", "abra", "cadabra the", "on on on", "cat", "x y z"]
    got = {r.doc_id: r for r in ctw.scores(cases.plain(spark, texts), 4, chunk_bytes, subtree).collect()}
    raw = [(t or "").encode() for t in texts]
    held = [remainder(i, 7) == 2 for i in range(len(texts))]
    assert any(held) and [got[i].held_out for i in range(len(texts))] == held
    want = slow_ctw([t for t, h in zip(raw, held) if not h], raw, 4)
    words = [[w.lower() for w in t.decode().split()] + [None] for t in raw]
    counts = {}
    for ws, h in zip(words, held):
        for w in ws if not h else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ws in enumerate(words):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert r.score == pytest.approx(want[i], rel=1e-6), texts[i]
        assert r.bits_per_byte == pytest.approx(-want[i] * math.log2(10) / (len(raw[i]) + 1), rel=1e-6)


def test_chunks_hold_what_they_may():
    assert ctw._dealt([3, 4, 5, 0, 30, 2, 9], 10) == ([0, 0, 1, 1, 2, 5, 6], [1, 1, 1, 1, 3, 1, 1])
    assert ctw._dealt([0], 10) == ([0], [1]) and ctw._dealt([25], 10) == ([0], [3])


def test_one_identifier_may_have_many_chunks(spark):
    docs = spark.createDataFrame([(7, f"text number {i} of many") for i in range(40)] + [(None, "x y z")] * 5, "doc_id long, text string")
    chunked, chunks = ctw._chunked(docs, 100)
    assert chunked.where(f"chunk < 0 or chunk >= {chunks}").isEmpty()
    assert chunked.select("chunk").distinct().count() > 5 and chunked.count() == 45
    got = sorted(tuple(r) for r in ctw.scores(docs, 4, 100).where("doc_id = 7").select("n_tokens", "base_score", "score").collect())
    want = sorted(tuple(r) for r in ctw.scores(docs, 4).where("doc_id = 7").select("n_tokens", "base_score", "score").collect())
    assert len(got) == 40 and [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose(got, want, rtol=1e-6)


def test_context_tree_edges(spark):
    got = ctw.scores(cases.edge(spark))
    cases.same_ids(got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.collect())
    assert ctw.scores(cases.empty(spark)).count() == 0
    alone = next(i for i in range(99) if remainder(i, 7) == 2)
    r = ctw.scores(cases.plain(spark, ["ab"], alone)).first()
    assert r.train_tokens == 0 and r.score == pytest.approx(3 * math.log10(1 / 256)) and r.base_score == 0


def test_a_slab_scores_as_each_document_alone():
    rng = np.random.default_rng(9)
    words = ["a", "I", "i", "d", "o", "t", "é", "x9idiot", "7cruel", "word", "-", "y" * 50, " ", "\n", "3", "ab-", ""]
    texts = ["you i d i o t", "A day", "x b", "i d i o t you", "", "see x9idiot", "Apple", *(" ".join(rng.choice(words, rng.integers(0, 15))) for _ in range(400))]
    machine = toxicity.Machine(rng.normal(size=toxicity.CODES), (0.1, 1.0, 0.5), -2.0, 0.1)

    def units_and_chances(some):
        raw = [t.encode() for t in some]
        buf, offs = toxicity._FOLD[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum([0, *map(len, raw)])
        a, b, doc = toxicity.units(buf, offs)
        found = [sorted(buf[i:j].tobytes() for i, j, d in zip(a, b, doc, strict=True) if d == k) for k in range(len(some))]
        return found, machine.probability(machine.features(doc, machine.values(buf, a, b), len(some)))

    found, chances = units_and_chances(texts)
    alone = [units_and_chances([t]) for t in texts]
    assert b"i d i o t" in found[0] and b"i d i o t" in found[3] and b"idiot" in found[5]
    assert found == [f[0] for f, _ in alone]
    assert chances == pytest.approx([p[0] for _, p in alone])


def test_a_bounded_sample_keeps_both_classes(spark, monkeypatch):
    from millrace.llm import samples

    monkeypatch.setattr(samples, "BYTES", 4000)
    docs = cases.plain(spark, ["x" * 100] * 200)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(200)], "doc_id long, toxic int")
    bodies, marks, _ = samples.labelled(docs, labels, "toxic", 4, 2)
    assert len(bodies) == 40 and sum(marks) == 20
    huge = cases.plain(spark, ["x" * 9000, *["y" * 100] * 199])
    assert set(samples.labelled(huge, labels, "toxic", 4, 2)[1]) == {0, 1}


def test_attention_scores_by_hand(spark):
    """Scores of the query's own way against gates, shares and sums in plain loops, a document at a time."""
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(*quality_model.labelled(docs, labels, "quality", *quality_model.HELD_OUT))
    some = docs.where("doc_id % 25 = 0").collect()
    assert max(len(r.text.split()) for r in some) > 3 * quality_model.PASSAGE
    got = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    p = {k: v.tolist() for k, v in model.p.items()}
    size = range(len(p["b"]))
    for r in some:
        x, owner = quality_model.passages(*A.flat(__import__("pyarrow").array([r.text])))
        words = r.text.split()
        assert len(owner) == max(1, -(-len(words) // quality_model.PASSAGE))
        for k, row in enumerate(x):
            part = words[k * quality_model.PASSAGE : (k + 1) * quality_model.PASSAGE]
            assert row[len(quality_model._SETS) + 1] == pytest.approx(len(set(part)) / max(1, len(part)))
        logits, codes = [], []
        for row in x.tolist():
            e = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(row, model.mean.tolist(), model.scale.tolist(), strict=True)]
            h = [math.tanh(sum(v * p["w"][i][j] for i, v in enumerate(e)) + p["b"][j]) for j in size]
            t = [math.tanh(sum(h[i] * p["v"][i][j] for i in size)) for j in size]
            s = [1 / (1 + math.exp(-sum(h[i] * p["u"][i][j] for i in size))) for j in size]
            logits.append(sum(t[j] * s[j] * p["a"][j] for j in size))
            codes.append(h)
        shares = [math.exp(v - max(logits)) for v in logits]
        z = [sum(w * h[j] for w, h in zip(shares, codes, strict=True)) / sum(shares) for j in size]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(sum(z[j] * p["c"][j] for j in size) + p["d"]))), abs=1e-6)


def test_string_kernel_scores_by_hand(spark):
    """Scores of the query's own way against subsequences listed in dictionaries, a document at a time."""
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit(*toxicity.labelled(docs, labels, "toxic", *toxicity.HELD_OUT))
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    high = sorted(got, key=lambda i: -got[i])
    texts = {r.doc_id: r.text for r in docs.collect()}
    code = lambda c: c - 96 if 97 <= c <= 122 else 27 + (c - 0x80 | 0x20) % 5 if 0x80 <= c < 0xC0 else 0
    for i in high[:8] + high[-8:] + high[len(high) // 2 :][:8]:
        if len(texts[i]) > 4000:
            continue
        buf = toxicity._FOLD[np.frombuffer(texts[i].encode(), np.uint8)]
        a, b, _ = toxicity.units(buf, np.array([0, len(buf)]))
        values = []
        for s in (buf[x:y].tolist() for x, y in zip(a.tolist(), b.tolist(), strict=True)):
            vector = {}
            for x in range(len(s)):
                for y in range(x + 1, len(s)):
                    for z in range(y + 1, min(len(s), x + 11)):
                        if code(s[x]) and code(s[y]) and code(s[z]):
                            t = code(s[x]) << 10 | code(s[y]) << 5 | code(s[z])
                            vector[t] = vector.get(t, 0) + 0.7 ** (z - x + 1)
            norm = math.sqrt(sum(w * w for w in vector.values()))
            values.append(sum(w * machine.weights[t] for t, w in vector.items()) / norm + machine.bias if norm else machine.floor)
        row = (1.0, max([machine.floor, *values]), math.log1p(sum(v > toxicity.BAD for v in values)))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(x * y for x, y in zip(row, machine.line, strict=True)))), abs=1e-6)


def test_labels_that_contradict_are_not_learnt(spark):
    from millrace.llm import samples

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)] + [(1, "another"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (5, None), (None, 1), (6, 2)], "doc_id long, toxic int")
    texts, y, counts = samples.labelled(docs, labels, "toxic", 4, 99)
    assert (texts, y, counts) == (["another", "", "text 4"], [1, 0, 1], {1: 2, 0: 1})


def test_long_texts_leave_room_for_both_classes(spark, monkeypatch):
    from millrace.llm import samples

    monkeypatch.setattr(samples, "BYTES", 100_000)
    docs = spark.createDataFrame([(i, ("é" if i % 2 else "x") * (20_000 if i % 5 else 10)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    texts, y, counts = samples.labelled(docs, labels, "toxic", 4, 99)
    assert counts == {0: 40, 1: 20} and y.count(1) >= 4 and y.count(0) >= 8
    for k in (0, 1):
        assert sum(len(t.encode()) for t, label in zip(texts, y) if label == k) <= 50_000
