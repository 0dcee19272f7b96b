import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import arrays as A, minhash

from . import cases


def grams(text):
    """The shingles of a text, the first, second, ... of equal ones told apart: a bag as a set."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, out = Counter(), set()
    for g in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []:
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def slow(rows, similarity=0.8):
    """doc_id, class_id and class size of each row, by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or (both and both >= similarity * len(sets[a] | sets[b])):
                label[root(a)] = root(b)
    groups = [[i for k, (i, _) in enumerate(rows) if root(k) == r] for r in range(len(rows))]
    return sorted(((i, min((j for j in groups[root(k)] if j is not None), default=None), len(groups[root(k)])) for k, (i, _) in enumerate(rows)), key=repr)


def told(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in df.collect()), key=repr)


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow([(r.doc_id, r.text) for r in docs.collect()])
    got = minhash.classes(docs)
    assert told(got) == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.collect())
    assert len({c for _, c, _ in want}) < len(want)


def test_chains_in_hot_buckets(spark, monkeypatch):
    """A long chain of near copies, more than a block holds, is one class."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    words = [f"w{i}" for i in range(400)]
    rows = [" ".join(words[i : i + 100]) for i in range(0, 120, 4)] + [" ".join(f"z{j}_{i}" for i in range(50)) for j in range(5)]
    assert told(minhash.classes(cases.plain(spark, rows))) == slow(list(enumerate(rows)))


def test_shingles_count_as_often_as_they_occur(spark):
    rng = random.Random(8)
    one, two = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(60)) for k in "ab")
    rows = [one, f"{one} {one}", f"{one} {one} {one} {one} {one} {one} {one}", f"{one} {one} {one} {one} {one} {one} {one} {one}", f"{two} {one}", f"{one} {one} {one} {one} {one} {one} {one} {two}"]
    want = slow(list(enumerate(rows)))
    assert {i: c for i, c, _ in want} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 2}
    assert told(minhash.classes(cases.plain(spark, rows))) == want


def test_edges(spark):
    docs = cases.edge(spark)
    assert told(minhash.classes(docs)) == slow(cases.TEXTS)
    assert minhash.classes(cases.empty(spark)).count() == 0
    kept = minhash.keep(docs)
    assert kept.columns == docs.columns
    assert [(i, (t or "")[:20]) for i, t in cases.kept_rows(kept)] == sorted([(i, (t or "")[:20]) for i, t in dict.fromkeys(cases.TEXTS) if i not in (3, 4, 7, 9) and (i is not None or t)], key=repr)


def test_rows_that_share_an_identifier_or_have_none(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(80)) for k in "abcd")
    near = lambda t: t + " one more"
    rows = [(0, a), (1, near(a)), (1, b), (None, near(b)), (None, c), (None, near(c)), (2, d), (2, near(d)), (2, d), (1, c + " " + d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(minhash.classes(docs)) == slow(rows)
    assert len(cases.kept_rows(minhash.keep(docs))) == 5
    kept = {t for _, t in cases.kept_rows(minhash.keep(docs))}
    assert {a, b, c + " " + d} < kept
    for rows, want in (([(0, "x y z"), (1, "x y z"), (1, "unique text of one")], [(0, "x y z"), (1, "unique text of one")]), ([(1, "same")] * 3, [(1, "same")])):
        assert cases.kept_rows(minhash.keep(spark.createDataFrame(rows, "doc_id long, text string"))) == want


@pytest.mark.parametrize("hub", [500, 2])
def test_components_of_stars_chains_and_rings(spark, monkeypatch, hub):
    from millrace.llm import graph

    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(3)
    links = [(5000, i) for i in range(1000, 1040)] + [(i, i + 1) for i in range(50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (900, 899), (899, 900)]
    links += [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)]
    label = {x: x for link in links for x in link}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    loose = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in label if x not in loose}


def test_coordinates_agree_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = A.mix(np.arange(1, 61, dtype=A.U64))
    x, y = rng.uniform(0.2, 6, 60), rng.uniform(0.2, 6, 60)
    y[:40] = x[:40]
    doc = np.repeat([0, 1], 60)
    sig = minhash.signatures(doc, np.tile(elements, 2), np.concatenate([x, y]), 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum(), abs=0.03)
    one = np.ones(60)
    sig = minhash.signatures(np.repeat([0, 1], [60, 30]), np.concatenate([elements, elements[:30]]), one.repeat(2)[:90], 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.5, abs=0.03)


def test_heavy_and_light_documents_of_a_slab_take_little():
    import tracemalloc

    elements = A.mix(np.arange(1, 12, dtype=A.U64))
    weights = np.array([3e6, 1.0, *[1.0] * 9])
    tracemalloc.start()
    sig = minhash.signatures(np.array([0, 1, *[2] * 9]), elements, weights, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
    alone = [minhash.signatures(np.zeros(len(e), np.int64), e, w, 1)[0] for e, w in ((elements[:1], weights[:1]), (elements[1:2], weights[1:2]), (elements[2:], weights[2:]))]
    assert (sig == np.stack(alone)).all()
