import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import repeats

from . import cases


def slow(rows, length=100):
    """doc_id, n_bytes, n_removed, n_spans and kept digest of each row, by a dictionary of all strings.

    Rows of one doc_id (or of none) and one text are one document; such of one doc_id and several texts, and
    those of none, come in any order that the result fits.
    """
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0])):
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                gone[a : a + length] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)
        keep = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        out[i, t] = (i, len(raw), int(gone.sum()), len(edges), hashlib.sha256(keep).hexdigest())
    return sorted((out[i, t or ""] for i, t in rows), key=repr)


def told(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_against_a_dictionary(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow([(r.doc_id, r.text) for r in docs.collect()])
    assert told(repeats.digests(repeats.cut(docs))) == want
    assert any(v[2] for v in want)


@pytest.mark.parametrize(("hot", "sample"), [(2000, 64), (8, 2), (2, 1)])
def test_repetitive_texts(spark, monkeypatch, hot, sample):
    """Anchors of too many segments are anchored again, once and twice, and such as are everywhere are dealt over tasks; the result is the same."""
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    rng = random.Random(hot)
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for _ in range(60)] + ["ab" * 300, "ab" * 300, "a" * 500, "xa" + "a" * 200]
    want = slow(list(enumerate(rows)), 24)
    got = told(repeats.digests(repeats.cut(cases.plain(spark, rows), 24, (8, 15, 24), hot)))
    assert got == want


def test_edges(spark):
    got = repeats.digests(repeats.cut(cases.edge(spark)))
    assert told(got) == slow(cases.TEXTS)
    assert repeats.cut(cases.empty(spark)).count() == 0


def test_rows_that_share_an_identifier_or_have_none(spark):
    rng = random.Random(9)
    a, b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, None), (2, d), (2, c + c[:150]), (2, d), (3, b + d), (2**63 - 1, a)]
    assert told(repeats.digests(repeats.cut(spark.createDataFrame(rows, "doc_id long, text string")))) == slow(rows)
    # unrelated texts lose nothing to each other
    rows = [(None, a), (None, b), (4, c), (4, d)]
    assert all(r[2] == 0 for r in told(repeats.digests(repeats.cut(spark.createDataFrame(rows, "doc_id long, text string")))))


def test_long_documents_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 1000)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [text + text[700:1900], text[300:4000]]
    assert told(repeats.digests(repeats.cut(cases.plain(spark, rows).coalesce(1)))) == slow(list(enumerate(rows)))


def test_index_runs():
    rng = random.Random(2)
    for _ in range(30):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(rng.randrange(1, 8))]
        seen, want = set(), []
        for s in strings:
            hit = []
            for i in range(len(s) - 5):
                hit.append(s[i : i + 6] in seen)
                seen.add(s[i : i + 6])
            want.append(hit)
        got = repeats.repeated_windows([np.frombuffer(s, np.uint8) for s in strings], 6)
        assert [g.tolist() for g in got] == want
    index = repeats.RunLengthIndex([np.frombuffer(b"abcabcabcabc" * 20, np.uint8)])
    assert len(index.heads) < index.n / 10


def test_statistics_are_those_of_sorted_suffixes():
    rng = random.Random(4)
    for _ in range(200):
        strings = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))).encode() for _ in range(rng.randrange(1, 6))]
        index = repeats.RunLengthIndex([np.frombuffer(s, np.uint8) for s in strings])
        text = [x for k, s in enumerate(strings) for x in [*(b + 100 for b in s), k]]  # ends: each its own, below all others
        order = sorted(range(len(text)), key=lambda i: text[i:])
        above, agree = index.statistics()
        for row in range(1, len(order)):
            a, b = order[row - 1], order[row]
            n = 0
            while text[a + n] == text[b + n]:
                n += 1
            assert agree[b] == n and above[b] == a
        before = [0 if text[i - 1] < 100 else text[i - 1] for i in order]
        assert [h for h in range(len(order)) if h == 0 or before[h] != before[h - 1] or not before[h]] == index.heads.tolist()


def test_an_anchor_of_most_documents_is_dealt_over_tasks(spark, monkeypatch):
    """One phrase in ever new surroundings, and copies among them."""
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    phrase = "the phrase that all of these documents have, word for word"
    rows = [some(70) + phrase + some(70) for _ in range(150)]
    rows += [rows[3], rows[7][20:], some(30) + rows[9][40:160]]
    docs = cases.plain(spark, rows)
    keyed, _ = repeats.keyed(docs)
    found = repeats._segment_rows(keyed, 100, 40)
    settled = repeats._settle(found, found)
    most = found.where("n > 0").groupBy("key").agg(F.count_distinct("seg").alias("n")).orderBy(F.desc("n")).first()
    assert most.n > 40  # all of them open, whatever task they came to
    assert settled.where(F.col("open") & (F.col("key") == most.key)).count() == most.n
    for hot in (2000, 20):
        assert told(repeats.digests(repeats.cut(docs, hot=hot))) == slow(list(enumerate(rows)))
