import random
import zlib

import numpy as np
import pytest

from millrace.llm import packing

from . import cases


def check(rows, lengths, capacity):
    """rows: (doc_id, start, length, doc_tokens, sequence_id, offset); lengths: doc_id -> tokens of each of its rows."""
    by_sequence, by_doc = {}, {}
    for doc, start, n, total, seq, off in rows:
        assert n > 0
        by_sequence.setdefault(seq, []).append((off, n))
        by_doc.setdefault(doc, []).append((start, n, total))
    for pieces in by_sequence.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= capacity
    for doc, sizes in lengths.items():
        assert sorted(n for s, n, t in by_doc[doc] for _ in [0] if s + n == t for n in [t]) == sorted(sizes)
        covered = {}
        for s, n, t in by_doc[doc]:
            for x in range(s, s + n):
                covered[t, x] = covered.get((t, x), 0) + 1
        assert covered == {(t, x): sizes.count(t) for t in set(sizes) for x in range(t)}
    return len(by_sequence)


def test_whole_table(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: np.array([*code.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    got = packing.digests(packing.pack(docs)).collect()
    n = check([(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in got], {i: [len(x)] for i, x in ids.items()}, 1024)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    total = sum(map(len, ids.values()))
    assert total / (n * 1024) > 0.95
    parts = packing.pack(docs.repartition(3)).select("sequence_id").distinct().count()
    assert total / (parts * 1024) > 0.95


def test_edges(spark):
    got = packing.pack(cases.edge(spark))
    assert {r.doc_id for r in got.collect()} == {i for i, _ in cases.TEXTS}
    assert packing.pack(cases.empty(spark)).count() == 0
    rows = got.where("doc_id = 1").collect()
    assert sum(r.length for r in rows) == 2 * rows[0].doc_tokens  # a repeated row is packed twice
    for i in (2, 3):
        assert [(r.length, r.ids) for r in got.where(f"doc_id = {i}").collect()] == [(1, bytes(4))]


@pytest.mark.parametrize("capacity", [1024, 7, 1])
def test_classes_hold_fixed_numbers(capacity):
    rng = np.random.default_rng(capacity)
    packer, rows, lengths = packing.Packer(5, capacity), [], {}
    for i in range(600):
        n = int(rng.integers(1, 3 * capacity + 2))
        lengths[i] = [n]
        rows += packer.add(i, np.arange(n).astype("<u4"))
    rows += packer.close()
    check([r[:6] for r in rows], lengths, capacity)
    for rest in range(1, capacity):
        cut = packing.cuts(rest, capacity)
        assert sum(n for n, _ in cut) == rest and all(n <= capacity // m for n, m in cut)


def test_special_strings_are_text(spark):
    text = "a<|endoftext|>b <s> </s>"
    assert len(packing.encoder().encode_ordinary(text)) == packing.pack(cases.plain(spark, [text])).first().length - 1


@pytest.mark.parametrize("blanks", [" " * 1_100_000, "a" + " \n" * 600_000 + "b \u2003c", "\n" * 1_100_000 + " x"])
def test_a_million_blanks(spark, blanks):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(blanks, add_special_tokens=False).ids
    assert packing.encoder().encode_ordinary(blanks) == want
    got = packing.pack(cases.plain(spark, ["a b", blanks])).where("doc_id = 1").collect()
    assert sum(r.length for r in got) == got[0].doc_tokens == len(want) + 1


def test_added_tokens_as_the_library_has_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end + end, f"  {end}\n\n{end} x", f"a<{end}>", "<|endoftext|", "<|ENDOFTEXT|>", f"{end}s's", *(t or "" for _, t in cases.TEXTS), *(f"{t or ''}{end}{t or ''}" for _, t in cases.TEXTS)]
    want = [code.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [packing.encoder().encode_ordinary(t) for t in texts] == want
    got = {}
    for r in packing.pack(cases.plain(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert [np.frombuffer(b"".join(i for _, i in sorted(got[k])), "<u4").tolist() for k in range(len(texts))] == [[*w, 0] for w in want]


def test_bins_hold_the_count_of_their_class():
    """Before the rests are chained, each sequence is one full piece, or as many pieces as its class says, each of that class."""
    rng = random.Random(4)
    packer, closed, waste = packing.Packer(0), {}, 0
    for i in range(3000):
        for row in packer.add(i, np.arange(rng.choice([rng.randrange(1, 60), rng.randrange(1, 3000)]), dtype="<u4")):
            closed.setdefault(row[4], []).append(row[2])
    assert len(closed) > 1000
    for lengths in closed.values():
        waste += packing.CAPACITY - sum(lengths)
        if lengths == [packing.CAPACITY]:
            continue
        m = len(lengths)
        slot = packing.CAPACITY // m
        assert all(n <= slot and (slot - n) * packing.WASTE <= slot for n in lengths), lengths
    assert waste <= len(closed) * packing.CAPACITY / packing.WASTE
    held = {m: len(pieces) for m, pieces in packer.bins.items()}
    assert all(0 < n < m for m, n in held.items())  # an open bin lacks at least one
    rest = {}
    for row in packer.close():
        rest.setdefault(row[4], []).append(row[2])
    assert sorted(sum(x) == packing.CAPACITY for x in rest.values()).count(False) <= 1
