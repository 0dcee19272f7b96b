import hashlib
import re

from millrace.llm import entries, exact_dedup

from ..oracle import compare
from . import cases


def slow(rows):
    """doc_id, keep_id, group_size, kept, sha of each row."""
    norm = [(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for i, t in rows]
    out = []
    for k, (i, h) in enumerate(norm):
        group = [(j is None, j, n) for n, (j, g) in enumerate(norm) if g == h]
        _, keep, first = min(group, key=lambda x: (x[0], x[1] or 0, x[2]))
        out.append((i, keep, len(group), k == first, h))
    return sorted(out, key=repr)


def test_sql(spark, sf):
    assert compare(entries.queries()["op2_exact_dedup"](spark, sf), entries.oracle_sql()["op2_exact_dedup"], sf) == 200


def test_edges_and_collisions(spark):
    for bits in (256, 3):  # three bits: texts that differ meet under one digest
        got = exact_dedup.classes(cases.edge(spark), digest_bits=bits, entries=4).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, got.collect()), key=repr) == slow(cases.TEXTS)
    assert exact_dedup.classes(cases.empty(spark)).count() == 0


def test_keep_returns_the_columns(spark):
    docs = cases.edge(spark)
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert cases.kept_rows(kept) == cases.wanted_rows(slow(cases.TEXTS), docs)


def test_no_row_goes_for_another_of_its_doc_id(spark):
    for rows, want in (
        ([(0, "x y z"), (1, "x y z"), (1, "unique text of one")], [(0, "x y z"), (1, "unique text of one")]),
        ([(5, "t"), (None, "t"), (None, "unique")], [(5, "t"), (None, "unique")]),
        ([(1, "same")] * 3, [(1, "same")]),
        ([(None, "same")] * 3, [(None, "same")]),
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, exact_dedup.keep(docs).collect()), key=repr) == sorted(want, key=repr)
        assert sorted(map(tuple, exact_dedup.classes(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr) == slow(rows)


def test_index_grows_and_compacts(spark):
    index = exact_dedup.MergeIndex(spark, fanout=2, entries=3)
    for first, texts in ((10, ["a", "b", "a "]), (0, ["b", "c"]), (20, ["a"]), (30, ["d", "d"])):
        rows = index.append(cases.plain(spark, texts, first))
        assert rows.count() == len(texts)
    assert len(index.levels) > 1 and not index.levels[0]
    found = index.entries_of()
    assert {r.first_id: r.n for r in found.collect()} == {10: 2, 12: 1, 0: 2, 1: 1, 30: 2}  # "a " isn't "a"
    assert sum(map(len, index.levels)) == 1
    assert exact_dedup.MergeIndex(spark).entries_of().count() == 0


def test_filter_knows_what_it_was_given(spark):
    digests = spark.range(3000).selectExpr("unhex(sha2(cast(id as string), 256)) as digest", "id")
    probed = exact_dedup.Filter(digests.where("id < 1000").select("digest")).probe(digests)
    assert probed.where("id < 1000 and not perhaps").count() == 0
    assert probed.where("id >= 1000 and perhaps").count() < 100
    assert exact_dedup.Filter(digests.where("id < 0").select("digest")).probe(digests).where("perhaps").count() == 0
