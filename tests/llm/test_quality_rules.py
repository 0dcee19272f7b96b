import re
from collections import Counter

import numpy as np

from millrace.llm import quality_rules as Q

from . import cases


def slow(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if many[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = Q.judge(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_edges(spark):
    got = Q.judge(cases.edge(spark))
    cases.same_ids(got)
    want = dict(cases.TEXTS)
    for r in got.where("doc_id is not null").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(want[r.doc_id]), r.doc_id
    assert Q.judge(cases.empty(spark)).count() == 0
    docs = cases.edge(spark)
    kept = Q.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {5, 7, 8, None}
    bare = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    assert Q.judge(bare).first().kept


def test_fences_follow_their_group(spark):
    """Thirty signs are usual in one source and odd in another."""
    body, signs = " ".join(f"word{i}" for i in range(60)), " ".join(f"#sign{i}" for i in range(30))
    rows = [(i, f"{body} {i} {signs if s == 'code' or i % 150 == 7 else ''}", "en", s) for i in range(600) for s in [("code", "prose")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r.doc_id for r in Q.judge(docs).where("not kept").collect()}
    assert gone == {i for i, t, _, s in rows if s == "prose" and "#" in t}


def test_each_row_goes_by_its_own_verdict(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (1, "too short"), (None, good), (None, "short"), (None, None), (2, good), (2, good)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    assert cases.kept_rows(Q.keep(docs)) == sorted([(1, good), (None, good), (2, good), (2, good)], key=repr)


def test_verdicts_against_exact_quantiles(spark):
    """The sketches' fences against those of sorted values: verdicts differ nowhere but close to a fence."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = Q._judged(docs, Q.SIGNALS).toPandas()
    fine = rows[~rows.base_failed]
    values = {s.name: fine.eval(s.value.replace("greatest(n_words, 1)", "n_words").replace("greatest(n_lines, 1)", "n_lines").replace("greatest(word_chars, 1)", "word_chars")) for s in Q.SIGNALS}
    inside, close = np.ones(len(fine), bool), np.zeros(len(fine), bool)
    sizes = fine.groupby(["lang", "source"]).size(), fine.groupby("lang").size()
    for (lang, source), at in fine.groupby(["lang", "source"]).indices.items():
        if sizes[0][lang, source] >= Q.LEAST_GROUP:
            group = at
        elif sizes[1][lang] >= Q.LEAST_GROUP:
            group = np.flatnonzero(fine.lang == lang)
        else:
            group = np.arange(len(fine))
        for s in Q.SIGNALS:
            v = values[s.name].to_numpy()
            a, m, b = np.quantile(v[group], [0.25, 0.5, 0.75], method="inverted_cdf")
            spread = s.reach * max(b - a, s.least)
            inside[at] &= (v[at] <= m + spread) & (not s.both or v[at] >= m - spread)
            near = 0.1 * spread  # a sketch's ranks are off by about one in a hundred
            close[at] |= (np.abs(v[at] - m - spread) < near) | (s.both & (np.abs(v[at] - m + spread) < near))
    different = inside != fine.kept.to_numpy()
    assert not (different & ~close).any()
    assert different.mean() < 0.002 and 0 < (~inside).sum()
