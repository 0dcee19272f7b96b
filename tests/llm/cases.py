"""Rows that every operator must take: nulls in any column, empty and endless texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, start string, n string, bucket string, digest string, value string, chunk string, component string, held_out string, kept string, score string"
ENDLESS = "x1" * 60_000
LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
TEXTS = [
    (1, "a b c"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, ENDLESS),
    (7, LONG),
    (1, "a b c"),
    (None, "some words that have no identifier at all here"),
    (None, None),
    (8, "ünïcödé \U0001f600 text  with   gaps\r\nand lines\n\nand lines\n"),
    (9, "a  b\tc"),
    (-5, "negative identifiers are identifiers too, and so they stay"),
]


def edge(spark, extra=()):
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, *["clash"] * 11) for k, (i, t) in enumerate([*TEXTS, *extra])]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return edge(spark).limit(0)


def plain(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def same_ids(df):
    """The doc_ids of a result are those of the rows that went in, each as often."""
    got = sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)
    assert got == sorted((i for i, _ in TEXTS), key=repr)


def kept_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def wanted_rows(verdicts, docs):
    """doc_id and text of the rows that a row-wise verdict (doc_id, ..., kept, sha of the text) keeps."""
    import hashlib
    import re

    text = {}
    for r in docs.collect():
        text.setdefault((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()), r.text)
    return sorted(((v[0], text[v[0], v[-1]]) for v in verdicts if v[-2]), key=repr)
