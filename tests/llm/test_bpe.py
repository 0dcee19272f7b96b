import hashlib
import random

from millrace.llm import bpe

from . import cases


def reference():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_is_the_librarys(spark, sf):
    code = reference()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.round_trip(docs).collect():
        ids = code.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_texts_and_edges(spark):
    code, mine, split = reference(), bpe.coder(), bpe.splitter()
    rng = random.Random(4)
    alphabet = ["a", "the", "ing", " ", "  ", "\n", "\r\n", "\t", "\u0085", "\u001c", "é", "ß", "漢", "\U0001f600", "'s", "'LL", "123", "!", "<|endoftext|>", "​", "A", "qz"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        assert mine.encode(text, split) == code.encode_ordinary(text), ascii(text)
    for text in ("ab" * 3000, "z" * 5000, "".join(rng.choice("abcdefghij") for _ in range(20_000))):
        assert mine.encode(text, split) == code.encode_ordinary(text)
    got = bpe.round_trip(cases.edge(spark))
    cases.same_ids(got)
    want = dict(cases.TEXTS)
    for r in got.where("doc_id is not null").collect():
        assert r.n_tokens == len(code.encode_ordinary(want[r.doc_id] or ""))
    assert bpe.round_trip(cases.empty(spark)).count() == 0


def test_general_interface(spark):
    docs = cases.plain(spark, ["hello world", None, "été"])
    back = bpe.decoded(bpe.encoded(docs)).collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in back} == {0: "hello world", 1: "", 2: "été"}


def test_appends_and_edits_are_exact():
    code = bpe.coder()
    rng = random.Random(9)
    live = bpe.PrefixEncoding(code)
    for _ in range(60):
        live.append("".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(6))).encode())
        assert live.tokens() == bpe.PrefixEncoding(code, live.piece).tokens()
    for _ in range(60):
        a = rng.randrange(len(live.piece) + 1)
        b = min(len(live.piece), a + rng.randrange(5))
        again = live.edit(a, b, "".join(rng.choice("the ing") for _ in range(rng.randrange(4))).encode())
        assert again == len(live.piece) - a
        assert live.tokens() == bpe.PrefixEncoding(code, live.piece).tokens()
    word = b"unbelievable"
    assert bpe.PrefixEncoding(code, word).tokens() == reference().encode_ordinary(word.decode())
