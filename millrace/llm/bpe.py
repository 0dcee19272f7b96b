"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece there is one token that can end its encoding: a token t that is a suffix
of the prefix, such that the encoding of what stands before it and t do not merge across their border. Storing
that token for each prefix gives the encoding by walking back, allows bytes to be appended without touching what
is stored, and lets an edit start anew at the edited byte instead of at the beginning.

Texts are cut into pieces by the tokenizer's pattern; a worker keeps the encoding of the pieces it has met,
up to a bound. Null texts are empty: no tokens. Repeated rows are encoded each. Empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tables import texts

#: Pieces, of at most so many bytes, that a worker remembers.
CACHED, CACHED_BYTES = 400_000, 64
_CODERS: dict[str, Coder] = {}


class Coder:
    """The vocabulary of a rank file and what prefix encoding needs to know of it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split: dict[int, tuple[int, int]] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged(token, i)
                if len(parts) == 2:
                    self.split[i] = (ranks[parts[0]], ranks[parts[1]])
        self._pairs: dict[int, bool] = {}
        # finds the tokens that end at each byte, the longest first; a token that merges never yield is no candidate
        self._suffixes = ahocorasick.Automaton()
        for token, i in ranks.items():
            if len(token) == 1 or i in self.split:
                self._suffixes.add_word(token.decode("latin-1"), (i, len(token)))
        self._suffixes.make_automaton()

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """token's bytes after all merges of rank less than below."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when the bytes of both are merged from scratch.

        Undo the latest merge of the two, again and again; if ever the tokens at the border would
        merge earlier than what was undone, they would have done so first.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        ranks, name, split = self.ranks, self.bytes_of, self.split
        limit = 1 << 62
        while True:
            over = ranks.get(name[left] + name[right])
            if over is not None and over < limit:
                return False
            a, b = split.get(left), split.get(right)
            if a is None and b is None:
                return True
            # of equal ranks the left merge comes first, so the right one is undone first
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def extend(self, piece: bytes, last: list[int]) -> None:
        """last[i] is the last token of the first i + 1 bytes; append what piece has beyond len(last)."""
        ranks, longest, stable = self.ranks, self.longest, self.stable
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(piece[start:end])
                if token is not None and (not start or stable(last[start - 1], token)) and (len(piece[start:end]) == 1 or token in self.split):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        known, n = self._pairs.get, 0
        for end, (token, size) in self._suffixes.iter(piece.decode("latin-1")):
            if end == n:  # not found yet
                if size > n:
                    last.append(token)
                    n += 1
                else:
                    before = last[n - size]
                    good = known(before << 32 | token)
                    if good or (good is None and self.stable(before, token)):
                        last.append(token)
                        n += 1
        return self.walk(last)

    def encode(self, text: str, pattern=None) -> list[int]:
        return [i for piece in (pattern or splitter()).findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixEncoding:
    """A piece whose encoding follows appends and edits."""

    def __init__(self, coder: Coder, piece: bytes = b""):
        self.coder, self.piece, self.last = coder, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.coder.extend(self.piece, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace the bytes from start to end; returns how many prefixes were computed again."""
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.last[start:]
        self.coder.extend(self.piece, self.last)
        return len(self.piece) - start

    def tokens(self) -> list[int]:
        return self.coder.walk(self.last)


def splitter():
    """public_tokenizers.PATTERN, with white space as Unicode's property has it."""
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def coder(path: str | None = None) -> Coder:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    if path not in _CODERS:
        with open(path, "rb") as file:
            _CODERS[path] = Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})
    return _CODERS[path]


class _Pieces(dict):
    """piece -> (number of tokens, ids as text, decoded bytes)."""

    def __init__(self, code: Coder):
        self.code = code

    def __missing__(self, piece: str):
        raw = piece.encode()
        ids = self.code.encode_piece(raw)
        out = len(ids), ",".join(map(str, ids)), self.code.decode(ids)
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out


_SEEN: dict[str | None, _Pieces] = {}


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and its ids as an array."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        code, split = coder(path), splitter()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids = [code.encode(t or "", split) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of its ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        code = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], schema=schema)

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    count, text_of, bytes_of = itemgetter(0), itemgetter(1), itemgetter(2)

    def run(batches):
        pieces = _SEEN.setdefault(path, _Pieces(coder(path)))
        find = splitter().findall
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(map(pieces.__getitem__, find(text.as_py() or "")))
                ids = ",".join(map(text_of, found)).encode()
                rows.append((doc_id, sum(map(count, found)), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(map(bytes_of, found))).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
