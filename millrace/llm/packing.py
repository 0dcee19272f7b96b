"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document is cut into full sequences and a rest. The rest belongs to the reciprocal class
M = capacity // rest, whose bins hold exactly M pieces. Where the class would waste
more than 1/64 of its slot, the slot of class M + 1 is cut off first and what remains is classed anew,
so the padding stays small. Workers fill their bins independently; what is left in a worker's open bins
is chained, cut freely, and closed in full sequences but for one.

A document is its tokens and one end token; null and empty texts are the end token alone. Repeated
rows are packed each. Empty table: no rows. Sequence numbers are unique over all workers and
the same whenever a partition is computed again.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import splitter
from .tables import texts

CAPACITY, END, WASTE = 1024, 0, 64
#: Tokens of the pieces that a worker holds before they leave.
HELD = 1_000_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ENCODERS: dict[str, Encoder] = {}
#: The library's splitter fails on about a million white-space characters in a row; texts with runs of this length are split by bpe.splitter().
BLANKS = 100_000
_BLANKS = re.compile(rf"(?<!\s)\s{{{BLANKS}}}")


class Encoder:
    """What the tokenizers library makes of the JSON file beside a rank file, without added ends, by tiktoken's merges at less cost.

    A text is cut at the JSON's added tokens first, wherever their strings stand.
    """

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.code = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.split = splitter()
        described = ranks.removesuffix(".tiktoken") + ".json"
        self.added = {}
        if os.path.exists(described):
            with open(described, encoding="utf-8") as file:
                self.added = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", ())}
        self.cut = re.compile("({})".format("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))) if self.added else None

    def encode_ordinary(self, text: str) -> list[int]:
        if not self.added or not any(t in text for t in self.added):
            return self._text(text)
        out = []
        for part in self.cut.split(text):
            out += [self.added[part]] if part in self.added else self._text(part)
        return out

    def _text(self, text: str) -> list[int]:
        if len(text) < BLANKS or not _BLANKS.search(text):
            return self.code.encode_ordinary(text)
        return [i for piece in self.split.findall(text) for i in self.code._encode_single_piece(piece)]


def encoder(ranks: str | None = None) -> Encoder:
    """The tokenizer of a rank file and the JSON beside it."""
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = Encoder(ranks)
    return _ENCODERS[ranks]


def cuts(rest: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a rest shorter than the capacity."""
    out = []
    while rest:
        m = capacity // rest
        slot = capacity // m
        if (slot - rest) * WASTE <= slot:
            out.append((rest, m))
            break
        slot = capacity // (m + 1)
        out.append((slot, m + 1))
        rest -= slot
    return out


class Packer:
    """The bins of one worker. add() and close() return rows of (doc_id, start, length, doc_tokens, sequence_id, offset, ids)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.sequence, self.capacity = first_sequence, capacity
        self.bins: dict[int, list] = {}

    def _closed(self, pieces: list) -> list:
        rows, offset = [], 0
        for doc_id, start, total, ids in pieces:
            rows.append((doc_id, start, len(ids), total, self.sequence, offset, ids.tobytes()))
            offset += len(ids)
        self.sequence += 1
        return rows

    def add(self, doc_id, ids: np.ndarray) -> list:
        rows, total, at = [], len(ids), 0
        while total - at >= self.capacity:
            rows += self._closed([(doc_id, at, total, ids[at : at + self.capacity])])
            at += self.capacity
        for length, m in cuts(total - at, self.capacity):
            held = self.bins.setdefault(m, [])
            held.append((doc_id, at, total, ids[at : at + length].copy()))
            at += length
            if len(held) == m:
                rows += self._closed(self.bins.pop(m))
        return rows

    def close(self) -> list:
        rows, held, room = [], [], self.capacity
        for m in sorted(self.bins):
            for doc_id, start, total, ids in self.bins[m]:
                while len(ids):
                    part = ids[:room]
                    held.append((doc_id, start, total, part))
                    ids, start, room = ids[len(part) :], start + len(part), room - len(part)
                    if not room:
                        rows += self._closed(held)
                        held, room = [], self.capacity
        if held:
            rows += self._closed(held)
        self.bins = {}
        return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """A row for each piece; ids are its tokens as little-endian unsigned 32-bit numbers."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())])

    def run(batches):
        code = encoder(ranks)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*code.encode_ordinary(text.as_py() or ""), END], "<u4")
                rows += packer.add(doc_id, ids)
                held += len(ids)
                if held > HELD and rows:
                    yield batch_of(rows)
                    rows, held = [], 0
        rows += packer.close()
        if rows:
            yield batch_of(rows)

    return texts(docs).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
