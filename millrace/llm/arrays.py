"""Vectorised text primitives over Arrow string columns.

Everything works on runs of whole documents ("slabs") of about one megabyte, so the memory of a
task is bounded by the largest document, not by its partition. Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLAB_BYTES, SLAB_DOCS = 1 << 20, 4000
#: Bits of a per-document key that hold the hash; the rest number the documents of a slab.
KEY_BITS = 52
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        steps = np.full(max(n, SLAB_BYTES + 65_536), base, U64)
        steps[0] = 1
        _POWERS[kind] = np.multiply.accumulate(steps)
    return _POWERS[kind][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums s such that span_hash(s, a, b) depends on buf[a:b] alone."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TABLE[buf] * _power("up", len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    down = _power("down", len(sums))
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(column, size: int = SLAB_BYTES):
    """(first row, end row, bytes, offsets) over runs of whole documents."""
    data, offsets = flat(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + SLAB_DOCS, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs without white space."""
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~SPACE[buf]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends[:-1] &= ~solid[1:] | edge[1:n]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return a, b, np.searchsorted(offsets, a, "right") - 1


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many True bytes each document has."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def doc_keys(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One sortable key of a document's number in its slab and a hash."""
    return (doc.astype(U64) << U64(KEY_BITS)) | (hashes >> U64(64 - KEY_BITS))


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words, and hashes, of the windows of size words that stay within a document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    h = np.zeros(len(at), U64)
    for i in range(size):
        h = h * U64(0xFF51AFD7ED558CCD) + hashes[at + i]
    return at, mix(h)


def squeeze(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    text = text.translate(_TO_SPACE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


_TO_SPACE = bytes(0x20 if SPACE[i] else i for i in range(256))


def trim() -> None:
    """Give what the allocators hold in reserve back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fixed(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
