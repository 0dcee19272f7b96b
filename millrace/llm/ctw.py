"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each in a tree of contexts: the bytes before it, up to DEPTH of them, the
nearest first. Each node of the tree counts the decisions of the training corpus and has their Krichevsky-Trofimov
probability; bottom up, a node's weighted probability is half its own and half the product of its children's. The
share of a node's own estimate in its weighted probability then mixes the estimates of all depths
for a new byte. A context that training has not met has no say: the deepest one met on the path ends
the mixture, so what is predicted stays a probability.

Counts are of all training texts. Nothing is kept in one place: each chunk of documents lists its distinct
(context, byte) strings, these are counted and weighted where they meet, by subtrees of two context bytes,
and their code lengths return to the chunk; a subtree of very many strings is dealt out by three. Only the two upper
levels of the tree (at most 65,792 nodes) and the roots of at most a thousand such subtrees (255,000 nodes) pass the driver.

Beside it, a base score of word tokens, each with one added to its count. Null texts are empty: they are an end. An
end, byte 0, closes each text. Rows that repeat a doc_id are scored each. Empty table: no rows; no training texts:
every byte has probability 1/256.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import remainder, texts, written

DEPTH = 5
HELD_OUT = (7, 2)
#: Text bytes of a chunk, whose distinct strings a task holds while it scores the chunk.
CHUNK = 3 << 24
#: Entries that a writer holds before it lets them go.
ENTRIES = 2_500_000
BREAKS = 5000
#: Strings of a subtree of two context bytes above which it is dealt out by three; of more than a thousand times as many, a thousandth of all.
SUBTREE = 4_000_000
#: Tasks that chunks are dealt to; of more chunks, each has several, one after the other.
MOST_TASKS = 20_000
#: Keys that are worked on at a time, and bytes of text.
BLOCK, SLAB = 200_000, 1 << 18
WORD = A.U64(1 << 63)
END_KEY = WORD | A.U64(0x5EED)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(buf: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the depth bytes before and the byte, as a number; and the document."""
    nd = len(offs) - 1
    sizes = np.diff(offs) + depth + 1
    padded = np.zeros(int(sizes.sum()), np.uint8)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(nd), np.diff(offs))
    padded[np.arange(len(buf)) + (begin + depth - offs[:-1])[doc]] = buf
    out = np.zeros(max(0, len(padded) - depth), A.U64)
    for i in range(depth + 1):
        out = (out << A.U64(8)) | padded[i : i + len(out)]
    owner = np.repeat(np.arange(nd), sizes)[: len(out)]
    inside = np.ones(len(out), bool)  # starts of windows within one document
    for i in range(1, depth + 1):
        at = begin[1:] - i
        inside[at[at >= 0]] = False
    return out[inside], owner[inside]


def word_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[buf]
    a, b, doc = A.words(low, offs)
    return A.span_hash(A.prefix_hash(low), a, b) | WORD, doc


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, moved up to where it holds to double precision."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        shift[small] -= np.log(x[small])
        x = x + small
    inv = 1 / x
    inv2 = inv * inv
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _ln_gamma(zeros + 0.5) + _ln_gamma(ones + 0.5) - _ln_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _sums(keys: np.ndarray, *values: np.ndarray):
    unique, back = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(back, v, len(unique)) for v in values)


def _bits(gram: np.ndarray, places=range(8)) -> tuple[np.ndarray, np.ndarray]:
    """(places, n) nodes of the byte's binary tree on the way to the byte, and the bit taken at each."""
    byte = (gram & A.U64(255)).astype(np.int64)
    j = np.array(places)[:, None]
    return (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def _context(gram: np.ndarray, d: int) -> np.ndarray:
    return (gram >> A.U64(8)) & A.U64((1 << 8 * d) - 1)


def levels(gram: np.ndarray, count: np.ndarray, top: int, depth: int = DEPTH, places=range(8)) -> list:
    """From depth up to top: (keys of (context, node), zeros, ones, own log probability, weighted log probability).

    places: which of the byte's decisions; their nodes have nothing in common, so each can be taken by itself.
    """
    seen = count > 0
    gram, count = gram[seen], count[seen].astype(np.float64)
    node, bit = _bits(gram, places)
    keys = ((_context(gram, depth) << A.U64(8))[None, :] | node.astype(A.U64)).ravel()
    one = (bit * count[None, :]).ravel()
    keys, total, ones = _sums(keys, np.tile(count, len(node)), one)
    zeros = total - ones
    own = ln_kt(zeros, ones)
    out = [(keys, zeros, ones, own, own)]
    for d in range(depth - 1, top - 1, -1):
        keys, zeros, ones, _, weighted = out[-1]
        short = (((keys >> A.U64(8)) & A.U64((1 << 8 * d) - 1)) << A.U64(8)) | (keys & A.U64(255))
        keys, zeros, ones, below = _sums(short, zeros, ones, weighted)
        own = ln_kt(zeros, ones)
        out.append((keys, zeros, ones, own, np.logaddexp(own, below) - math.log(2)))
    return out[::-1]


def _mixed(gram: np.ndarray, tables: list, places=range(8)) -> np.ndarray:
    """log10 of the probability of each string's last byte, or of some of its decisions. tables: (keys, zeros, ones, own, weighted) for depth 0, 1, ..."""
    node, bit = _bits(gram, places)
    node = node.astype(A.U64)
    p = np.full(node.shape, 0.5)  # of a one
    deeper = np.zeros(node.shape, bool)  # a longer context has been met
    for d in range(len(tables) - 1, -1, -1):
        keys, zeros, ones, own, weighted = tables[d]
        if not len(keys):
            continue
        wanted = (_context(gram, d) << A.U64(8))[None, :] | node
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        met = keys[at] == wanted
        estimate = (ones[at] + 0.5) / (zeros[at] + ones[at] + 1)
        share = np.where(deeper, np.exp(np.minimum(own[at] - weighted[at] - math.log(2), 0)), 1.0)
        p = np.where(met, share * estimate + (1 - share) * p, p)
        deeper |= met
    return np.log10(np.where(bit == 1, p, 1 - p)).sum(0)


class Lookup:
    """Values by 64-bit key, by hashing without chains: what collides goes to a smaller next table.

    Keys may be there twice, with one value. Nothing is sorted or copied; work goes in blocks, so little beyond the keys,
    the values and the tables is held.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.tables = keys, values, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            bits = max(4, int(1.2 * len(left)).bit_length())
            table = np.zeros(1 << bits, np.int32)
            blocks = [left[i : i + BLOCK] for i in range(0, len(left), BLOCK)]
            for block in blocks:
                table[self._place(keys[block], len(self.tables), bits)] = block
            left = np.concatenate([block[keys[table[self._place(keys[block], len(self.tables), bits)]] != keys[block]] for block in blocks])
            self.tables.append((bits, table))

    def _place(self, keys, salt, bits):
        return (A.mix(keys + A.U64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> A.U64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.empty(len(keys), self.values.dtype), None
        for salt, (bits, table) in enumerate(self.tables):
            k = keys if open_ is None else keys[open_]
            at = table[self._place(k, salt, bits)]
            hit = self.keys[at] == k
            if open_ is None:
                out[hit] = self.values[at[hit]]
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = self.values[at[hit]]
                open_ = open_[~hit]
            if not len(open_):
                return out
        if len(keys):
            raise KeyError(f"{len(keys) if open_ is None else len(open_)} strings have no value")
        return out


def _dealt(sizes: list[int], chunk_bytes: int) -> tuple[list[int], list[int]]:
    """For each of adjacent ranges the chunk it belongs to, or begins with, and how many it is split into."""
    first, parts, chunk, held = [], [], -1, chunk_bytes
    for size in sizes:
        split = max(1, math.ceil(size / chunk_bytes))
        if split > 1 or held + size > chunk_bytes or chunk < 0:
            chunk, held = chunk + 1, 0
        first.append(chunk)
        parts.append(split)
        if split > 1:
            chunk, held = chunk + split - 1, chunk_bytes
        held += size
    return first, parts


def _chunked(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, text, held_out and chunk, and the number of chunks: ranges of doc_id of at most chunk_bytes of text, so that a reader meets few chunks.

    The borders are between at most BREAKS ranges of about as many rows; a range that is too long for a chunk (by long texts, or by a
    doc_id or null that very many rows have) is dealt over several by a hash of doc_id and text.
    """
    docs = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("doc_id", [i / BREAKS for i in range(1, BREAKS)], 50_000).alias("breaks")).first()
    ranges = min(8 * max(1, math.ceil((known["bytes"] or 0) / chunk_bytes)), BREAKS)
    cuts = sorted({known["breaks"][i * BREAKS // ranges - 1] for i in range(1, ranges)}) if known["breaks"] else []
    place = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, x: n + (F.coalesce(F.col("doc_id"), F.lit(0)) >= x).cast("int")) if cuts else F.lit(0)
    sizes = dict(docs.groupBy(place.alias("range")).agg(F.sum(F.octet_length("text"))).collect())  # BREAKS rows at most
    first, parts = _dealt([sizes.get(i) or 0 for i in range(len(cuts) + 1)], chunk_bytes)
    chunk = F.get(F.array(*map(F.lit, first)), F.col("range"))
    if max(parts) > 1:
        split = F.get(F.array(*map(F.lit, parts)), F.col("range"))
        chunk = chunk + F.when(split > 1, F.pmod(F.xxhash64("doc_id", "text"), split)).otherwise(0).cast("int")
    mod, out = HELD_OUT
    named = docs.withColumn("range", place).select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False)).alias("held_out"), chunk.alias("chunk"))
    return named, first[-1] + parts[-1]


def _listed(docs: DataFrame, depth: int) -> DataFrame:
    """chunk, key, n: the distinct strings and words of each chunk, and how often training texts have them."""
    schema = pa.schema([("chunk", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def merged(chunk):
            keys, n = map(np.concatenate, zip(*held.pop(chunk), strict=True))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[chunk] = [(keys[first], np.add.reduceat(n, first))]
            return len(first)

        def flush():
            for chunk in sorted(held):
                merged(chunk)
                keys, n = held[chunk][0]
                for i in range(0, len(keys), 500_000):
                    part = keys[i : i + 500_000]
                    yield A.batch_of(schema, np.full(len(part), chunk, np.int32), part.view(np.int64), n[i : i + 500_000].astype(np.int64))
            held.clear()

        for batch in batches:
            out = batch.column(2).to_numpy(zero_copy_only=False)
            of = batch.column(3).to_numpy()
            for i, j, buf, offs in A.slabs(batch.column(1), 2 * SLAB):
                gram, doc = grams(buf, offs, depth)
                word, word_doc = word_keys(buf, offs)
                keys = np.concatenate([gram, word, np.full(j - i, END_KEY)])
                doc = np.concatenate([doc, word_doc, np.arange(j - i)])
                for chunk in np.unique(of[i:j]).tolist():
                    mine = of[i:j] == chunk
                    for train in (True, False):
                        use = mine & (out[i:j] != train)
                        if use.any():
                            k, n = np.unique(keys[use[doc]] if not use.all() else keys, return_counts=True)
                            held.setdefault(chunk, []).append((k, (n * train).astype(np.uint32)))
                            size += len(k)
                if size > ENTRIES:
                    size = sum(merged(c) for c in list(held))
                    if size > ENTRIES // 2:
                        yield from flush()
                        size = 0
        yield from flush()
        A.trim()

    return docs.mapInArrow(run, "chunk int, key long, n long")


def _groups(batches, width: int):
    """Whole groups of equal first column from sorted batches; each group as its other columns."""
    held: list = []
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(width)]
        if not len(cols[0]):
            continue
        if held and held[-1][0][-1] != cols[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        edge = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        last = 0
        for at in edge.tolist():
            held.append([c[last:at] for c in cols])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, last = [], at
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _apart(strings: int) -> list:
    """The decisions of a byte all at once in small subtrees, one by one in large ones, of which an eighth is held then."""
    return [range(8)] if strings < BLOCK // 2 else [[j] for j in range(8)]


def _squeezed(x: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True)


def _unsqueezed(raw: pa.Buffer, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


#: Strings that a packer holds before it lets them go.
PACKED = 1_000_000
PARCEL = "chunk int, n int, words boolean, keys binary, found binary"


def _parcels(rows: DataFrame) -> DataFrame:
    """The answers for a chunk in few large rows: their keys in order as differences, and code lengths or words' counts."""
    schema = pa.schema([("chunk", pa.int32()), ("n", pa.int32()), ("words", pa.bool_()), ("keys", pa.binary()), ("found", pa.binary())])

    def packed(held):
        chunk, key, value = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((key, chunk))
        chunk, key, value = chunk[order], key[order].view(np.uint64), value[order]
        edges = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | ((key[1:] >= WORD) != (key[:-1] >= WORD)), [True]]))
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            words = bool(key[a] >= WORD)
            steps = np.diff(key[a:b], prepend=A.U64(0))
            out.append((int(chunk[a]), int(b - a), words, _squeezed(steps), _squeezed(value[a:b] if words else value[a:b].astype(np.float32))))
        return A.batch_of(schema, *map(list, zip(*out, strict=True)))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy().copy() for i in range(3)))
            size += batch.num_rows
            if size > PACKED:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)
        A.trim()

    return rows.select("chunk", "key", F.coalesce(F.col("n").cast("double"), F.col("value").cast("double")).alias("value")).mapInArrow(run, PARCEL)


def _sums_of(rows: DataFrame, context: int) -> tuple[np.ndarray, ...]:
    """Keys of nodes with so many bits of context, and the sums of what lies below: zeros, ones, weighted log probability."""
    key = F.shiftright("key", 8).bitwiseAND((1 << context) - 1) * 256 + F.col("key").bitwiseAND(0xFF)
    found = rows.groupBy(key.alias("key")).agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).orderBy("key").toPandas().to_numpy()
    found = found if len(found) else np.zeros((0, 4))
    return found[:, 0].astype(A.U64), *found[:, 1:].astype(np.float64).T


def _level(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    own = ln_kt(zeros, ones)
    return keys, zeros, ones, own, np.logaddexp(own, below) - math.log(2)


def code_lengths(counts: DataFrame, depth: int = DEPTH, subtree: int = SUBTREE) -> DataFrame:
    """key and value, log10 of the probability of its last byte after the bytes before, for each string. counts: key, n."""
    near = F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int")
    sizes = counts.groupBy(near.alias("sub")).count()
    most = max(subtree, (counts.count() if depth > 2 else 0) // 1000)
    hot = [r["sub"] for r in sizes.where(F.col("count") > most).collect()] if depth > 2 else []  # a thousand at most
    # subtrees by three bytes are told by a bit above these
    sub = F.when(near.isin(hot), F.shiftright("key", 8).bitwiseAND(0xFFFFFF).cast("int").bitwiseOR(1 << 24)).otherwise(near) if hot else near
    sorted_ = counts.withColumn("sub", sub).select("sub", "key", "n").repartition("sub").sortWithinPartitions("sub")
    roots = pa.schema([("top", pa.int32()), ("key", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("weighted", pa.float64())])

    def upward(batches):
        for sub, key, n in _groups(batches, 3):
            top = 3 if sub[0] >> 24 else 2
            for places in _apart(len(key)):
                keys, zeros, ones, _, weighted = levels(key.astype(A.U64), n, top, depth, places)[0]
                if len(keys):
                    yield A.batch_of(roots, np.full(len(keys), top, np.int32), keys.astype(np.int64), zeros, ones, weighted)
        A.trim()

    up = sorted_.mapInArrow(upward, "top int, key long, zeros double, ones double, weighted double")
    if hot:
        up = written(up, "roots")
    two = _level(*_sums_of(up.where("top = 3"), 16)) if hot else None
    # the sums of each first context byte's nodes: 256 x 255 rows at most
    one = _sums_of(up.where("top = 2"), 8)
    if hot:
        keys, zeros, ones, _, weighted = two
        first = keys & A.U64(0xFFFF)
        one = _sums(*(np.concatenate(x) for x in zip(one, (first, zeros, ones, weighted), strict=True)))
    one = _level(*one)
    top = [_level(*_sums(one[0] & A.U64(255), one[1], one[2], one[4])), one]
    shared = counts.sparkSession.sparkContext.broadcast((top, [two] if hot else []))
    schema = pa.schema([("key", pa.int64()), ("value", pa.float32())])

    def downward(batches):
        above, split = shared.value
        for sub, key, n in _groups(batches, 3):
            gram, value = key.astype(A.U64), np.zeros(len(key))
            known = above + split if sub[0] >> 24 else above
            for places in _apart(len(key)):
                tables = known + levels(gram, n, len(known), depth, places)
                step = BLOCK // len(places)
                for i in range(0, len(gram), step):
                    value[i : i + step] += _mixed(gram[i : i + step], tables, places)
            for i in range(0, len(gram), BLOCK):
                yield A.batch_of(schema, key[i : i + BLOCK], value[i : i + BLOCK].astype(np.float32))
        A.trim()

    return sorted_.mapInArrow(downward, "key long, value float")


def scores(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK, subtree: int = SUBTREE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    docs, chunks = _chunked(docs, chunk_bytes)
    listed = written(_listed(docs, depth), "strings")
    totals = written(listed.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words = totals.where("key < 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    # code lengths travel as floats, as half of what is shuffled would be digits beyond those that count; counts stay whole
    values = words.select("key", F.lit(None).cast("float").alias("value"), "n").unionByName(code_lengths(totals.where("key >= 0"), depth, subtree).withColumn("n", F.lit(None).cast("long")))
    answers = _parcels(listed.select("chunk", "key").join(values, "key")).select("chunk", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("held_out"), "n", "words", "keys", "found")
    asked = docs.select("chunk", "doc_id", "text", "held_out", F.lit(None).cast("int").alias("n"), F.lit(None).cast("boolean").alias("words"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("found"))
    # a chunk for each task, as far as that goes
    tasks = min(chunks, MOST_TASKS)
    met = answers.unionByName(asked).repartitionById(tasks, F.col("chunk") % tasks).sortWithinPartitions("chunk", F.col("n").isNull())
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], *[(c, pa.float64()) for c in ("base_score", "score", "bits_per_byte")]])
    floor = math.log10(n + v + 1)

    def run(batches):
        chunk, found, lookup = None, {False: [], True: []}, None

        def joined(parts, k, dtype):
            out, at = np.empty(sum(len(p[0]) for p in parts), dtype), 0
            for p in parts:
                out[at : at + len(p[0])] = p[k]
                at += len(p[0])
                p[k] = None  # what has been copied goes
            return out

        def table(words):
            parts = found[words]
            values = joined(parts, 1, np.float64 if words else np.float32)
            keys = joined(parts, 0, np.uint64)
            parts.clear()
            return Lookup(keys, values)

        for batch in batches:
            of = batch.column(0).to_numpy()
            given = np.asarray(batch.column(4).is_valid())
            edges = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (given[1:] != given[:-1])])) if len(of) else []
            for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
                if of[a] != chunk:
                    chunk, lookup, counts = of[a], None, None
                part = batch.slice(a, b - a)
                if given[a]:
                    for size, words, key, value in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(6), part.column(7), strict=True):
                        found[words].append([np.cumsum(_unsqueezed(key.as_buffer(), size, np.uint64), dtype=np.uint64), _unsqueezed(value.as_buffer(), size, np.float64 if words else np.float32)])
                    continue
                if lookup is None:
                    lookup, counts = table(False), table(True)
                for i, j, buf, offs in A.slabs(part.column(2), SLAB):
                    gram, doc = grams(buf, offs, depth)
                    score = np.bincount(doc, lookup(gram), j - i)
                    word, doc = word_keys(buf, offs)
                    count, ends = counts(word), counts(np.full(j - i, END_KEY))
                    tokens = np.bincount(doc, minlength=j - i) + 1
                    base = np.bincount(doc, np.log10(count + 1), j - i) + np.log10(ends + 1) - tokens * floor
                    known = np.bincount(doc, count > 0, j - i).astype(np.int64) + (ends > 0)
                    bits = -score * math.log2(10) / (np.diff(offs) + 1)
                    yield A.batch_of(schema, part.column(1)[i:j], part.column(3)[i:j], tokens, known, np.full(j - i, n), base, score, bits)
        A.trim()

    return met.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
