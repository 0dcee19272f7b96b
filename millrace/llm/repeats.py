"""Removal of long strings that occur earlier, by run-length compressed suffix indexes.

Every window of LENGTH bytes is known by its anchor, the gram in it (a string of GRAMS[0] bytes) of the least hash, the
leftmost of equals. Adjacent windows with one anchor form a segment, so windows are equal only if the segments that they
lie in have equal anchors: all comparisons can be made where an anchor's segments meet.

1. Segments are dealt out by anchor. Whole segments that are equal are one string of the collection: all but the first
   are repeats. Writers settle this for their own rows first, so copies in any number leave few rows of one anchor. The
   different segments of an anchor that very many documents have (one in SHARE of a sample's segments, so no more than SHARE
   anchors are) are dealt over DEALT tasks by their hashes; the sample decides on nothing but that.
2. Segments that share an anchor but differ are fetched and indexed, a bounded lot of whole anchors at a time. Kept of
   the Burrows-Wheeler transform are its runs and, sampled at the run ends, the text positions on either side of each
   border and how far they agree. Streaming the text past the samples gives the matching statistics of each place:
   where the suffix sorted before it stands, and how long the two agree. Over LENGTH bytes the window occurs
   elsewhere; following the places found that way leads all equal windows to one, and the earliest stays.
3. An anchor of over HOT different segments (a common line in ever new surroundings) doesn't fit a lot. Its windows are
   anchored again by the next longer gram, and go through the same two steps. The last gram is the
   window itself, of which no two different segments exist.
4. The repeats of a document are joined to it and cut out.

Texts are taken as UTF-8 bytes; null is empty. Texts shorter than LENGTH lose nothing. Null doc_ids come last. Rows that
repeat a doc_id, or have none, are one document if their texts are equal (each row is cut at its marks), else
documents of their own, in the order of a hash of the text. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import texts, written

LENGTH = 100
#: Bytes of an anchor: at first, and of the windows of an anchor that has too many segments.
GRAMS = (40, 72, LENGTH)
#: Documents longer than this are read in parts that overlap by LENGTH - 1 bytes.
PART = 1 << 20
#: Different segments of one anchor above which its windows are anchored again, and bytes of a lot that is indexed.
HOT, LOT = 2000, 1 << 19
#: Segments that a writer compares with each other, and bytes of contexts it holds, before it lets them go.
HELD, HELD_BYTES = 250_000, 1 << 21
#: One document in so many is looked at for anchors that are dealt over several tasks; the share of segments that makes one, and those tasks.
SAMPLE, SHARE, DEALT = 64, 2000, 256
_PLACE = A.U64((1 << 24) - 1)
LAST_ID = np.iinfo(np.int64).max


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width adjacent keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def segments(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAMS[0]):
    """Anchor hash, segment hash, document number, start in the document and number of windows of each segment."""
    counts = np.maximum(np.diff(offs) - (length - 1), 0)
    total = int(counts.sum())
    if not total:
        e = np.zeros(0, np.int64)
        return e.astype(A.U64), e.astype(A.U64), e, e, e
    sums = A.prefix_hash(buf)
    n = len(buf) - gram + 1
    grams = A.mix((sums[gram:] - sums[:-gram]) * A._power("down", n))
    lowest = _lowest((grams & ~_PLACE) | np.arange(n, dtype=A.U64), length - gram + 1)
    starts = np.arange(total) + np.repeat(offs[:-1] - (np.cumsum(counts) - counts), counts)
    anchor = (lowest[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    size = np.diff(np.append(first, total))
    begin = starts[first]
    doc = np.searchsorted(offs, begin, "right") - 1
    return grams[anchor[first]], A.span_hash(sums, begin, begin + size + length - 1), doc, begin - offs[doc], size


def _parts(column, length: int):
    """(first row, end row, bytes, offsets, bytes skipped): slabs, with long documents in overlapping parts."""
    for i, j, buf, offs in A.slabs(column):
        if j - i > 1 or len(buf) <= PART:
            yield i, j, buf, offs, 0
        else:
            for at in range(0, len(buf) - length + 1, PART):
                part = buf[at : at + PART + length - 1]
                yield i, j, part, np.array([0, len(part)]), at


SEGMENTS = "key long, seg long, doc_id long, twin long, start int, n int"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, ddl.split(", "))])


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id (the last for null), unnamed (it is null), twin and text; and whether a document may have several rows.

    twin tells apart rows of one doc_id, or of none, by a hash of their texts; it is 0 where the doc_id says enough.
    """
    docs = texts(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce("text", F.lit("")).alias("text"))
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("unnamed").alias("any")).where("rows > 1 or any").select(F.col("doc_id").alias("again"))
    again = written(again, "repeated-ids")
    if again.isEmpty():
        return docs.withColumn("twin", F.lit(0).cast("long")), False
    told = docs.join(again, F.col("doc_id") == F.col("again"), "left")
    return told.withColumn("twin", F.when(F.col("again").isNull(), 0).otherwise(F.xxhash64("text", "unnamed")).cast("long")).drop("again"), True


def _first_of_equals(found: list[tuple]) -> pa.RecordBatch:
    """A writer's segments, the first of equals; the others as marks: n negative, key arbitrary."""
    key, seg, doc, twin, start, n = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((start, twin, doc))
    key, seg, doc, twin, start, n = (x[order] for x in (key, seg, doc, twin, start, n))
    _, first, back = np.unique(A.mix(key) ^ seg, return_index=True, return_inverse=True)
    lead = first[back]
    later = lead != np.arange(len(lead))
    n[later] *= -1
    key[later] = A.mix(doc[later].astype(A.U64) + start[later].astype(A.U64))
    real = ~(later & (doc == doc[lead]) & (twin == twin[lead]) & (start == start[lead]))  # the same occurrence again
    return A.batch_of(_schema(SEGMENTS), key.view(np.int64)[real], seg.view(np.int64)[real], doc[real], twin[real], start[real], n[real])


def _segment_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments of all texts. docs: doc_id, twin, text."""

    def run(batches):
        for batch in batches:
            ids, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found, size = [], 0
            for i, _, buf, offs, skipped in _parts(batch.column(2), length):
                key, seg, doc, start, n = segments(buf, offs, length, gram)
                found.append((key, seg, ids[i + doc], twins[i + doc], start + skipped, n))
                size += len(key)
                if size > HELD:
                    yield _first_of_equals(found)
                    found, size = [], 0
            if found:
                yield _first_of_equals(found)

    return docs.select("doc_id", "twin", "text").mapInArrow(run, SEGMENTS)


MARKS = "key long, doc_id long, twin long, start int, n int, open boolean"


def _some(df: DataFrame) -> DataFrame:
    """The rows of one document in SAMPLE."""
    return df.where(F.pmod(F.xxhash64("doc_id", "twin"), F.lit(SAMPLE)) == 0)


def _settle(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Marks (n windows from start), and with open true segments whose anchor has other segments too, or may have. rows: segments in any order; some: those of a sample."""
    schema = _schema(MARKS)
    counts = written(some.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("segments")), "sampled-anchors")
    total = counts.agg(F.coalesce(F.sum("segments"), F.lit(0))).first()[0]
    # no more than SHARE rows
    wide = F.broadcast(counts.where(F.col("segments") > max(16, total // SHARE)).select("key", F.lit(True).alias("wide")))
    dealt = F.when(F.col("wide"), F.pmod("seg", F.lit(DEALT))).otherwise(0)
    rows = rows.join(wide, "key", "left").select("key", "seg", "doc_id", "twin", "start", "n", F.coalesce("wide", F.lit(False)).alias("wide"))

    def run(batches):
        before = None  # key, seg, doc_id, twin, start of the last segment
        held = None  # the first segment of the last key, if it is that key's only one so far
        for batch in batches:
            key, seg, doc, twin, start, n = (batch.column(i).to_numpy() for i in range(6))
            wide = batch.column(6).to_numpy(zero_copy_only=False)
            mark = n < 0
            marks = [(key[mark], doc[mark], twin[mark], start[mark], -n[mark], np.zeros(int(mark.sum()), bool))]
            key, seg, doc, twin, start, n, wide = (x[~mark] for x in (key, seg, doc, twin, start, n, wide))
            if len(key):
                p = before or (~key[0], 0, 0, 0, 0)
                pk, ps, pd, pw, pt = (np.concatenate([[v], x[:-1]]) for v, x in zip(p, (key, seg, doc, twin, start), strict=True))
                same_key = key == pk
                same = same_key & (seg == ps)
                later = same & ~((doc == pd) & (twin == pw) & (start == pt))
                marks.append((key[later], doc[later], twin[later], start[later], n[later], np.zeros(int(later.sum()), bool)))
                first = np.flatnonzero(~same)
                prior = same_key[first]  # not the first segment of its key
                follow = np.concatenate([prior[1:], [False]])
                if held is not None and len(first) and prior[0]:
                    marks.append(tuple(np.array([x]) for x in (*held, True)))
                    held = None
                opened = prior | follow | wide[first]
                at = first[opened]
                marks.append((key[at], doc[at], twin[at], start[at], n[at], np.ones(len(at), bool)))
                if len(first):
                    at = first[-1]
                    held = None if opened[-1] else (key[at], doc[at], twin[at], start[at], n[at])
                before = key[-1], seg[-1], doc[-1], twin[-1], start[-1]
            yield A.batch_of(schema, *map(np.concatenate, zip(*marks, strict=True)))

    return rows.repartition("key", dealt).sortWithinPartitions("key", "seg", "doc_id", "twin", "start").mapInArrow(run, MARKS)


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of a collection of byte strings.

    Kept, besides the strings' sizes, is what there is of each run: its symbol and first row; and the samples of its
    border with the run above, by place in the text: the place of its first row, the place of the last row of
    the run above, and how many symbols these agree in. Each string ends in a symbol of its own, below all others, so no
    two suffixes are equal, and the runs of these symbols are one row each.
    """

    def __init__(self, strings: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(self.sizes + 1) - 1
        self.n = n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = np.concatenate(strings).astype(np.int64) + 1
        known = np.zeros(257, bool)
        known[text] = True
        known[0] = True
        text = (np.cumsum(known) - 1)[text]
        #: Symbols from each place to the end of its string.
        left = np.repeat(ends, self.sizes + 1) - np.arange(n)
        keys, width = self._packed(text, left, int(known.sum()))
        order = self._sorted(keys, width, left)

        before = text[order - 1]
        before[left[order] == np.repeat(self.sizes, self.sizes + 1)[order]] = 0  # a string's first place
        self.heads = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)]))
        self.symbols = before[self.heads]
        # samples at the borders, in the order of the text
        place, above = order[self.heads], order[self.heads - 1]
        agree = self._agreement(keys, width, text, left, place, above)
        agree[0] = 0
        by_place = np.argsort(place)
        self.places, self.above, self.agree = place[by_place], above[by_place], agree[by_place]

    @staticmethod
    def _packed(text: np.ndarray, left: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
        """The first symbols of each suffix as one number, as many as fit (a power of two); zeros beyond its end."""
        bits = max(1, (symbols - 1).bit_length())
        keys, width = text.copy(), 1
        while 2 * width * bits <= 62:
            further = np.zeros(len(keys), np.int64)
            further[:-width] = keys[width:]
            further[left < width] = 0
            keys = (keys << (width * bits)) | further
            width *= 2
        return keys, width

    @staticmethod
    def _sorted(keys: np.ndarray, width: int, left: np.ndarray) -> np.ndarray:
        """The places in the order of their suffixes, by prefix doubling of those that still agree with others."""
        n = len(keys)
        order = np.argsort(keys)
        rank = np.empty(n, np.int64)
        slot, group = np.arange(n), keys[order]
        span = width
        while True:
            # a group's rank is its first slot
            first = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.flatnonzero(first)
            rank[order[slot]] = np.repeat(slot[start], np.diff(np.append(start, len(slot))))
            many = ~first
            many[:-1] |= ~first[1:]
            slot = slot[many]
            mine = order[slot]
            over = left[mine] < span  # the ends themselves have been compared: the order of the strings decides
            if over.any():
                order[slot[over]] = mine[over][np.lexsort((mine[over], rank[mine[over]]))]
                slot, mine = slot[~over], mine[~over]
            if not len(slot):
                return order
            group = rank[mine] * (n + 1) + rank[mine + span]
            by = np.argsort(group)
            group = group[by]
            order[slot] = mine[by]
            span *= 2

    @staticmethod
    def _agreement(keys, width, text, left, a, b) -> np.ndarray:
        """In how many symbols the suffixes at a and b agree."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        least = np.minimum(left[a], left[b])
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            same = (out[live] + width <= least[live]) & (keys[x] == keys[y])
            live = live[same]
            out[live] += width
        live = np.arange(len(a))
        while len(live):
            same = (out[live] < least[live]) & (text[a[live] + np.minimum(out[live], least[live])] == text[b[live] + np.minimum(out[live], least[live])])
            live = live[same]
            out[live] += 1
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, streamed from its sample on: the place of the suffix sorted before, and in how many symbols it agrees.

        Where a place and the one before it in the text lie within runs, both of their neighbours do too, one symbol further on:
        the samples of the border before hold, with one symbol less for each step.
        """
        sample = np.zeros(self.n, np.int64)
        sample[self.places] = np.arange(len(self.places))
        sample = np.maximum.accumulate(sample)
        gone = np.arange(self.n) - self.places[sample]
        return self.above[sample] + gone, self.agree[sample] - gone


def repeated_windows(strings: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which windows occur before: in an earlier string or earlier in the same."""
    index = RunLengthIndex(strings)
    above, agree = index.statistics()
    linked = agree >= length
    at = np.flatnonzero(linked)
    # the place that each chain of equal windows leads to
    lead = np.where(linked, above, np.arange(index.n))
    live = at
    while len(live):
        further = lead[lead[live]]
        live, further = live[further != lead[live]], further[further != lead[live]]
        lead[live] = further
    first = np.arange(index.n)
    np.minimum.at(first, lead[at], at)
    hit = np.zeros(index.n, bool)
    hit[at] = first[lead[at]] != at
    tops = np.unique(lead[at])
    hit[tops] = first[tops] != tops
    starts = np.cumsum(index.sizes + 1) - (index.sizes + 1)
    return [hit[a : a + max(0, s - length + 1)] for a, s in zip(starts.tolist(), index.sizes.tolist(), strict=True)]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


CONTEXTS = "key long, doc_id long, twin long, start int, body binary"


def _with_spans(docs: DataFrame, wanted: DataFrame, several: bool) -> DataFrame:
    """doc_id, twin, text as bytes and the wanted segments of each document that has some."""
    lists = wanted.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "n", "key")).alias("spans"))
    body = docs.dropDuplicates(["doc_id", "twin"]) if several else docs
    return body.join(lists, ["doc_id", "twin"]).select("doc_id", "twin", F.col("text").cast("binary").alias("text"), "spans")


def _contexts(docs: DataFrame, wanted: DataFrame, several: bool, length: int) -> DataFrame:
    """key, doc_id, twin, start, body of the wanted segments."""
    schema = _schema(CONTEXTS)

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for doc_id, twin, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                raw = text.as_buffer()
                part = spans.values
                for key, start, n in zip(part.field("key").to_pylist(), part.field("start").to_pylist(), part.field("n").to_pylist(), strict=True):
                    out.append((key, doc_id, twin, start, raw[start : start + n + length - 1].to_pybytes()))
                    held += n + length + 100
                if held > HELD_BYTES:
                    yield A.batch_of(schema, *map(list, zip(*out, strict=True)))
                    out, held = [], 0
            if out:
                yield A.batch_of(schema, *map(list, zip(*out, strict=True)))

    return _with_spans(docs, wanted, several).mapInArrow(run, CONTEXTS)


def _anchored_again(docs: DataFrame, wanted: DataFrame, several: bool, length: int, gram: int) -> DataFrame:
    """The segments, by a longer anchor, of the windows of the wanted segments."""

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for doc_id, twin, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                begin = spans.values.field("start").to_numpy()
                ends = begin + spans.values.field("n").to_numpy() + length - 1
                step = max(1, PART // (2 * length))  # a span has at most length windows
                for i in range(0, len(begin), step):
                    a, b = begin[i : i + step], ends[i : i + step]
                    offs = np.concatenate([[0], np.cumsum(b - a)])
                    buf = np.concatenate([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    key, seg, span, start, n = segments(buf, offs, length, gram)
                    found.append((key, seg, np.full(len(key), doc_id), np.full(len(key), twin), a[span] + start, n))
                    size += len(key)
                    if size > HELD:
                        yield _first_of_equals(found)
                        found, size = [], 0
        if found:
            yield _first_of_equals(found)

    return _with_spans(docs, wanted, several).mapInArrow(run, SEGMENTS)


PLACES = "doc_id long, twin long, start int, n int"


def _index_lots(rows: DataFrame, length: int) -> DataFrame:
    """Marks of the windows that occur earlier among the segments of their anchor. rows: contexts."""
    schema = _schema(PLACES)

    def solve(lot):
        # anchors sort apart, and within one the earlier segments come first
        key, doc, twin, start, bodies = (np.concatenate(x) for x in zip(*lot, strict=True))
        strings = [np.frombuffer(b, np.uint8) for b in bodies]
        hits = repeated_windows(strings, length)
        sizes = np.array(list(map(len, hits)))
        if not sizes.sum():
            return None
        base = np.cumsum(sizes + 1) - (sizes + 1)  # a gap after each, so no run spans two
        flat = np.zeros(int((sizes + 1).sum()), bool)
        for at, hit in zip(base.tolist(), hits, strict=True):
            flat[at : at + len(hit)] = hit
        at, n = _runs(flat)
        of = np.searchsorted(base, at, "right") - 1
        return A.batch_of(schema, doc[of], twin[of], start[of] + (at - base[of]), n)

    def run(batches):
        lot, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, twin, start = (batch.column(i).to_numpy() for i in range(4))
            bodies = np.array(batch.column(4).to_pylist(), object)
            long = pc.binary_length(batch.column(4)).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if size > LOT and key[a] != last:
                    if (done := solve(lot)) is not None:
                        yield done
                    lot, size = [], 0
                lot.append((key[a:b], doc[a:b], twin[a:b], start[a:b], bodies[a:b]))
                size += int(long[a:b].sum())
                last = key[b - 1]
        if lot and (done := solve(lot)) is not None:
            yield done
        A.trim()

    return rows.repartition("key").sortWithinPartitions("key", "doc_id", "twin", "start").mapInArrow(run, PLACES)


def _marks(docs: DataFrame, several: bool, length: int, grams: tuple[int, ...], hot: int) -> DataFrame:
    rows, some, out = _segment_rows(docs, length, grams[0]), _segment_rows(_some(docs), length, grams[0]), []
    for level, _ in enumerate(grams):
        settled = written(_settle(rows, some), "segments")
        out.append(settled.where("not open").select("doc_id", "twin", "start", "n"))
        unsure = settled.where("open").select("key", "doc_id", "twin", "start", "n")
        # of the windows themselves no two segments of an anchor differ
        if level + 1 == len(grams):
            break
        # a table, so that the planner knows its size before it decides on a way to join it
        many = written(unsure.groupBy("key").agg(F.count(F.lit(1)).alias("segments")).where(F.col("segments") > hot).select("key"), "hot-anchors")
        any_hot = not many.isEmpty()
        found = written(_contexts(docs, unsure.join(many, "key", "left_anti") if any_hot else unsure, several, length), "contexts")
        out.append(_index_lots(found, length))
        if not any_hot:
            break
        again = unsure.join(many, "key", "left_semi")
        rows, some = (_anchored_again(f(docs), f(again), several, length, grams[level + 1]) for f in (lambda df: df, _some))
    marks = out[0]
    for more in out[1:]:
        marks = marks.unionByName(more)
    return marks


def marks(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, hot: int = HOT) -> DataFrame:
    """doc_id, twin, start, n: windows that occur earlier, n from start on. grams: lengths of anchors, the last that of the windows."""
    docs, several = keyed(docs)
    return _marks(docs, several, length, grams, hot)


def cut(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the removed runs, in bytes) and kept (the bytes that remain)."""
    docs, several = keyed(docs)
    lists = _marks(docs, several, length, grams, hot).groupBy(F.col("doc_id").alias("mark_id"), F.col("twin").alias("mark_twin")).agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    joined = docs.join(lists, (F.col("doc_id") == F.col("mark_id")) & (F.col("twin") == F.col("mark_twin")), "left")
    joined = joined.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("marks.start").alias("starts"), F.col("marks.n").alias("sizes"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for doc_id, text, starts, sizes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                if not starts.is_valid:
                    out.append((doc_id, len(raw), [], [], raw.tobytes()))
                else:
                    a = np.minimum(starts.values.to_numpy(), len(raw))
                    b = np.minimum(a + sizes.values.to_numpy() + length - 1, len(raw))
                    depth = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    s, n = _runs(gone)
                    out.append((doc_id, len(raw), s.tolist(), (s + n).tolist(), raw[~gone].tobytes()))
                held += len(raw)
                if held > HELD_BYTES:
                    yield A.batch_of(schema, *map(list, zip(*out, strict=True)))
                    out, held = [], 0
            if out:
                yield A.batch_of(schema, *map(list, zip(*out, strict=True)))

    return joined.mapInArrow(run, "doc_id long, n_bytes long, starts array<int>, ends array<int>, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
