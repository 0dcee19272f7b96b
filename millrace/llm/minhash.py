"""Near-duplicates by DartMinHash signatures.

Darts are thrown at the plane of weight and rank, one plane for each shingle: the plane is cut
into cells, doubling in both directions; a hash of (shingle, cell) says how many darts hit the
cell and hashes of (shingle, cell, dart) say where. A document owns the darts below the
weights of its shingles. Each dart names a coordinate of the signature, which keeps
its dart of the lowest rank. About k ln k + 2k darts fill k coordinates, so ranks are cut off at that
number over the document's weight, and the few documents that miss one get twice as many.
Two documents agree in a coordinate with the probability of their weighted Jaccard similarity. A shingle weighs as much
as it occurs in the document, so this is the similarity of the bags of shingles, and links are verified as such:
the sum of the lesser counts over the sum of the greater ones is 0.8 or more.

Signatures are banded; documents that share a band are candidates. Each document is first compared with the
centre (the smallest identifier) that it shares most bands with. What these links leave in several components
within a bucket is compared there, in blocks of bounded size, by exact intersections of the bags of shingles; only
links between components leave a block. So no link is lost to a cap, and no pairs are listed.

A document's words are the runs without ASCII white space, its shingles are its runs of five
adjacent words (all its words, if it has one to four). Documents of equal words are one
text. Null and wordless texts are equal to each other and near nothing else. A text, not a doc_id, is what is linked: rows
that repeat a doc_id, or have none, belong to the classes of their texts. Null doc_ids come last. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .graph import components, parts
from .tables import apart, chosen, one_of_each, squeezed, texts, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS
#: Bounds of the cells in rank and in weight.
RANKS = [0.0, 1 / 16, 1 / 4, *[2.0**i for i in range(0, 24)]]
WEIGHTS = [0.0, *[2.0**i for i in range(0, 24)]]


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities, up to certainty."""
    n = int(mean + 12 * math.sqrt(mean) + 16)
    log = np.arange(n) * math.log(mean) - mean - np.cumsum(np.log(np.maximum(np.arange(n), 1)))
    return np.cumsum(np.exp(log))


_CDF: dict[float, np.ndarray] = {}


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> A.U64(11)).astype(np.float64) * 2.0**-53


def _darts(elements: np.ndarray, weights: np.ndarray, top: np.ndarray, k: int):
    """Element index, coordinate and rank of the darts below each element's weight and rank limit."""
    most_rank, most_weight = top.max(initial=0), weights.max(initial=0)
    for w in range(len(WEIGHTS) - 1):
        if WEIGHTS[w] >= most_weight:
            break
        for r in range(len(RANKS) - 1):
            if RANKS[r] >= most_rank:
                break
            at = np.flatnonzero((top > RANKS[r]) & (weights > WEIGHTS[w]))
            if not len(at):  # else the cell is no larger than a document's region: its rank limit falls with its weight
                continue
            height, width = RANKS[r + 1] - RANKS[r], WEIGHTS[w + 1] - WEIGHTS[w]
            seed = A.mix(np.array([w * 1000 + r + 1], A.U64))[0]
            cell = A.mix(elements[at] ^ seed)
            area = height * width
            if area not in _CDF:
                _CDF[area] = _poisson(area)
            n = np.searchsorted(_CDF[area], _unit(cell), "right")
            owner = np.repeat(np.arange(len(at)), n)
            if not len(owner):
                continue
            ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            h = A.mix(cell[owner] + (ordinal + 1).astype(A.U64) * A.U64(0x9E3779B97F4A7C15))
            rank = RANKS[r] + height * _unit(h)
            owner = at[owner]
            h = A.mix(h + A.U64(0x632BE59BD9B4E019))
            good = rank < top[owner]
            if width > 1 or most_weight < 1 or weights[at].min() < WEIGHTS[w + 1]:
                good &= WEIGHTS[w] + width * _unit(A.mix(h ^ A.U64(0xD1B54A32D192ED03))) < weights[owner]
            yield owner[good], ((h[good] >> A.U64(32)) * A.U64(k) >> A.U64(32)).astype(np.int64), rank[good]


def signatures(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, nd: int, k: int = K) -> np.ndarray:
    """(nd, k) of uint32: each coordinate's lowest dart, by the bits of its rank. Documents without elements: zeros."""
    total = np.bincount(doc, weights, nd)
    out = np.zeros((nd, k), np.uint32)
    t = k * math.log(k) + 2 * k
    open_docs = total > 0
    while open_docs.any():
        limit = np.where(open_docs, t / np.maximum(total, 1e-300), 0)
        mine = np.flatnonzero(open_docs[doc])
        if math.isclose(len(mine), len(doc)):
            mine = slice(None)
        d, e, w = doc[mine], elements[mine], weights[mine]
        slots = []
        for owner, coordinate, rank in _darts(e, w, limit[d], k):
            slots.append(((d[owner] * k + coordinate).astype(A.U64) << A.U64(32)) | rank.astype(np.float32).view(np.uint32).astype(A.U64))
        slots = np.sort(np.concatenate(slots)) if slots else np.zeros(0, A.U64)
        place = (slots >> A.U64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        filled = np.bincount(place[first] // k, minlength=nd) == k
        flat = np.zeros(nd * k, np.uint32)
        flat[place[first]] = slots[first].astype(np.uint32)
        done = open_docs & filled
        out[done] = flat.reshape(nd, k)[done]
        open_docs &= ~filled
        t *= 2
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    h = np.zeros((len(sig), bands), A.U64)
    for i in range(rows):
        h = h * A.U64(0xFF51AFD7ED558CCD) + sig[:, i::rows][:, :bands].astype(A.U64) + A.U64(1)
    return A.mix(h + np.arange(1, bands + 1, dtype=A.U64) * A.U64(0x9E3779B97F4A7C15)).view(np.int64)


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 52-bit hash and count of the distinct shingles of a slab, by document and hash."""
    a, b, doc = A.words(buf, offs)
    h = A.span_hash(A.prefix_hash(buf), a, b)
    at, wide = A.windows(h, doc, WORDS)
    keys = A.doc_keys(doc[at], wide)
    n = np.bincount(doc, minlength=len(offs) - 1)
    small = n[doc] < WORDS
    if small.any():
        ds, hs = doc[small], h[small]
        begins = np.flatnonzero(np.concatenate([[True], ds[1:] != ds[:-1]]))
        place = np.arange(len(ds)) - np.repeat(begins, np.diff(np.append(begins, len(ds))))
        keys = np.concatenate([keys, A.doc_keys(ds[begins], A.mix(np.add.reduceat(A.mix(hs + place.astype(A.U64)), begins)))])
    keys, counts = np.unique(keys, return_counts=True)
    return (keys >> A.U64(A.KEY_BITS)).astype(np.int64), keys & A.U64((1 << A.KEY_BITS) - 1), counts


def text_key() -> Column:
    """128 bits of a digest of a text's words; as signed() has it."""
    return F.unhex(F.substring(F.sha2(F.trim(squeezed()), 256), 1, 32))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles (with repeats) and bands of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in A.slabs(batch.column(1)):
                doc, elements, counts = shingles(buf, offs)
                sig = signatures(doc, A.mix(elements), counts.astype(np.float64), j - i)
                raw = buf.tobytes()
                keys = [hashlib.sha256(A.squeeze(raw[a:b]).strip(b" ")).digest()[:16] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(band_hashes(sig).ravel()))
                yield A.batch_of(schema, batch.column(0)[i:j], keys, np.bincount(doc, counts, j - i).astype(np.int64), bands)

    return texts(docs).mapInArrow(run, "doc_id long, text_key binary, n_shingles long, bands array<long>")


def _grams(docs: DataFrame) -> DataFrame:
    """doc_id and a hash of eight bytes for each occurrence of a shingle, the first, second, ... of equal ones told apart: bags as sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in A.slabs(batch.column(1)):
                doc, elements, counts = shingles(buf, offs)
                ends = np.cumsum(np.concatenate([[0], np.bincount(doc, counts, j - i)])).astype(np.int64)
                if len(counts) and counts.max() > 1:
                    begins = np.cumsum(counts) - counts
                    nth = (np.arange(int(counts.sum())) - np.repeat(begins, counts)).astype(A.U64)
                    elements = np.repeat(elements, counts)
                    elements = np.where(nth > 0, A.mix(elements + nth * A.U64(0x9E3779B97F4A7C15)) >> A.U64(64 - A.KEY_BITS), elements)
                yield A.batch_of(schema, batch.column(0)[i:j], [elements[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)])

    return docs.mapInArrow(run, "doc_id long, grams binary")


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose bags of shingles have at least the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good.append(same >= similarity * (len(both) - same) and same > 0)
            good = np.array(good, bool)
            yield A.batch_of(schema, batch.column(0).to_numpy()[good], batch.column(1).to_numpy()[good])

    one, two = (bodies.select(F.col("doc_id").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long")


def block_links(ids: np.ndarray, parts_: np.ndarray, grams: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join all components of a block which the similarity joins: one fewer than the components that become one."""
    ids, first = np.unique(ids, return_index=True)
    parts_, grams = parts_[first], [grams[i] for i in first]
    size = np.array([len(g) for g in grams])
    owner = np.repeat(np.arange(len(ids)), size)
    _, code, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    same = np.zeros((len(ids), len(ids)), np.float32)
    width = 2048
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [at, at + width])
        hits = np.zeros((len(ids), width), np.float32)
        hits[owner[a:b], code[a:b] - at] = 1
        same += hits @ hits.T
    near = same >= similarity * (size[:, None] + size[None, :] - same)
    near &= same > 0
    out, label = [], {int(p): int(p) for p in parts_}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(near[i, :i] & (parts_[:i] != parts_[i])).tolist():
            x, y = root(int(parts_[i])), root(int(parts_[j]))
            if x != y:
                label[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[j])))
    return out


#: Documents and shingles of a block; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 768, 2_000_000


def _across(rows: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """Links between the components of each bucket. rows: bucket, doc_id, n, component."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = rows.join(rows.groupBy("bucket").agg(blocks.alias("blocks")), "bucket")
    mine = sized.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = mine.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "component")

    def solve(table: pa.Table) -> pa.Table:
        ids, parts_ = table["doc_id"].to_numpy(), table["component"].to_numpy()
        found = []
        if (parts_ != parts_[0]).any():
            found = block_links(ids, parts_, [np.frombuffer(g.as_buffer(), np.uint64) for g in table["grams"]], similarity)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.join(bodies.hint("merge"), "doc_id").groupBy("bucket", "i", "j").applyInArrow(solve, "a long, b long")


def _nodes(sigs: DataFrame) -> tuple[DataFrame, bool]:
    """text_key, rep (its smallest doc_id), node, n, copies and bands of each text, and whether all nodes are reps.

    A node is rep, or a hash where rep is null or another text's too.
    """
    reps = sigs.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    unclear = written(reps.groupBy("rep").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1 or rep is null").select(F.col("rep").alias("unclear"), F.lit(True).alias("met")), "unclear-ids")
    if unclear.isEmpty():
        return reps.withColumn("node", F.col("rep")), True
    told = reps.join(unclear, F.col("rep").eqNullSafe(F.col("unclear")), "left")
    return told.withColumn("node", F.when(F.col("met"), F.xxhash64("text_key")).otherwise(F.col("rep"))).drop("unclear", "met"), False


def _texts_of(source: DataFrame, involved: DataFrame, clear: bool) -> DataFrame:
    """doc_id (the node) and text of the involved: node, rep, key. A doc_id's other rows are told apart by their words."""
    # said so that it isn't taken for a key of the join, which all rows would have to be given
    own = F.nullif(text_key(), F.col("key")).isNull()
    plain = source.join(involved.where("node = rep").hint("merge"), (F.col("doc_id") == F.col("rep")) & own).select(F.col("node").alias("doc_id"), "text")
    if clear:
        return plain
    # rows of null or shared doc_ids meet by their words at once
    shared = involved.where("rep is null or node <> rep")
    met = source.withColumn("own", text_key()).join(shared.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("key")))
    return plain.unionByName(met.select(F.col("node").alias("doc_id"), "text"))


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, text_key, class_id, class_size, kept."""
    source = texts(docs)
    sigs = written(signed(source), "signatures")
    reps, clear = _nodes(sigs)
    rows = reps.where("n > 0").select(F.col("node").alias("doc_id"), "rep", "text_key", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("centre")).where("members > 1").drop("members")
    live = written(rows.join(shared, "bucket"), "buckets")
    k = parts(live.count())
    # None of these has a proven bound, so none is broadcast at any size: plans, and what they shuffle, stay in proportion to the input.
    involved = live.select(F.col("doc_id").alias("node"), "rep", F.col("text_key").alias("key")).dropDuplicates(["node"]).coalesce(k)
    live = live.drop("rep", "text_key")
    bodies = written(_grams(_texts_of(source, involved, clear)).dropDuplicates(["doc_id"]), "shingles")
    met = live.where("doc_id <> centre").groupBy("doc_id", "centre").agg(F.count(F.lit(1)).alias("bands")).coalesce(k)
    best = met.groupBy(F.col("doc_id").alias("a")).agg(F.max_by("centre", F.struct("bands", -F.col("centre"))).alias("b")).coalesce(k)
    links = written(_verified(best, bodies, similarity), "near-links")
    part = components(links)

    known = live.join(part, live.doc_id == part.node, "left").select("doc_id", "n", "bucket", F.coalesce("component", "doc_id").alias("component")).coalesce(4 * k)
    mixed = known.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket").coalesce(k)
    more = written(_across(written(known.join(mixed, "bucket", "left_semi").coalesce(4 * k), "unsettled"), bodies, similarity).distinct().coalesce(k), "near-links")
    if not more.isEmpty():
        part = components(links.unionByName(more))

    part = part.withColumnRenamed("node", "met")
    found = reps.select("text_key", "rep", "copies", "node").join(part, F.col("node") == F.col("met"), "left").select("text_key", "rep", "copies", F.coalesce("component", "node").alias("component"))
    # the smallest doc_id leads, null ones last; of texts that share it, that of the smallest digest
    lead = F.min(F.struct(F.col("rep").isNull(), "rep", "text_key"))
    sizes = found.groupBy(F.col("component").alias("class")).agg(F.sum("copies").alias("class_size"), lead.alias("lead"))
    found = found.join(sizes, F.col("component") == F.col("class")).select("text_key", F.col("lead.rep").alias("class_id"), "class_size", (F.col("lead.text_key") == F.col("text_key")).alias("leads"))
    named = sigs.select("doc_id", "text_key").join(found, "text_key")
    return named.withColumn("kept", F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).drop("leads")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size, kept.

    A row for each row of docs. Rows of equal words share a class.
    """
    return _classes(docs, similarity).drop("text_key")


def keep(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with the columns that docs came with."""
    win = _classes(docs, similarity).where("kept").select(F.col("doc_id").alias("win_id"), F.col("text_key").alias("win_key"))
    return chosen(one_of_each(apart(docs, text_key())), win, docs.columns)
