"""Exact deduplication through a log-structured merge index.

Writers fill a memtable from digest to the smallest identifier and the number of its rows; a full memtable is flushed as a
run, sorted by digest. Runs are tables in the shared folder, so an append adds runs and rewrites nothing; a level of
FANOUT runs is compacted into one run of the next, where each digest keeps its smallest identifier. A Bloom filter
over the digests that several rows have is probed with each row's digest before anything is looked up: a row that it
does not know is alone. The others look up their digest in the compacted runs. A digest that several rows have
is only a hit: the texts behind it are compared byte by byte with that of its smallest identifier, and texts that differ
under one digest stay apart.

Texts are equal if identical after each run of ASCII white space becomes one space; null counts as
empty. Rows that repeat a doc_id are counted as rows of their group. Null doc_ids come last
among equals. Of rows that are equal in doc_id and text one is kept. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .tables import apart, chosen, one_of_each, shared_dir, squeezed, texts, written

MEMTABLE_ENTRIES = 65_536
#: A digest's length in bits; tests shorten it to see collisions.
DIGEST_BITS = 256
FANOUT = 8
#: Rows of a digest that one task may be given together.
SALT = 1000
#: Bits of a filter for each digest in it, as a bound, and the places that a digest has. Beyond the bound a filter says "perhaps" more often.
FILTER_BITS, MOST_FILTER_BITS, FILTER_PLACES = 10, 1 << 26, 4

RUN = "digest binary, first_id long, n long"
ROW = "digest binary, sha binary, doc_id long"


def flushed(docs: DataFrame, digest_bits: int = DIGEST_BITS, entries: int = MEMTABLE_ENTRIES) -> DataFrame:
    """The rows of each document (run is null) and the entries of the memtables, in runs sorted by digest.

    Digests are the first bits of the SHA-256 of the normalised bytes.
    """
    schema = pa.schema([("run", pa.int32()), ("digest", pa.binary()), ("sha", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64())])
    size = -(-digest_bits // 8)
    mask = 0xFF << (size * 8 - digest_bits) & 0xFF

    def flush(memtable: dict, run: int) -> pa.RecordBatch:
        digests = sorted(memtable)
        return A.batch_of(schema, [run] * len(digests), digests, [None] * len(digests), *map(list, zip(*(memtable[d] for d in digests), strict=True)))

    def run(batches):
        memtable: dict = {}
        number = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            shas = [hashlib.sha256(A.squeeze(text.as_py() or b"")).digest() for text in batch.column(1).cast(pa.binary())]
            digests = shas if digest_bits == 256 else [sha[: size - 1] + bytes([sha[size - 1] & mask]) for sha in shas]
            yield A.batch_of(schema, [None] * len(ids), digests, shas, ids, [None] * len(ids))
            for digest, i in zip(digests, ids, strict=True):
                first, n = memtable.get(digest, (None, 0))
                memtable[digest] = (i if first is None or (i is not None and i < first) else first, n + 1)
                if len(memtable) >= entries:
                    yield flush(memtable, number)
                    memtable, number = {}, number + 1
        if memtable:
            yield flush(memtable, number)

    return texts(docs).mapInArrow(run, "run int, digest binary, sha binary, doc_id long, n long")


def _places(bits: int) -> list[Column]:
    a, b = (F.xxhash64("digest", F.lit(i)).bitwiseAND(bits - 1) for i in range(2))
    return [(a + i * b).bitwiseAND(bits - 1) for i in range(FILTER_PLACES)]


class Filter:
    """A Bloom filter over digests. At most MOST_FILTER_BITS (8 MB) pass the driver."""

    def __init__(self, digests: DataFrame):
        spark = digests.sparkSession
        n = max(1, digests.count())
        self.bits = min(MOST_FILTER_BITS, max(1 << 15, 1 << (FILTER_BITS * n - 1).bit_length()))
        place = digests.select(F.explode(F.array(*[p + 1 for p in _places(self.bits)])).alias("place"))
        blocks = place.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
        table = np.zeros((self.bits >> 15, 1 << 12), np.uint8)
        for block, bitmap in blocks.collect():  # 2048 rows of 4 KB at most
            table[block - 1, : len(bitmap)] = np.frombuffer(bytes(bitmap), np.uint8)
        self.table = spark.sparkContext.broadcast(table.ravel())

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows with perhaps: whether the filter may have their digest."""
        table, fields = self.table, rows.schema
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in fields)}, perhaps boolean"

        def run(batches):
            bits = table.value
            for batch in batches:
                met = np.ones(batch.num_rows, bool)
                for i in range(FILTER_PLACES):
                    at = batch.column(len(fields) + i).to_numpy()
                    met &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(met)], names=[*batch.schema.names[: len(fields)], "perhaps"])

        return rows.select("*", *[p.alias(f"_place{i}") for i, p in enumerate(_places(self.bits))]).mapInArrow(run, schema)


class MergeIndex:
    """An index that grows by appended runs and is compacted level by level.

    Levels are tables under root; the state is their list, kept by whoever holds the object.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, digest_bits: int = DIGEST_BITS, fanout: int = FANOUT, entries: int = MEMTABLE_ENTRIES):
        self.spark, self.digest_bits, self.fanout, self.entries = spark, digest_bits, fanout, entries
        self.root = root or f"{shared_dir(spark)}/merge-index-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _path(self, level: int) -> str:
        self._made += 1
        while len(self.levels) <= level:
            self.levels.append([])
        return f"{self.root}/level{level}-{self._made:06d}"

    def append(self, docs: DataFrame) -> DataFrame:
        """Flush the rows of docs as new runs; compact the levels that are full. Returns digest, sha and doc_id of each row.

        What one append flushes is one table of many runs: a run for each memtable of each writer.
        """
        path = self._path(0)
        written(flushed(docs, self.digest_bits, self.entries).withColumn("part", F.when(F.col("run").isNull(), "rows").otherwise("runs")), path=path, by="part")
        self.levels[0].append(path)
        for level, paths in enumerate(self.levels):
            if len(paths) >= self.fanout:
                self.compact(level)
        return self.spark.read.schema(f"{ROW}, part string").parquet(path).where("part = 'rows'").drop("part")

    def _runs(self, level: int) -> DataFrame | None:
        paths = self.levels[level] if level < len(self.levels) else []
        if not paths:
            return None
        if level:
            return self.spark.read.schema(RUN).parquet(*paths)
        tables = [self.spark.read.schema("digest binary, doc_id long, n long, part string").parquet(p).where("part = 'runs'") for p in paths]
        out = tables[0]
        for more in tables[1:]:
            out = out.unionByName(more)
        return out.select("digest", F.col("doc_id").alias("first_id"), "n")

    def compact(self, level: int) -> None:
        """Merge a level's runs into one of the next, sorted by digest; each digest keeps its smallest identifier and its number of rows."""
        merged, self.levels[level] = self._runs(level), []
        if merged is None:
            return
        # memtables have combined equal digests, so a hot one has a row for each memtable here
        merged = merged.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        path = self._path(level + 1)
        written(merged, path=path)
        self.levels[level + 1].append(path)

    def entries_of(self) -> DataFrame:
        """digest, first_id and n of each digest in the index, by a compaction down to one run."""
        for level in range(len(self.levels)):
            if level + 1 < len(self.levels) or level == 0 or len(self.levels[level]) > 1:
                self.compact(level)
        last = self._runs(len(self.levels) - 1)
        return self.spark.createDataFrame([], RUN) if last is None else last


def classes(docs: DataFrame, digest_bits: int = DIGEST_BITS, entries: int = MEMTABLE_ENTRIES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    source = texts(docs)
    index = MergeIndex(source.sparkSession, digest_bits=digest_bits, entries=entries)
    rows = index.append(source)
    found = index.entries_of().withColumnsRenamed({"first_id": "lead_id", "n": "rows"})
    several = found.where("rows > 1")
    probed = Filter(several).probe(rows)
    alone = probed.where("not perhaps").select(F.lit(1).cast("long").alias("rows"), "sha", "doc_id")
    looked = probed.where("perhaps").select("digest", "sha", "doc_id")
    # Of n rows at most 1000 digests have over n / 1000, so these are known to be few whatever the size; they meet their rows where those are.
    hot = F.broadcast(written(several.where(F.col("rows") > max(SALT, rows.count() // 1000)), "hot-digests"))
    looked = looked.join(hot, "digest").unionByName(looked.join(hot.select("digest"), "digest", "left_anti").join(found, "digest"))
    alone = alone.unionByName(looked.where("rows = 1").select("rows", "sha", "doc_id")).select("doc_id", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    hits = looked.where("rows > 1").groupBy("digest", "sha", "doc_id", "lead_id").agg(F.count(F.lit(1)).alias("copies"), F.ceil(F.max("rows") / SALT).cast("int").alias("salts"))
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    checked = written(_verified(source, hits), "exact-hits")
    sizes = checked.groupBy("digest", "part").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.max("salts").alias("salts"))
    salted = sizes.select("digest", "part", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # of rows that are equal in doc_id and text, the first stays
    many = checked.join(salted, ["digest", "part", "salt"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    return alone.unionByName(many)


def _verified(source: DataFrame, hits: DataFrame) -> DataFrame:
    """hits with part: empty for rows whose bytes equal their leader's, else the row's own SHA-256.

    Each row of a hit is compared with the leader of its digest, never with all others: rows that
    differ from the leader fall apart by the hash of their own bytes. The leader's text is sent once for each SALT
    rows of its digest, so a hot digest is many small comparisons in many tasks.
    """
    lead = hits.groupBy("digest", "lead_id").agg(F.max("salts").alias("salts"))
    body = source.select("doc_id", F.col("text").alias("body"))
    lead_text = lead.join(body, F.col("lead_id").eqNullSafe(F.col("doc_id"))).groupBy("digest", "salts").agg(F.min("body").alias("lead_body"))
    lead_text = lead_text.select("digest", "lead_body", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    own = hits.join(body.withColumnRenamed("doc_id", "body_id"), F.col("doc_id").eqNullSafe(F.col("body_id"))).select("digest", "salt", "salts", "sha", "doc_id", "copies", "body")
    pairs = own.join(lead_text, ["digest", "salt"], "left")
    schema = pa.schema([("digest", pa.binary()), ("sha", pa.binary()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("part", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for digest, sha, i, copies, salt, salts, x, y in zip(*(batch.column(k).cast(pa.binary()).to_pylist() if k > 5 else batch.column(k).to_pylist() for k in range(8)), strict=True):
                x, y = A.squeeze(x or b""), A.squeeze(y or b"")
                if x == y or hashlib.sha256(x).digest() == sha:  # else another text that has this doc_id too
                    rows.append((digest, sha, i, copies, salt, salts, b"" if x == y else sha))
            yield A.batch_of(schema, *(map(list, zip(*rows, strict=True)) if rows else [[]] * 7))

    found = pairs.select("digest", "sha", "doc_id", "copies", "salt", "salts", "body", "lead_body").mapInArrow(run, "digest binary, sha binary, doc_id long, copies long, salt int, salts int, part binary")
    return found.dropDuplicates(["digest", "sha", "doc_id", "part"])


def keep(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each text, with the columns they came with. Rows are told apart by doc_id and text, so none goes for another's sake."""
    win = classes(docs).where("kept").select(F.col("doc_id").alias("win_id"), F.col("text_sha256").alias("win_key"))
    return chosen(one_of_each(apart(docs, F.sha2(squeezed(), 256))), win, docs.columns)
