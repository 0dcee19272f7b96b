"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import remainder, texts

#: Rows of each class that a classifier may be fitted on, and bytes that their texts may have together, half for each class.
ROWS_PER_CLASS = 900
BYTES = 48_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, out: int, rows_per_class: int = ROWS_PER_CLASS) -> tuple[list[str], list[int], dict[int, int]]:
    """Whole texts, their labels and the counts of each class among the rows that may be learnt from.

    Only rows whose crc32(doc_id) mod `mod` is not `out` are looked at, and of labels that are given again only those that agree.
    Of each class at most rows_per_class rows are taken, in the order of a hash of doc_id; a text that would take
    its class over half of BYTES is passed over, unless it is the first. Of a doc_id's texts the least
    in the order of strings is taken. The counts are of all.
    """
    known = F.col(label).cast("int")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("label")).where("doc_id is not null and label in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    train = labels.where(remainder(F.col("doc_id"), mod) != out)
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    picked = train.where("label = 0").orderBy(order, "doc_id").limit(rows_per_class).unionByName(train.where("label = 1").orderBy(order, "doc_id").limit(rows_per_class))
    # at most 2 * rows_per_class identifiers are sent to all
    found = texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy(order, "doc_id")
    kept, size = [], {0: 0, 1: 0}
    for row in found.toLocalIterator():
        long = max(1, len(row["text"].encode()))
        if not size[row["label"]] or size[row["label"]] + long <= BYTES // 2:
            size[row["label"]] += long
            kept.append((row["doc_id"], row["text"], row["label"]))
    kept.sort(key=lambda x: x[0])
    return [t for _, t, _ in kept], [y for _, _, y in kept], counts
