"""Reading the tables, and telling their rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir, written  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: What a reader and an exchange with Python hold at a time, where the session has Spark's own values, which are for short rows.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: batches of few of them keep the executors' memory outside of the heap, and large arrays in it, small."""
    for name, (usual, ours) in BATCHES.items():
        if spark.conf.get(name, None) == usual:
            spark.conf.set(name, ours)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def remainder(df_id, mod: int):
    """crc32 of an identifier as text, mod a number."""
    return F.crc32(df_id.cast("string").cast("binary")) % F.lit(mod)


def squeezed(text: str = "text") -> Column:
    """A text, null as empty, with each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def apart(docs: DataFrame, key: Column) -> DataFrame:
    """_id, _key and _row: each row's doc_id, a key of what it holds, and all its columns, whatever their names."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("_id"), key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def chosen(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, as they were before apart(), whose _id and _key are a pair of wanted's win_id and win_key."""
    met = rows.join(wanted, F.col("_id").eqNullSafe(F.col("win_id")) & (F.col("_key") == F.col("win_key")), "left_semi")
    return met.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of apart()'s rows with equal _id and _key, one. They are combined before the shuffle, so their number is no matter."""
    return rows.groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
