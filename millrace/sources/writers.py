"""Sinks. Parquet partitions where the pipeline reads again; text, CSV and JSON where people do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, column: str = "line") -> None:
    """One line of text for each row."""
    df.select(column).write.mode("overwrite").text(path)


def routed(df: DataFrame, path: str, by: str = "verdict") -> None:
    """A partition for each verdict; nothing is dropped."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def split(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A CSV file with a header; reports are a row for each source or variant."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, from the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def tokenizer(vocab: DataFrame, merges: DataFrame | None, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    if merges is not None:
        merges.write.mode("overwrite").parquet(f"{path}/merges")


def placeholders(table: dict[str, str], df: DataFrame, path: str) -> None:
    """At most 6,400 pairs, as one JSON object."""
    df.sparkSession.createDataFrame([(json.dumps(table, ensure_ascii=False),)], "value string").coalesce(1).select(F.col("value")).write.mode("overwrite").text(path)
