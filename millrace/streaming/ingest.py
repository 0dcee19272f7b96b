"""Lines as they arrive, beyond what is asked of batches: cleaned, routed and counted as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as T
from ..operators import corpus
from ..profiles import LATIN, ScriptProfile


def arriving(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """source, line and arrived of text files as they come."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_batch).text(path)
    return lines.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("arrived"))


def routed(lines: DataFrame, profile: ScriptProfile = LATIN) -> DataFrame:
    """Cleaned lines that hold words, with their verdicts; stateless."""
    clean = lines.withColumn("line", T.clean_web("line", profile)).where("line <> ''")
    return corpus.route_ratio(clean, profile)


def first_seen(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Lines not seen within the delay. The state holds what the watermark spans, not the whole stream."""
    return lines.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["line"])


def counted(events: DataFrame, time: str, width: str, delay: str, by: str) -> DataFrame:
    """Rows and sums of value in tumbling windows; late rows beyond the delay are left out, state is dropped behind it."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("starts"), by, "n", "total")


def to_table(lines: DataFrame, path: str, checkpoint: str, by: str = "verdict") -> DataStreamWriter:
    """A writer that takes what is there and ends; run again, it goes on from its checkpoint."""
    return lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(by).trigger(availableNow=True)
