from pyspark.sql import functions as F

from millrace.streaming import ingest


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        ingest.to_table(ingest.routed(ingest.first_seen(ingest.arriving(spark, str(tmp_path / "in")))), str(tmp_path / "out"), str(tmp_path / "state")).start().awaitTermination()
        return sorted((r.verdict, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.txt").write_text("hello world\nhello world\n1 2 3 4 x\n")
    assert run() == [("above", "hello world"), ("below", "1 2 3 4 x")]
    (tmp_path / "in" / "b.txt").write_text("more\n")
    assert run() == [("above", "hello world"), ("above", "more"), ("below", "1 2 3 4 x")]


def test_windows(spark, sf, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    ingest.counted(events, "ts", "1 day", "40 days", "event_type").writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")
    assert batch.exceptAll(spark.table("counted").select("starts", "event_type", "n")).count() == 0
