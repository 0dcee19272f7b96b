"""Routing, merging, deduplicating, splitting and sampling of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..profiles import LATIN, ScriptProfile
from ..tables import written

LONG, RATIO, SHORT = 2500, 0.3, 2
ORDER = ("source", "doc_id", "line_no")


def route_long(lines: DataFrame, limit: int = LONG) -> DataFrame:
    """verdict: long for more tokens than the limit, else main."""
    return lines.withColumn("verdict", F.when(F.size(T.tokens("line")) > limit, "long").otherwise("main"))


def route_ratio(lines: DataFrame, profile: ScriptProfile = LATIN, threshold: float = RATIO) -> DataFrame:
    """ratio, and verdict below for less than the threshold."""
    return lines.withColumn("ratio", T.content_ratio("line", profile)).withColumn("verdict", F.when(F.col("ratio") < threshold, "below").otherwise("above"))


def ratio_report(routed: DataFrame) -> DataFrame:
    above = F.count_if(F.col("verdict") == "above")
    return routed.groupBy("source").agg(above.alias("above"), F.count_if(F.col("verdict") == "below").alias("below"), F.count(F.lit(1)).alias("total"), (above / F.count(F.lit(1))).alias("pass_ratio"), F.avg("ratio").alias("mean_ratio"))


def merge(sources: list[DataFrame], profile: ScriptProfile = LATIN) -> DataFrame:
    """All lines of all sources, with whether they hold the script."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df)
    return out.withColumn("written", T.has_script("line", profile))


def first_of_equals(lines: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """kept: the first of equal lines in the order. Equality is of all characters; nothing is normalised.

    The first place of each line is aggregated before the shuffle and joined back, so a line of any frequency is
    many small rows that a skewed join can be split by.
    """
    place = F.struct(*order)
    first = lines.groupBy("line").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return lines.join(first, "line").withColumn("kept", place == F.col("_first")).drop("_first")


def dedup_report(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("unique_lines"), F.count_if(~F.col("kept")).alias("dropped"))


def _rank_key(seed: int, order: tuple[str, ...]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]))


def numbered(df: DataFrame, order: tuple[str, ...] = ORDER, name: str = "row_no") -> DataFrame:
    """df with the rank of each row in the order, from 0.

    The rows are sorted by ranges and written, with their place in their range; the ranges' sizes, a row for each range, then give
    the rank of its first row. No window spans all rows.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranges.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    first = sizes.select(F.col("_range").alias("_of"), (F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).alias("_first"))
    # as many rows as there are ranges
    return placed.join(F.broadcast(first), F.col("_range") == F.col("_of")).withColumn(name, F.coalesce("_first", F.lit(0)) + F.col("_place")).drop("_range", "_place", "_of", "_first")


def exact_split(lines: DataFrame, share: float = 0.1, seed: int = 42, order: tuple[str, ...] = ORDER, train_down: bool = False) -> DataFrame:
    """split: exactly floor(share * rows) test rows, chosen by a seeded hash of their place; the rest train.

    With train_down it is the train rows that are rounded down.

    The rows are made once and written with their keys; the border is found from a histogram of the key's first 16 bits and one
    bucket of it. There is no window over all rows.
    """
    keyed = written(lines.withColumn("_key", _rank_key(seed, order)).withColumn("_bucket", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int")), "keyed")
    counts = sorted((r["_bucket"], r["count"]) for r in keyed.groupBy("_bucket").count().collect())  # 65,536 rows at most
    rows = sum(n for _, n in counts)
    left = rows - int((1 - share) * rows) if train_down else int(share * rows)
    for bucket, n in counts:
        if left < n:
            break
        left -= n
    else:
        bucket, left = 65_536, 0
    inside = keyed.where(F.col("_bucket") == bucket).select("_key").orderBy("_key").limit(left) if left else None
    edge = inside.agg(F.max("_key")).first()[0] if inside is not None else None
    test = F.col("_bucket") < bucket
    if edge is not None:
        test = test | ((F.col("_bucket") == bucket) & (F.col("_key") <= edge))
    return keyed.withColumn("split", F.when(test, "test").otherwise("train")).drop("_key", "_bucket")


def shuffled_split(lines: DataFrame, share: float = 0.1, seed: int = 42, order: tuple[str, ...] = ORDER, most: int = 2_000_000) -> DataFrame:
    """The split that a seeded shuffle of a list of labels in the lines' order gives; for lists that a driver can hold."""
    import random

    spark = lines.sparkSession
    ranked = numbered(lines, order, "_row")
    n = ranked.count()
    if n > most:
        raise ValueError(f"{n} lines are more than {most}; use exact_split")
    labels = ["test"] * int(share * n) + ["train"] * (n - int(share * n))
    random.Random(seed).shuffle(labels)
    return ranked.join(spark.createDataFrame(list(enumerate(labels)), "_row long, split string"), "_row").drop("_row")


def sample(lines: DataFrame, k: int, seed: int = 42, order: tuple[str, ...] = ORDER) -> DataFrame:
    """k rows, equally likely, the same for a seed."""
    return lines.withColumn("_key", _rank_key(seed, order)).orderBy("_key", *order).limit(k).drop("_key")


def sample_each(df: DataFrame, by: str, k: int, seed: int = 42, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """k rows of each value."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(_rank_key(seed, order), *order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def every_nth(df: DataFrame, n: int, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A systematic sample: the first row in the order, and each nth after it."""
    return numbered(df, order, "_rank").where(F.col("_rank") % n == 0).drop("_rank")


def audit(lines: DataFrame, profile: ScriptProfile = LATIN, most: int | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The lines that a check objects to: check, reason, and their place; with most, so many for each check."""
    full = F.col("line") != ""
    checks = F.array(
        F.when(F.size(T.tokens("line")) < SHORT, F.struct(F.lit("short").alias("check"), F.lit("short").alias("reason"))),
        F.when(full & (T.disallowed_chars("line", profile) > 0), F.struct(F.lit("contaminated").alias("check"), F.lit("disallowed char").alias("reason"))),
        F.when(full & T.anomaly("line").isNotNull(), F.struct(F.lit("anomalous").alias("check"), T.anomaly("line").alias("reason"))),
    )
    out = lines.withColumn("found", F.explode(F.filter(checks, lambda x: x.isNotNull()))).select(*order, "found.check", "found.reason", "line")
    copies = first_of_equals(lines.where(full), order).where(~F.col("kept")).select(*order, F.lit("duplicate").alias("check"), F.lit("duplicate").alias("reason"), "line")
    out = out.unionByName(copies)
    return sample_each(out, "check", most, order=order) if most else out
