"""What training and evaluation read and write: token arrays, pairs, masks, labels, logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .tokenizers import MASK, PAD, SPECIALS, Model, templated

NAMES = {0: "entailment", 1: "neutral", 2: "contradiction"}
LINE_TOKENS, PAIR_TOKENS = 512, 128


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- token arrays -----------------------------------------------------------------------------------------------


def model_rows(encoded: DataFrame, model: Model, limit: int = LINE_TOKENS) -> DataFrame:
    """input_ids, cut so that the template's tokens stay within the limit, and attention_mask; the text is dropped."""
    ids = templated(F.slice("ids", 1, limit - 2), model)
    return encoded.withColumn("input_ids", ids).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("ids", "line", "text")


def longest_first(a: Column | str, b: Column | str, room: int) -> tuple[Column, Column]:
    """Two arrays cut to room together, always a token off the longer; of equals off the second."""
    a, b = _col(a), _col(b)
    x, y = F.size(a), F.size(b)
    big, small = (room + 1) // 2, room // 2
    first = F.when(x + y <= room, x).when(x <= small, x).when(y <= small, F.lit(room) - y).when(x <= big, x).otherwise(F.lit(big))
    first = F.least(first, x)
    return F.slice(a, F.lit(1), first), F.slice(b, F.lit(1), F.least(y, F.lit(room) - first))


def pair_rows(pairs: DataFrame, model: Model, first: str = "ids1", second: str = "ids2", limit: int = PAIR_TOKENS) -> DataFrame:
    """input_ids of both parts in the template, attention_mask, num_tokens and whether the limit was reached."""
    a, b = longest_first(first, second, limit - 3)
    out = pairs.withColumn("input_ids", templated(a, model, b)).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return out.withColumn("num_tokens", F.size("input_ids")).withColumn("truncated", F.col("num_tokens") >= limit).drop(first, second)


def masked(rows: DataFrame, model: Model, share: float = 0.15, epoch: int = 0, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """input_ids with a share of the places hidden: 80 % become the mask, 10 % a random token, 10 % stay; labels hold what was there, -100 elsewhere.

    The choice hangs on key, place, epoch and seed alone, so a task computed again masks the same.
    """
    special = [model.vocab[t] for t in SPECIALS if t in model.vocab]
    size = len(model.vocab)
    draw = lambda i, salt: F.pmod(F.xxhash64(F.col(key), i, F.lit(epoch), F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1e6
    hidden = lambda x, i: ~x.isin(*special) & (draw(i, "pick") < share)
    new = lambda x, i: F.when(draw(i, "kind") < 0.8, F.lit(model.vocab[MASK])).when(draw(i, "kind") < 0.9, F.pmod(F.xxhash64(F.col(key), i, F.lit(epoch), F.lit(seed)), F.lit(size)).cast("int")).otherwise(x)
    out = rows.withColumn("labels", F.transform("input_ids", lambda x, i: F.when(hidden(x, i), x).otherwise(F.lit(-100))))
    # what is hidden was drawn above; a label is the token that was there
    return out.withColumn("input_ids", F.transform("labels", lambda y, i: F.when(y == -100, F.get("input_ids", i)).otherwise(new(y, i))))


def padded(rows: DataFrame, model: Model, batch: str = "batch") -> DataFrame:
    """input_ids and attention_mask as long as the longest of the batch. Batches are small by design; only their lengths are aggregated."""
    longest = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_longest"))
    pad = lambda c, x: F.concat(F.col(c), F.array_repeat(F.lit(x), F.col("_longest") - F.size(c)))
    return rows.join(longest, batch).withColumn("attention_mask", pad("attention_mask", 0)).withColumn("input_ids", pad("input_ids", model.vocab[PAD])).drop("_longest")


def schedule(rows: int, batch: int = 16, accumulate: int = 4, epochs: int = 6, warm_up: float = 0.06) -> dict[str, int]:
    """Steps of an epoch, in all, and of the warm-up (halves go to the even number)."""
    steps = math.ceil(math.ceil(rows / batch) / accumulate)
    return {"steps_per_epoch": steps, "total_steps": steps * epochs, "warm_up_steps": round(warm_up * steps * epochs)}


# -- pairs and labels -------------------------------------------------------------------------------------------


def turn_pairs(turns: DataFrame) -> DataFrame:
    """sentence1, sentence2: each turn of a conversation and the one after it."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("sentence2", F.lead("text").over(after)).where(F.col("sentence2").isNotNull()).select("conv_id", "turn", F.col("text").alias("sentence1"), "sentence2")


def without_pairs(pairs: DataFrame, held_out: DataFrame) -> DataFrame:
    """The pairs of which no equal is held out."""
    same = [pairs[c].eqNullSafe(held_out[c]) for c in ("sentence1", "sentence2")]
    return pairs.join(held_out, same[0] & same[1], "left_anti")


def named(df: DataFrame, label: str = "gold_label", names: dict[int, str] = NAMES) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn("label_name", F.try_element_at(table, F.col(label)))


def label_counts(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    return df.groupBy(*([by] if by else []), label).agg(F.count(F.lit(1)).alias("n"))


def argmax(c: Column | str) -> Column:
    """The place, from 0, of the first largest value."""
    c = _col(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def classification_metrics(df: DataFrame, label: str, predicted: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """accuracy, f1 of each class (0 where it is neither there nor predicted) and their mean, in one aggregate."""
    hit = lambda k: F.count_if((F.col(label) == k) & (F.col(predicted) == k))
    all_ = lambda c, k: F.count_if(F.col(c) == k)
    f1 = [F.coalesce(F.try_divide(2.0 * hit(k), all_(label, k) + all_(predicted, k)), F.lit(0.0)).alias(f"f1_{k}") for k in classes]
    out = df.agg(F.coalesce(F.try_divide(F.count_if(F.col(label) == F.col(predicted)), F.count(F.lit(1))), F.lit(0.0)).alias("accuracy"), *f1)
    return out.withColumn("macro_f1", sum((F.col(f"f1_{k}") for k in classes), F.lit(0.0)) / len(classes))


def length_stats(pairs: DataFrame, limit: int = PAIR_TOKENS, tokens: str = "num_tokens") -> DataFrame:
    """Median, 99th percentile, and how many and what share reach the limit."""
    cut = F.count_if(F.col(tokens) >= limit)
    return pairs.agg(F.percentile(tokens, 0.5).alias("median"), F.percentile(tokens, 0.99).alias("p99"), cut.alias("truncated"), F.coalesce(F.try_divide(cut, F.count(F.lit(1))), F.lit(0.0)).alias("truncated_share"))


def char_lengths(pairs: DataFrame) -> DataFrame:
    """Means and extremes of the parts' lengths in code points, and of their difference."""
    one, two = F.length("sentence1"), F.length("sentence2")
    return pairs.agg(*[f(x).alias(f"{name}_{what}") for what, x in (("first", one), ("second", two), ("difference", one - two)) for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def bare_words(df: DataFrame, column: str) -> DataFrame:
    """token: distinct words without the marks around them."""
    words = F.filter(F.split(F.coalesce(column, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return df.select(F.explode(words).alias("w")).distinct().select(F.btrim("w", F.lit(".,:()[]")).alias("token")).where("token <> ''").distinct()


# -- logs -------------------------------------------------------------------------------------------------------


def perplexity(loss: Column | str) -> Column:
    return F.exp(_col(loss))


def evaluations(history: DataFrame) -> DataFrame:
    """The log entries that have an evaluation, with whether it is the best (within 1e-9) and its perplexity."""
    evals = history.where(F.col("eval_loss").isNotNull())
    return evals.withColumn("best", F.abs(F.col("eval_loss") - F.col("best_metric")) < 1e-9).withColumn("perplexity", perplexity("eval_loss"))


def best_evaluation(history: DataFrame) -> DataFrame:
    """The lowest evaluation loss and its earliest step."""
    return history.where(F.col("eval_loss").isNotNull()).agg(F.min("eval_loss").alias("best_loss"), F.min_by("step", F.struct("eval_loss", "step")).alias("best_step"))


def last_evaluations(history: DataFrame, n: int = 8) -> DataFrame:
    return history.where(F.col("eval_loss").isNotNull()).orderBy(F.col("step").desc()).limit(n)


def running_best(df: DataFrame, value: str, order: str, by: str, patience: int = 15) -> DataFrame:
    """best so far, how many values since it was last bettered, and whether patience has run out. A series for each by."""
    series = Window.partitionBy(by).orderBy(order)
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.min(value).over(series.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("best", F.min(value).over(so_far)).withColumn("_better", (earlier.isNull() | (F.col(value) < earlier)).cast("int")).withColumn("_row", F.row_number().over(series))
    last = F.max(F.when(F.col("_better") == 1, F.col("_row"))).over(so_far)
    out = out.withColumn("since_best", (F.col("_row") - last).cast("long"))
    return out.withColumn("stopped", F.max((F.col("since_best") >= patience).cast("int")).over(so_far) == 1).drop("_better", "_row")


# -- sentence similarity ----------------------------------------------------------------------------------------


def mean_pooled(vectors: Column | str, mask: Column | str | None = None) -> Column:
    """The mean of an array of vectors of one length, of those that a mask of 0 and 1 leaves; null without any."""
    v = _col(vectors)
    if mask is not None:
        v = F.transform(F.filter(F.arrays_zip(v.alias("v"), _col(mask).alias("m")), lambda x: x.m == 1), lambda x: x.v)
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    sums = F.aggregate(F.transform(v, lambda x: x.cast("array<double>")), F.array().cast("array<double>"), add)
    return F.when(F.size(v) > 0, F.transform(sums, lambda x: x / F.size(v)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine of two vectors of one length; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(_col(x), _col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def ranks(df: DataFrame, value: str) -> DataFrame:
    """value and its rank from 1, of equals the mean: distinct values are sorted by ranges, whose sizes add up to the first rank of each."""
    kinds = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = written(kinds.repartitionByRange(value).withColumn("_range", F.spark_partition_id()), "ranks")
    sizes = placed.groupBy("_range").agg(F.sum("_n").alias("_size"))
    first = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    within = F.sum("_n").over(Window.partitionBy("_range").orderBy(value)) - F.col("_n")
    # as many rows as there are ranges
    return placed.withColumn("_within", within).join(F.broadcast(first), F.col("_range") == F.col("_of")).select(value, (F.col("_first") + F.col("_within") + (F.col("_n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, one: str, two: str) -> DataFrame:
    """The rank correlation of two columns, and the number of rows that have both."""
    both = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).select(one, two)
    out = both.join(ranks(both, one).withColumnRenamed("rank", "_a"), one).join(ranks(both, two).withColumnRenamed("rank", "_b"), two)
    return out.agg(F.corr("_a", "_b").alias("spearman"), F.count(F.lit(1)).alias("n"))


# -- vectors ----------------------------------------------------------------------------------------------------


def unsound_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vectors hold what is no finite number, or nothing at all."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(column).isNull() | bad)


