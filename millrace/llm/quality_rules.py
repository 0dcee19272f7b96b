"""Quality rules with thresholds that follow the corpus.

Counts per document come from one vectorised pass. The cutoffs aren't constants: mergeable KLL
quantile sketches of each signal are kept per language and source, small groups borrow from
their language and then from everything, and a fence above (or around) the median decides.

Nulls: a null text has no words; null lang and source are groups of their own. Empty table: no
rows. Repeated rows: each is judged, alike. Ties at a fence are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .tables import apart, chosen, small_batches, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_bangs"]
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS, UPPER, BANG = A.byte_set("#*$%&|<>"), A.byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), A.byte_set("!")


@dataclass(frozen=True)
class Signal:
    """A share of each document, and its fence: median + reach * max(q75 - q25, least), and below if both."""

    name: str
    value: Column | str
    reach: float
    least: float
    both: bool = False


#: least is the spread that a group is granted even where nearly all its documents agree.
SIGNALS = (
    Signal("symbols", "n_symbols / greatest(n_words, 1)", 4.0, 0.06),
    Signal("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 4.0, 0.12),
    Signal("repeats", "n_repeat_words / greatest(n_words, 1)", 4.0, 0.045),
    Signal("upper", "n_upper / greatest(word_chars, 1)", 4.0, 0.12),
    Signal("bangs", "n_bangs / greatest(n_words, 1)", 4.0, 0.1),
    Signal("word_length", "word_chars / greatest(n_words, 1)", 4.0, 1.5, True),
)
#: Groups of fewer documents than this use their language's sketch, and those of fewer still the whole corpus'.
LEAST_GROUP = 100


def _count(column) -> np.ndarray:
    out = []
    for _, _, buf, offs in A.slabs(column):
        nd = len(offs) - 1
        a, b, doc = A.words(buf, offs)
        solid = ~A.SPACE[buf]
        sums = A.prefix_hash(buf)
        # lines: from a document's start or past a \n, up to the next \n or the document's end
        breaks = np.flatnonzero(buf == 10)
        starts = np.concatenate([offs[:-1], breaks + 1])
        starts.sort(kind="stable")
        owner = np.concatenate([np.arange(nd), np.searchsorted(offs, breaks, "right") - 1])
        owner.sort(kind="stable")
        ends = np.concatenate([starts[1:] - 1, [offs[-1]]])
        last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
        ends[last] = offs[1:][owner[last]]
        seen = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(solid, out=seen[1:])
        full = seen[ends] > seen[starts]
        starts, ends, owner = starts[full], ends[full], owner[full]
        distinct = np.unique(A.doc_keys(owner, A.span_hash(sums, starts, ends)))
        lines = np.bincount(owner, minlength=nd)
        dup_lines = lines - np.bincount((distinct >> A.U64(A.KEY_BITS)).astype(np.int64), minlength=nd)
        # windows found twice or more
        at, h = A.windows(A.span_hash(sums, a, b), doc, WINDOW)
        keys = A.doc_keys(doc[at], h)
        order = np.sort(keys)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        covered = np.zeros(len(a) + 1, np.int64)
        if len(twice):
            place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = at[twice[place] == keys]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + WINDOW, -1)
        repeated = np.cumsum(covered)[:-1] > 0
        out.append(
            np.stack(
                [
                    np.bincount(doc, minlength=nd),
                    A.per_doc(solid & ((buf & 0xC0) != 0x80), offs),
                    A.per_doc(SYMBOLS[buf], offs),
                    dup_lines,
                    np.bincount(doc[repeated], minlength=nd),
                    lines,
                    A.per_doc(UPPER[buf], offs),
                    A.per_doc(BANG[buf], offs),
                ]
            )
        )
    return np.concatenate(out, axis=1) if out else np.zeros((len(COUNTS + EXTRA), 0), np.int64)


def _content(docs: DataFrame) -> Column:
    """A hash of all that a verdict depends on: rows of one doc_id may differ in it."""
    return F.xxhash64(*[F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("text", "lang", "source")])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, a hash of the content, and the counts of each whole text."""
    small_batches(docs.sparkSession)
    fields = ["doc_id", "lang", "source"]
    have = [F.col(c).cast("long" if c == "doc_id" else "string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in fields]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("content", pa.int64()), *[(c, pa.int64()) for c in COUNTS + EXTRA]])

    def run(batches):
        for batch in batches:
            yield A.batch_of(schema, *(batch.column(i) for i in range(4)), *_count(batch.column(4)))

    return docs.select(*have, _content(docs).alias("content"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang string, source string, content long, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fences(measured: DataFrame, signals: tuple[Signal, ...] = SIGNALS, least_group: int = LEAST_GROUP) -> DataFrame:
    """lang, source and a struct low/high of each signal; one row for each group.

    The sketches of a group are made where the rows are and merged twice more, to its language
    and to the corpus; nothing but sketches of a few kilobytes is shuffled.
    """
    value = {s.name: F.expr(s.value) if isinstance(s.value, str) else s.value for s in signals}
    group = measured.where(~base_failed()).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(value[s.name].cast("double")).alias(s.name) for s in signals])
    merged = [F.kll_merge_agg_double(s.name).alias(s.name) for s in signals]
    by_lang = group.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    whole = group.agg(F.sum("n").alias("n"), *merged)

    def bounds(name: str) -> list[Column]:
        out = []
        for s in signals:
            q = [F.expr(f"kll_sketch_get_quantile_double({s.name}, {p}D)") for p in (0.25, 0.5, 0.75)]
            spread = s.reach * F.greatest(q[2] - q[0], F.lit(s.least))
            out.append(F.struct((q[1] - spread if s.both else F.lit(-1.0)).alias("low"), (q[1] + spread).alias("high")).alias(f"{name}_{s.name}"))
        return out

    g = group.select(F.col("lang"), F.col("source"), F.col("n").alias("g_n"), *bounds("g"))
    m = by_lang.select(F.col("lang").alias("m_lang"), F.col("n").alias("m_n"), *bounds("m"))
    w = whole.select(*bounds("w"))
    rows = g.join(m, F.col("lang").eqNullSafe(F.col("m_lang"))).join(F.broadcast(w))  # w is one row
    pick = lambda s: F.when(F.col("g_n") >= least_group, F.col(f"g_{s.name}")).when(F.col("m_n") >= least_group, F.col(f"m_{s.name}")).otherwise(F.col(f"w_{s.name}"))
    return rows.select("lang", "source", *[pick(s).alias(f"fence_{s.name}") for s in signals])


def _judged(docs: DataFrame, signals: tuple[Signal, ...]) -> DataFrame:
    counts = written(measure(docs), "quality")
    limits = fences(counts, signals).select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[f"fence_{s.name}" for s in signals])
    # A hot source makes a hot key of this join; the fences of all sources are one small row each, and AQE splits the large side.
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    within = F.lit(True)
    for s in signals:
        value = F.expr(s.value) if isinstance(s.value, str) else s.value
        within &= F.coalesce(value.between(F.col(f"fence_{s.name}.low"), F.col(f"fence_{s.name}.high")), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)


def judge(docs: DataFrame, signals: tuple[Signal, ...] = SIGNALS) -> DataFrame:
    """One row for each document: its counts, base_failed and kept."""
    return _judged(docs, signals).select("doc_id", *COUNTS, "base_failed", "kept", *EXTRA)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with. Each row goes by its own verdict, also where it shares its doc_id."""
    good = _judged(docs, SIGNALS).where("kept").select(F.col("doc_id").alias("win_id"), F.col("content").alias("win_key"))
    return chosen(apart(docs, _content(docs)), good, docs.columns)
