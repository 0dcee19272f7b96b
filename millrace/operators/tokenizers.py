"""Subword tokenizers of three families: learning, encoding, decoding and their metrics.

What grows with the corpus is a DataFrame: the table of distinct words and their counts, from which all else
follows, is made by one aggregate and written once. Learning runs over that table: the merge loop of BPE and WordPiece in
arrays, on the driver for a few words, else dealt over tasks that go in step; the expectation steps of Unigram on the
executors, with only the pieces' sums coming back. Metrics are one pass over the lines, whose tasks remember words.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marking, text as T
from ..profiles import WS_CHARS
from ..tables import written

META, CONTINUES = "▁", "##"
UNK, CLS, SEP, PAD, MASK = SPECIALS = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")
UNUSED, VOCAB = 1000, 32_000
#: Distinct words that the merge loop takes; more is an error, which a least count per word puts right.
MOST_WORDS = 1_000_000_000
#: Symbols of distinct words that the driver takes by itself; more are dealt over tasks, of which each has at least so many words.
DRIVER_SYMBOLS, TASK_WORDS = 4_000_000, 1000
#: Code points of a word beyond which WordPiece gives it up.
MOST_CHARS = 100
#: Words that an encoder remembers in a worker, and how long they are at most.
CACHED, CACHED_CHARS = 200_000, 64
FAMILIES = ("bert", "bpe", "unigram")


def reserved(unused: int = UNUSED) -> list[str]:
    """The tokens that come before all learnt ones."""
    return [*SPECIALS, *(f"[unused{i}]" for i in range(unused))]


def pieces(c: Column | str) -> Column:
    """The words of a normalised line, each led by the sign of a space; a run of spaces leaves bare signs."""
    line = T.normalise(c)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(line, " "), lambda w: F.concat(F.lit(META), w)))


def word_counts(lines: DataFrame, column: str = "line") -> DataFrame:
    """word, n: the distinct pieces and how often they occur."""
    return lines.select(F.explode(pieces(column)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right, n of the adjacent characters of all words: the first step of learning merges."""
    chars = F.filter(F.split("word", ""), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("left"), F.get("c", i).alias("right")))
    return words.select(chars.alias("c"), "n").where(F.size("c") > 1).select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """A learnt vocabulary. merges: pairs in order of rank; scores: log probabilities of Unigram's pieces."""

    family: str
    vocab: dict[str, int]
    merges: tuple[tuple[str, str], ...] = ()
    scores: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"unknown family {self.family!r}; one of {', '.join(FAMILIES)}")

    @property
    def tokens(self) -> list[str]:
        return sorted(self.vocab, key=self.vocab.get)

    @property
    def unk(self) -> int:
        if UNK not in self.vocab:
            raise ValueError(f"the vocabulary has no {UNK}")
        return self.vocab[UNK]

    def relabelled(self, table: dict[str, str]) -> Model:
        """Placeholders in the pieces put back to what they stand for."""
        back = str.maketrans({v: k for k, v in table.items()})
        put = lambda t: t.translate(back)
        return replace(self, vocab={put(t): i for t, i in self.vocab.items()}, merges=tuple((put(a), put(b)) for a, b in self.merges), scores={put(t): s for t, s in self.scores.items()})


# -- learning ---------------------------------------------------------------------------------------------------


class _Words:
    """Distinct words as one array of symbols. kinds: the symbols' names, if those of other words are to have the same numbers."""

    def __init__(self, batches, within: str = "", kinds: list[str] | None = None):
        chars, sizes, ns = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            chars.append(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
            sizes.append(np.fromiter(map(len, texts), np.int64, len(texts)))
            ns.append(batch.column(1).to_numpy())
        chars, sizes, self.n = np.concatenate(chars), np.concatenate(sizes), np.concatenate(ns)
        self.word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        # within a word a symbol may have another name than at its start
        inner = np.concatenate([[False], self.word[1:] == self.word[:-1]]) if within and len(chars) else np.zeros(len(chars), bool)
        codes = chars * np.uint32(2) + inner.astype(np.uint32)
        if kinds is None:
            known = np.unique(codes)
            self.names = [(within if k & 1 else "") + chr(k >> 1) for k in known.tolist()]
            self.symbols = np.searchsorted(known, codes).astype(np.int32)
        else:
            self.names = kinds
            known = np.array([ord(k[-1]) * 2 + (len(k) > 1) for k in kinds], np.uint32)
            order = np.argsort(known)
            self.symbols = order[np.searchsorted(known[order], codes)].astype(np.int32)

    def counts(self) -> list[int]:
        return np.bincount(self.symbols, self.n[self.word], len(self.names)).astype(np.int64).tolist()


def _by_count(counts: dict[str, int]) -> list[str]:
    """The symbols, the most frequent first."""
    return sorted(counts, key=lambda x: (-counts[x], x))


def _alone(changes: dict[int, int]) -> dict[int, int]:
    return changes


class _Merges:
    """Symbols of words as linked lists in arrays, with pair counts and places that follow each merge.

    A merge is a few array operations over the places of its pair, in whatever words these are. The words may be dealt over several
    of these, which go in step: together() then adds up what has changed in all of them, and the counts are those of all words.
    """

    def __init__(self, words: _Words, single: list[int], together=_alone):
        self.names, self.id = list(words.names), {t: i for i, t in enumerate(words.names)}
        self.symbols, self.word, self.n, self.single, self.together = words.symbols, words.word, words.n, list(single), together
        size = len(self.symbols)
        self.after, self.before = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        left = np.flatnonzero(words.word[1:] == words.word[:-1]).astype(np.int32)
        self.after[left], self.before[left + 1] = left + 1, left
        self.met = np.zeros(size, bool)
        self.count: dict[int, int] = {}
        self.change: dict[int, int] = {}
        self.where: dict[int, list[np.ndarray]] = {}
        self._come(self._codes(self.symbols[left], self.symbols[left + 1]), left)
        self._settle()

    def _settle(self) -> dict[int, int]:
        """Take over what has changed in all words."""
        changes, self.change = self.together(self.change), {}
        for code, n in changes.items():
            self.count[code] = self.count.get(code, 0) + n
        return changes

    @staticmethod
    def _codes(a, b) -> np.ndarray:
        return (np.asarray(a, np.int64) << 32) | np.asarray(b, np.int64)

    def pair(self, code: int) -> tuple[str, str]:
        return self.names[code >> 32], self.names[code & 0xFFFFFFFF]

    def _come(self, codes: np.ndarray, at: np.ndarray) -> None:
        """Count pairs that have come at the places of their left symbols."""
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        sums = np.add.reduceat(self.n[self.word[at]], first).tolist() if len(first) else []
        for code, n, places in zip(codes[first].tolist(), sums, np.split(at, first[1:]), strict=False):
            self.change[code] = self.change.get(code, 0) + n
            self.where.setdefault(code, []).append(places)

    def _gone(self, codes: np.ndarray, weight: np.ndarray) -> None:
        kinds, back = np.unique(codes, return_inverse=True)
        for code, n in zip(kinds.tolist(), np.bincount(back, weight, len(kinds)).astype(np.int64).tolist(), strict=True):
            self.change[code] = self.change.get(code, 0) - n

    def merge(self, code: int, name: str) -> list[int]:
        """Join a pair wherever it stands, from the left. Returns the pairs that have become more; counts of others can only have fallen."""
        a, b = code >> 32, code & 0xFFFFFFFF
        if (c := self.id.get(name)) is None:
            c = self.id[name] = len(self.names)
            self.names.append(name)
            self.single.append(0)
        symbols, after, before, met = self.symbols, self.after, self.before, self.met
        at = np.concatenate(self.where.pop(code, [np.zeros(0, np.int32)]))
        at = at[(symbols[at] == a) & (after[at] >= 0)]
        at = np.unique(at[symbols[after[at]] == b])  # places that have lost the pair are left out
        if a == b and len(at) > 1:  # of a run of the same, every other one
            start = np.flatnonzero(np.concatenate([[True], at[1:] != after[at[:-1]]]))
            place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            at = at[place % 2 == 0]
        second, left, weight = after[at], before[at], self.n[self.word[at]]
        right = after[second]
        met[second] = True
        lead, follow = (left >= 0) & ~met[left], right >= 0  # what stands between two merges is counted once
        self._gone(self._codes(symbols[left[lead]], np.full(int(lead.sum()), a)), weight[lead])
        self._gone(self._codes(np.full(int(follow.sum()), b), symbols[right[follow]]), weight[follow])
        met[second] = False
        symbols[at], symbols[second], after[at] = c, -1, right
        before[right[follow]] = at[follow]
        met[at] = True
        left = before[at]
        lead = (left >= 0) & ~met[left]
        met[at] = False
        self._come(np.concatenate([self._codes(symbols[left[lead]], np.full(int(lead.sum()), c)), self._codes(np.full(int(follow.sum()), c), symbols[right[follow]])]), np.concatenate([left[lead], at[follow]]))
        self.change[-1] = int(weight.sum())  # no pair
        changes = self._settle()
        times = self.count.pop(-1)
        for symbol, change in ((a, -times), (b, -times), (c, times)):
            self.single[symbol] += change
        self.count.pop(code, None)
        return [x for x, n in changes.items() if n > 0 and x not in (code, -1)]


def _merge_loop(state: _Merges, first: list[str], room: int, glue, score: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Learnt tokens, the first ones first, and merges. Of equal scores the lesser pair comes first."""
    tokens, merges = dict.fromkeys(first), []

    def apply(code):
        pair = state.pair(code)
        new = glue(*pair)
        tokens.setdefault(new)
        merges.append(pair)
        return state.merge(code, new)

    if score == "likelihood":  # a merge raises the scores of pairs that it doesn't touch, so all are looked at
        while len(tokens) < room and (live := [(-n / (state.single[p >> 32] * state.single[p & 0xFFFFFFFF]), state.pair(p), p) for p, n in state.count.items() if n > 0]):
            apply(min(live)[2])
        return list(tokens), merges
    heap = [(-n, state.pair(p), p) for p, n in state.count.items() if n > 0]
    heapq.heapify(heap)
    while len(tokens) < room and heap:
        value, pair, code = heapq.heappop(heap)
        now = state.count.get(code, 0)
        if now <= 0:
            continue
        if -value != now:  # out of date
            heapq.heappush(heap, (-now, pair, code))
            continue
        for p in apply(code):
            if (n := state.count.get(p, 0)) > 0:
                heapq.heappush(heap, (-n, state.pair(p), p))
    return list(tokens), merges


def _symbol_counts(words: DataFrame, within: str) -> dict[str, int]:
    """How often each symbol stands in all words; a row for each reaches the driver."""
    schema = pa.schema([("symbol", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            found = _Words([batch], within)
            yield pa.RecordBatch.from_arrays([pa.array(found.names, pa.string()), pa.array(found.counts(), pa.int64())], schema=schema)

    return {r["symbol"]: r["n"] for r in words.mapInArrow(run, "symbol string, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()}


def _packed(changes: dict[int, int]) -> str:
    return base64.b64encode(zlib.compress(np.array([*changes, *changes.values()], np.int64).tobytes(), 1)).decode()


def _unpacked(messages: list[str]) -> dict[int, int]:
    out: dict[int, int] = {}
    for m in messages:
        both = np.frombuffer(zlib.decompress(base64.b64decode(m)), np.int64).reshape(2, -1)
        for code, n in zip(*both.tolist(), strict=True):
            out[code] = out.get(code, 0) + n
    return out


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def _parts(words: DataFrame, rows: int) -> int:
    """Tasks for so many distinct words: as many as run at once, if each has enough of them."""
    return max(1, min(_slots(words.sparkSession), rows // TASK_WORDS))


def _spread(words: DataFrame) -> DataFrame:
    """The words dealt over tasks, if fewer would read them: a written table of some MB is one task's."""
    parts = _parts(words, words.count())
    return words if words.rdd.getNumPartitions() >= parts else words.repartition(parts, "word")


def _learn_merges(words: DataFrame, least: int, most: int, within: str, room: int, glue, score: str, held: bool = False) -> tuple[list[str], list[tuple[str, str]]]:
    """Learnt tokens, the symbols first, and merges. held: the words are a written table.

    Of a few words the driver learns. More are dealt over tasks that run at once: each has the symbols of its words, and
    after each merge they tell one another by how much it has changed the pairs' counts. The driver gets the merges alone.
    """
    kept = words.where((F.col("n") >= least) & (F.col("word") != "")).select("word", "n")
    kept = kept if held else written(kept, "words")
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if rows > most:
        raise ValueError(f"more than {most} distinct words occur {least} times; raise least or most")
    if size <= DRIVER_SYMBOLS:
        held = _Words(kept.toArrow().to_batches(), within)
        counts = held.counts()
        return _merge_loop(_Merges(held, counts), _by_count(dict(zip(held.names, counts, strict=True)))[: max(0, room)], room, glue, score)
    symbols = _symbol_counts(kept, within)
    names = _by_count(symbols)
    if len(names) >= room:
        return names[: max(0, room)], []

    def run(batches):
        tasks = BarrierTaskContext.get()
        state = _Merges(_Words(batches, within, names), [symbols[x] for x in names], lambda changes: _unpacked(tasks.allGather(_packed(changes))))
        merges = _merge_loop(state, names, room, glue, score)[1]
        if tasks.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(merges)), pa.int32()), *(pa.array(x, pa.string()) for x in (zip(*merges, strict=True) if merges else ((), ())))], names=["rank", "left", "right"])

    found = kept.repartition(_parts(kept, rows), "word").mapInArrow(run, "rank int, left string, right string", barrier=True).collect()
    merges = [(r["left"], r["right"]) for r in sorted(found, key=lambda r: r["rank"])]
    return list(dict.fromkeys([*names, *(glue(*p) for p in merges)])), merges


def train_bpe(words: DataFrame, vocab_size: int = VOCAB, unused: int = UNUSED, least: int = 1, most: int = MOST_WORDS, held: bool = False) -> Model:
    """Merges of the most frequent adjacent pair, again and again. held: the words are a written table."""
    first = reserved(unused)
    tokens, merges = _learn_merges(words, least, most, "", vocab_size - len(first), lambda a, b: a + b, "freq", held)
    return Model("bpe", {t: i for i, t in enumerate([*first, *tokens])}, tuple(merges))


def train_wordpiece(words: DataFrame, vocab_size: int = VOCAB, unused: int = UNUSED, least: int = 1, most: int = MOST_WORDS, score: str = "freq", held: bool = False) -> Model:
    """The same merges over characters that know whether they begin a word; score: freq, or likelihood (the pair's count over those of its parts)."""
    if score not in ("freq", "likelihood"):
        raise ValueError(f"unknown score {score!r}")
    first = reserved(unused)
    tokens, merges = _learn_merges(words, least, most, CONTINUES, vocab_size - len(first), lambda a, b: a + b.removeprefix(CONTINUES), score, held)
    return Model("bert", {t: i for i, t in enumerate([*first, *tokens])}, tuple(merges))


class _Lattice:
    """The pieces that lie in a word; a character that no piece covers is one of its own."""

    def __init__(self, scores: dict[str, float]):
        self.floor = min(scores.values(), default=0.0) - 10
        self.single = {p for p in scores if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), s))
        if scores:
            self.automaton.make_automaton()

    def arcs(self, word: str) -> list[tuple[int, int, float]]:
        """(start, end, score) by end, the longest first."""
        out = [(e + 1 - n, e + 1, s) for e, (n, s) in self.automaton.iter(word)] if len(self.automaton) else []
        odd = [(i, i + 1, self.floor) for i, c in enumerate(word) if c not in self.single]
        return sorted(out + odd, key=lambda x: x[1]) if odd else out

    def best(self, word: str) -> list[str]:
        best = [0.0] + [-math.inf] * len(word)
        back = [0] * (len(word) + 1)
        for a, b, s in self.arcs(word):
            if best[a] + s > best[b]:
                best[b], back[b] = best[a] + s, a
        out, end = [], len(word)
        while end:
            out.append(word[back[end] : end])
            end = back[end]
        return out[::-1]

    def without(self, piece: str) -> float:
        """The best score of a piece's characters if it weren't there itself."""
        best = [0.0] + [-math.inf] * len(piece)
        for a, b, s in self.arcs(piece):
            if b - a < len(piece) and best[a] + s > best[b]:
                best[b] = best[a] + s
        return best[-1]

    def expect(self, word: str, n: int, out: dict[str, float]) -> None:
        """Adds each piece's expected count. Sums are scaled by the best path's score, so long words don't underflow."""
        arcs, m = self.arcs(word), len(word)
        best = [0.0] + [-math.inf] * m
        for a, b, s in arcs:
            if best[a] + s > best[b]:
                best[b] = best[a] + s
        ahead, behind = [1.0] + [0.0] * m, [0.0] * m + [1.0]
        share = [math.exp(best[a] + s - best[b]) for a, b, s in arcs]  # of the best path to the same place
        for (a, b, _), p in zip(arcs, share, strict=True):  # by end: all that ends at a has been added
            ahead[b] += ahead[a] * p
        for (a, b, _), p in zip(reversed(arcs), reversed(share), strict=True):
            behind[a] += behind[b] * p
        whole = n / ahead[m]
        for (a, b, _), p in zip(arcs, share, strict=True):
            p *= ahead[a] * behind[b] * whole
            if p > 1e-12:
                out[word[a:b]] += p


def viterbi(word: str, scores: dict[str, float]) -> list[str]:
    """The pieces of the most likely segmentation; of equals, the one whose last piece begins first."""
    return _Lattice(scores).best(word)


def expected_counts(words: DataFrame, scores: dict[str, float]) -> DataFrame:
    """piece, n: expected counts under the scores, summed in each task before they meet."""
    shared = words.sparkSession.sparkContext.broadcast(scores)  # as many as the seed has, which is a parameter
    schema = pa.schema([("piece", pa.string()), ("n", pa.float64())])

    def run(batches):
        held: dict[str, float] = defaultdict(float)
        lattice = _Lattice(shared.value)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.expect(word, n, held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.float64())], schema=schema)

    return words.select("word", "n").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def seed_pieces(words: DataFrame, size: int, longest: int = 16) -> DataFrame:
    """piece, n of the substrings of words that occur twice or more, the most telling first; all single characters are among them."""
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - i + 1)), lambda k: F.substring(F.col("word"), i, k))))
    counts = words.where(F.length("word") > 0).select(F.explode(spans).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    one = F.length("piece") == 1
    return counts.where((F.col("n") > 1) | one).orderBy(one.desc(), (F.col("n") * F.length("piece")).desc(), "piece").limit(size)


def train_unigram(words: DataFrame, vocab_size: int = VOCAB, unused: int = UNUSED, seed_size: int = 0, shrink: float = 0.75, steps: int = 2, held: bool = False) -> Model:
    """Expectation and pruning, until the pieces fit the vocabulary. Of equally dispensable pieces the lesser goes last."""
    first = reserved(unused)
    room = vocab_size - len(first)
    words = _spread(words.select("word", "n") if held else written(words.select("word", "n"), "words"))  # each step reads them
    seed = seed_pieces(words, seed_size or min(1_000_000, 4 * vocab_size)).collect()  # seed_size rows
    total = sum(r["n"] * len(r["piece"]) for r in seed) or 1
    scores = {r["piece"]: math.log(r["n"] * len(r["piece"]) / total) for r in seed}
    while True:
        for _ in range(steps):
            # at most a row for each piece and unknown character; twelve digits, as tasks are added up in any order
            counts = {r["piece"]: float(f"{r['n']:.12g}") for r in expected_counts(words, scores).collect()}
            kept = {p: max(counts.get(p, 0.0), 1e-3 if len(p) == 1 else 0.0) for p in scores}
            kept = {p: n for p, n in kept.items() if n >= 0.5 or len(p) == 1}
            whole = sum(kept.values()) or 1
            scores = {p: math.log(n / whole) for p, n in kept.items()}
        if len(scores) <= room:
            break
        lattice, loss = _Lattice(scores), {}
        for p, n in kept.items():
            if len(p) > 1:
                loss[p] = n * (scores[p] - lattice.without(p))
        keep = max(room, int(shrink * len(scores))) - (len(scores) - len(loss))
        if keep <= 0:  # characters alone
            scores = {p: s for p, s in scores.items() if len(p) == 1}
            break
        stay = set(sorted(loss, key=lambda p: (-loss[p], p))[:keep])
        scores = {p: s for p, s in scores.items() if len(p) == 1 or p in stay}
    tokens = sorted(scores, key=lambda p: (-scores[p], p))
    return Model("unigram", {t: i for i, t in enumerate([*first, *tokens])}, (), {p: scores[p] for p in tokens})


TRAINERS = {"bert": train_wordpiece, "bpe": train_bpe, "unigram": train_unigram}


def train(family: str, words: DataFrame, vocab_size: int = VOCAB, **options) -> Model:
    if family not in TRAINERS:
        raise ValueError(f"unknown family {family!r}; one of {', '.join(FAMILIES)}")
    return TRAINERS[family](words, vocab_size, **options)


# -- encoding ---------------------------------------------------------------------------------------------------


class Encoder:
    """Words to ids by a model."""

    def __init__(self, model: Model):
        self.model, self.vocab, self.unk = model, model.vocab, model.unk
        self.rank = {p: i for i, p in enumerate(model.merges)}
        self.longest = max(map(len, model.vocab), default=1)
        self.one = {"bert": self._wordpiece, "bpe": self._bpe, "unigram": self._unigram}[model.family]
        self.lattice = _Lattice(model.scores) if model.family == "unigram" else None
        self.seen: dict[str, list[int]] = {}

    def __call__(self, word: str) -> list[int]:
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) >= CACHED:
                self.seen.clear()
            known = self.seen[word] = self.one(word)
        return known

    def _wordpiece(self, word: str) -> list[int]:
        if len(word) > MOST_CHARS:
            return [self.unk]
        out, a = [], 0
        while a < len(word):
            lead = CONTINUES if a else ""
            for b in range(min(len(word), a + self.longest), a, -1):
                found = self.vocab.get(lead + word[a:b])
                if found is not None:
                    break
            else:
                return [self.unk]
            out.append(found)
            a = b
        return out

    def _bpe(self, word: str) -> list[int]:
        """The lowest rank first, the leftmost of equals; a heap keeps one endless word in n log n."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < n and (r := self.rank.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.vocab.get(s, self.unk) for s in symbols if s is not None]

    def _unigram(self, word: str) -> list[int]:
        out = []
        for p in self.lattice.best(word):
            i = self.vocab.get(p, self.unk)
            if not (i == self.unk and out and out[-1] == self.unk):  # adjacent unknowns are one
                out.append(i)
        return out


#: normalise() in Python: runs of marks.
_REPEATS = re.compile(r"([,.'-])\1+")


def _normal_words(line: str | None) -> list[str]:
    """pieces() in Python, without the signs of spaces."""
    line = _REPEATS.sub(r"\1", unicodedata.normalize("NFC", (line or "").strip(WS_CHARS)))
    return line.split(" ") if line else []


class _Remembered(dict):
    """What make gives for a word; so many short ones are remembered."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        made = self.make(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[word] = made
        return made


def _arrays(rows) -> pa.Array:
    """Arrays of int32 from lists of such arrays."""
    flat, ends = array("i"), array("i", [0])
    for parts in rows:
        for part in parts:
            flat.extend(part)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))


def _encoder(spark: SparkSession, model: Model):
    """A column function from lines to ids; a task remembers the words it has met."""
    shared = spark.sparkContext.broadcast(model)  # a vocabulary: its size is a parameter
    held: list[_Remembered] = []

    @F.arrow_udf("array<int>")
    def encode(s: pa.Array) -> pa.Array:
        if not held:
            coder = Encoder(shared.value)
            held.append(_Remembered(lambda w: array("i", coder.one(META + w))))
        known = held[0]
        return _arrays([known[w] for w in _normal_words(line)] for line in s.to_pylist())

    return encode


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """words with ids, each distinct word encoded once."""
    shared = words.sparkSession.sparkContext.broadcast(model)
    held: list[Encoder] = []

    @F.arrow_udf("array<int>")
    def encode_(s: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder(shared.value))
        return _arrays([array("i", held[0].one(w))] for w in s.to_pylist())

    return words.withColumn("ids", encode_("word"))


def encode(lines: DataFrame, model: Model, column: str = "line") -> DataFrame:
    """lines with ids; no shuffle."""
    return lines.withColumn("ids", _encoder(lines.sparkSession, model)(column))


def token_numbers(spark: SparkSession, model: Model):
    """A column function from lines to how many ids encode() gives them."""
    shared = spark.sparkContext.broadcast(model)
    held: list[_Remembered] = []

    @F.arrow_udf("long")
    def number(s: pa.Array) -> pa.Array:
        if not held:
            coder = Encoder(shared.value)
            held.append(_Remembered(lambda w: len(coder.one(META + w))))
        known = held[0]
        return pa.array([sum([known[w] for w in _normal_words(line)]) for line in s.to_pylist()], pa.int64())

    return number


def _sums(lines: DataFrame, model: Model, names: tuple[str, ...], of_ids, of_line=None, column: str = "line") -> DataFrame:
    """One row of sums: of_line's of each line, if there is one, and those of the ids of each piece. No words are shuffled; a task yields a row for each batch."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(n, pa.int64()) for n in names])
    width = len(names) - (of_line is not None)

    def run(batches):
        coder = Encoder(shared.value)
        known = _Remembered(lambda w: of_ids(coder.one(META + w)))
        for batch in batches:
            sums, spoken = [0] * width, 0
            for line in batch.column(0).to_pylist():
                if of_line:
                    spoken += of_line(line)
                for found in map(known.__getitem__, _normal_words(line)):
                    for k in range(width):
                        sums[k] += found[k]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in ([spoken] if of_line else []) + sums], schema=schema)

    parts = lines.select(column).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def token_table(spark: SparkSession, model: Model) -> DataFrame:
    """token, id, score: the vocabulary."""
    rows = [(t, i, model.scores.get(t)) for t, i in model.vocab.items()]
    return spark.createDataFrame(rows, "token string, id int, score double")


def templated(ids: Column | str, model: Model, pair: Column | str | None = None) -> Column:
    """[CLS] A [SEP], or [CLS] A [SEP] B [SEP]."""
    mark = lambda t: F.array(F.lit(model.vocab[t]))
    col = lambda c: F.col(c) if isinstance(c, str) else c
    parts = [mark(CLS), col(ids), mark(SEP)]
    return F.concat(*parts, *([col(pair), mark(SEP)] if pair is not None else []))


def type_ids(ids: Column | str, pair: Column | str | None = None) -> Column:
    """0 for the first part of the template, 1 for the second."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    zeros = F.array_repeat(F.lit(0), F.size(col(ids)) + 2)
    return zeros if pair is None else F.concat(zeros, F.array_repeat(F.lit(1), F.size(col(pair)) + 1))


def decode_tokens(tokens: Column | str, family: str) -> Column:
    """Text of an array of tokens: the family's joints, then the signs of spaces, then boundary marks dropped."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    if family == "bert":
        joined = F.array_join(F.transform(tokens, lambda t, i: F.when(t.startswith(CONTINUES), F.substr(t, F.lit(len(CONTINUES) + 1))).when(i == 0, t).otherwise(F.concat(F.lit(" "), t))), "")
        for mark in (".", "?", "!", ","):
            joined = F.replace(joined, F.lit(f" {mark}"), F.lit(mark))
    else:
        joined = F.array_join(tokens, "")
    spaced = F.replace(joined, F.lit(META), F.lit(" "))
    return F.replace(F.when(spaced.startswith(" "), F.substr(spaced, F.lit(2))).otherwise(spaced), F.lit(marking.MARK), F.lit(""))


def decode(encoded: DataFrame, model: Model, column: str = "ids") -> DataFrame:
    """encoded with text, its special tokens left out."""
    names = F.array(*[F.lit(t) for t in model.tokens])  # a literal the size of the vocabulary
    special = [model.vocab[t] for t in SPECIALS if t in model.vocab]
    tokens = F.transform(F.filter(F.col(column), lambda i: ~i.isin(*special)), lambda i: F.get(names, i))
    return encoded.withColumn("text", decode_tokens(tokens, model.family))


# -- metrics ----------------------------------------------------------------------------------------------------


def evaluate(lines: DataFrame, model: Model, column: str = "line") -> DataFrame:
    """words, tokens, unknown, fertility (tokens for each word between white space) and oov_rate in percent, of the lines that aren't blank.

    One pass over the lines, without a shuffle: a task adds up the numbers of the words that it remembers.
    """
    unk = model.unk
    full = lines.where(T.strip(column) != "")
    return _rates(_sums(full, model, ("words", "tokens", "unknown"), lambda ids: (len(ids), ids.count(unk)), lambda line: len(line.split()), column))


def evaluate_counts(words: DataFrame, model: Model) -> DataFrame:
    """evaluate() from the table of distinct words that word_counts() makes of the lines: each is encoded once.

    Pieces part at spaces, which are white space, so the words of the lines are those of the pieces.
    """
    shared = words.sparkSession.sparkContext.broadcast(model)
    names = ("words", "tokens", "unknown")
    schema = pa.schema([(x, pa.int64()) for x in names])

    def run(batches):
        coder, unk = Encoder(shared.value), shared.value.unk
        for batch in batches:
            sums = [0, 0, 0]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.one(word)
                sums[0] += n * len(word[len(META) :].split())
                sums[1] += n * len(ids)
                sums[2] += n * ids.count(unk)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], schema=schema)

    parts = _spread(words.select("word", "n")).mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return _rates(parts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names]))


def _rates(sums: DataFrame) -> DataFrame:
    rate = lambda a, b, k: F.coalesce(F.try_divide(F.col(a) * F.lit(k), F.col(b)), F.lit(0.0))
    return sums.select("words", "tokens", "unknown", rate("tokens", "words", 1.0).alias("fertility"), rate("unknown", "tokens", 100.0).alias("oov_rate"))


def evaluate_other(lines: DataFrame, path: str, unknown: str = UNK, column: str = "line") -> DataFrame:
    """evaluate() for a tokenizer of somebody else's, of which there is a JSON file on every machine; without the tokens of a template."""
    schema = pa.schema([("words", pa.int64()), ("tokens", pa.int64()), ("unknown", pa.int64())])

    def run(batches):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        lost = model.token_to_id(unknown)
        for batch in batches:
            coded = model.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            sums = [sum(batch.column(1).to_pylist()), sum(len(c.ids) for c in coded), sum(c.ids.count(lost) for c in coded)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], schema=schema)

    full = lines.where(T.strip(column) != "").select(T.strip(column).alias("line"), F.size(T.tokens(column)).alias("words"))
    parts = full.mapInArrow(run, "words long, tokens long, unknown long")
    return _rates(parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "tokens", "unknown")]))


def marker_usage(lines: DataFrame, model: Model, column: str = "line") -> DataFrame:
    """How often boundary marks stand alone as tokens, and how often within one."""
    marked = {i: t.lstrip(META).removeprefix(CONTINUES) == marking.MARK for t, i in model.vocab.items() if marking.MARK in t}
    alone, fused = {i for i, a in marked.items() if a}, {i for i, a in marked.items() if not a}
    return _sums(lines, model, ("isolated", "fused"), lambda ids: (sum(i in alone for i in ids), sum(i in fused for i in ids)), None, column)


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Variants by fertility."""
    return metrics.orderBy("fertility", "variant")


# -- storage ----------------------------------------------------------------------------------------------------


def from_json(text: str) -> Model:
    """A model from what as_json wrote, or any object of that form; merges may be pairs or strings parted by a space."""
    body = json.loads(text)["model"]
    family = {"WordPiece": "bert", "BPE": "bpe", "Unigram": "unigram"}.get(body.get("type"))
    if family is None:
        raise ValueError(f"unknown model type {body.get('type')!r}")
    if family == "unigram":
        pieces_ = body["vocab"]
        return Model(family, {t: i for i, (t, _) in enumerate(pieces_)}, (), {t: s for t, s in pieces_ if t not in SPECIALS and not t.startswith("[unused")})
    merges = tuple(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in body.get("merges", ()))
    return Model(family, body["vocab"], merges)


def save(spark: SparkSession, model: Model, path: str) -> None:
    """vocab and merges as Parquet, the family as JSON beside them."""
    token_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    merges = [(i, a, b) for i, (a, b) in enumerate(model.merges)]
    spark.createDataFrame(merges, "rank int, left string, right string").coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    spark.createDataFrame([(json.dumps({"family": model.family}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/family")


def load(spark: SparkSession, path: str) -> Model:
    vocab = spark.read.schema("token string, id int, score double").parquet(f"{path}/vocab").collect()
    merges = spark.read.schema("rank int, left string, right string").parquet(f"{path}/merges").orderBy("rank").collect()
    family = json.loads(spark.read.text(f"{path}/family").first()[0])["family"]
    vocab = sorted(vocab, key=lambda r: r["id"])
    return Model(family, {r["token"]: r["id"] for r in vocab}, tuple((r["left"], r["right"]) for r in merges), {r["token"]: r["score"] for r in vocab if r["score"] is not None})


def as_json(model: Model) -> str:
    """The model as one JSON object."""
    body = {"type": {"bert": "WordPiece", "bpe": "BPE", "unigram": "Unigram"}[model.family], "vocab": [[t, model.scores.get(t, 0.0)] for t in model.tokens] if model.family == "unigram" else model.vocab}
    if model.merges:
        body["merges"] = [list(p) for p in model.merges]
    return json.dumps({"model": body}, ensure_ascii=False)
