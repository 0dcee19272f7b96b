"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel counts the three-letter subsequences that two strings share, each weighted by DECAY to the power of the
stretch it takes in either, so "id*iot" and "i d i o t" stay near "idiot": characters that are no letters only
stretch. Landmarks are a few dozen strings of the training sample; the kernel's values with them, whitened by their own
kernel matrix, are the features of a linear machine. As the kernel is an inner product of finite vectors,
the trained machine is one weight for each triple of letters, and scoring needs no landmark again.

A document is a bag of units (words, long words in pieces, the letter runs of mixed words, runs of single letters), judged by
its worst unit and by how many are bad. Training alternates: the worst unit of each toxic document, by the
machine so far, stands for it, against units of clean documents. A logistic fit on the sample makes both
a probability.

Null and empty texts have no units and score as low as a text can. Labels may be missing, null or repeated.
Without both classes to learn from, every score is the share of toxic rows (0 if none).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .samples import ROWS_PER_CLASS, labelled
from .tables import remainder, texts

HELD_OUT = (4, 2)
PREDICT = 0.3
DECAY, STRETCH = 0.7, 11
LANDMARKS, ROUNDS = 320, 4
LONGEST, PIECE = 40, 24
#: Value above which a unit is bad.
BAD = 0.4
CODES = 1 << 15
#: Units whose values a worker remembers.
CACHED = 2_000_000
#: Units whose triples are listed at a time, and bytes of text: what bounds a worker.
CHUNK, SLAB = 4_000, 1 << 20
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = np.arange(1, 27)
# Second bytes of accented letters share the five codes that are left; capitals fold to small ones.
_LETTER[0x80:0xC0] = [27 + (i | 0x20) % 5 for i in range(64)]
_SOLID = _LETTER > 0
_SOLID[0xC0:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the units of a slab."""
    a, b, doc = A.words(buf, offs)
    letter = _SOLID[buf]
    size = b - a
    out = [(a[size <= LONGEST], b[size <= LONGEST], doc[size <= LONGEST])]
    for i in np.flatnonzero(size > LONGEST).tolist():  # long words, in overlapping pieces
        at = np.arange(a[i], b[i] - PIECE // 2, PIECE // 2)
        out.append((at, np.minimum(at + PIECE, b[i]), np.full(len(at), doc[i])))
    # letter runs of words that have other characters inside
    count = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(letter, out=count[1:])
    # a run ends with its document, though the next one may go on with a letter
    border = np.zeros(len(buf) + 1, bool)
    border[offs] = True
    before, after = np.concatenate([[False], letter]), np.concatenate([letter, [False]])
    ra, rb = np.flatnonzero(after & (~before | border)), np.flatnonzero(before & (~after | border))
    if len(ra) and len(a):
        w = np.searchsorted(a, ra, "right") - 1
        part = (rb - ra >= 3) & (rb - ra < count[b[w]] - count[a[w]])
        out.append((ra[part], rb[part], doc[w[part]]))
    # runs of at least four words of one letter, each in one document
    single = (size <= 2) & (count[b] - count[a] == 1)
    other = np.concatenate([[True], doc[1:] != doc[:-1], [True]]) if len(doc) else np.ones(1, bool)
    before, after = np.concatenate([[False], single]), np.concatenate([single, [False]])
    first, last = np.flatnonzero(after & (~before | other)), np.flatnonzero(before & (~after | other))
    for s, e in zip(first.tolist(), last.tolist(), strict=True):
        if e - s >= 4:
            for i in range(s, max(s + 1, e - 6), 6):
                j = min(e, i + 12) - 1
                out.append((a[i : i + 1], b[j : j + 1], doc[i : i + 1]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def triples(buf: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(unit, code, weight) of the distinct letter triples of each span of buf."""
    size = b - a
    owner = np.repeat(np.arange(len(a)), size)
    letters = _LETTER[buf[np.arange(len(owner)) + np.repeat(a - (np.cumsum(size) - size), size)]]
    keys, weights = [], []
    n = len(letters)
    for one in range(1, STRETCH - 1):
        for two in range(1, STRETCH - one):
            gap = one + two
            if gap >= n:
                continue
            good = np.flatnonzero((owner[: n - gap] == owner[gap:]) & (letters[: n - gap] > 0) & (letters[one : n - two] > 0) & (letters[gap:] > 0))
            keys.append(owner[good] * CODES + (letters[good] << 10 | letters[good + one] << 5 | letters[good + gap]))
            weights.append(np.full(len(good), DECAY ** (gap + 1)))
    if not keys:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    keys, back = np.unique(keys, return_inverse=True)
    return keys // CODES, keys % CODES, np.bincount(back, weights, len(keys))


def kernel(x: str, y: str) -> float:
    """The normalised kernel of two strings, by its definition."""

    def vector(s):
        raw = np.frombuffer(s.encode(), np.uint8)
        _, code, weight = triples(raw, np.array([0]), np.array([len(raw)]))
        return dict(zip(code.tolist(), weight.tolist(), strict=True))

    u, v = vector(x), vector(y)
    dot = sum(w * v.get(c, 0.0) for c, w in u.items())
    return dot / math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in v.values())) if dot else 0.0


@dataclass
class Machine:
    """A weight for each triple; and the weights of a constant, the worst unit's value and the log of the number of bad units."""

    weights: np.ndarray
    line: tuple[float, float, float]
    floor: float = -1.0
    bias: float = 0.0

    def values(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), self.floor)
        for i in range(0, len(a), CHUNK):
            unit, code, weight = triples(buf, a[i : i + CHUNK], b[i : i + CHUNK])
            n = min(CHUNK, len(a) - i)
            norm = np.sqrt(np.bincount(unit, weight * weight, n))
            value = np.bincount(unit, weight * self.weights[code], n)
            out[i : i + n] = np.where(norm > 0, value / np.maximum(norm, 1e-12) + self.bias, self.floor)
        return out

    def features(self, doc: np.ndarray, values: np.ndarray, nd: int) -> np.ndarray:
        worst = np.full(nd, self.floor)
        np.maximum.at(worst, doc, values)
        return np.stack([np.ones(nd), worst, np.log1p(np.bincount(doc[values > BAD], minlength=nd))], axis=1)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.line), -40, 40)))


def _vectors(strings: list[bytes]) -> np.ndarray:
    """Unit-length triple vectors, dense, of a few strings."""
    size = np.array([len(s) for s in strings])
    b = np.cumsum(size)
    unit, code, weight = triples(np.frombuffer(b"".join(strings), np.uint8), b - size, b)
    out = np.zeros((len(strings), CODES), np.float32)
    out[unit, code] = weight
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _kernels(strings: list[bytes], marks: np.ndarray) -> np.ndarray:
    """Normalised kernel values of strings with marks, a row for each."""
    out = np.zeros((len(strings), len(marks)), np.float32)
    by_code = np.ascontiguousarray(marks.T)
    for i in range(0, len(strings), 400):
        part = strings[i : i + 400]
        size = np.array([len(s) for s in part])
        end = np.cumsum(size)
        unit, code, weight = triples(np.frombuffer(b"".join(part), np.uint8), end - size, end)
        if len(unit):
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            norm = np.sqrt(np.add.reduceat(weight * weight, first))
            out[i + unit[first]] = np.add.reduceat(weight[:, None].astype(np.float32) * by_code[code], first) / norm[:, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1000.0, steps: int = 500) -> tuple[np.ndarray, float]:
    """A linear machine of squared hinge loss, by accelerated gradient descent. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    weight = (weight / weight.sum()).astype(np.float32)
    heavy = x * np.sqrt(weight)[:, None]
    rate = 1 / (1 / c + 2 * np.linalg.eigvalsh(heavy.T @ heavy)[-1])
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * x.T @ (weight * y * slack).astype(np.float32) + np.append(v[:-1], 0) / c
        new = (v - rate * grad).astype(np.float32)
        v, w = (new + k / (k + 3) * (new - w)).astype(np.float32), new
    return w[:-1].astype(np.float64), float(w[-1])


def _logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple:
    """Weights of a logistic fit, by Newton's method, with a little shrinkage."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * p * (1 - p) + 1e-9
        w = w - np.linalg.solve((x * h[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (weight * (p - label)) + 1e-2 * w)
    return tuple(w.tolist())


def fit(bodies: list[str], labels: list[int], counts: dict[int, int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine:
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(set(labels)) < 2:
        line = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Machine(np.zeros(CODES), (line, 0.0, 0.0))
    whole, bags, names, index = [], [], [], {}
    for text in bodies:
        buf = _FOLD[np.frombuffer(text.encode(), np.uint8)]
        a, b, _ = units(buf, np.array([0, len(buf)]))
        raw = buf.tobytes()
        bag = []
        for s in (raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)):
            if s not in index:
                index[s] = len(names)
                names.append(s)
            bag.append(index[s])
        whole.append(np.array(bag, np.int64))
        bags.append(np.unique(whole[-1]))
    y = np.array(labels)
    n = len(names)
    in_toxic = np.bincount(np.concatenate([g for g, t in zip(bags, y, strict=True) if t] or [[]]).astype(np.int64), minlength=n)
    in_clean = np.bincount(np.concatenate([g for g, t in zip(bags, y, strict=True) if not t] or [[]]).astype(np.int64), minlength=n)
    toxic, clean = int(y.sum()), int((1 - y).sum())
    size = np.array([len(s) for s in names])
    end = np.cumsum(size)
    buf = np.frombuffer(b"".join(names), np.uint8)
    # at first a unit is as toxic as its share of toxic documents says; three of them stand against chance
    value = np.log((in_toxic + 0.5) / (toxic + 1)) - np.log((in_clean + 0.5) / (clean + 1)) - 3.0 * (in_toxic < 3)
    value[size < 3] = -9
    machine = Machine(np.zeros(CODES), (0.0, 1.0, 0.0))
    order = np.argsort(A.mix(np.arange(n, dtype=A.U64)))
    strong = np.flatnonzero((value > 3) & (in_toxic >= 6))
    for turn in range(rounds):
        picked = np.array([g[np.argmax(value[g])] for g, t in zip(bags, y, strict=True) if t and len(g)])
        # a unit that many toxic and hardly any clean documents have stays with them; weights are numbers of toxic documents
        pos = np.unique(np.concatenate([strong, picked[:0] if not turn else picked[value[picked] > 0]]))
        times = in_toxic[pos]
        if not len(pos):
            break
        able = in_clean > 0
        able[pos] &= in_clean[pos] * toxic > in_toxic[pos] * clean
        hard = np.argsort(-np.where(able, value, -99), kind="stable")[:1500]
        neg = np.unique(np.concatenate([hard[able[hard]], order[able[order]][:3000]]))
        pos, times = pos[~np.isin(pos, neg)], times[~np.isin(pos, neg)]
        if not len(pos):
            break
        best = pos[np.argsort(-times, kind="stable")][: landmarks // 2]
        marks = _vectors([names[i] for i in np.concatenate([best, hard[: landmarks // 2], order[: landmarks // 8]])])
        gram = marks @ marks.T
        scale, basis = np.linalg.eigh(gram.astype(np.float64))
        good = scale > 1e-6
        white = basis[:, good] / np.sqrt(scale[good])  # the Nystroem map: kernel values with the landmarks times this
        rows = np.concatenate([pos, neg])
        values = _kernels([names[i] for i in rows], marks)
        weight = np.concatenate([times / times.sum(), np.sqrt(in_clean[neg]) / np.sqrt(in_clean[neg]).sum()])
        v, bias = _svm(values @ white, np.concatenate([np.ones(len(pos)), -np.ones(len(neg))]), weight)
        machine = Machine((marks.T @ (white @ v)).astype(np.float64), (0.0, 1.0, 0.0), -2.0, bias)
        value = machine.values(buf, end - size, end)
    doc = np.repeat(np.arange(len(whole)), [len(g) for g in whole])
    x = machine.features(doc, value[np.concatenate(whole)] if len(doc) else np.zeros(0), len(whole))
    machine.line = _logistic(x, y, np.where(y == 1, share / toxic, (1 - share) / clean) * len(y))
    return machine


class _Remembered:
    """Values by hash, in sorted runs that are merged when there are many."""

    def __init__(self):
        self.runs: list = []

    def __call__(self, machine: Machine, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = A.span_hash(A.prefix_hash(buf), a, b)
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        out, known = np.zeros(len(unique)), np.zeros(len(unique), bool)
        for k, v in self.runs:
            at = np.minimum(np.searchsorted(k, unique), len(k) - 1)
            hit = k[at] == unique
            out[hit] = v[at[hit]]
            known |= hit
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = machine.values(buf, a[first[new]], b[first[new]])
            self.runs.append((unique[new], out[new]))
        if len(self.runs) > 8:
            k, v = map(np.concatenate, zip(*self.runs, strict=True))
            order = np.argsort(k)
            self.runs = [(k[order], v[order])] if len(k) < CACHED else []
        return out[back]


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        memory = _Remembered()
        for batch in batches:
            for i, j, buf, offs in A.slabs(batch.column(1), SLAB):
                buf = _FOLD[buf]
                a, b, doc = units(buf, offs)
                x = machine.features(doc, memory(machine, buf, a, b), j - i)
                yield A.batch_of(schema, batch.column(0)[i:j], machine.probability(x))
        A.trim()

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    mod, out = HELD_OUT
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    return score(docs, fit(*labelled(docs, labels, "toxic", *HELD_OUT, rows_per_class)))
