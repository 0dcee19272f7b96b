"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. An encoder turns each passage's measurements into a hidden
vector; gated attention (a tanh and a sigmoid branch, multiplied) weighs the passages of a document
against each other; the weighted sum is scored. All weights are learnt together from labels of whole
documents, so the passages that tell good from bad are found without labels of their own.

Every passage of every text is encoded. Null and empty texts are one passage without words. Labels may be missing,
null or repeated; without both classes to learn from, every score is the share of good rows (one half if
there are none). Repeated rows are scored each. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .samples import ROWS_PER_CLASS, labelled
from .tables import remainder, texts

HELD_OUT = (5, 0)
PREDICT = 0.3
PASSAGE, BUCKETS, HIDDEN = 64, 32, 16
_SETS = [A.byte_set(c) for c in ("#*$%&<>", "|", "!", ".,", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "=@+()[]{}/\\_", '"', "\n")]


def passages(buf: np.ndarray, offs: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """A row of measurements for each passage of a slab, and its document."""
    nd = len(offs) - 1
    a, b, doc = A.words(buf, offs)
    n = np.bincount(doc, minlength=nd)
    per_doc = np.maximum(1, -(-n // size))
    base = np.cumsum(per_doc) - per_doc
    total = int(per_doc.sum())
    owner = np.repeat(np.arange(nd), per_doc)
    place = np.arange(len(a)) - (np.cumsum(n) - n)[doc]
    of = base[doc] + place // size  # passage of each word
    words = np.bincount(of, minlength=total).astype(np.float64)
    at_least = np.maximum(words, 1)
    chars = b - a
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    # a passage reaches from its first word to the next passage's first, in its document
    starts = offs[owner].copy()
    starts[of[first]] = a[first]
    ends = np.append(starts[1:], len(buf))
    ends = np.where(np.append(owner[1:], -1) == owner, ends, offs[1:][owner])
    out = []
    for chosen in _SETS:
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(chosen[buf], out=sums[1:])
        out.append(np.log1p((sums[ends] - sums[starts]) / at_least))
    h = A.span_hash(A.prefix_hash(buf), a, b)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])]) if len(h) else np.zeros(0, bool)
    keys = np.unique((of.astype(A.U64) << A.U64(40)) | (h >> A.U64(24)))
    distinct = np.bincount((keys >> A.U64(40)).astype(np.int64), minlength=total)
    out.append(np.bincount(of[again], minlength=total) / at_least)
    out.append(distinct / at_least)
    out.append(np.log1p(np.bincount(of, chars, total) / at_least))
    out.append(np.bincount(of[chars <= 2], minlength=total) / at_least)
    out.append(np.bincount(of[chars >= 14], minlength=total) / at_least)
    out.append(np.minimum(words / size, 1))
    out.append(np.log1p(n)[owner] / 8)
    # words of the document that an earlier passage of it has, seen as a whole
    whole = np.unique((doc.astype(A.U64) << A.U64(A.KEY_BITS)) | (h >> A.U64(64 - A.KEY_BITS)))
    kinds = np.bincount((whole >> A.U64(A.KEY_BITS)).astype(np.int64), minlength=nd)
    out.append((kinds / np.maximum(n, 1))[owner])
    bucket = (h >> A.U64(59)).astype(np.int64)
    out += list(np.sqrt(np.bincount(of * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / at_least[:, None]).T)
    return np.stack(out, axis=1), owner


@dataclass
class Attention:
    """Encoder w, b; attention v, u, a; output c. Measurements are centred and scaled first."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    constant: float | None = None

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray, first: np.ndarray, owner: np.ndarray):
        """Probability of each bag, and what the backward pass needs. x: encoded; first: each bag's first passage."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        share = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(h * share[:, None], first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, (h, t, s, share, z)

    def score(self, x: np.ndarray, owner: np.ndarray, nd: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(nd, self.constant)
        return self.forward(self.encode(x), np.searchsorted(owner, np.arange(nd)), owner)[0]


def fit(bodies: list[str], labels: list[int], counts: dict[int, int], hidden: int = HIDDEN, steps: int = 400, seed: int = 5) -> Attention:
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(set(labels)) < 2:
        return Attention(np.zeros(1), np.ones(1), {}, share)
    xs, owners, nd = [], [], 0
    for _, _, buf, offs in A.slabs(pa.array(bodies, pa.large_string())):
        x, owner = passages(buf, offs)
        xs.append(x)
        owners.append(owner + nd)
        nd += len(offs) - 1
    x, owner = np.concatenate(xs), np.concatenate(owners)
    first = np.searchsorted(owner, np.arange(nd))
    y = np.array(labels, np.float64)
    good = y.sum()
    weight = np.where(y == 1, share / good, (1 - share) / (nd - good))
    rng = np.random.default_rng(seed)
    r = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"w": r(x.shape[1], hidden), "b": np.zeros(hidden), "v": r(hidden, hidden), "u": r(hidden, hidden), "a": r(hidden), "c": r(hidden), "d": np.zeros(())}
    model = Attention(x.mean(0), x.std(0) + 1e-3, p)
    x = model.encode(x)
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    for k in range(1, steps + 1):
        out, (h, t, s, part, z) = model.forward(x, first, owner)
        dy = weight * (out - y)
        g = {"c": z.T @ dy, "d": dy.sum()}
        dz = (dy[:, None] * p["c"])[owner]
        dpart = (dz * h).sum(1)
        de = part * (dpart - np.add.reduceat(part * dpart, first)[owner])
        g["a"] = (t * s).T @ de
        dg = de[:, None] * p["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh = (dz * part[:, None] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        g["w"], g["b"] = x.T @ dh, dh.sum(0)
        for q in p:
            grad = g[q] + (1e-4 * p[q] if q not in ("b", "d") else 0)
            m[q] = 0.9 * m[q] + 0.1 * grad
            v[q] = 0.999 * v[q] + 0.001 * grad * grad
            p[q] = p[q] - 0.02 * (m[q] / (1 - 0.9**k)) / (np.sqrt(v[q] / (1 - 0.999**k)) + 1e-8)
    return model


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in A.slabs(batch.column(1)):
                yield A.batch_of(schema, batch.column(0)[i:j], model.score(*passages(buf, offs), j - i))

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    mod, out = HELD_OUT
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    return score(docs, fit(*labelled(docs, labels, "quality", *HELD_OUT, rows_per_class)))
