"""Toxicity: a linear classifier over hashed words whose score is held steady when identity terms are swapped.

Training minimises logistic loss with an L1 penalty, plus the squared change of the score between a
labelled sentence and its counterfactual, in which each identity term is replaced by another of its
group. Terms of a group are also paired with each other once, so terms that the sample lacks move
together with the rest. Features are the distinct words of the whole text without punctuation and their
starts of 4, 5 and 7 bytes, hashed: a start tells inflected and compound forms that the sample lacks.

Defined results: a null or empty text gets the bias alone; without labels of both kinds every score is
the share of label 1 (0 without labels). A repeated doc_id is scored row by row. Other columns than those
named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, raw, remainder, trimmed, words
from .learning import PUNCTUATION, REMEMBERED, Buckets, Rows, gathered, labelled, sigmoid

#: Neutral identity terms by group.
GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual", "transgender"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("women", "men", "girls", "boys", "females", "males"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian", "japanese"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
)
N_BUCKETS, SAMPLE, STEADY, L1, ROUNDS = 1 << 20, 8_000, 4.0, 1e-4, 120
#: Features enter training if the labels' shares with and without them differ by so many standard errors; label 1 weighs so much more, at most.
TELLING, MOST_WEIGHT = 2.5, 6.0


class Forms(Buckets):
    """word -> buckets of the word without punctuation and of its starts."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(PUNCTUATION)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = (zlib.crc32(bare) % self.n, *(zlib.crc32(b"^" + bare[:k]) % self.n for k in (4, 5, 7) if len(bare) > k)) if bare else ()
        return out

    def of(self, tokens: Iterable[bytes]) -> np.ndarray:
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, set(tokens))), np.int64))


@dataclass
class Model:
    bias: float
    weight: np.ndarray


def swaps(text: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """For each sentence with identity terms: the terms that leave and those that come."""
    following = {a.encode(): g[(i + 1) % len(g)].encode() for g in GROUPS for i, a in enumerate(g)}
    out = []
    for sentence in re.split(rb"[.!?\n]+", text.lower()):
        if gone := sorted({w for w in re.findall(rb"[a-z]+", sentence) if w in following}):
            out.append((gone, [following[w] for w in gone]))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, steady: float = STEADY) -> Model:
    """Trains on at most about `sample` labelled documents that aren't held out."""
    buckets = Forms(N_BUCKETS)

    def rows_of(text: bytes, y: int) -> dict:
        pairs = [(buckets.of(a), buckets.of(b)) for a, b in swaps(text)]
        return {"words": buckets.of(words(text)), "pairs": [[a.tolist(), b.tolist()] for a, b in pairs]}

    found = gathered(labelled(docs, labels, label, sample), rows_of, "words array<int>, pairs array<array<array<int>>>")
    y = found["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(N_BUCKETS))
    parts = []
    n, n_1 = np.zeros(N_BUCKETS), np.zeros(N_BUCKETS)
    for b in found.select(["words", "y", "place"]).to_batches(max_chunksize=500):
        size, col = b.column("words").value_lengths().to_numpy(zero_copy_only=False), b.column("words").flatten().to_numpy()
        n += np.bincount(col, minlength=N_BUCKETS)
        n_1 += np.bincount(col, np.repeat(b.column("y").to_numpy(), size), N_BUCKETS)
        parts.append((np.repeat(b.column("place").to_numpy(), size).astype(np.int32), col))
    share = y.mean()
    telling = (n >= 2) & (np.abs(n_1 - n * share) > TELLING * np.sqrt(np.maximum(n, 1) * share * (1 - share) * np.maximum(1 - n / len(y), 1e-3)))
    of, col = (np.concatenate([p[k][telling[p[1]]] for p in parts]).astype(np.int64) for k in (0, 1))
    order = np.lexsort((col, of))
    x = Rows([])
    x.n, x.of, x.col = len(y), of[order], col[order]
    x.val = np.ones(len(x.col))
    found = found.select(["y", "pairs", "place"]).sort_by("place")
    y = found["y"].to_numpy().astype(float)
    del parts, of, col, order
    pairs = [(a, b) for p in found["pairs"].to_pylist() for a, b in p]
    pairs += [(buckets.of([g[0].encode()]), buckets.of([t.encode()])) for g in GROUPS for t in g[1:]]
    swapped = Rows([np.array([*a, *b], np.int64) for a, b in pairs], [np.array([-1.0] * len(a) + [1.0] * len(b)) for a, b in pairs])
    return solve(x, y, swapped, steady)


def solve(x: Rows, y: np.ndarray, swapped: Rows, steady: float) -> Model:
    """Accelerated proximal gradient steps with backtracking."""
    used, at = np.unique(np.concatenate([x.col, swapped.col]), return_inverse=True)
    x.col, swapped.col, size = at[: len(x.col)], at[len(x.col) :], len(used)
    weight = np.where(y > 0, min(MOST_WEIGHT, (1 - y.mean()) / y.mean()), 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(size), float(np.log(weight @ y / (1 - weight @ y)))
    v, v_bias, t, rate = w.copy(), bias, 1.0, 1.0

    def loss(z: np.ndarray, d: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, z) - y * z) + steady * np.mean(d * d))

    for _ in range(ROUNDS):
        z, d = x.times(v) + v_bias, swapped.times(v)
        r = (sigmoid(z) - y) * weight
        g, g_bias, now = x.back(r, size) + swapped.back(2 * steady * d / swapped.n, size), float(r.sum()), loss(z, d)
        while True:
            new = v - rate * g
            new = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
            new_bias = v_bias - rate * g_bias
            step, step_bias = new - v, new_bias - v_bias
            bound = now + g @ step + g_bias * step_bias + (step @ step + step_bias**2) / (2 * rate)
            if rate < 1e-6 or loss(x.times(new) + new_bias, swapped.times(new)) <= bound + 1e-12:
                break
            rate /= 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t, rate = new, new_bias, t_new, rate * 1.2
    out = np.zeros(N_BUCKETS, np.float32)
    out[used] = w
    return Model(bias, out)


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep, and score (0 to 1) and predicted of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    trimmed()
    at = docs.columns.index("text")

    def make():
        buckets, m = Forms(N_BUCKETS), sent.value

        def columns(batch):
            s = sigmoid(np.array([m.bias + m.weight[buckets.of(words(t))].sum() for t in raw(batch.column(at))], float))
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return columns

    return appended(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)


def judged(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, **parameters), ["doc_id"])
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
