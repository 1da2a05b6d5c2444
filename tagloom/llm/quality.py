"""Quality: a factorisation machine over hashed words, structure statistics and metadata (lengths) of whole texts.

score = sigmoid(w0 + Σ w_i x_i + ½ Σ_f ((Σ v_if x_i)² - Σ v_if² x_i²)): all pairwise interactions, of low
rank, in time linear in the number of features. Statistics are binned by the sample's quantiles and
one-hot; words are the distinct ones, hashed, and share a fixed length.

Defined results: a null or empty text is scored by its statistics alone; without labels of both kinds
every score is the share of label 1 (1 without labels, so that nothing is rejected). A repeated doc_id is
scored row by row. Other columns than those named are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, raw, remainder, trimmed
from .learning import Buckets, Rows, gathered, labelled, sigmoid

N_BUCKETS, BINS, RANK, SAMPLE, EPOCHS, BATCH, RATE, L2, THRESHOLD = 1 << 14, 12, 8, 8_000, 12, 256, 0.1, 1e-4, 0.3
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
LOWER = bytes(range(97, 123))
SYMBOLS, STOPS = b"%&$*#@^~|<>{}[]\\=+_", b".!?"
HIGH = bytes(range(128, 256))


def structure(text: bytes, tokens: list[bytes]) -> list[float]:
    """Statistics of a text's build and length."""
    n, m = max(1, len(text)), max(1, len(tokens))
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / n
    lines = [x for x in text.split(b"\n") if x]
    counts = Counter(tokens)
    upper, lower = share(UPPER), share(LOWER)
    return [
        np.log1p(len(text)), np.log1p(len(tokens)), np.log1p(len(lines)), len(text) / m,
        upper / (upper + lower) if upper + lower else 0.0, share(DIGITS), share(SYMBOLS), share(b"!"), share(STOPS), share(HIGH), share(b" \n\t\r"),
        len(counts) / m, max(counts.values(), default=0) / m, sum(map(bytes.__eq__, tokens, tokens[1:])) / m,
        len(set(lines)) / max(1, len(lines)), len(lines) / m, max(map(len, counts), default=0) / 10,
        sum(x[-1:] in (b".", b"!", b"?", b":", b";") for x in lines) / max(1, len(lines)),
    ]


@dataclass
class Model:
    """Columns: the words' buckets, then BINS for each statistic. edges: the bins' bounds, a row a statistic."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def columns(self, words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (self.edges < stats[:, None]).sum(1) + N_BUCKETS + BINS * np.arange(len(stats))
        value = np.full(len(words) + len(bins), 1 / np.sqrt(len(stats)))
        value[: len(words)] = 1 / np.sqrt(max(1, len(words)))
        return np.concatenate([words, bins]), value

    def raw_scores(self, x: Rows) -> np.ndarray:
        sums = x.times(self.factors)
        squares = Rows.times(_squared(x), (self.factors**2).sum(1))
        return self.bias + x.times(self.weight) + ((sums**2).sum(1) - squares) / 2


def _squared(x: Rows) -> Rows:
    out = Rows([])
    out.n, out.of, out.col, out.val = x.n, x.of, x.col, x.val**2
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Trains on at most about `sample` labelled documents that aren't held out."""
    buckets = Buckets(N_BUCKETS)

    def rows_of(text: bytes, y: int) -> dict:
        tokens = text.lower().split()
        return {"words": buckets.of(tokens), "stats": structure(text, text.split())}

    found = gathered(labelled(docs, labels, label, sample), rows_of, "words array<int>, stats array<double>").sort_by("place")
    y = found["y"].to_numpy().astype(float)
    n_stats = len(structure(b"", []))
    stats = found["stats"].combine_chunks().flatten().to_numpy().reshape(-1, n_stats)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(y) else np.zeros((n_stats, BINS - 1))
    size = N_BUCKETS + BINS * n_stats
    rng = np.random.default_rng(6)
    model = Model(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)), edges)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        model.bias, model.factors[:] = float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0
        return model
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    flat = found["words"].combine_chunks()
    ends = np.append(0, np.cumsum(flat.value_lengths().to_numpy()))
    col = flat.flatten().to_numpy().astype(np.int64)
    rows = [model.columns(col[a:b], s) for a, b, s in zip(ends[:-1], ends[1:], stats, strict=True)]
    g_bias, g_weight, g_factors = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            x = Rows([rows[k][0] for k in own], [rows[k][1] for k in own])
            used, at = np.unique(x.col, return_inverse=True)
            v, w = model.factors[used], model.weight[used]
            part = Rows([])
            part.n, part.of, part.col, part.val = x.n, x.of, at, x.val
            sums = part.times(v)
            z = model.bias + part.times(w) + ((sums**2).sum(1) - _squared(part).times((v**2).sum(1))) / 2
            r = (sigmoid(z) - y[own]) / len(own)
            d_w = part.back(r, len(used)) + L2 * w
            own_part = np.bincount(at, part.val**2 * r[part.of], len(used))
            d_v = np.stack([part.back(r * sums[:, k], len(used)) for k in range(RANK)], 1) - own_part[:, None] * v + L2 * v
            g_bias += float(r.sum()) ** 2
            g_weight[used] += d_w**2
            g_factors[used] += d_v**2
            model.bias -= RATE * float(r.sum()) / np.sqrt(g_bias)
            model.weight[used] -= RATE * d_w / np.sqrt(g_weight[used])
            model.factors[used] -= RATE * d_v / np.sqrt(g_factors[used])
    return model


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep, and score (0 to 1) and predicted (1 from THRESHOLD on) of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    trimmed()
    at = docs.columns.index("text")

    def make():
        buckets, m = Buckets(N_BUCKETS), sent.value

        def columns(batch):
            out, texts = [], raw(batch.column(at))
            for i in range(0, len(texts), 500):
                rows = [m.columns(buckets.of(t.lower().split()), np.array(structure(t, t.split()))) for t in texts[i : i + 500]]
                out.append(sigmoid(m.raw_scores(Rows([c for c, _ in rows], [v for _, v in rows]))))
            s = np.concatenate(out) if out else np.empty(0)
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return columns

    return appended(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)


def judged(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, **parameters), ["doc_id"])
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
