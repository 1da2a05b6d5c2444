"""Packing documents into sequences by vector best-fit.

A document's ids are those of a public tokenizer and an end id. What is longer than a sequence is cut into
whole sequences and a rest. A piece needs three things of a sequence: its tokens, one document, and the
attention of its tokens over each other, n (n + 1) / 2. A sequence has a capacity of each. Pieces are
placed in falling order of their tokens, each into the open sequence that, of those where every residual
suffices, has the largest weighted dot product of need and residual, or the smallest weighted norm of what
would be left; if none fits, a new one is opened.

A need depends on a piece's length alone, so the placement works on counts: pieces of one length and
sequences of one content are placed at once, and its input is one number for each possible length, however
many documents there are. Spark does the rest: it tokenizes, counts the lengths, numbers the pieces of a
length (by task, then by what earlier tasks have, so that no length gathers in one task) and looks up the
place that the plan has for that number.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are documents of
their own; an empty table gives no rows; columns other than doc_id and the text are ignored. Long texts are
cut, never shortened. The same input files give the same sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, raw, segments, sliced, written

MODEL = "/opt/tokenizers/word_bpe_49k.json"
END = 1
#: Words (and parts of words) that a task remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 400_000, 64
SPACE = re.compile(rb"[ \t-\r]")
#: The model's pattern for words of these letters and signs, and the characters by which it spells bytes.
LETTERS = "a-zß-öø-ıĳ-ňŊ-ſ"
PLAIN, PARTS = re.compile(f"(?:[!-~À-ÖØ]|[{LETTERS}])*"), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)}.difference(SHOWN)))}
#: Ways of choosing a sequence: the score, and the weights of tokens, documents and attention. The way that needs fewest sequences counts.
WAYS = (("norm", (1.0, 1e-6, 1e-6)), ("norm", (1.0, 0.01, 0.1)), ("dot", (1.0, 0.1, 1.0)))


def attention(length):
    """Pairs of a token and one that it sees."""
    return length * (length + 1) // 2


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The defaults for documents and attention bind no sequence of so many tokens."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = attention(4096)

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that fits an empty sequence."""
        n = min(self.tokens, int(((8 * self.attention + 1) ** 0.5 - 1) / 2) + 1)
        while attention(n) > self.attention:
            n -= 1
        if n < 1 or self.documents < 1:
            raise ValueError("a sequence has to hold one token of one document at least")
        return n


def placed(counts: dict[int, int], capacity: Capacity, score: str = "norm", weights: tuple[float, float, float] = WAYS[0][1]) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Kinds of sequences: how many there are, and the (length, pieces) in each, for counts of pieces by length.

    Each length adds a few kinds at most, so there are a few times as many kinds as lengths.
    """
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention])
    weight, room = np.array(weights), 64
    left, bins, held = np.zeros((room, 3), np.int64), np.zeros(room, np.int64), []

    def add(rest, n, content):
        nonlocal left, bins
        if len(held) == len(bins):
            left, bins = np.concatenate([left, np.zeros_like(left)]), np.concatenate([bins, np.zeros_like(bins)])
        left[len(held)], bins[len(held)] = rest, n
        held.append(content)

    for length in sorted(counts, reverse=True):
        n, need = counts[length], np.array([length, 1, attention(length)])
        while n:
            fits = np.flatnonzero((left[: len(held)] >= need).all(1) & (bins[: len(held)] > 0))
            if not len(fits):
                add(caps, -(-n // int((caps // need).min())), ())
                fits = np.array([len(held) - 1])
            rest, share = left[fits] / caps, need / caps
            value = rest @ (weight * share) if score == "dot" else -((rest - share) ** 2 @ weight)
            c = fits[value.argmax()]
            # The best fit stays the best by the norm until it is full.
            k = min(n, int((left[c] // need).min()) if score == "norm" else 1)
            full = min(int(bins[c]), n // k)
            n -= full * k
            more = (*held[c], (length, k))
            if full == bins[c]:
                left[c] -= k * need
                held[c] = more
            else:
                bins[c] -= full
                add(left[c] - k * need, full, more)
    return [(int(b), h) for b, h in zip(bins, held, strict=False) if b and h]


def slots(kinds: list[tuple[int, tuple[tuple[int, int], ...]]]) -> tuple[np.ndarray, ...]:
    """length, first number, pieces a sequence, offset, first sequence: where the pieces of a length from a number on go; by length and number."""
    first, rows, sequence = {}, [], 0
    for n, content in kinds:
        offset = 0
        for length, k in content:
            at = first.get(length, 0)
            rows.append((length, at, k, offset, sequence))
            first[length] = at + n * k
            offset += length * k
        sequence += n
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


class Words:
    """Ids of texts as little-endian 32-bit numbers.

    White space ends a token, so a word's ids don't depend on what is around it, and each word is encoded
    once. Words of plain letters, digits and signs are split by the model's own pattern, and its merges are
    asked for each part once; the tokenizer encodes other words, special tokens among them, whole.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts = Tokenizer.from_str(model), {}, {}
        self.merges = self.tokenizer.model.tokenize

    def part(self, p: str) -> bytes:
        out = self.parts.get(p)
        if out is None:
            if len(self.parts) > REMEMBERED:
                self.parts.clear()
            spelled = p if p.isascii() else "".join(map(SPELLED.__getitem__, p.encode()))
            out = self.parts[p] = array("I", [t.id for t in self.merges(spelled)]).tobytes()
        return out

    def word(self, w: bytes) -> bytes:
        if w.isalpha():
            return self.part(w.decode().lower())
        s = w.decode("utf-8", "replace")
        if PLAIN.fullmatch(s) and "<|" not in s:
            return b"".join(map(self.part, PARTS.findall(s.lower())))
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.piece, segments(text, SPACE)))

    def piece(self, text: bytes) -> bytes:
        # Special tokens are found before letters are lower-cased.
        words, known = (text if b"<|" in text else text.lower()).split(), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
        fresh = {*words}.difference(known)
        known.update(zip(fresh, map(self.word, fresh), strict=True))
        out = b"".join(map(known.__getitem__, words))
        for w in fresh:
            if len(w) > LONGEST:
                del known[w]
        return out


def pieces(docs: DataFrame, longest: int, text: str = "text", model: str = MODEL, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; part and nth: the task that made a piece, and how many of that length it had before."""
    with open(model, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", F.col(text).alias("text"))
    names = ["piece", "start", "length", "ids_crc32", "part", "nth"]
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = Words(sent.value), TaskContext.get().partitionId(), [0] * (longest + 1)
        for whole in batches:
            for batch in sliced(whole):
                of, out = [], []
                for i, t in enumerate(raw(batch.column(1))):
                    data = words.ids(t) + last
                    n = len(data) // 4
                    for piece, start in enumerate(range(0, n, longest)):
                        length = min(longest, n - start)
                        of.append(i)
                        out.append((piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                own = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *own], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {'int' if n == 'piece' else 'bigint'}" for n in names))


def packed(docs: DataFrame, capacity: Capacity = Capacity(), text: str = "text", model: str = MODEL, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    cut = written(pieces(docs, capacity.longest, text, model, end))
    # One row for each task and length; a length's rows are as many as there are tasks.
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many as lengths
    kinds = min((placed(counts, capacity, *way) for way in WAYS), key=lambda found: sum(n for n, _ in found))
    sent = docs.sparkSession.sparkContext.broadcast(slots(kinds))
    numbered = cut.join(sizes.select("length", "part", "before"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, k, offset, sequence = sent.value
        key = length << 44 | first
        for b in batches:
            own, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, own << 44 | number, "right") - 1
            nth = number - first[at]
            where = [pa.array(sequence[at] + nth // k[at]), pa.array(offset[at] + nth % k[at] * own)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *where], [*b.schema.names[:5], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields[:5])
    out = written(numbered.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint"))
    dropped(cut)
    dropped(sizes)
    return out
