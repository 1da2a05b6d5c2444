"""Importance resampling towards a target's distribution of hashed n-grams.

Features are all runs of 1 to `n` words; each falls into one of `buckets` by the crc32 of its bytes. A
bucket's gain is the scaled log ratio of its smoothed shares in the target and in the documents, a
document's weight the mean gain of its features, and a document's score its weight plus Gumbel noise drawn
from its id, so that the highest scores are a weighted sample without replacement.

Long texts are cut at word boundaries into chunks of about `size` bytes and dealt to all tasks. A chunk
carries the n - 1 words that follow it, and owns the features that start in it, so each feature counts once;
counts and gains of a document's chunks are summed. What is gathered is one number a bucket.

The drawn documents are numbered without a global window: they are sorted by ranges, each range's size is
counted, and a document's rank is its place in its range behind the ranges before.

Defined results: null text has no words; a text without features has weight 0; a null doc_id draws its noise
from an empty id and comes after others with its score; repeated rows are documents of their own, ranked in
any order among themselves; an empty target gives each bucket the gain of its absence there; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, raw, sliced, written

N, BUCKETS, SEED, SHARE, FEWEST, SCALE = 1, 10_000, 2024, (10, 100), 20, 1000
#: Bytes of a chunk, and features that a task remembers.
SIZE, REMEMBERED = 1 << 16, 400_000
#: What isn't part of a word becomes a space, and A-Z is lower-cased.
FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def chunks(text: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(chunk with n - 1 words of what follows, words that start in it) of a text; a word is never cut."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        own, carry = text[at:end], []
        for m in WORD.finditer(text, end) if n > 1 else ():
            carry.append(m[0])
            if len(carry) == n - 1:
                break
        yield b" ".join([own, *carry]), len(words(own))
        at = end


def features(found: list[bytes], own: int, n: int) -> list[bytes]:
    """Runs of 1 to n words that start at one of the first `own` ones."""
    if n == 1:
        return found[:own]
    return [b" ".join(found[i : i + k]) for i in range(own) for k in range(1, min(n, len(found) - i) + 1)]


class Buckets:
    """Buckets of features; each is hashed once."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, found: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known = {}
            self.known.update((f, zlib.crc32(f) % self.buckets) for f in {*found}.difference(self.known))
            return np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))


def parts(docs: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, own, text of docs (doc_id, text): whole short texts, where row and own are null, and the chunks of long ones, dealt out evenly."""
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    short = docs.filter(length <= size).select("doc_id", F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("own"), F.col("text").cast("binary").alias("text"))
    long = docs.filter(length > size).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 1):
                found = list(chunks(raw(batch.column(2))[0], n, size))
                of = pa.array([0] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(range(len(found)), pa.int64()), pa.array([k for _, k in found], pa.int64()), pa.array([t for t, _ in found], pa.binary())], ["doc_id", "row", "nth", "own", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = long.mapInArrow(cut, f"doc_id {kind}, row bigint, nth bigint, own bigint, text binary").repartition("row", "nth")
    return short, dealt.drop("nth")


def counted(docs: DataFrame, n: int = N, buckets: int = BUCKETS, size: int = SIZE) -> np.ndarray:
    """How many features of docs (doc_id, text) fall into each bucket. One number a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in sliced(whole):
                found = []
                for own, t in zip(batch.column(2).to_pylist(), raw(batch.column(3)), strict=True):
                    ws = words(t)
                    found.append(known.of(features(ws, len(ws) if own is None else own, n)))
                total += np.bincount(np.concatenate(found), minlength=buckets) if found else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    short, long = parts(docs, n, size)
    for r in short.union(long).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's scaled log ratio of smoothed shares, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = lambda a, b: (float(a + 1) * float(s + n)) / (float(b + 1) * float(t + n))
    return np.array([math.floor(SCALE * math.log(ratio(a, b))) for a, b in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = N, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_features, weight of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        known = Buckets(len(gain))
        for whole in batches:
            for batch in sliced(whole):
                out = []
                for own, t in zip(batch.column(2).to_pylist(), raw(batch.column(3)), strict=True):
                    ws = words(t)
                    own = len(ws) if own is None else own
                    found = known.of(features(ws, own, n))
                    out.append((own, len(found), int(gain[found].sum())))
                numbers = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers], ["doc_id", "row", "n_words", "n_features", "gain"])

    short, long = (x.mapInArrow(run, f"doc_id {kind}, row bigint, n_words bigint, n_features bigint, gain bigint") for x in parts(docs, n, size))
    columns = ["doc_id", "n_words", "n_features", "gain"]
    whole = long.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in columns[1:])).select(*columns)
    weight = F.expr("if(n_features = 0, 0, (gain - pmod(gain, n_features)) div n_features)").cast("bigint")
    return short.select(*columns).unionByName(whole).select("doc_id", "n_words", "n_features", weight.alias("weight"))


def noise(doc_id, seed: int = SEED):
    """Scaled Gumbel noise from the first 32 bits of the sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, share: tuple[int, int] = SHARE, fewest: int = FEWEST, size: int = SIZE) -> DataFrame:
    """doc_id, n_features, weight, score, rank of docs (doc_id, text) towards target (text): rank is null for what isn't drawn."""
    docs = docs.select("doc_id", "text")
    gain = gains(counted(docs, n, buckets, size), counted(target.select(F.lit(None).cast("int").alias("doc_id"), "text"), n, buckets, size))
    scored = weighed(docs, gain, n, size).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("bigint"))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    may = F.col("n_words") >= fewest
    # The row's number lets equal scores of equal ids part.
    ordered = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranges = scored.filter(may).repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("place", F.monotonically_increasing_id())
    ranges = written(ranges.select("doc_id", "n_features", "weight", "score", F.shiftright("place", 33).alias("range"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    # A row a range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(ranges.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))))
    drawn = (sizes.agg(F.sum("n")).first()[0] or 0) * share[0] // share[1]
    rank = F.col("before") + F.col("nth") + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ranges.join(F.broadcast(sizes.select("range", "before")), "range").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    out = written(ranked.unionByName(scored.filter(~may).select(*columns, F.lit(None).cast("bigint").alias("rank"))))
    for x in (scored, ranges, sizes):
        dropped(x)
    return out
