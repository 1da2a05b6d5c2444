"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space, and one end ("\\n"). A byte's context is the
bytes before it, nearest first, at most DEPTH of them: for the first REACH bytes of a word they go on into
the last REACH bytes of the word before, for later ones they end at the word's start, with spaces beyond.
Each byte is eight binary decisions; every decision has a tree of contexts whose nodes hold a
Krichevsky-Trofimov estimate, and a node's probability is half its own estimate plus half the product of
its children's. Frozen after training, that makes a decision's probability a mix of the estimates at all
depths of its context, weighted by how well each depth did on the training texts. A context that training
never met ends the mix one depth above.

A text's score is thus a sum over its parts, the words' ends (what follows their first REACH bytes) and
the junctions between words, and every step works on parts or contexts rather than on texts:

* One scan deals texts into blocks of about BLOCK bytes. A block is a dictionary of its parts, cut by hash
  into ranges, and, for each document, how often each part occurs. Both are written, so block ids only
  need to be unique, and travel as compressed arrays.
* The dictionaries' pieces of one range meet in one task, which sums the parts' counts over all blocks.
  Counts of (context, byte) come from those by aggregation.
* Trees are cut by their two nearest context bytes, so a task holds the trees of some such pairs; what lies
  above has at most 256 * 255 + 255 nodes and is computed on the driver.
* A part's score is looked up in the (context, byte) table if that is small enough to broadcast, and by a
  join otherwise. Scores go back to the blocks, and there to the documents.

Defined results: a null or empty text is one end token; repeated rows are scored row by row; without
training texts every binary decision has probability 1/2. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from math import log, log10, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, remainder, trimmed, trimming, words, written

DEPTH, REACH, BLOCK, END = 6, 3, 32 << 20, b"\n"
#: Parts of a range, about, and the text bytes that bring a new one.
RANGE, BYTES_A_PART = 500_000, 33
#: Rows of the (context, byte) table that may be broadcast, at 12 bytes each.
MOST_BROADCAST = 8_000_000
#: Parts of a range that are spelled out at once.
SPELLED = 1 << 16


class Dictionary(dict):
    """word -> number in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def grown(n: np.ndarray, size: int) -> np.ndarray:
    """n with room for so many numbers at least, zeros behind its own."""
    return n if len(n) >= size else np.concatenate([n, np.zeros(max(size, 2 * len(n)) - len(n), n.dtype)])


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, as compressed byte planes."""
    both = np.concatenate([np.asarray(a, "<i8") for a in arrays])
    return zlib.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return np.split(both, n)


def listed(words: list[bytes]) -> bytes:
    """Words and junctions, none of which holds a tab."""
    return zlib.compress(b"\t".join(words), 1)


def unlisted(blob: bytes) -> list[bytes]:
    return zlib.decompress(blob).split(b"\t")


def blocks(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (block, range, words, ids) of the blocks' dictionaries, ids holding the words' numbers and occurrences in training texts, and rows (block, doc_id, held_out, bag)."""
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    names = ["block", "doc_id", "held_out", "bag", "range", "words", "ids"]

    def run(batches):
        def fresh():
            return uuid.uuid4().int >> 65, Dictionary(), np.zeros(0, np.int64), 0

        def closed():
            n = grown(trained, len(found))
            parts: dict[int, list[bytes]] = {}
            for w in found:
                parts.setdefault(zlib.crc32(w) % ranges, []).append(w)
            for k, part in parts.items():
                part.sort()
                ids = np.fromiter(map(found.__getitem__, part), np.int64, len(part))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.array([k], pa.int64()), pa.array([listed(part)], pa.binary()), pa.array([packed(ids, n[ids])], pa.binary())], names)

        block, found, trained, size = fresh()
        for b in batches:
            done, bags, texts = 0, [], raw(b.column("text"))
            for k, (t, held) in enumerate(zip(texts, b.column("held_out").to_pylist(), strict=True)):
                tokens = words(t)
                joints = [b" " + a[-REACH:] + b" " + (w + b" ")[:REACH] for a, w in zip([b"", *tokens], tokens)]
                joints.append(b" " + (tokens[-1][-REACH:] if tokens else b"") + b" " + END)
                tokens += [END, *joints]
                ids, times = np.unique(np.fromiter(map(found.__getitem__, tokens), np.int64, len(tokens)), return_counts=True)
                if not held:
                    trained = grown(trained, len(found))
                    trained[ids] += times
                bags.append(packed(np.diff(ids, prepend=0), times))
                size += len(t)
                if size > BLOCK or k == len(texts) - 1:
                    m = len(bags)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), b.column("doc_id").slice(done, m).cast(pa.int64()), b.column("held_out").slice(done, m), pa.array(bags, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names)
                    done, bags = done + m, []
                    if size > BLOCK:
                        yield from closed()
                        block, found, trained, size = fresh()
        if found:
            yield from closed()

    return rows.mapInArrow(trimming(run), "block long, doc_id long, held_out boolean, bag binary, range long, words binary, ids binary")


def merged(made: DataFrame) -> DataFrame:
    """A row for each range: its words, their counts c, how many of them are training tokens (train, kinds), and for each block the words' places here and numbers there."""

    def meet(group: pa.Table) -> pa.Table:
        found, places, total = Dictionary(), [], np.zeros(0, np.int64)
        for blob, ids in zip(group["words"].to_pylist(), group["ids"].to_pylist(), strict=True):
            own = unlisted(blob)
            at = np.fromiter(map(found.__getitem__, own), np.int64, len(own))
            ids, n = unpacked(ids, 2)
            places.append(packed(at, ids))
            total = grown(total, len(found))
            total[at] += n
        total = total[: len(found)]
        token = np.fromiter((w[:1] != b" " for w in found), bool, len(found))
        out = pa.table({"range": group["range"][:1], "words": pa.array([listed(list(found))], pa.binary()), "c": pa.array([packed(total)], pa.binary()), "train": pa.array([int(total[token].sum())]), "kinds": pa.array([int((total[token] > 0).sum())]), "blocks": pa.array([group["block"].to_pylist()], pa.list_(pa.int64())), "places": pa.array([places], pa.list_(pa.binary()))})
        del found, places, own
        trimmed()
        return out

    dictionaries = made.filter("words is not null").select("block", "range", "words", "ids")
    return dictionaries.groupBy("range").applyInArrow(meet, "range long, words binary, c binary, train long, kinds long, blocks array<long>, places array<binary>")


def spelled(found: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) keys of parts, the nearest context byte highest, and how many each part has.

    A part that begins with a space is a junction: the end of one word, a space, and the bytes to predict.
    Any other is a word, of which the bytes after the first REACH are predicted.
    """
    known = [w.rindex(b" ", 0, -1) if w[:1] == b" " else REACH for w in found]
    parts = [w[1:] if w[:1] == b" " else w + b" " if w != END else b"" for w in found]
    whole = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.minimum(np.array(known, np.int64), whole)
    size = whole - first
    lead = b" " * depth
    flat = np.frombuffer(lead + lead.join(parts), np.uint8).astype(np.uint64)
    start = np.cumsum(whole) - whole + depth * np.arange(1, len(parts) + 1) + first
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    key = np.zeros(len(at), np.uint64)
    for k in range(1, depth + 1):
        key = key << np.uint64(8) | flat[at - k]
    return key << np.uint64(8) | flat[at], size


def lots(found: list[bytes], depth: int):
    """(a slice, what spelled() gives for its parts) after another: a text's byte takes 8 bytes several times over, so a range is never spelled whole."""
    for i in range(0, len(found), SPELLED):
        yield slice(i, i + SPELLED), *spelled(found[i : i + SPELLED], depth)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of n over each."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, beyond 8 by the recurrence."""
    y, shift = x + 8, np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def estimated(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - log(pi)


class Level:
    """The nodes of one depth for one of the eight decisions: keys (context, bits decided before), counts and weights."""

    def __init__(self, key: np.ndarray, n: np.ndarray, bit: int):
        one = (key >> np.uint64(7 - bit)) & np.uint64(1)
        node = key >> np.uint64(8 - bit)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, np.int64)
        self.key, self.bit = node[first], bit
        total = np.add.reduceat(n, first).astype(float) if len(first) else np.empty(0)
        self.ones = np.add.reduceat(n * one.astype(np.int64), first).astype(float) if len(first) else np.empty(0)
        self.zeros = total - self.ones
        self.own = estimated(self.zeros, self.ones)
        self.whole, self.weight = self.own, np.ones(len(self.key))

    def over(self, below: Level) -> Level:
        """Mixes in the children."""
        children = np.bincount(np.searchsorted(self.key, below.parents()), below.whole, len(self.key))
        return self.mixed(children)

    def mixed(self, children: np.ndarray) -> Level:
        self.whole = np.logaddexp(self.own, children) - log(2)
        self.weight = np.exp(self.own - log(2) - self.whole)
        return self

    def parents(self) -> np.ndarray:
        bits = np.uint64(self.bit)
        return self.key >> (bits + np.uint64(8)) << bits | self.key & np.uint64((1 << self.bit) - 1)

    def mix(self, key: np.ndarray, p: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a one at this depth, from that one depth below where it is known; key: (context, byte)."""
        at = np.searchsorted(self.key, key >> np.uint64(8 - self.bit))
        n = self.zeros[at] + self.ones[at]
        own = (self.ones[at] + 0.5) / (n + 1)
        return np.where(known, self.weight[at] * own + (1 - self.weight[at]) * p, own), n > 0


def cut(key: np.ndarray, n: np.ndarray, depth: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) counts of a lesser depth."""
    return summed(key >> np.uint64(8 * (depth - to + 1)) << np.uint64(8) | key & np.uint64(255), n)


def forest(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> Iterator[list[Level]]:
    """For each decision, one after the other, its levels from top to depth."""
    counts = {d: cut(key, n, depth, d) for d in range(top, depth + 1)}
    for bit in range(8):
        levels = [Level(*counts[depth], bit)]
        for d in range(depth - 1, top - 1, -1):
            levels.append(Level(*counts[d], bit).over(levels[-1]))
        yield levels[::-1]


def rows(batches) -> tuple[np.ndarray, np.ndarray]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return summed(np.concatenate([k for k, _ in held]).view(np.uint64), np.concatenate([n for _, n in held]))


def model(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """grams (gram, n), n 0 for those that only held-out texts have -> gram, lp: the log10 probability of the byte in its context."""
    near = F.shiftrightunsigned("gram", 8 * (depth - 1))
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grams.select("gram", "n").repartition(parts, near)

    def sums(batches):
        key, n = rows(batches)
        for bit, levels in enumerate(forest(key, n, depth, 2)):
            at = levels[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at.key), bit)), pa.array(at.parents().astype(np.int64)), pa.array(at.zeros), pa.array(at.ones), pa.array(at.whole)], ["bit", "node", "zeros", "ones", "whole"])

    top = dealt.mapInArrow(trimming(sums), "bit long, node long, zeros double, ones double, whole double").groupBy("bit", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "whole"))).toArrow().sort_by([("bit", "ascending"), ("node", "ascending")])
    bit, node, zeros, ones, whole = (top[c].to_numpy() for c in ("bit", "node", "zeros", "ones", "whole"))
    above: list[list[Level]] = []
    for b in range(8):
        own = bit == b
        first, root = Level.__new__(Level), Level.__new__(Level)
        first.bit, first.key, first.zeros, first.ones = b, node[own].astype(np.uint64), zeros[own], ones[own]
        first.own = estimated(first.zeros, first.ones)
        first.mixed(whole[own])
        root.bit, (root.key, back) = b, np.unique(first.parents(), return_inverse=True)
        root.zeros, root.ones = np.bincount(back, first.zeros, len(root.key)), np.bincount(back, first.ones, len(root.key))
        root.own = estimated(root.zeros, root.ones)
        root.mixed(np.bincount(back, first.whole, len(root.key)))
        above.append([root, first])
    sent = grams.sparkSession.sparkContext.broadcast(above)

    def probabilities(batches):
        key, n = rows(batches)
        lp = np.zeros(len(key))
        for bit, levels in enumerate(forest(key, n, depth, 2)):
            p, known = np.full(len(key), 0.5), np.zeros(len(key), bool)
            for d, level in reversed(list(enumerate([*sent.value[bit], *levels]))):
                short = key >> np.uint64(8 * (depth - d + 1)) << np.uint64(8) if d < depth + 1 and 8 * (depth - d + 1) < 64 else np.zeros(len(key), np.uint64)
                p, known = level.mix(short | key & np.uint64(255), p, known)
            one = (key >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            lp += np.log10(np.where(one, p, 1 - p))
        for i in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(lp[i : i + (1 << 16)])], ["gram", "lp"])

    return dealt.mapInArrow(trimming(probabilities), "gram long, lp double")


def gram_counts(found: list[bytes], c: np.ndarray, depth: int) -> list[pa.Array]:
    """The distinct (context, byte) keys of parts that occur c times, and how often each occurs."""
    each = [summed(key, np.repeat(c[at], size)) for at, key, size in lots(found, depth)]
    key, n = summed(np.concatenate([k for k, _ in each]), np.concatenate([n for _, n in each]))
    return [pa.array(key.view(np.int64)), pa.array(n)]


def counted(vocabulary: DataFrame, depth: int) -> DataFrame:
    """gram, n over the merged ranges."""

    def run(batches):
        for b in batches:
            for blob, c in zip(b.column("words"), b.column("c"), strict=True):
                yield from pa.Table.from_arrays(gram_counts(unlisted(blob.as_py()), unpacked(c.as_py(), 1)[0], depth), ["gram", "n"]).to_batches(1 << 16)

    return vocabulary.select("words", "c").mapInArrow(trimming(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def returned(row: dict, lp: np.ndarray, size: np.ndarray):
    """A range's scores for each of its blocks: numbers, counts (-1 for a junction, which is no token), sizes, and log10 probabilities."""
    c = unpacked(row["c"], 1)[0]
    c = np.where(np.fromiter((w[:1] != b" " for w in unlisted(row["words"])), bool, len(c)), c, -1)
    for block, places in zip(row["blocks"], row["places"], strict=True):
        at, ids = unpacked(places, 2)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed(ids, c[at], size[at])], pa.binary()), pa.array([lp[at].astype("<f4").tobytes()], pa.binary())], ["of", "known", "lp"])


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def part_sums(found: list[bytes], keys: np.ndarray, values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The log10 probability and the bytes of each part, by the table (keys, values)."""
    lp, whole = np.zeros(len(found)), np.zeros(len(found), np.int64)
    for at, key, size in lots(found, depth):
        each = values[np.searchsorted(keys, key)].astype(float)
        lp[at], whole[at] = np.bincount(np.repeat(np.arange(len(size)), size), each, len(size)), size
    return lp, whole


SCORES = "of long, known binary, lp binary"


def part_scores(vocabulary: DataFrame, probabilities: DataFrame, depth: int, most: int = MOST_BROADCAST) -> DataFrame:
    """Rows (of: the block, known, lp) with the scores of some of a block's parts."""
    if probabilities.count() <= most:
        got = probabilities.toArrow()
        key, lp = got["gram"].to_numpy().view(np.uint64), got["lp"].to_numpy().astype(np.float32)
        order = np.argsort(key)
        sent = vocabulary.sparkSession.sparkContext.broadcast((key[order], lp[order]))
        del got, key, lp, order

        def run(batches):
            keys, values = sent.value
            for b in batches:
                for row in one_by_one(b):
                    yield from returned(row, *part_sums(unlisted(row["words"]), keys, values, depth))

        return vocabulary.mapInArrow(trimming(run), SCORES)

    def exploded(batches):
        for b in batches:
            for row in one_by_one(b.select(["range", "words"])):
                for own, key, size in lots(unlisted(row["words"]), depth):
                    at = np.repeat(np.arange(own.start, own.start + len(size)), size)
                    yield from pa.Table.from_arrays([pa.array(np.full(len(at), row["range"])), pa.array(at), pa.array(key.view(np.int64))], ["r", "at", "gram"]).to_batches(1 << 16)

    some = vocabulary.mapInArrow(trimming(exploded), "r long, at long, gram long").join(probabilities, "gram").groupBy("r", "at").agg(F.sum("lp").alias("lp"), F.count("*").alias("size"))

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        n = len(unpacked(row["c"], 1)[0])
        lp, size = np.zeros(n), np.zeros(n, np.int64)
        lp[right["at"].to_numpy()], size[right["at"].to_numpy()] = right["lp"].to_numpy(), right["size"].to_numpy()
        out = pa.Table.from_batches(list(returned(row, lp, size)))
        del row, lp, size
        trimmed()
        return out

    return vocabulary.groupBy("range").cogroup(some.groupBy("r")).applyInArrow(give, SCORES)


def scored(docs: DataFrame, depth: int = DEPTH, most: int = MOST_BROADCAST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (of the scored bytes) and bits_per_byte."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    made = written(blocks(docs, 1 + size // BYTES_A_PART // RANGE))
    vocabulary = written(merged(made))
    n_train, n_kinds = vocabulary.agg(F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    grams = written(counted(vocabulary, depth))
    probabilities = written(model(grams, depth))
    scores = part_scores(vocabulary, probabilities, depth, most)
    texts = made.filter("bag is not null").select("block", "doc_id", "held_out", "bag")
    floor = log10(n_train + n_kinds + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [unpacked(b, 3) for b in right["known"].to_pylist()]
        order = np.argsort(np.concatenate([k[0] for k in known]))
        c, size = (np.concatenate([k[i] for k in known])[order] for i in (1, 2))
        lp = np.concatenate([np.frombuffer(b, "<f4") for b in right["lp"].to_pylist()]).astype(float)[order]
        token = c >= 0
        base, out = np.where(token, np.log10(np.maximum(c, 0) + 1.0) - floor, 0), []
        for blob in left["bag"].to_pylist():
            ids, times = unpacked(blob, 2)
            ids = np.cumsum(ids)
            out.append((int(times[token[ids]].sum()), int(times[c[ids] > 0].sum()), float(times @ base[ids]), float(times @ lp[ids]), int(times @ size[ids])))
        n_tokens, n_known, base_score, total, n_bytes = zip(*out, strict=True)
        made = pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": base_score, "score": total, "n_bytes": pa.array(n_bytes, pa.int64())})
        del known, order, c, size, lp, token, base, out, n_tokens, n_known, base_score, total, n_bytes
        trimmed()
        return made

    out = texts.groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (F.col("score") / -log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
