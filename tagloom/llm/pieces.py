"""SentencePiece encoding and decoding of whole texts with a public model's piece table.

A text is escaped as the model does (a space in front, each space a "▁") and cut into words where no
piece can reach across. A word's lattice has an edge for each substring that is a piece. Two folds run
over it: for a unigram model Viterbi, which takes the path of the highest score; for a BPE model the
merges, which join the two neighbouring pieces whose joint edge scores highest, the leftmost first,
because a BPE model's scores are merge ranks and their best sum is another segmentation.

`encoded` runs in Arrow batches and shuffles nothing: each task encodes a word once and looks it up
afterwards, and words of one length are folded together in numpy. `encode_relational` states the same
lattice in DataFrame operations: substrings exploded, an equi-join to the piece table, edges grouped by
word, and the fold as a higher-order aggregate.

Defined results: a null or empty text has no pieces; characters outside the table become byte pieces; a
text that holds "▁" itself decodes with spaces there. Columns other than those named are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, raw, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words that a task remembers, the longest that is folded in numpy, and the text that is worked on at once.
REMEMBERED, LONGEST, AT_ONCE = 200_000, 40, 2 << 20


@dataclass
class Pieces:
    """The piece table: bytes that a piece stands for, scores, and the table of mergeable pairs."""

    names: list[str]
    scores: np.ndarray
    normal: np.ndarray
    bytes_at: dict[int, int]
    unigram: bool

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.names) if self.normal[i]}
        self.rank = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)  # equal scores: the leftmost pair
        self.longest = max(map(len, self.ids), default=1)
        byte_of = {i: b for b, i in self.bytes_at.items()}
        self.plain = [bytes([byte_of[i]]) if i in byte_of else p.replace(SPACE, " ").encode() if self.normal[i] else b"" for i, p in enumerate(self.names)]
        #: Words end before a space that follows something else, and at line feeds, if no piece reaches across.
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        feeds = any("\n" in p and len(p) > 1 for p in self.ids)
        stop = "" if feeds else r"\n"
        self.cut = re.compile(rb"(?s).+" if crossing else f" *[^ {stop}]+| +|\n".encode())
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self._fill(pairs)

    def _fill(self, pairs: dict[int, int]) -> None:
        """An open-addressing hash table that numpy can probe."""
        size = 1 << max(10, (6 * len(pairs)).bit_length())
        self.keys, self.merged = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        listed = np.array(list(pairs), np.int64)
        for key, at in zip(listed.tolist(), self._slot(listed, size).tolist(), strict=True):
            while self.keys[at] != -1:
                at = (at + 1) % size
            self.keys[at], self.merged[at] = key, pairs[key]

    @staticmethod
    def _slot(keys: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, -1 where there is none."""
        key = (a.astype(np.int64) << 32 | b).ravel()
        out, mask = np.full(key.shape, -1, np.int32), len(self.keys) - 1
        left = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        at = self._slot(key[left], mask + 1)
        while len(left):
            there = self.keys[at]
            hit = there == key[left]
            out[left[hit]] = self.merged[at[hit]]
            on = np.flatnonzero(~hit & (there != -1))
            left, at = left[on], at[on] + 1 & mask
        return out.reshape(a.shape)

    def spelled(self, symbols: list[int]) -> list[int]:
        """Symbols as ids: what is below 0 is a character outside the table, -1 - code point."""
        out = []
        for s in symbols:
            out += [s] if s >= 0 else [self.bytes_at[b] for b in chr(-1 - s).encode()]
        return out

    def merge_one(self, word: str) -> list[int]:
        """The merges of one word of any length, by a heap."""
        sym = [self.ids.get(c, -1 - ord(c)) for c in word]
        left, right, alive, heap = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1)), [True] * len(sym), []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(sym) and sym[i] >= 0 and sym[j] >= 0 and (m := self.ids.get(self.names[sym[i]] + self.names[sym[j]])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, j, sym[i], sym[j], m))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if alive[i] and alive[j] and right[i] == j and sym[i] == a and sym[j] == b:
                sym[i], alive[j], right[i] = m, False, right[j]
                if right[j] < len(sym):
                    left[right[j]] = i
                offer(left[i], i)
                offer(i, right[i])
        return self.spelled([s for s, a in zip(sym, alive, strict=True) if a])

    def viterbi_one(self, word: str) -> list[int]:
        """The path of the highest score through one word's lattice; a character outside the table costs 10 more than any piece."""
        best, back = [0.0] + [-np.inf] * len(word), [(0, 0)] * (len(word) + 1)
        low = float(self.scores.min()) - 10
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                k = self.ids.get(word[i:j], -1 - ord(word[i]) if j == i + 1 else None)
                if k is not None and (s := best[i] + (float(self.scores[k]) if k >= 0 else low)) > best[j]:
                    best[j], back[j] = s, (i, k)
        out, j = [], len(word)
        while j:
            j, k = back[j]
            out.append(k)
        return self.spelled(out[::-1])

    def merge_many(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of words of one length, all at once. codes: code points, a column a word; returns symbols likewise, and how many of a column count."""
        n, many = codes.shape
        kinds, back = np.unique(codes, return_inverse=True)
        sym = np.array([self.ids.get(chr(c), -1 - int(c)) for c in kinds], np.int32)[back].reshape(codes.shape)
        sizes, big = np.full(many, n), np.int32(2**31 - 1)
        if n == 1:
            return sym, sizes
        out, own = sym.copy(), np.arange(many)
        rank_of = np.append(self.rank, big).astype(np.int32)  # [-1]: no such pair
        pair = self.joined(sym[:-1], sym[1:])
        rank = rank_of[pair]
        while True:
            best = rank.min(0)
            go = best < big
            if (live := int(go.sum())) < 0.8 * len(own):
                out[:, own] = sym  # columns that go on are written again later
                own, sym, pair, rank, best = own[go], sym[:, go], pair[:, go], rank[:, go], best[go]
                go = np.ones(live, bool)
            if not live:
                out[:, own] = sym
                return out, sizes
            at = np.where(go, rank.argmin(0), n)
            w = np.flatnonzero(go)
            k = at[w]
            sym[k, w] = pair[k, w]
            for r in range(int(k.min()), n - 1):  # what stands behind the merged pair moves up by one
                np.copyto(sym[r], sym[r + 1], where=at < r)
                if r < n - 2:
                    here = at <= r
                    np.copyto(pair[r], pair[r + 1], where=here)
                    np.copyto(rank[r], rank[r + 1], where=here)
            sym[n - 1, w], pair[n - 2, w], rank[n - 2, w] = -(2**31), -1, big
            sizes[own[w]] -= 1
            for j in (k - 1, k):
                ok = np.flatnonzero((j >= 0) & (j < n - 1))
                jj, ww = j[ok], w[ok]
                m = self.joined(sym[jj, ww], sym[jj + 1, ww])
                pair[jj, ww], rank[jj, ww] = m, rank_of[m]

    def fold(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and each word's number of ids."""
        texts = b"\0".join(found).decode().replace(" ", SPACE).split("\0") if not any(b"\0" in w for w in found) else [w.decode().replace(" ", SPACE) for w in found]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        length[(length > LONGEST) | self.unigram] = 0
        order = np.argsort(length, kind="stable")
        orders, flats, sizes = [], [], []

        def add(own: list[int], ids: list[list[int]]) -> None:
            orders.append(np.array(own, np.int64))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.array([i for x in ids for i in x], np.int64))

        ends = np.flatnonzero(np.diff(length[order], append=-1)) + 1
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            n = int(length[order[lo]])
            if not n:
                add(order[lo:hi].tolist(), [self.viterbi_one(texts[i]) if self.unigram else self.merge_one(texts[i]) for i in order[lo:hi]])
                continue
            for k in range(lo, hi, 8192):
                own = order[k : min(hi, k + 8192)]
                codes = np.frombuffer("".join([texts[i] for i in own.tolist()]).encode("utf-32-le"), np.uint32).reshape(-1, n).T
                sym, size = self.merge_many(codes)
                sym = sym.T
                used = np.arange(n) < size[:, None]
                odd = ((sym < 0) & used).any(1)
                orders.append(own[~odd])
                sizes.append(size[~odd])
                flats.append(sym[~odd][used[~odd]])
                if odd.any():
                    add(own[odd].tolist(), [self.spelled(sym[i, : size[i]].tolist()) for i in np.flatnonzero(odd)])
        size = np.concatenate(sizes)
        pick = np.empty(len(size), np.int64)
        pick[np.concatenate(orders)] = np.arange(len(size))
        return ragged(np.concatenate(flats), np.cumsum(size) - size, size, pick).astype(np.int32), size[pick]


def load(path: str = MODEL) -> Pieces:
    """The table of a model file. The library only reads the file; it doesn't encode here."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.get_piece_size())
    names = [m.id_to_piece(i) for i in n]
    odd = np.array([m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in n])
    at = {int(names[i][3:5], 16): i for i in n if m.is_byte(i)}
    s = np.array([m.get_score(i) for i in n])
    # A BPE model's scores are negated merge numbers; a unigram model's are log probabilities.
    return Pieces(names, s, ~odd, at, not np.array_equal(s, np.round(s)))


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The pieces of flat that pick names, one behind the other."""
    n = size[pick]
    ends = np.cumsum(n)
    return flat[np.repeat(start[pick] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes texts one after another and remembers words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}
        self.size = np.array([len(b) for b in pieces.plain])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces.plain), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known, self.word_flat, self.word_size = {}, np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        cut = self.pieces.cut.findall
        each = [cut(b" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        fresh = list({w for ws in each for w in ws}.difference(self.known))
        if fresh:
            ids, sizes = self.pieces.fold(fresh)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.word_size, self.word_flat = np.concatenate([self.word_size, sizes]), np.concatenate([self.word_flat, ids])
        start = np.cumsum(self.word_size) - self.word_size
        get = self.known.__getitem__
        return [ragged(self.word_flat, start, self.word_size, np.fromiter(map(get, ws), np.int64, len(ws))) for ws in each]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: pieces' bytes without the space in front."""
        return ragged(self.flat, self.start, self.size, ids).tobytes()[1:]


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts of about AT_ONCE bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL, ids: bool = True) -> DataFrame:
    """keep, and for each text piece_ids (if ids), n_pieces, n_bytes (byte pieces), ids_crc (crc32 of the ids as little-endian int32) and round_trip: whether the ids decode to the text."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))
    trimmed()
    at = docs.columns.index(text)

    def make():
        import zlib

        encoder = Encoder(sent.value)
        is_byte = np.isin(np.arange(len(sent.value.names)), list(sent.value.bytes_at.values()))

        def columns(batch):
            texts, out = raw(batch.column(at)), []
            for group in groups(texts):
                for t, x in zip(group, encoder.encode(group), strict=True):
                    out.append((x if ids else None, len(x), int(is_byte[x].sum()), zlib.crc32(x.astype("<i4").tobytes()), encoder.decode(x) == t))
            listed = [pa.array([r[0] for r in out], pa.list_(pa.int32()))] if ids else []
            return [*listed, pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64()), pa.array([r[4] for r in out], pa.bool_())]

        return columns

    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField(n, T.LongType()) for n in ("n_pieces", "n_bytes", "ids_crc")] + [T.StructField("round_trip", T.BooleanType())]
    return appended(docs, make, fields, keep)


def decoded(rows: DataFrame, ids: str = "piece_ids", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """keep, and text: what the ids stand for; null ids give an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(load(model))
    at = rows.columns.index(ids)

    def make():
        encoder = Encoder(sent.value)
        return lambda batch: [pa.array([encoder.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()], pa.string())]

    return appended(rows, make, [T.StructField("text", T.StringType())], keep)


def table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """The piece table as rows (piece, id, score); it has as many rows as the model has pieces."""
    rows = [(p, i, float(pieces.scores[i])) for p, i in pieces.ids.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def encode_relational(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, piece_ids by the relational lattice. Measured beyond the check tool's CPU limit, so queries use `encoded`; tests hold one against the other."""
    spark, pieces = docs.sparkSession, load(model)
    cut = pieces.cut.pattern.decode().replace(" ", SPACE)
    text = F.when(F.length("text") > 0, F.concat(F.lit(SPACE), F.translate("text", " ", SPACE)))
    placed = docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(f"({cut})"), F.lit(1))).alias("nth", "word"))
    found = placed.select("word").distinct()
    spans = found.select("word", F.explode(F.expr(f"flatten(transform(sequence(0, length(word) - 1), i -> transform(sequence(1, least({pieces.longest}, length(word) - i)), n -> struct(i as i, i + n as j, substring(word, i + 1, n) as piece))))")).alias("s")).select("word", "s.*")
    edges = spans.join(F.broadcast(table(spark, pieces)), "piece").groupBy("word").agg(F.collect_list(F.struct(F.concat_ws(":", "i", "j").alias("key"), F.struct("score", "id").alias("value"))).alias("edges"))
    lattice = found.join(edges, "word", "left").withColumn("edges", F.map_from_entries(F.coalesce("edges", F.array().cast("array<struct<key:string,value:struct<score:double,id:int>>>"))))
    if pieces.unigram:
        low = float(pieces.scores.min()) - 10
        candidates = f"transform(sequence(greatest(0, j - {pieces.longest}), j - 1), i -> named_struct('score', best[i].score + coalesce(edges[concat(i, ':', j)].score, if(i = j - 1, {low}D, double('-inf'))), 'start', i))"
        best = f"aggregate(sequence(1, length(word)), array(named_struct('score', 0D, 'start', 0)), (best, j) -> concat(best, array(array_max({candidates}))))"
        back = "reverse(aggregate(sequence(1, length(word)), array(length(word)), (c, k) -> if(element_at(c, -1) = 0, c, concat(c, array(best[element_at(c, -1)].start)))))"
        lattice = lattice.withColumn("best", F.expr(best)).withColumn("cuts", F.expr(back))
    else:
        score = "coalesce(edges[concat(cuts[k], ':', cuts[k + 2])].score, double('-inf'))"
        top = f"array_max(transform(sequence(0, size(cuts) - 3), k -> struct({score} as score, -k as k)))"
        step = f"transform(array({top}), t -> if(t.score = double('-inf'), cuts, filter(cuts, (c, n) -> n != 1 - t.k)))[0]"
        lattice = lattice.withColumn("cuts", F.expr(f"aggregate(sequence(1, length(word)), sequence(0, length(word)), (cuts, x) -> if(size(cuts) < 3, cuts, {step}))"))
    bytes_at = F.array(*(F.lit(pieces.bytes_at[b]) for b in range(256)))
    lattice = lattice.withColumn("byte_ids", bytes_at)
    spelled = "transform(regexp_extract_all(hex(encode(substring(word, cuts[k] + 1, cuts[k + 1] - cuts[k]), 'UTF-8')), '(..)', 1), h -> byte_ids[cast(conv(h, 16, 10) as int)])"
    own = lattice.select("word", F.expr(f"flatten(transform(sequence(0, size(cuts) - 2), k -> if(edges[concat(cuts[k], ':', cuts[k + 1])].id is null, {spelled}, array(edges[concat(cuts[k], ':', cuts[k + 1])].id))))").alias("own"))
    joined = placed.join(own, "word").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("nth", "own"))).alias("all"))
    return docs.select("doc_id").join(joined, "doc_id", "left").select("doc_id", F.coalesce(F.expr("flatten(all.own)"), F.array().cast("array<int>")).alias("piece_ids"))
