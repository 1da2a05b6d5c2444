"""Base alignment qualities: how sure it is that a read's base stands where its alignment puts it.

A read and the piece of the reference around it are a profile HMM with matches, insertions and deletions,
whose ends on the reference are free. Forward and backward sums over a band give each base's most probable
place; where that isn't the alignment's, or isn't sure, the base's quality is lowered. Reads get their piece
of the reference by a join with sequence chunks, and are worked on in Arrow batches: all reads of one length and band at
once, in numpy, one base after another.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cigar, flags, tags
from ..sources import sequences

#: The chances to open and to extend a gap, the half width of the band, the chance of an inserted base, and the share of a miscalled one.
OPEN, EXTEND, BAND, INSERTED, MISCALLED = 0.001, 0.1, 7, 0.25, 1 / 3
#: The codes of bases; others are ambiguous.
CODE = np.full(256, 4, np.int8)
CODE[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2


def posterior(ref: np.ndarray, size: np.ndarray, query: np.ndarray, qual: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For reads (rows) of one length: the reference place (from 0) of each base's most probable state, whether that is an insertion, and the state's quality.

    ref holds codes, padded beyond each row's size. In row i of the band, column w is reference place i - band + w.
    """
    n, length = query.shape
    wide, end = 2 * band + 1, 1 / (2 * length + 2)
    stay = 1 - end
    mm, mg, im, ii, dm, dd = (1 - 2 * OPEN) * stay, OPEN * stay, (1 - EXTEND) * stay, EXTEND * stay, 1 - EXTEND, EXTEND
    error = 10.0 ** (-qual / 10.0)
    padded = np.concatenate([np.full((n, band + 1), 4, np.int8), ref, np.full((n, length + 2 * band + 2), 4, np.int8)], 1)
    columns = np.arange(wide)

    def inside(i: int) -> np.ndarray:
        k = i - band + columns
        return (k >= 1) & (k <= size[:, None])

    def emitted(i: int) -> np.ndarray:
        # Base i (from 1) against the places of its row.
        r, q, e = padded[:, i : i + wide], query[:, i - 1 : i], error[:, i - 1 : i]
        return np.where((r > 3) | (q > 3), 1.0, np.where(r == q, 1 - e, e * MISCALLED))

    match, insert = np.zeros((length + 1, n, wide)), np.zeros((length + 1, n, wide))
    scale = np.ones((length + 2, n))
    gone = np.zeros((n, wide))
    for i in range(1, length + 1):
        ok, e = inside(i), emitted(i)
        if i == 1:
            m, x = e * ((1 - OPEN) / size)[:, None], np.broadcast_to((INSERTED * OPEN / size)[:, None], (n, wide))
            m, x, d = np.where(ok, m, 0), np.where(ok, x, 0), np.zeros((n, wide))
        else:
            m = np.where(ok, e * (mm * match[i - 1] + im * insert[i - 1] + dm * gone), 0)
            x = np.zeros((n, wide))
            x[:, :-1] = INSERTED * (mg * match[i - 1][:, 1:] + ii * insert[i - 1][:, 1:])
            x = np.where(ok, x, 0)
            d = np.zeros((n, wide))
            for w in range(1, wide):
                d[:, w] = np.where(ok[:, w], mg * m[:, w - 1] + dd * d[:, w - 1], 0)
        total = (m + x + d).sum(1)
        scale[i] = np.where(total > 0, total, 1)
        match[i], insert[i], gone = m / scale[i][:, None], x / scale[i][:, None], d / scale[i][:, None]
    last = (match[length] + insert[length]).sum(1) * end
    scale[length + 1] = np.where(last > 0, last, 1)

    place, kind, sure = np.zeros((n, length), np.int64), np.zeros((n, length), bool), np.zeros((n, length))
    bm = np.where(inside(length), (end / scale[length] / scale[length + 1])[:, None], 0)
    bi = bm.copy()
    for i in range(length, 0, -1):
        if i < length:
            ok = inside(i)
            e = np.where(i - band + columns < size[:, None], emitted(i + 1) * bm, 0)
            after = np.zeros((n, wide))
            after[:, 1:] = bi[:, :-1]
            bd = np.zeros((n, wide + 1))
            for w in range(wide - 1, -1, -1):
                bd[:, w] = np.where(ok[:, w], (dm * e[:, w] + dd * bd[:, w + 1]) * (i > 1), 0)
            new = np.where(ok, mm * e + INSERTED * mg * after + mg * bd[:, 1:], 0)
            bi = np.where(ok, im * e + INSERTED * ii * after, 0) / scale[i][:, None]
            bm = new / scale[i][:, None]
        both = np.stack([match[i] * bm, insert[i] * bi], 2).reshape(n, -1)
        best, total = both.argmax(1), both.sum(1)
        place[:, i - 1], kind[:, i - 1] = i - band + best // 2 - 1, best % 2 == 1
        sure[:, i - 1] = np.divide(both.max(1), total, out=np.zeros(n), where=total > 0)
    with np.errstate(divide="ignore"):
        quality = np.minimum(-4.343 * np.log(1 - np.minimum(sure, 1)) + 0.499, 1000).astype(int)
    return place, kind, np.where(quality > 100, 99, quality)


def framed(pos: int, ops: list[tuple[int, str]], length: int) -> tuple[int, int, int] | None:
    """The piece of the reference (start, end) to align a read with, and the band; None for reads that aren't realigned."""
    x, y, first, last = pos, 0, None, None
    for n, o in ops:
        if o in "M=X":
            first = first or (x, y)
            x, y = x + n, y + n
            last = (x, y)
        elif o in "SI":
            y += n
        elif o == "D":
            x += n
        elif o == "N":
            return None
    if first is None or y != length:
        return None
    low, high = first[0], last[0]
    odd = abs((last[0] - first[0]) - (last[1] - first[1]))
    band = odd + 3 if odd > BAND else BAND
    low, high = max(0, low - first[1] - band // 2), high + length - last[1] + band // 2
    if high - low - length > band:
        low += (high - low - length - band) // 2
        high -= (high - low - length - band) // 2
    return low, high, band


def offsets(qual: np.ndarray, pos: int, ops: list[tuple[int, str]], low: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], extend: bool) -> np.ndarray:
    """How much each base's quality is lowered."""
    place, kind, sure = found
    out, x, y = qual.copy(), pos, 0
    for n, o in ops:
        if o in "M=X":
            at = slice(y, y + n)
            good = np.where(kind[at] | (place[at] != x - low + np.arange(n)), 0, sure[at])
            if extend:  # a base is as sure as the surest on its weaker side
                good = np.minimum(np.maximum.accumulate(good), np.maximum.accumulate(good[::-1])[::-1])
            out[at] = good if extend else np.minimum(qual[at], good)
            x, y = x + n, y + n
        elif o in "SI":
            y += n
        elif o == "D":
            x += n
    return np.maximum(qual - out, 0)


def lowered(rows: list[tuple], extend: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, offsets) for rows (pos, cigar, seq, qual, piece of the reference, its start)."""
    groups = defaultdict(list)
    for k, (pos, text, seq, qual, piece, start) in enumerate(rows):
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=XB])", text or "")]
        frame = framed(pos, ops, len(seq)) if piece is not None and seq != "*" and len(qual) == len(seq) and qual != "*" else None
        if frame:
            low, high, band = frame
            ref = CODE[np.frombuffer(piece[low - start : high - start].encode(), np.uint8)]
            if len(ref):
                widest = max(len(ref), len(seq))
                groups[len(seq), max(min(widest, band), abs(len(ref) - len(seq)))].append((k, ops, low, ref))
    for (length, band), own in groups.items():
        for part in (own[i : i + 256] for i in range(0, len(own), 256)):
            size = np.array([len(r) for *_, r in part])
            ref = np.full((len(part), size.max()), 4, np.int8)
            for j, (*_, r) in enumerate(part):
                ref[j, : len(r)] = r
            query = np.stack([CODE[np.frombuffer(rows[k][2].encode(), np.uint8)] for k, *_ in part])
            qual = np.stack([np.frombuffer(rows[k][3].encode("latin-1"), np.uint8).astype(int) - 33 for k, *_ in part])
            place, kind, sure = posterior(ref, size, query, qual, band)
            for j, (k, ops, low, _) in enumerate(part):
                yield k, offsets(qual[j], rows[k][0], ops, low, (place[j], kind[j], sure[j]), extend)


def adjusted(records: DataFrame, chunks: DataFrame, chunk: int = sequences.CHUNK, extend: bool = False, apply: bool = True) -> DataFrame:
    """Records with lowered qualities and, as the tag ZQ, by how much; with apply=False qualities stay, and the tag is BQ.

    Mapped records with qualities and matches, without skipped reference, whose reference is in the chunks are
    realigned; others stay as they are, and so do those that already have the tag. The tag of the other kind is
    turned into this one.
    """
    c, n = F.col("cigar"), F.length("seq")
    margin = n + cigar.reference_length(c) + 16
    new, old = ("ZQ", "BQ") if apply else ("BQ", "ZQ")
    has = lambda tag: F.coalesce(F.map_contains_key("aux", tag), F.lit(False))
    names = records.columns
    may = ~flags.has(F.col("flag"), flags.UNMAPPED) & (F.col("seq") != "*") & (F.col("qual") != "*") & ~has("ZQ") & ~has("BQ")
    start = F.greatest(F.col("pos") - margin, F.lit(0))
    windows = records.select(F.when(may, F.col("rname")).alias("seqnames"), (start + 1).alias("start"), (cigar.reference_end(F.col("pos").cast("bigint"), c) + margin).alias("end"), *(F.col(x).alias(f"_r_{x}") for x in [*records.columns]))
    pieces = sequences.fetched(chunks, windows, chunk).withColumnRenamed("seq", "_piece")
    kinds = pieces.select(*(F.col(f"_r_{x}").alias(x) for x in records.columns), F.col("start").alias("_from"), "_piece")
    schema = T.StructType([*kinds.drop("_from", "_piece").schema.fields, T.StructField("_lower", T.StringType())])
    at = {x: kinds.columns.index(x) for x in ("pos", "cigar", "seq", "qual", "_piece", "_from")}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = {x: b.column(k).to_pylist() for x, k in at.items()}
            given = [(p, g, s or "*", q or "*", w, (f or 1) - 1) for p, g, s, q, w, f in zip(*(cols[x] for x in ("pos", "cigar", "seq", "qual", "_piece", "_from")), strict=True)]
            out: list[str | None] = [None] * len(given)
            for k, low in lowered(given, extend):
                out[k] = "".join(chr(64 + int(v)) for v in low)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.string())], [*names, "_lower"])

    made = kinds.mapInArrow(run, schema)
    codes = lambda text, less: F.transform(F.split(text, ""), lambda x: F.ascii(x) - less)
    moved = lambda by, sign: F.array_join(F.transform(F.arrays_zip(codes(F.col("qual"), 33).alias("q"), codes(by, 64).alias("o")), lambda e: F.char(33 + F.greatest(e["q"] + sign * e["o"], F.lit(0)))), "")
    other = tags.get(F.col("aux"), old)
    turn = has(old) & ~has(new) & (F.length(other) == F.length("qual"))
    by = F.when(turn, other).otherwise(F.col("_lower"))
    sign = -1 if apply else 1
    quality = F.when(F.col("_lower").isNotNull(), moved(F.col("_lower"), -1) if apply else F.col("qual")).when(turn, moved(other, sign)).otherwise(F.col("qual"))
    tagged = F.when(by.isNotNull(), tags.put(tags.drop(F.coalesce("aux", F.create_map().cast(tags.AUX)), old), new, "Z", by)).otherwise(F.col("aux"))
    return made.select(*(quality.alias(x) if x == "qual" else tagged.alias(x) if x == "aux" else F.col(x) for x in records.columns))
