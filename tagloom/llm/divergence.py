"""How far the sources of a language differ in the terms that they use, from dense term blocks.

1. Terms are counted in tasks and then by (lang, source, term), with the number of documents that hold each.
2. A language keeps the terms of at least `least` of its documents. Kept terms are dealt into blocks by hash,
   as many blocks as keep a block's tile, sources by terms, at about `cells` cells, or at as many terms as
   there are sources if that is more, so that pair sums are no more rows than cells.
3. A block is a numpy int64 tile of scaled shares. All pairs of its sources are broadcast against each other,
   |p - q| is summed over the block's terms, and a top list of terms is made for each source. Where a language
   has many sources, a task takes `rows` of them against all.
4. Partial pair sums are added up, and the top lists merged, by source.

Shares are floor(scale * (count + prior) / (N + prior * V)) + 1 in integers: the division is done three digits
at a time, so no product overflows, and everything is exact.

Defined results: null text, lang and source are ''; repeated rows count as often as they occur; a source
without kept terms has the prior's shares, and with no kept terms in its language all its pairs are 0; an
empty table gives no rows; columns other than lang, source and the text are ignored. Ties go to the smaller
item in UTF-8.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, raw, segments, sliced, written

LEAST, PRIOR, TOP = 30, 5, 50
#: Different terms that a task counts before it passes them on; cells of a tile, small enough for a language's terms to go to several tasks; sources that a task takes against all; pairs of a tile worked on at once.
HELD, CELLS, ROWS, AT_ONCE = 200_000, 1 << 15, 256, 1 << 21
#: What isn't part of a term becomes a space, and A-Z is lower-cased.
FOLD = bytes(32 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))
GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """lang, source, term -> n occurrences and docs documents. Each (lang, source) also has a row with a null term."""
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        since = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                found = list(n)
                for k in range(0, len(found) + 1, 10_000):
                    own = found[k : k + 10_000] + [None] * (k == 0)
                    columns = [[lang] * len(own), [source] * len(own), own]
                    numbers = [pa.array([c[t] if t is not None else 0 for t in own], pa.int64()) for c in (n, docs)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()).cast(pa.string()) for c in columns), *numbers], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for whole in batches:
            for batch in sliced(whole):
                for lang, source, t in zip(*(raw(batch.column(k)) for k in range(3)), strict=True):
                    n, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
                    own: set[bytes] = set()
                    for part in segments(t, GAP):
                        found = terms(part)
                        n.update(found)
                        own.update(found)
                        since += len(found)
                    docs.update(own)
                    if since > HELD:
                        since = 0
                        if sum(len(n) for n, _ in held.values()) > HELD:
                            yield from flushed()
        yield from flushed()

    return docs.select("lang", "source", text).mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray, kept: int, prior: int = PRIOR, digits: int = 9) -> np.ndarray:
    """1 + floor(10^digits * (n + prior) / (total + prior * kept)) in 64 bits."""
    whole, out = total + prior * kept, np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64)
    rest = np.broadcast_to(n + prior, out.shape)
    for _ in range(digits // 3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def tile(sources: list[str], totals: np.ndarray, kept: int, counts: np.ndarray, names: list[bytes], own: range, prior: int = PRIOR, top: int = TOP) -> tuple[np.ndarray, list[tuple[int, bytes, int]]]:
    """The sums of |p - q| of own sources (rows) and all (columns), and (source, term, f) of each own source's top terms, for counts of sources by terms."""
    p, q = shares(counts, totals[:, None], kept, prior), shares(counts.sum(0), totals.sum(), kept, prior)
    pairs, step = np.zeros((len(own), len(sources)), np.int64), max(1, AT_ONCE // max(1, p.size))
    for k in range(0, len(own), step):
        rows = p[own.start + k : own.start + min(k + step, len(own))]
        pairs[k : k + len(rows)] = np.abs(rows[:, None, :] - p[None, :, :]).sum(2)
    best, order = [], np.argsort(np.array(names, object), kind="stable") if names else np.array([], np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    for g in own:
        f = p[g] - q
        found = np.flatnonzero((counts[g] > 0) & (f > 0))
        best += [(g, names[t], int(f[t])) for t in found[np.lexsort((rank[found], -f[found]))[:top]]]
    return pairs, best


def audited(docs: DataFrame, text: str = "text", least: int = LEAST, prior: int = PRIOR, top: int = TOP, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counts = written(counted(docs.select(blank("lang"), blank("source"), text), text))
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    used = written(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))
    groups = counts.select("lang", "source").distinct().join(used.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").na.fill(0, ["n"])
    # Blocks and row tiles of each language: V terms, G sources.
    langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(used.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill(0, ["v"])
    langs = written(langs.select("lang", "v", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("g") / F.greatest(F.lit(cells), F.col("g") * F.col("g")))).cast("bigint").alias("blocks"), F.ceil(F.col("g") / F.lit(rows)).cast("bigint").alias("tiles")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    heads = groups.join(langs, "lang").withColumn("block", every("blocks")).withColumn("tile", every("tiles"))
    body = used.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).withColumn("tile", every("tiles"))
    dealt = heads.select("lang", "block", "tile", "source", F.lit(None).cast("string").alias("term"), "n", "v").unionByName(body.select("lang", "block", "tile", "source", "term", "n", "v"))

    def run(key, table):
        lang, _, nth = (x.as_py() for x in key)
        is_head = table.column("term").is_null()
        head, body = table.filter(is_head), table.filter(pc.invert(is_head))
        of = sorted(zip(raw(head.column("source").combine_chunks()), head.column("n").to_pylist(), strict=True))
        sources, totals, v = [s for s, _ in of], np.array([n for _, n in of], np.int64), head.column("v")[0].as_py()
        number = {s: k for k, s in enumerate(sources)}
        words = raw(body.column("term").combine_chunks()) if body.num_rows else []
        names = list(dict.fromkeys(words))
        place = {t: k for k, t in enumerate(names)}
        found = np.zeros((len(sources), len(names)), np.int64)
        if words:
            found[[number[s] for s in raw(body.column("source").combine_chunks())], [place[t] for t in words]] = body.column("n").to_numpy()
        own = range(nth * rows, min((nth + 1) * rows, len(sources)))
        pairs, best = tile(sources, totals, v, found, names, own, prior, top)
        out = [(sources[g], b"pair", sources[h], int(pairs[g - own.start, h])) for g in own for h in range(len(sources)) if g != h]
        out += [(sources[g], b"term", t, f) for g, t, f in best]
        texts = [pa.array([r[k] for r in out], pa.binary()).cast(pa.string()) for k in range(3)]
        return pa.Table.from_arrays([pa.array([lang] * len(out), pa.string()), *texts, pa.array([r[3] for r in out], pa.int64())], ["lang", "source", "part", "item", "value"])

    partial = dealt.groupBy("lang", "block", "tile").applyInArrow(run, "lang string, source string, part string, item string, value bigint")
    partial = written(partial)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = partial.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by))
    # A term is in one block only; Spark cuts each task's rows to the top ones before it merges them.
    best = partial.filter("part = 'term'").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    out = written(pairs.unionByName(best))
    for x in (counts, used, langs, partial):
        dropped(x)
    return out
