"""URL filters: exact membership by a cascade of Bloom filters, and host/path rules.

Level 1 holds the listed keys. Level 2 holds the keys of the universe that level 1 lets through though
they aren't listed, level 3 the listed keys that level 2 lets through, and so on until a level lets
nothing wrong through. A key of the universe is listed exactly if the first level that refuses it is an
even one (or the last level that passes it is odd), so membership of any key in the universe is exact
and takes no join: the filters, whose size follows the list, are what executors get.

Defined results: a null url, or one without "://", has an empty host and path; keys that are null are
never listed; an empty list refuses all. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, written

#: Filters up to this size are sent to executors at once; a larger cascade is cut into segments of the key space.
BROADCAST_BYTES = 64 << 20


def mixed(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key for a level: splitmix64 of the key's hash."""
    with np.errstate(over="ignore"):
        out = []
        for salt in (2 * level + 1, 2 * level + 2):
            x = h + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(x ^ (x >> np.uint64(31)))
        return out[0], out[1] | np.uint64(1)


def spots(h: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
    a, b = mixed(h, level)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(k)])


@dataclass
class Bloom:
    level: int
    bits: int
    k: int
    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        at = spots(h, self.level, self.bits, self.k)
        return ((self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


@dataclass
class Cascade:
    """Levels of filters for one segment of the key space after another; key hashes modulo their number tell the segment."""

    segments: list[list[Bloom]] = field(default_factory=list)

    def listed(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        of = h % np.uint64(max(1, len(self.segments)))
        for s, levels in enumerate(self.segments):
            own = np.flatnonzero(of == s)
            for i, bloom in enumerate(levels):
                own = own[bloom.has(h[own])]
                out[own] = i % 2 == 0
        return out

    @property
    def n_bytes(self) -> int:
        return sum(b.words.nbytes for s in self.segments for b in s)


def filled(keys: DataFrame, n: int, level: int, rate: float) -> Bloom | None:
    """A filter of the n hashes in keys (h), each partition's bits set there and combined by a bitwise or."""
    if not n:
        return None
    bits = max(64, int(n * -np.log(rate) / np.log(2) ** 2) + 7 & ~7)
    k = max(1, round(bits / n * np.log(2)))

    def run(batches):
        words = np.zeros(bits // 8, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = spots(h, level, bits, k).ravel()
            np.bitwise_or.at(words, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(words)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)], pa.int64()), pa.array(words[at[i : i + (1 << 16)]].astype(np.int64), pa.int64())], ["at", "bits"])

    found = keys.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 8, np.uint8)
    words[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return Bloom(level, bits, k, words)


def passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield b.filter(pa.array(sent.value.has(h)))

    return keys.mapInArrow(run, "h long")


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.01, deeper: float = 0.5, most_bytes: int = BROADCAST_BYTES) -> Cascade:
    """The filters for the listed keys (key) among those of the universe (key). Later levels hold few keys, so they get by with a higher rate.

    A list whose first level would be over most_bytes is cut into segments of the key space, and each
    filter then stays under that size.
    """
    listed = written(listed.filter("key is not null").select(key_hash(F.col("key")).alias("h")).distinct())
    universe = written(universe.filter("key is not null").select(key_hash(F.col("key")).alias("h")).distinct())
    n = listed.count()
    parts = max(1, int(np.ceil(n * -np.log(rate) / np.log(2) ** 2 / 8 / most_bytes)))
    out = Cascade()
    for s in range(parts):
        # The JVM's hashes are signed and the filters' are not, so the segment is taken from the unsigned remainder.
        own = (F.conv(F.hex("h"), 16, 10).cast("decimal(20,0)") % F.lit(parts)).cast("int") == s
        inside = listed.filter(own) if parts > 1 else listed
        outside = (universe.filter(own) if parts > 1 else universe).join(listed, "h", "left_anti")
        levels, these, those, level = [], inside, outside, 0
        count = inside.count()
        while count and (bloom := filled(these, count, level, rate if level < 2 else deeper)):
            levels.append(bloom)
            those = written(passing(those, bloom))
            count, level = those.count(), level + 1
            these, those = those, these
        out.segments.append(levels)
    return out


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (text, verdict); null if none does."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """pages (page_id, url) -> page_id, url, host, path, rule, listed, verdict.

    listed (key) holds blocked hosts, which cover their subdomains. The universe is every host of the
    pages with all the domains above it, so that the cascade is exact for whatever is looked up here.
    """
    rows = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    above = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    universe = rows.select("host").distinct().select(F.explode(above).alias("key")).distinct()
    sent = pages.sparkSession.sparkContext.broadcast(cascade(listed, universe))
    rows = rows.withColumn("hashes", F.transform(above, lambda k: key_hash(k)))
    at = rows.columns.index("hashes")

    def make():
        def columns(batch):
            hashes = batch.column(at)
            flat = sent.value.listed(hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            of = np.repeat(np.arange(len(hashes)), hashes.value_lengths().to_numpy(zero_copy_only=False))
            return [pa.array(np.bincount(of, weights=flat, minlength=len(hashes)) > 0)]

        return columns

    rows = appended(rows, make, [T.StructField("listed", T.BooleanType())], ["page_id", "url", "host", "path"])
    rows = rows.withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "url", "host", "path", F.col("r.text").alias("rule"), "listed", F.coalesce("r.verdict", method).alias("verdict"))
