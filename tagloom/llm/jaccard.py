"""N-gram Jaccard join: exact similarity join of whole texts on word shingles, and the groups that its links form.

A document's set holds the 64-bit hashes of its distinct shingles. Documents of the same set (by a 128-bit
digest) form a class and are compared through one of them. The shingles of a set are ordered rare first:
by document frequency, then by hash. Frequencies are counted over all classes, in ranges of the hash
space; tasks get them as a bitmap of what several classes share and a bounded table of frequent ones. Two sets that are similar enough
share at least l shingles among the first |x| - ceil(t |x|) + l of each, so classes are joined on those.
Shingles that no other class has come first of all, so most sets without a near-duplicate have none to join on.
A pair's shared prefix shingles are counted, and the length filter, the positional filter (shared so far
plus what both have left) and the count itself drop most pairs; a suffix filter that compares the sets'
counts in hash ranges drops more before sets are intersected, once a pair.

Only components are wanted, so pairs inside one aren't needed. First only the few least shingles of each
class's prefix are joined, and the classes of one compared with a few of them, mostly with those that have the fewest shingles of their own: that finds nearly
all links in groups of copies. Shingles whose classes are all in one component then go, as do a class's that
no set of a size it could link with has, and pairs between different components are joined in full. Every link between different components is thus found.

Defined results: a null text, or one without words, has an empty set, is its own component and links with
nothing; fewer words than a shingle form one shingle; repeated rows of a doc_id are one class if their
texts have the same set. A null doc_id is never the smallest of a component unless all of it is null. An
empty table gives an empty result.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, raw, trimming, words, written
from .graph import components
from .urls import filled, key_hash

WORDS, PERCENT = 5, 75
#: Shingles told apart by frequency, at most; those of a lower count than the next only matter as "several".
MOST_FREQUENT, COUNTED = 1 << 19, 4
#: Bits that tell which shingles several classes may share: 16 MB.
BITMAP = 27
#: Bytes of it in a value.
PART = 1 << 20
#: A task counts shingles in lots of so many, and a range of the hash space holds so many; words it remembers; the most that a filter of class ids is sized for.
LOT, RANGE, REMEMBERED, MOST_FILTERED = 1 << 21, 1 << 21, 200_000, 1 << 25
#: Longs of a set's parities.
PARITIES = 16
#: An l-prefix asks for one shared shingle more for each so many shingles.
STRIDE = 32
#: Shingles of a class in the first round, and the classes of one that are compared with all of them.
SKETCH, PIVOTS = 8, 3


class Shingler(dict):
    """word -> 64-bit hash, and sets of shingles."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def of(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        tokens = words(text)
        h = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        if not len(h):
            return h
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            x = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
                x ^= x >> np.uint64(29)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return np.unique(x ^ (x >> np.uint64(31)))


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    whole = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def packed(slots: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and how often each occurs, as compressed byte planes of the differences and of the counts."""
    both = np.concatenate([np.diff(slots, prepend=np.uint64(0)), times.astype(np.uint64)])
    return zlib.compress(np.ascontiguousarray(both.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    slots, times = np.split(np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<u8").ravel(), 2)
    return np.cumsum(slots), times.astype(np.int64)


def summarised(docs: DataFrame, n: int, bits: int, ranges: int) -> DataFrame:
    """A row (doc_id, n, c1, c2) for each document, and rows (range, slots): each lot's shingle hashes cut to so many bits, and how many of its classes have each."""
    names, shift = ["doc_id", "n", "c1", "c2", "range", "slots"], np.uint64(64 - bits)

    def run(batches):
        shingler, seen, lots, size = Shingler(n), set(), [], 0

        def counted():
            slots, times = np.unique(np.concatenate(lots) >> shift, return_counts=True)
            ends = np.searchsorted(slots, np.arange(1, ranges, dtype=np.uint64) << np.uint64(bits - ranges.bit_length() + 1))
            for k, (part, n_part) in enumerate(zip(np.split(slots, ends), np.split(times, ends), strict=True)):
                if len(part):
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([k], pa.int64()), pa.array([packed(part, n_part)], pa.binary())], names)

        for b in batches:
            sizes, ones, twos = [], [], []
            for t in raw(b.column("text")):
                found = shingler.of(t)
                c = digest(found)
                sizes.append(len(found))
                ones.append(c[0])
                twos.append(c[1])
                if c not in seen:
                    seen.add(c)
                    lots.append(found)
                    size += len(found)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, ones, twos)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)
            if size > LOT:
                yield from counted()
                lots, size, seen = [], 0, set()
        if lots:
            yield from counted()

    return docs.select("doc_id", "text").mapInArrow(trimming(run), "doc_id long, n long, c1 long, c2 long, range long, slots binary")


def marked(marks: np.ndarray) -> list[bytes]:
    """Marks as bits, compressed in parts of PART bytes: on their way the driver's JVM holds several copies of a value."""
    bits = np.packbits(marks)
    return [zlib.compress(bits[i : i + PART].tobytes(), 1) for i in range(0, len(bits), PART)]


class Frequencies:
    """What tasks need to know of document frequencies: which shingles several classes may share, and the counts of frequent ones."""

    def __init__(self, lots: DataFrame, bits: int, ranges: int):
        segment = 1 << max(3, BITMAP - ranges.bit_length() + 1)

        def count(group: pa.Table) -> pa.Table:
            blobs = [unpacked(b) for b in group["slots"].to_pylist()]
            slots, back = np.unique(np.concatenate([x for x, _ in blobs]), return_inverse=True)
            times = np.bincount(back, np.concatenate([n for _, n in blobs]), len(slots)).astype(np.int64)
            some = slots[times > 1]
            marks = np.zeros(segment, np.uint8)
            marks[(some >> np.uint64(bits - BITMAP)).astype(np.int64) % segment] = 1
            often = times >= COUNTED
            k = int(often.sum())
            parts = marked(marks)
            m, rest = len(parts), [None] * len(parts)
            return pa.table({"range": pa.array([group["range"][0].as_py()] * (m + k), pa.int64()), "part": pa.array([*range(m), *[None] * k], pa.int64()), "slot": pa.array([*rest, *slots[often].tolist()], pa.int64()), "n": pa.array([*rest, *times[often].tolist()], pa.int64()), "bits": pa.array(parts + [None] * k, pa.binary())})

        made = written(lots.groupBy("range").applyInArrow(count, "range long, part long, slot long, n long, bits binary"))
        # The frequent ones are those above a count that at most MOST_FREQUENT shingles reach.
        known = made.filter("slot is not null").select("slot", "n", F.floor(F.log2("n") * 2).cast("int").alias("level"))
        total, least = 0, 99
        for level, n in sorted(((r["level"], r["count"]) for r in known.groupBy("level").count().collect()), reverse=True):
            if total + n > MOST_FREQUENT:
                break
            total, least = total + n, level
        found = known.filter(F.col("level") >= least).select("slot", F.col("level").cast("byte").alias("level")).toArrow().sort_by("slot")
        self.bits, self.slots, self.levels = bits, found["slot"].to_numpy().astype(np.uint64), found["level"].to_numpy().astype(np.int8)
        self.marks = np.zeros(max(ranges * segment, 1 << BITMAP) // 8, np.uint8)
        for row in made.filter("bits is not null").select("range", "part", "bits").toLocalIterator():
            bits = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
            at = row["range"] * segment // 8 + row["part"] * PART
            self.marks[at : at + len(bits)] = bits
        dropped(made)

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted shingle hashes: whether several classes may share each, and its level of frequency, 0 only for those that none shares."""
        at = (found >> np.uint64(64 - BITMAP)).astype(np.int64)
        shared = self.marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0
        level = shared.astype(np.int8)
        some = np.flatnonzero(shared)
        if len(some) and len(self.slots):
            slots = found[some] >> np.uint64(64 - self.bits)
            at = np.searchsorted(self.slots, slots)
            at[at == len(self.slots)] = 0
            level[some] = np.where(self.slots[at] == slots, self.levels[at], 1)
        return shared, level


def prefixes(docs: DataFrame, n: int, percent: int, frequencies: Frequencies) -> DataFrame:
    """h, c1, c2, n, pos: the l-prefix of each set in rare-first order, without shingles that no other class has."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies)
    names = ["h", "c1", "c2", "n", "pos"]

    def run(batches):
        shingler, seen = Shingler(n), set()
        for b in batches:
            out = []
            for t in raw(b.column("text")):
                found = shingler.of(t)
                if not len(found):
                    continue
                c = digest(found)
                if c in seen:
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(c)
                m = len(found)
                shared, level = sent.value.of(found)
                order = np.argsort(level, kind="stable")[: m - (-(-percent * m // 100)) + prefix_share(m)]
                pos = np.flatnonzero(shared[order])
                out.append((found[order[pos]], pos, c, m))
            size = np.array([len(f) for f, *_ in out], np.int64)
            if size.sum():
                each = lambda x: pa.array(np.repeat(np.array(x, np.int64), size))
                yield from pa.Table.from_arrays([signed(np.concatenate([f for f, *_ in out])), each([c[0] for *_, c, _ in out]), each([c[1] for *_, c, _ in out]), each([m for *_, m in out]).cast(pa.int32()), pa.array(np.concatenate([p for _, p, *_ in out]).astype(np.int32))], names).to_batches(1 << 16)

    return docs.select("text").mapInArrow(trimming(run), "h long, c1 long, c2 long, n int, pos int")


def prefix_share(n):
    """How many shared prefix shingles an l-prefix of a set of n asks for."""
    return 1 + n // STRIDE


def parities(found: np.ndarray) -> np.ndarray:
    """Whether the hashes of a set that fall on each of 64 PARITIES places are odd in number, as longs: two sets differ in at least as many hashes as in places."""
    return np.packbits(np.bincount((found >> np.uint64(7)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1).view(np.int64)


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id, grams and the parities s0, s1...: the sets of the documents in ids (id), and of a few others that a filter of bounded size lets through; joins drop those."""
    keys = ids.select(key_hash(F.col("id")).alias("h"))
    names = ["doc_id", "grams", *(f"s{i}" for i in range(PARITIES))]
    bloom = docs.sparkSession.sparkContext.broadcast(filled(keys, min(MOST_FILTERED, ids.count()), 0, 0.01))

    def run(batches):
        shingler = Shingler(n)
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            b = b.filter(pa.array(bloom.value.has(h) if bloom.value else np.zeros(len(h), bool)))
            found = [shingler.of(t) for t in raw(b.column("text"))]
            odd = np.concatenate([np.zeros(0, np.int64), *map(parities, found)]).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([f.tobytes() for f in found], pa.binary()), *(pa.array(odd[:, i]) for i in range(PARITIES))], names)

    return docs.select("doc_id", "text", key_hash(F.col("doc_id")).alias("h")).mapInArrow(trimming(run), "doc_id long, grams binary, " + ", ".join(f"s{i} long" for i in range(PARITIES)))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x ∩ y| >= percent |x ∪ y|, for sorted sets of hashes."""
    total = len(x) + len(y)
    needed = -(-percent * total // (100 + percent))
    # Suffix filter: what the counts in 32 hash ranges differ by is missing from the intersection.
    bounds = np.arange(1, 32, dtype=np.uint64) << np.uint64(59)
    a, b = (np.diff(np.searchsorted(s, bounds), prepend=0, append=len(s)) for s in (x, y))
    if np.minimum(a, b).sum() < needed:
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= needed


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, as edges (u, v)."""
    one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")).hint("merge"), "b")
    both = one.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")).hint("merge"), "a").select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(trimming(run), "u long, v long")


def promising(index: DataFrame, percent: int) -> DataFrame:
    """The rows (h, id, n, root, k, pos) of an index whose shingle h may belong to a link between two components.

    No set shares more than k shingles before h and what is left from h on, which bounds the other set's size. So h must be
    in another component, and in a set of such a size; a bit for each of 16 steps an octave tells the sizes h has.
    """
    step = lambda n: F.floor(F.log2(n) * 16).cast("int")
    sizes = F.expr("bit_or(shiftleft(1L, cast(floor(log2(n) * 16) as int) % 64))")
    held = index.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("greatest"), sizes.alias("sizes")).filter("least < greatest").select("h", "sizes")
    fewest = F.expr(f"(n * {percent} + 99) div 100")
    most = F.expr(f"(k + n - pos) * {100 + percent} div {percent} - n")
    ones = F.expr("shiftleft(1L, _width) - 1L")
    fits = F.expr("(shiftleft(_ones, _low) | shiftrightunsigned(_ones, 64 - _low)) & sizes") != 0
    rows = index.withColumns({"_least": fewest, "_most": most}).filter("_least <= _most")
    rows = rows.withColumns({"_low": step(F.col("_least")) % 64, "_width": step(F.col("_most")) - step(F.col("_least")) + 1}).withColumn("_ones", ones)
    return rows.join(held.hint("merge"), "h").filter(fits).select(*index.columns)


def passed(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of joined prefix rows (a, b, and n, pos, k, s0... of both) that length, count, positional and parity filter let through.

    k counts the shingles before the joined one that may be shared at all; any common shingle bounds what its sets share.
    The filters of single rows become conditions of the join, which so gives few rows that aren't links.
    """
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    fewest = F.expr(f"least(n_a, n_b) div {STRIDE} + 1")
    differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(PARITIES)), F.lit(0))
    rows = rows.filter((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.least("k_a", "k_b") + 1 + left >= needed))
    # The first common shingles, as many as are asked for, stand before so many places: a set has no more of its own than the rest.
    rows = rows.filter((F.col("pos_a") < F.col("n_a") - needed + fewest) & (F.col("pos_b") < F.col("n_b") - needed + fewest) & (differ <= F.col("n_a") + F.col("n_b") - 2 * needed))
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.max(c).alias(c) for c in ("pos_a", "pos_b")), *(F.first(c).alias(c) for c in ("n_a", "n_b")))
    return pairs.filter((F.col("shared") >= fewest) & (F.col("shared") + left >= needed)).select("a", "b")


def near_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, (size // 6 // RANGE).bit_length())
    bits = min(62, max(32, size.bit_length() + 2))
    rows = written(summarised(docs, n, bits, ranges))
    each = rows.filter("slots is null").select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2")
    classes = written(each.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("id")).filter("id is not null"))
    frequencies = Frequencies(rows.filter("slots is not null").select("range", "slots"), bits, ranges)

    # Copies of a class from different tasks fall together, and shingles of one class go.
    found = written(prefixes(docs, n, percent, frequencies).distinct())
    shared = found.join(found.groupBy("h").count().filter("count > 1").select("h"), "h", "left_semi")
    whole = written(shared.join(classes, ["c1", "c2"]).select("h", "id", "n", "pos"))
    dropped(found)
    # What a class shares with all others together bounds what it shares with one, whose size is at least percent of its own.
    least = F.expr(f"(n * {percent} div 100) div {STRIDE} + 1")
    possible = (F.col("k") >= least) & (F.col("k") + F.col("n") - F.col("last") - 1 >= F.ceil(F.col("n") * percent / 100))
    # A row a class: what is joined with components in each round.
    each_class = whole.groupBy("id").agg(F.count("*").alias("k"), F.max("pos").alias("last"), F.first("n").alias("n"), F.collect_list(F.struct("pos", "h")).alias("items"))
    packed_ = written(each_class.filter(possible).select("id", "n", "items"))
    ids = packed_.select("id")
    dropped(whole)
    sets = written(sets_of(docs, ids, n))
    # Classes with few shingles of their own are nearest to what a group of copies was made from, so most of the group links with them.
    sketch = packed_.select("id", "n", (F.array_min("items.pos") / F.col("n")).alias("own"), F.explode(F.slice(F.sort_array("items.h"), 1, SKETCH)).alias("h"))
    tied = lambda i: F.xxhash64("id", F.lit(i))
    pivots = F.array_distinct(F.array(*(F.min_by(F.struct("id", "n"), F.struct("own", tied(i))) for i in range(PIVOTS - 1)), F.min_by(F.struct("id", "n"), tied(PIVOTS))))
    few = sketch.groupBy("h").agg(pivots.alias("p")).select("h", F.explode("p").alias("p"))
    mates = sketch.join(few.hint("merge"), "h").filter((F.col("p.id") != F.col("id")) & (F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * percent))
    first = written(mates.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct())
    roots = components(verified(first, sets, percent))
    index = packed_.join(roots.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"), F.posexplode(F.sort_array("items")).alias("k", "i")).select("id", "n", "root", "k", "i.h", "i.pos")
    index = promising(promising(written(index), percent), percent)
    index = written(index.join(sets.drop("grams").withColumnRenamed("doc_id", "id").hint("merge"), "id"))
    left, right = (index.select("h", *(F.col(c).alias(f"{c}_{s}") for c in index.columns if c != "h")) for s in "ab")
    rows = left.join(right.hint("merge"), "h").filter("id_a < id_b and root_a <> root_b").withColumnsRenamed({"id_a": "a", "id_b": "b"})
    second = written(passed(rows, percent).join(first, ["a", "b"], "left_anti"))
    edges = verified(second, sets, percent).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("id", F.coalesce("root", "id")).select("c1", "c2", "id")
    out = each.join(named, ["c1", "c2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out
