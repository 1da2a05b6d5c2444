"""FASTA files as a table of bounded chunks (name, chunk, seq), and ranges of sequences put together from few of them.

Files are read in ranges of bytes, first for what each of them holds: one row a range tells what stands before the
next. Then a range's lines are given in pieces with their places in their sequences. However long
a line or a sequence is, no row holds more than a piece or a chunk of it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: Bases of a chunk, bytes of a file's range, of a piece, and of the longest header line.
CHUNK, SPLIT, PIECE, HEADER = 1 << 16, 32 << 20, 1 << 16, 1 << 16
BLANK = bytes(range(33)) + b"\x7f"


def lines(path: str, start: int, stop: int) -> Iterator[tuple[bool, bytes]]:
    """(whether it is a header line, piece) of a range of bytes. A header line belongs to the range that its ">" is in; other bytes to the range that they are in."""
    with store.opened(path, max(store.SEEK, min(store.SCAN, HEADER + stop - start))) as f:
        back = max(0, start - HEADER)
        f.seek(back)
        before = f.read(start - back)
        line = before[before.rfind(b"\n") + 1 :]
        at, header, fresh, held = start, line[:1] == b">" and (b"\n" in before or back == 0), not line, b""
        skip = header
        while at < stop or header and not skip:
            data = f.read(PIECE if at >= stop else min(PIECE, stop - at))
            if not data:
                break
            at += len(data)
            while data:
                if fresh and data[:1] == b">":
                    header, skip, held = at - len(data) < stop, False, b""
                    if not header:
                        return
                end = data.find(b"\n")
                part, data = (data, b"") if end < 0 else (data[:end], data[end + 1 :])
                if header:
                    held += b"" if skip else part
                elif part:
                    yield False, part
                fresh = end >= 0
                if fresh and header:
                    if not skip:
                        yield True, held
                    header, held, skip = False, b"", False
                    if at - len(data) >= stop:
                        return
        if header and not skip:
            yield True, held


def pieces(path: str, start: int, stop: int) -> Iterator[tuple[str | None, int, str, int]]:
    """(name, place, bases, number) of a range; the name is null for what belongs to a sequence that an earlier range names, and places then count from the range's start. A header gives a row without bases."""
    name, at, number = None, 0, 0
    for is_header, data in lines(path, start, stop):
        if is_header:
            name, at = (data[1:].split(None, 1) or [b""])[0].decode("utf-8", "replace") if data[1:2] not in (b" ", b"\t") else "", 0
            yield name, 0, "", (number := number + 1)
            continue
        bases = data.translate(None, BLANK)
        if bases:
            yield name, at, bases.decode("ascii", "replace"), number
            at += len(bases)


def chunked(spark: SparkSession, path: str, chunk: int = CHUNK, split_bytes: int = SPLIT) -> DataFrame:
    """name, chunk (from 0), seq of FASTA files. Of sequences of one name, the first in the first file counts; one without bases has no chunk.

    A task reads several ranges where they are small, so that tasks grow with the files' bytes and not with the number of ranges.
    """
    files = [(p, store.size(p)) for x in path.split(",") for p in (store.listed(x, ".fa") or store.listed(x, ".fasta"))]
    files = [(p, n) for p, n in files if n]
    if not files:
        raise FileNotFoundError(f"no FASTA file: {path}")
    tasks = min(sum(-(-n // split_bytes) for _, n in files), max(4 * spark.sparkContext.defaultParallelism, -(-sum(n for _, n in files) // SPLIT)))

    def over(give, *kinds):
        """A function over batches of ranges that puts the rows that give makes of each range into batches of bounded size."""

        def run(batches):
            import pyarrow as pa

            names = [n for n, _ in kinds]
            types = [pa.string() if k == "string" else pa.int64() for _, k in kinds]
            batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            held, size = [], 0
            for b in batches:
                for part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for row in give(*part):
                        held.append(row)
                        size += sum(len(x) for x in row if isinstance(x, str))
                        if size > 4 << 20 or len(held) > 20_000:
                            yield batch(held)
                            held, size = [], 0
            if held:
                yield batch(held)

        return run, ", ".join(f"{n} {k}" for n, k in kinds)

    def ended(file, start, stop):
        last, tail, headers = None, 0, 0
        for own, at, bases, number in pieces(file, start, stop):
            last, tail, headers = own, at + len(bases), number
        yield file, start, stop, last, headers, tail

    def headed(file, start, stop, before_name, before, headers_before):
        number = 0
        for name, _, _, nth in pieces(file, start, stop):
            if nth > number:
                number = nth
                yield file, headers_before + nth, name

    def laid(file, start, stop, before_name, before, headers_before):
        for own, at, bases, number in pieces(file, start, stop):
            name = before_name if own is None else own
            if bases and name is not None:
                yield file, headers_before + number, name, at + (before if own is None else 0), bases

    ranges = spark.createDataFrame(files, "file string, n bigint").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"), "n")
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, "n").alias("stop")).repartition(tasks)
    # One row a range: its last sequence, its headers, and the bases behind the last one, or all.
    ends = ranges.mapInArrow(*over(ended, ("file", "string"), ("start", "bigint"), ("stop", "bigint"), ("last", "string"), ("headers", "bigint"), ("tail", "bigint")))
    by = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    ends = ends.withColumns({"run": F.coalesce(F.sum("tail").over(by), zero), "headers_before": F.coalesce(F.sum("headers").over(by), zero)})
    # What stands before a range is what the ranges since the last header add up to.
    since = F.last(F.when(F.col("headers") > 0, F.col("run")), ignorenulls=True).over(by)
    known = ends.select("file", "start", "stop", F.last("last", ignorenulls=True).over(by).alias("before_name"), (F.col("run") - F.coalesce(since, zero)).alias("before"), "headers_before").repartition(tasks)
    firsts = known.mapInArrow(*over(headed, ("file", "string"), ("nth", "bigint"), ("name", "string")))
    placed = known.mapInArrow(*over(laid, ("file", "string"), ("nth", "bigint"), ("name", "string"), ("at", "bigint"), ("bases", "string")))
    firsts = firsts.groupBy("name").agg(F.min(F.struct("file", "nth")).alias("first")).select("first.*")
    placed = placed.join(firsts, ["file", "nth"], "left_semi")
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.length("bases") - 1) / chunk)
    cut = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("chunk") * chunk, F.col("at"))
    part = F.substr("bases", (low - F.col("at") + 1).cast("int"), F.least((F.col("chunk") + 1) * chunk - low, F.lit(chunk)).cast("int"))
    return cut.select("name", "chunk", low.alias("low"), part.alias("part")).groupBy("name", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "part"))), lambda x: x["part"]), "").alias("seq"))


def build(spark: SparkSession, fasta_path: str, path: str, **options) -> None:
    """Writes the chunks, sorted by name and number."""
    chunked(spark, fasta_path, **options).repartitionByRange("name", "chunk").sortWithinPartitions("name", "chunk").write.mode("overwrite").parquet(path)


def fetched(chunks: DataFrame, wanted: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """wanted (seqnames, start, end: 1-based, inclusive) with seq: '' where the range has no bases, null where no sequence has the name.

    Ends are cut to the sequence. Only the chunks that ranges touch are joined; repeated ranges are put together once.
    """
    sizes = chunks.groupBy("name").agg(F.max(F.struct("chunk", F.length("seq").alias("n"))).alias("m")).select(F.col("name").alias("seqnames"), (F.col("m.chunk") * chunk + F.col("m.n")).alias("_size"))
    asked = wanted.select("seqnames", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).distinct()
    asked = asked.join(sizes, "seqnames", "left").withColumns({"_low": F.greatest(F.col("start") - 1, F.lit(0)), "_high": F.least("end", "_size")})
    some = asked.filter("_low < _high").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_low") / chunk), F.floor((F.col("_high") - 1) / chunk))))
    at = F.col("chunk") * chunk
    own = F.substr("seq", (F.greatest(F.col("_low") - at, F.lit(0)) + 1).cast("int"), (F.least(F.col("_high") - at, F.lit(chunk)) - F.greatest(F.col("_low") - at, F.lit(0))).cast("int"))
    found = some.join(chunks.withColumnRenamed("name", "seqnames"), ["seqnames", "chunk"]).groupBy("seqnames", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", own.alias("part")))), lambda x: x["part"]), "").alias("seq"))
    made = asked.join(found, ["seqnames", "start", "end"], "left").select("seqnames", "start", "end", F.when(F.col("_size").isNotNull(), F.coalesce("seq", F.lit(""))).alias("seq"))
    keys = made.select(F.col("seqnames").alias("_n"), F.col("start").alias("_s"), F.col("end").alias("_e"), "seq")
    return wanted.join(keys, F.col("seqnames").eqNullSafe(F.col("_n")) & F.col("start").eqNullSafe(F.col("_s")) & F.col("end").eqNullSafe(F.col("_e")), "left").drop("_n", "_s", "_e")
