"""Summaries of records: counts by reference, depth, and subsequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, flags

#: Positions of a bin of the depth.
BIN = 1 << 14


def reference_counts(records: DataFrame) -> DataFrame:
    """rname, mapped, unmapped; records without a reference are under "*"."""
    unmapped = flags.has(F.col("flag"), flags.UNMAPPED)
    return records.groupBy("rname").agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))


def region_summary(records: DataFrame, column: str) -> DataFrame:
    """n_reads and n_keys: records, and different values of a column."""
    return records.agg(F.count("*").alias("n_reads"), F.countDistinct(column).alias("n_keys"))


def covered(cigar_column: Column, pos: Column) -> Column:
    """The positions that a record's M, = and X operations cover, as an array of [start, length] arrays."""
    ops = F.arrays_zip(F.regexp_extract_all(cigar_column, F.lit("([0-9]+)[MIDNSHP=XB]"), F.lit(1)).alias("n"), F.regexp_extract_all(cigar_column, F.lit("[0-9]+([MIDNSHP=XB])"), F.lit(1)).alias("op"))

    def step(state, op):
        n = op["n"].cast("bigint")
        moves = op["op"].isin(*cigar.ON_REFERENCE)
        block = F.when(op["op"].isin("M", "=", "X"), F.array(F.array(state["at"], n))).otherwise(F.array().cast("array<array<bigint>>"))
        return F.struct((state["at"] + F.when(moves, n).otherwise(F.lit(0).cast("bigint"))).alias("at"), F.concat(state["found"], block).alias("found"))

    start = F.struct(pos.cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("found"))
    return F.aggregate(ops, start, step)["found"]


def depth(records: DataFrame, most: int | None = None) -> DataFrame:
    """rname, pos (0-based), depth: how many mapped records cover each covered position; at most `most` if given, as a cap on the number reported.

    Each covered run is a +1 and a -1 at its ends; only those are shuffled, and positions are laid out
    after the counts are known, so a deep position is no more work than a shallow one.
    """
    runs = records.filter(~flags.has(F.col("flag"), flags.UNMAPPED)).select("rname", F.explode(covered(F.col("cigar"), F.col("pos"))).alias("r"))
    ends = runs.select("rname", F.explode(F.array(F.struct(F.col("r")[0].alias("pos"), F.lit(1).alias("d")), F.struct((F.col("r")[0] + F.col("r")[1]).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("rname", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).filter("d <> 0")
    # Running sums within bins; what stands before a bin is one row a bin, so no task holds a whole reference.
    steps = steps.withColumn("bin", F.floor(F.col("pos") / BIN))
    by_name, order = Window.partitionBy("rname").orderBy("bin"), Window.partitionBy("rname", "bin").orderBy("pos")
    bins = steps.groupBy("rname", "bin").agg(F.sum("d").alias("total"), F.min("pos").alias("first"))
    bins = bins.select("rname", "bin", (F.sum("total").over(by_name) - F.col("total")).alias("before"), F.lead("first").over(by_name).alias("next"))
    levels = steps.join(bins, ["rname", "bin"]).withColumns({"depth": F.col("before") + F.sum("d").over(order), "stop": F.coalesce(F.lead("pos").over(order), "next")}).filter("depth > 0")
    out = levels.select("rname", F.explode(F.sequence("pos", F.col("stop") - 1)).alias("pos"), "depth")
    return out if most is None else out.withColumn("depth", F.least("depth", F.lit(most)))


def samples_depth(samples: dict[str, DataFrame]) -> DataFrame:
    """rname, pos, and a depth for each sample; 0 where a sample has none."""
    out = None
    for name, records in samples.items():
        own = depth(records).withColumnRenamed("depth", name)
        out = own if out is None else out.join(own, ["rname", "pos"], "full")
    return out.na.fill(0, list(samples))


def subsequence(sequences: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (seqnames, start, end: 1-based, inclusive) with seq, from sequences (name, seq)."""
    return wanted.join(sequences.select(F.col("name").alias("seqnames"), F.col("seq").alias("_whole")), "seqnames", "left").withColumn("seq", F.expr("substring(_whole, cast(start as int), cast(end - start + 1 as int))")).drop("_whole")
