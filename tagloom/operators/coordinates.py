"""A coordinate index: a table of the chunks in which a file's records of each bin stand.

A chunk is a run of neighbouring records that have the same bin of the five-level scheme, with the smallest
start and the largest end in it. Regions meet chunks by (reference, bin) and those bounds, which leave out
what a linear index would; then only the chunks that are left are read from the files. Files needn't be
sorted, but in sorted ones chunks are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bam
from . import index, overlap

NAME = "coordinates"
#: Fixed values of the scheme: the size of a level's bins as a power of two, and the number of its first bin.
LEVELS = ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))


def exists(spark: SparkSession, index_path: str) -> bool:
    return index.exists(spark, index_path, NAME)


def build(spark: SparkSession, bam_path: str, index_path: str, **options) -> None:
    """Writes the chunks of BAM files, sorted by reference and bin. Building again replaces them."""
    bam.register(spark)
    found = spark.read.format("bam").options(view="chunks", **options).load(bam_path)
    found.repartitionByRange("rname", "bin", "file", "start").sortWithinPartitions("rname", "bin", "low").write.mode("overwrite").parquet(f"{index_path}/{NAME}")


def opened(spark: SparkSession, index_path: str) -> DataFrame:
    if not exists(spark, index_path):
        raise ValueError(f"there is no index of coordinates in {index_path}")
    return spark.read.schema(bam.CHUNKS).parquet(f"{index_path}/{NAME}")


def bins(start: Column, end: Column) -> Column:
    """The bins that records in [start, end), 0-based, can have."""
    return F.flatten(F.array(*(F.sequence(F.lit(first) + F.shiftright(start, shift), F.lit(first) + F.shiftright(end - 1, shift)) for shift, first in LEVELS)))


def places(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, start, stop of the chunks that can hold records in regions (seqnames, start, end: 1-based, inclusive), each once."""
    reach = chunks.groupBy("rname").agg(F.max("high").alias("reach"))
    asked = overlap.proper(wanted).select(F.col("seqnames").alias("rname"), (F.col("start").cast("bigint") - 1).alias("from"), F.col("end").cast("bigint").alias("to")).distinct()
    # Regions that are open at their end reach as far as the records of their reference do.
    asked = asked.join(reach, "rname").withColumn("to", F.least("to", "reach")).withColumn("from", F.greatest("from", F.lit(0))).filter(F.col("from") < F.col("to"))
    asked = asked.select("rname", "from", "to", F.explode(bins(F.col("from"), F.col("to"))).alias("bin"))
    return chunks.join(asked, ["rname", "bin"]).filter((F.col("low") < F.col("to")) & (F.col("high") > F.col("from"))).select("file", "start", "stop").distinct()


def reads(spark: SparkSession, index_path: str, wanted: DataFrame, include_duplicates: bool = True, tally=None, **options) -> DataFrame:
    """Mapped records that overlap any of the regions, each once, read from the chunks that can hold them."""
    found = bam.fetched(spark, places(opened(spark, index_path), wanted), tally=tally, **options)
    return overlap.joined(overlap.kept(found, include_duplicates), wanted, "left_semi")
