"""Regions: text form, names of references, and the overlap rule."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regions for everything, and for reads without a place.
ALL, UNPLACED = ".", "*"
END = 2**31 - 1


def parse(text: str) -> tuple[str, int, int]:
    """name, start, end of "name", "name:start", "name:start-" or "name:start-end": 1-based, inclusive, commas allowed in numbers."""
    m = re.fullmatch(r"(.*):([0-9,]+)(?:-([0-9,]*))?", text, re.S)
    if not m:
        return text, 1, END
    number = lambda s: int(s.replace(",", ""))
    start, end = number(m[2]), number(m[3]) if m[3] else END
    if start > end:
        raise ValueError(f"region ends before it starts: {text}")
    return m[1], max(1, start), end


def parsed(text: Column) -> list[Column]:
    """Columns seqnames, start, end of region texts."""
    whole = r"^(?s)(.*):([0-9,]+)(-([0-9,]*))?$"
    number = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(text, whole, k), ",", ""), F.lit("")).cast("bigint")
    name = F.when(text.rlike(whole), F.regexp_extract(text, whole, 1)).otherwise(text)
    return [name.alias("seqnames"), F.greatest(F.coalesce(number(2), F.lit(1)), F.lit(1)).cast("bigint").alias("start"), F.coalesce(number(4), F.lit(END)).cast("bigint").alias("end")]


def table(spark: SparkSession, regions: list[str] | DataFrame) -> DataFrame:
    """Regions as a DataFrame with seqnames, start, end."""
    if isinstance(regions, DataFrame):
        if missing := {"seqnames", "start", "end"} - set(regions.columns):
            raise TypeError(f"regions need columns {sorted(missing)}")
        return regions
    if isinstance(regions, str) or not all(isinstance(r, str) for r in regions):
        raise TypeError("regions are a DataFrame or a list of texts")
    return spark.createDataFrame([parse(r) for r in regions], "seqnames string, start bigint, end bigint")


def plain(name: Column) -> Column:
    """A reference's name without "chr" in front."""
    return F.regexp_replace(name, "^chr", "")


def restyled(regions: DataFrame, references: DataFrame) -> DataFrame:
    """Regions whose names the references (name) lack get the other style, with or without "chr", if that is known. The records' side stays as it is, so filters on it still reach the scan."""
    names = references.select(F.col("name").alias("_known")).distinct()
    other = F.when(F.col("seqnames").startswith("chr"), plain(F.col("seqnames"))).otherwise(F.concat(F.lit("chr"), "seqnames"))
    marked = regions.join(names, F.col("seqnames") == F.col("_known"), "left")
    return marked.withColumn("seqnames", F.when(F.col("_known").isNull(), other).otherwise(F.col("seqnames"))).drop("_known")


def overlap(start: Column, end: Column, region_start: Column, region_end: Column) -> Column:
    """Whether [start, end), 0-based, meets the region, 1-based and inclusive."""
    return (end > region_start - 1) & (region_end > start)
