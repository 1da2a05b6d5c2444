"""Files by what they hold, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bam, intervals, sam, sequences, vcf


def kind(spark: SparkSession, path: str) -> str:
    """bam, sam, vcf, fasta, or what else `intervals.sniff` tells."""
    return intervals.sniff(spark, path)


def records(spark: SparkSession, path: str, tags: str = "") -> DataFrame:
    """Alignment records of BAM files or SAM text, in one schema. Other formats are an error that names the one found."""
    found = kind(spark, path)
    if found == "bam":
        return bam.read(spark, path, tags=tags)
    if found == "sam":
        return sam.read(spark, path, tags)
    raise ValueError(f"{path} holds no alignment records that can be read here: {found}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM, SAM or VCF files, or the chunks of FASTA files."""
    found = kind(spark, path)
    if found == "vcf":
        return vcf.read(spark, path)
    if found == "fasta":
        return sequences.chunked(spark, path)
    return records(spark, path)
