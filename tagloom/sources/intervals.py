"""Text files of intervals, sequences and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For each format the fields (from 1) of name, start and end, and whether starts count from 0.
FORMATS = {"gff": (1, 4, 5, False), "bed": (1, 2, 3, True), "psl": (15, 17, 18, True), "sam": (3, 4, 4, False), "vcf": (1, 2, 2, False), "tab": (1, 2, 3, False)}


def read(spark: SparkSession, path: str, kind: str = "bed", comment: str = "#") -> DataFrame:
    """seqnames, start, end (1-based, inclusive) and line of each row that isn't a comment; bad numbers are an error."""
    name, start, end, zero = FORMATS[kind]
    lines = spark.read.text(path).filter((F.col("value") != "") & ~F.col("value").startswith(comment) & ~F.col("value").rlike("^(track|browser)( |\t|$)") & ~F.col("value").rlike("^@[A-Z][A-Z]\t" if kind == "sam" else r"^\z"))
    c = F.split("value", "\t" if kind != "tab" else r"\s+")
    return lines.select(c[name - 1].alias("seqnames"), (c[start - 1].cast("bigint") + int(zero)).alias("start"), c[end - 1].cast("bigint").alias("end"), F.col("value").alias("line"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq: a row for each sequence; each is read whole."""
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    return records.filter(text != "").select(F.regexp_extract(text, r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*(\n|$)", ""), r"\s", "").alias("seq"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """name: the rows of a list."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")


def sniff(spark: SparkSession, path: str) -> str:
    """bam, cram, bcf, sam, vcf, fasta, gzip or text, by the first bytes of a file, or of the first one in a folder."""
    import zlib

    from . import store

    with store.opened(store.listed(path, "")[0], store.SEEK) as f:
        data = f.read(1 << 16)
    packed = data[:2] == b"\x1f\x8b"
    if packed:
        data = zlib.decompressobj(31).decompress(data, 4096)
    for kind, start in (("bam", b"BAM\1"), ("cram", b"CRAM"), ("bcf", b"BCF"), ("vcf", b"##fileformat=VCF"), ("fasta", b">")):
        if data.startswith(start):
            return kind
    if data[:1] == b"@" and data[1:3].isalpha() and data[3:4] == b"\t":
        return "sam"
    return "gzip" if packed else "text"
