"""Variant text files (VCF): columns whose types the header declares, and back.

chrom, pos (1-based), id, ref, alt, qual, filter, info, other, format and samples. info is a struct with a
field for each INFO line of the header, and samples an array, in the header's order, of structs with one for
each FORMAT line. Number=1 makes a value, Flag a boolean, every other Number an array; "." is null, in arrays
too. other is a map of the INFO entries that the header doesn't declare. All is parsed by column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The types of header lines, and the columns in front of the samples.
TYPES = {"Integer": "int", "Float": "double", "String": "string", "Character": "string", "Flag": "boolean"}
FIXED = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


@dataclass
class Header:
    """The header lines; INFO and FORMAT: id -> (Number, Type); the samples' names, and the contigs with their lengths."""

    text: str
    info: dict[str, tuple[str, str]] = field(default_factory=dict)
    format: dict[str, tuple[str, str]] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    contigs: dict[str, int | None] = field(default_factory=dict)


def parsed_header(text: str) -> Header:
    out = Header(text)
    for line in text.splitlines():
        if m := re.match(r"##(INFO|FORMAT|contig)=<(.*)>\s*$", line):
            about = {k: a or b for k, a, b in re.findall(r'(\w+)=(?:"((?:[^"\\]|\\.)*)"|([^,]*))', m[2])}
            if m[1] == "contig":
                out.contigs.setdefault(about.get("ID", ""), int(about["length"]) if about.get("length", "").isdigit() else None)
                continue
            if about.get("Type") not in TYPES:
                raise ValueError(f"a header line without a known type: {line}")
            (out.info if m[1] == "INFO" else out.format).setdefault(about["ID"], (about.get("Number", "."), about["Type"]))
        elif line.startswith("#CHROM"):
            out.samples = line.split("\t")[len(FIXED) :]
    if not text.startswith("##fileformat=VCF"):
        raise ValueError("not a VCF header")
    return out


def header(spark: SparkSession, path: str) -> Header:
    """The header of files; lines that several have count once."""
    lines = spark.read.text(path).filter(F.col("value").startswith("#"))
    found = list(dict.fromkeys(r["value"].rstrip("\r") for r in lines.collect()))  # as many as headers have
    found.sort(key=lambda x: (not x.startswith("##fileformat"), x.startswith("#CHROM")))
    return parsed_header("\n".join(found))


def known(text: Column) -> Column:
    return F.nullif(text, F.lit("."))


def typed(text: Column, number: str, kind: str) -> Column:
    """A value's text as its declared type."""
    if number == "1":
        return known(text).cast(TYPES[kind])
    return F.when(known(text).isNotNull(), F.transform(F.split(text, ","), lambda x: known(x).cast(TYPES[kind])))


def parsed(lines: DataFrame, head: Header) -> DataFrame:
    """Records of lines (value)."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("c"))
    c = lambda k: F.get(F.col("c"), F.lit(k))
    listed = lambda k, sep: F.when(known(c(k)).isNotNull(), F.split(c(k), sep))
    own = F.filter(F.split(F.coalesce(known(c(7)), F.lit("")), ";"), lambda x: x != "")
    keys = F.transform(own, lambda x: F.substring_index(x, "=", 1))
    # The first of repeated entries counts.
    first = F.filter(F.arrays_zip(keys.alias("k"), own.alias("x")), lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    entries = F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], F.when(F.contains(e["x"], F.lit("=")), F.substr(e["x"], F.length(e["k"]) + 2)))))
    rows = rows.withColumn("e", entries)
    info = [(F.map_contains_key("e", k) if kind == "Flag" else typed(F.element_at("e", k), n, kind)).alias(k) for k, (n, kind) in head.info.items()]
    other = F.map_filter("e", lambda k, _: ~k.isin(*head.info)) if head.info else F.col("e")

    def cell(s: Column, name: str) -> Column:
        at = F.array_position(F.split(c(8), ":"), name)
        return F.when(at > 0, F.get(F.split(s, ":"), (at - 1).cast("int")))

    fields = lambda s: F.struct(*(typed(cell(s, k), n, kind).alias(k) for k, (n, kind) in head.format.items()))
    samples = F.transform(F.slice(F.col("c"), 10, F.greatest(F.size("c") - 9, F.lit(0))), fields) if head.format else F.lit(None).cast("array<struct<none:string>>")
    return rows.select(c(0).alias("chrom"), c(1).cast("int").alias("pos"), listed(2, ";").alias("id"), c(3).alias("ref"), listed(4, ",").alias("alt"), known(c(5)).cast("double").alias("qual"), listed(6, ";").alias("filter"), (F.struct(*info) if info else F.lit(None).cast("struct<none:string>")).alias("info"), other.alias("other"), F.when(c(8).isNotNull(), F.split(c(8), ":")).alias("format"), samples.alias("samples"))


def read(spark: SparkSession, path: str, head: Header | None = None) -> DataFrame:
    return parsed(spark.read.text(path), head or header(spark, path))


def _text(value: Column, number: str, kind: str) -> Column:
    one = lambda x: F.coalesce(F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(x.cast("string")) if kind == "Float" else x.cast("string"), F.lit("."))
    return one(value) if number == "1" else F.when(value.isNotNull(), F.array_join(F.transform(value, one), ",")).otherwise(".")


def lines(records: DataFrame, head: Header) -> DataFrame:
    """Each record as a line (value). INFO entries come in the header's order, then the others by name."""
    own = []
    for k, (n, kind) in head.info.items():
        v = F.col("info").getField(k)
        own.append(F.when(v, k) if kind == "Flag" else F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), _text(v, n, kind))))
    others = F.transform(F.array_sort(F.map_entries("other")), lambda e: F.concat(e["key"], F.coalesce(F.concat(F.lit("="), e["value"]), F.lit(""))))
    info = F.array_compact(F.concat(F.array(*own) if own else F.array().cast("array<string>"), F.coalesce(others, F.array().cast("array<string>"))))
    joined = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit("."))

    def sample(s: Column) -> Column:
        def one(name: Column) -> Column:
            out = F.lit(".")
            for k, (n, kind) in head.format.items():
                out = F.when(name == k, _text(s.getField(k), n, kind)).otherwise(out)
            return out

        return F.array_join(F.transform(F.col("format"), one), ":")

    core = [F.col("chrom"), F.col("pos").cast("string"), joined("id", ";"), F.col("ref"), joined("alt", ","), F.coalesce(_text(F.col("qual"), "1", "Float"), F.lit(".")), joined("filter", ";"), F.when(F.size(info) > 0, F.array_join(info, ";")).otherwise(".")]
    rest = F.when(F.col("format").isNotNull(), F.concat(F.array(F.array_join("format", ":")), F.transform("samples", sample))).otherwise(F.array().cast("array<string>")) if head.format else F.array().cast("array<string>")
    return records.select(F.array_join(F.concat(F.array(*core), rest), "\t").alias("value"))


def write(records: DataFrame, path: str, head: Header, mode: str = "error") -> None:
    """Text files, each with the header in front."""

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([head.text])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], ["value"])

    lines(records, head).mapInArrow(headed, "value string").write.mode(mode).text(path)
