"""SAM text: parsed and written by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags
from . import schema
from .bam import references


def header(spark: SparkSession, path: str) -> str:
    """The header lines; one of several files' lines counts once."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@") & F.col("value").rlike("^@[A-Z][A-Z](\t|$)"))
    return "\n".join(dict.fromkeys(r["value"] for r in lines.collect()))


def parsed(lines: DataFrame) -> DataFrame:
    """Records of lines (value). voffset is null: text has none. Coordinates become 0-based; a read without reference, place or CIGAR is unmapped."""
    rows = lines.filter(~F.col("value").rlike("^@[A-Z][A-Z](\t|$)") & (F.col("value") != "")).select(F.split("value", "\t").alias("c"))
    c = lambda i: F.col("c")[i]
    number = lambda i: c(i).cast("int")
    placed = (c(2) != "*") & (number(3) > 0)
    flag = F.when(placed & (c(5) != "*"), number(1)).otherwise(number(1).bitwiseOR(F.lit(4)))
    entries = F.expr("slice(c, 12, greatest(size(c) - 11, 0))")
    aux = F.map_from_entries(F.transform(entries, lambda f: _field(f)))
    rname = F.when(number(3) > 0, c(2)).otherwise("*")
    return rows.select(c(0).alias("qname"), flag.cast("int").alias("flag"), rname.alias("rname"), (number(3) - 1).alias("pos"), number(4).alias("mapq"), c(5).alias("cigar"), c(6).alias("rnext"), number(7).alias("pnext"), number(8).alias("tlen"), c(9).alias("seq"), c(10).alias("qual"), F.lit(None).cast("bigint").alias("voffset"), F.lit(None).cast("string").alias("file"), aux.cast(tags.AUX).alias("aux"))


def _field(f: Column) -> Column:
    kind, value = F.substring(f, 4, 1), F.substr(f, F.lit(6))
    whole = F.when(kind == "i", value.cast("bigint"))
    sub, items = F.substring(value, 1, 1), F.filter(F.split(F.substr(f, F.lit(7)), ","), lambda x: x != "")
    # Integers are stored in the narrowest type, unsigned from 0 on.
    narrow = F.when(whole.between(0, 255), "C").when(whole.between(-128, -1), "c").when(whole.between(0, 65535), "S").when(whole.between(-32768, -1), "s").when(whole >= 0, "I").otherwise("i")
    typed = F.when(kind == "i", narrow).when(kind == "B", F.concat(F.lit("B"), sub)).when(kind.isin("a", "c", "C"), "A").otherwise(kind)
    real = F.when(kind.isin("f", "d"), value.cast("double"))
    text = F.when(kind.isin("A", "a", "c", "C", "Z", "H"), value)
    integers = F.when((kind == "B") & (sub != "f"), items.cast("array<bigint>"))
    floats = F.when((kind == "B") & (sub == "f"), items.cast("array<double>"))
    return F.struct(F.substring(f, 1, 2).alias("key"), F.struct(typed.alias("t"), whole.alias("i"), real.alias("f"), text.alias("s"), integers.alias("ia"), floats.alias("fa")).alias("value"))


def read(spark: SparkSession, path: str, tags: str = "") -> DataFrame:
    return schema.with_tags(parsed(spark.read.text(path)), tags)


def lines(records: DataFrame) -> DataFrame:
    """Each record as a line (value) of a SAM file: coordinates from 1, integers of any width as i."""
    listed = F.transform(F.map_entries("aux"), lambda e: _written(e["key"], e["value"]))
    text = lambda name: F.coalesce(F.col(name), F.lit("*"))
    core = [F.col("qname"), F.col("flag"), F.col("rname"), F.col("pos") + 1, F.col("mapq"), text("cigar"), F.col("rnext"), F.col("pnext"), F.col("tlen"), text("seq"), text("qual")]
    return records.select(F.array_join(F.concat(F.array(*(x.cast("string") for x in core)), F.coalesce(listed, F.array().cast("array<string>"))), "\t").alias("value"))


def _written(tag: Column, v: Column) -> Column:
    short = lambda x: F.regexp_replace(F.format_string("%.6g", x), r"(\.[0-9]*?)0+(e|$)", "$1$2")
    real = lambda x: F.regexp_replace(short(x), r"\.(e|$)", "$1")
    array = F.concat_ws(",", F.substring(v["t"], 2, 1), F.coalesce(v["ia"].cast("array<string>"), F.transform(v["fa"], real)))
    kind = F.when(v["i"].isNotNull(), "i").when(v["ia"].isNotNull() | v["fa"].isNotNull(), "B").otherwise(v["t"])
    return F.concat_ws(":", tag, kind, F.coalesce(v["s"], v["i"].cast("string"), F.when(v["f"].isNotNull(), real(v["f"])), array))


def write(records: DataFrame, path: str, header: str = "", mode: str = "error") -> None:
    """Text files, each with the header in front."""
    text = lines(records)

    def headed(batches):
        import pyarrow as pa

        if header:
            yield pa.RecordBatch.from_arrays([pa.array([header.rstrip("\n")])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    (text.mapInArrow(headed, "value string") if header else text).write.mode(mode).text(path)


__all__ = ["header", "lines", "parsed", "read", "references", "write"]
