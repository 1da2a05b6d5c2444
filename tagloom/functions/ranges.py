"""Alignment records as ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cigar, flags


def to_ranges(records: DataFrame) -> DataFrame:
    """seqnames, start, end, width, strand, qwidth and what else the records have.

    end is start plus deleted and matched bases, less one; other operations don't count. An unmapped record
    has start 1, end 0 and strand "*".
    """
    unmapped = flags.has(F.col("flag"), flags.UNMAPPED)
    start = F.when(unmapped, F.lit(1)).otherwise(F.col("pos")).cast("bigint")
    end = F.when(unmapped, F.lit(0)).otherwise(F.col("pos") + cigar.total(F.col("cigar"), "DM") - 1).cast("bigint")
    rest = [c for c in records.columns if c not in ("rname", "pos", "strand", "start", "end", "width", "qwidth", "seqnames")]
    qwidth = [F.length("seq").alias("qwidth")] if "seq" in records.columns else []
    return records.select(F.col("rname").alias("seqnames"), start.alias("start"), end.alias("end"), (end - start + 1).alias("width"), flags.strand(F.col("flag")).alias("strand"), *qwidth, *rest)
