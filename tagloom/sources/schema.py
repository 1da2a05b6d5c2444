"""The canonical schema of alignment records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags

#: Columns in their fixed order; pos is 0-based and pnext 1-based, as stored. voffset and file say where a record stands; both are null for records that come from no BAM file.
CORE = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string"
RECORD = f"{CORE}, voffset bigint, file string, aux {tags.AUX}"
NAMES = [c.split()[0] for c in CORE.split(", ")]


def promoted(spec: str) -> list[tuple[str, str]]:
    """(tag, type letter) pairs of a declaration such as "BX:Z,NM:i,ZB:Bf"; the type is Z if left out."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        tag, _, kind = part.partition(":")
        if len(tag) != 2:
            raise ValueError(f"a tag has two characters: {tag!r}")
        out.append((tag, kind or "Z"))
    return out


def with_tags(records: DataFrame, spec: str) -> DataFrame:
    """The records with a typed column for each declared tag."""
    return records.select("*", *(tags.get(F.col("aux"), t, k).alias(t) for t, k in promoted(spec)))


def one_based(records: DataFrame) -> DataFrame:
    """The records with pos counted from 1, as in text files."""
    return records.withColumn("pos", F.col("pos") + 1)
