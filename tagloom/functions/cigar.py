"""CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole CIGAR string, operations that consume the reference, and those that consume the read.
VALID, ON_REFERENCE, ON_READ = r"^([0-9]+[MIDNSHP=XB])+$", "MDN=X", "MIS=X"


def total(cigar: Column, operations: str) -> Column:
    """The summed lengths of some operations; 0 for null, "*" and anything that is no CIGAR string."""
    found = F.regexp_extract_all(F.when(cigar.rlike(VALID), cigar), F.lit(f"([0-9]+)[{operations}]"), F.lit(1))
    return F.coalesce(F.aggregate(found, F.lit(0).cast("bigint"), lambda n, x: n + x.cast("bigint")), F.lit(0).cast("bigint"))


def counts(cigar: Column) -> list[Column]:
    """Columns D, I, M, S: the lengths of deletions, insertions, matches and soft clips."""
    return [total(cigar, op).alias(op) for op in "DIMS"]


def reference_length(cigar: Column) -> Column:
    return total(cigar, ON_REFERENCE)


def query_length(cigar: Column) -> Column:
    return total(cigar, ON_READ)


def reference_end(pos: Column, cigar: Column) -> Column:
    """The position behind the last base on the reference; an alignment without any takes one."""
    return pos + F.greatest(reference_length(cigar), F.lit(1).cast("bigint"))


def without_star(cigar: Column) -> Column:
    return F.nullif(cigar, F.lit("*"))
