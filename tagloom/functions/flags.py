"""Alignment flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twelve bits from the lowest on, as column names and as words of a flag text.
NAMES = ("isPaired", "isProperPair", "isUnmappedQuery", "hasUnmappedMate", "isMinusStrand", "isMateMinusStrand", "isFirstMateRead", "isSecondMateRead", "isNotPrimaryRead", "isNotPassingQualityControls", "isDuplicate", "isSupplementary")
WORDS = ("PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY")
UNMAPPED, REVERSE, SECONDARY, DUPLICATE, QCFAIL = 4, 16, 256, 1024, 512


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def bits(flag: Column) -> list[Column]:
    """Twelve columns of 0 or 1."""
    return [F.shiftright(flag, i).bitwiseAND(F.lit(1)).cast("int").alias(name) for i, name in enumerate(NAMES)]


def text(flag: Column) -> Column:
    """The words of the bits that are set, joined by commas; bits beyond the twelfth as one hexadecimal number."""
    rest = flag.bitwiseAND(F.lit(~0xFFF))
    return F.concat_ws(",", *(F.when(has(flag, 1 << i), F.lit(w)) for i, w in enumerate(WORDS)), F.when(rest != 0, F.concat(F.lit("0x"), F.lower(F.hex(rest)))))


def parsed(value: Column) -> Column:
    """A flag from its text, or from a decimal, octal (0...) or hexadecimal (0x...) number; null if any part is neither."""
    known = F.create_map(*(F.lit(x) for i, w in enumerate(WORDS) for x in (w, 1 << i)))

    def number(part: Column) -> Column:
        up = F.upper(F.trim(part))
        return F.coalesce(
            F.element_at(known, up),
            F.when(up.rlike("^0X[0-9A-F]+$"), F.conv(F.substring(up, F.lit(3), F.length(up)), 16, 10).cast("int")),
            F.when(up.rlike("^0[0-7]*$"), F.conv(up, 8, 10).cast("int")),
            F.when(up.rlike("^[1-9][0-9]*$"), up.cast("int")),
        )

    parts = F.filter(F.split(value, ","), lambda p: (value != "") | (p != ""))  # an empty text is 0
    return F.aggregate(F.transform(parts, number), F.lit(0), lambda a, b: a.bitwiseOR(b))


def strand(flag: Column) -> Column:
    return F.when(has(flag, UNMAPPED), "*").when(has(flag, REVERSE), "-").otherwise("+")
