"""Kinds of variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternative alleles that stand for no change, beside a single base and beside any.
UNCHANGED_BASE, UNCHANGED = (".", "*", "X"), ("<*>", "<X>")


def _differing(r: Column, a: Column) -> Column:
    """The place, from 1, of the first letter that differs; the end of one text counts as a difference."""
    places = F.sequence(F.lit(1), F.least(F.length(r), F.length(a)) + 1)
    return F.get(F.filter(places, lambda i: r.substr(i, F.lit(1)) != a.substr(i, F.lit(1))), F.lit(0))


def _ending(r: Column, a: Column) -> Column:
    """How many letters both share at their ends, where each keeps one."""
    most = F.least(F.length(r), F.length(a))
    return F.get(F.filter(F.sequence(F.lit(1), most), lambda i: (r.substr(-i, F.lit(1)) != a.substr(-i, F.lit(1))) | (i == most)), F.lit(0)) - 1


def kind(ref: Column, alt: Column) -> Column:
    """REF, SNP, MNP, INDEL, BND or OTHER of a reference and an alternative allele.

    Of two single letters, equal ones are REF and others a SNP, also where only their case differs. Longer
    alleles are compared whatever their case: what both share at the start and then at the end doesn't count;
    one base that changes is a SNP, several that change into as many an MNP; bases that are only added or only
    missing are an INDEL, and added ones that begin with a bracket a BND. A null alternative is REF.
    """
    upper_r, upper_a = F.upper(ref), F.upper(alt)
    first = _differing(upper_r, upper_a)
    r, a = upper_r.substr(first, F.length(ref)), upper_a.substr(first, F.length(alt))
    shared = _ending(r, a)
    n_r, n_a = F.length(r) - shared, F.length(a) - shared
    one_stays = r.substr(n_r, F.lit(1)) == a.substr(n_a, F.lit(1))
    trimmed = (
        F.when(upper_r == upper_a, "REF")
        .when((r == "") & a.substr(1, 1).isin("[", "]"), "BND")
        .when((r == "") | (a == ""), "INDEL")
        .when((n_r == 1) & (n_a == 1), "SNP")
        .when((n_r == 1) | (n_a == 1), F.when(one_stays, "INDEL").otherwise("OTHER"))
        .when(n_r == n_a, "MNP")
        .otherwise("OTHER")
    )
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    symbol = F.when(alt.startswith(UNCHANGED[0]) | alt.startswith(UNCHANGED[1]), "REF").otherwise("OTHER")
    return F.when(alt.isNull(), "REF").when(single, F.when(alt.isin(*UNCHANGED_BASE) | (ref == alt), "REF").otherwise("SNP")).when(alt.startswith("<"), symbol).otherwise(trimmed)
