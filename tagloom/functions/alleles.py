"""Alleles and genotypes of variant records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of(genotype: Column) -> Column:
    """The allele numbers of a genotype such as "0/1" or "1|."; "." is null."""
    return F.transform(F.split(genotype, "[/|]"), lambda x: F.nullif(x, F.lit(".")).cast("int"))


def phased(genotype: Column) -> Column:
    return F.contains(genotype, F.lit("|"))


def kind(genotype: Column) -> Column:
    """hom_ref, het_ref_alt, hom_alt, het_alt, hap_ref, hap_alt, or unknown where an allele or all is missing."""
    a = of(genotype)
    alts = F.size(F.array_distinct(F.filter(a, lambda x: x > 0)))
    ref = F.array_contains(a, 0)
    found = F.when(F.size(a) == 1, F.when(ref, "hap_ref").otherwise("hap_alt")).when(~ref, F.when(alts == 1, "hom_alt").otherwise("het_alt")).when(alts == 0, "hom_ref").otherwise("het_ref_alt")
    return F.when(genotype.isNull() | F.exists(a, lambda x: x.isNull()), "unknown").otherwise(found)


def counts(genotypes: Column, alts: Column) -> Column:
    """How often the reference and each alternative allele occur in an array of genotypes; an allele that the record lacks is an error."""
    found = F.filter(F.flatten(F.transform(F.filter(genotypes, lambda g: g.isNotNull()), of)), lambda x: x.isNotNull())
    n = F.coalesce(F.size(alts), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    each = F.transform(F.sequence(F.lit(0), n), lambda k: F.size(F.filter(found, lambda x: x == k)))
    return F.when(F.exists(found, lambda x: x > n), F.raise_error(F.lit("a genotype has an allele that its record lacks")).cast("array<int>")).otherwise(each)


def known_counts(ac: Column, an: Column, counted: Column) -> Column:
    """Counts from a record's own AC and AN where it has both, else the counted ones; more alternative alleles than all is an error."""
    alt = F.aggregate(ac, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    told = F.when(an < alt, F.raise_error(F.lit("AC is more than AN")).cast("array<int>")).otherwise(F.concat(F.array((an - alt).cast("int")), F.transform(ac, lambda x: F.coalesce(x, F.lit(0)).cast("int"))))
    return F.when(an.isNotNull() & ac.isNotNull(), told).otherwise(counted)


def _picked(values: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(values, i))


def _kept_values(values: Column, number: str, kept: Column, n: Column) -> Column:
    """The values of the kept alleles of a field with a value for each alternative allele, each allele, or each genotype."""
    if number == "A":
        return F.when(F.size(values) == n - 1, _picked(values, F.transform(F.filter(kept, lambda k: k > 0), lambda k: k - 1))).otherwise(values)
    if number == "R":
        return F.when(F.size(values) == n, _picked(values, kept)).otherwise(values)
    # Genotypes of two alleles i <= j stand at j (j + 1) / 2 + i; of one, at the allele's number.
    pairs = F.flatten(F.transform(kept, lambda j: F.transform(F.filter(kept, lambda i: i <= j), lambda i: (j * (j + 1) / 2 + i).cast("int"))))
    return F.when(F.size(values) == n * (n + 1) / 2, _picked(values, pairs)).when(F.size(values) == n, _picked(values, kept)).otherwise(values)


def renumbered(genotype: Column, kept: Column) -> Column:
    """A genotype with the kept alleles' new numbers; one that isn't kept becomes "."."""
    new = F.transform(of(genotype), lambda a: F.when(F.array_contains(kept, a), (F.array_position(kept, a) - 1).cast("string")).otherwise("."))
    signs = F.concat(F.regexp_extract_all(genotype, F.lit("[/|]"), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(new, signs, lambda a, s: F.concat(a, s)), "")


def without(records: DataFrame, head, kept: Column) -> DataFrame:
    """Variant records (as `sources.vcf` reads them) with the alleles whose numbers, rising and with 0, are kept: alt, genotypes, and all fields with a value for each allele or genotype."""
    rows = records.withColumns({"_kept": kept, "_n": F.greatest(F.coalesce(F.size("alt"), F.lit(0)), F.lit(0)) + 1})
    k, n = F.col("_kept"), F.col("_n")
    changed = lambda v, number: _kept_values(v, number, k, n) if number in ("A", "R", "G") else v
    out = {"alt": F.when(F.size(k) > 1, _picked(F.col("alt"), F.transform(F.filter(k, lambda x: x > 0), lambda x: x - 1)))}
    if head.info:
        out["info"] = F.struct(*(changed(F.col("info").getField(f), number).alias(f) for f, (number, _) in head.info.items()))
    if head.format:
        own = lambda s: F.struct(*((renumbered(s.getField(f), k) if f == "GT" else changed(s.getField(f), number)).alias(f) for f, (number, _) in head.format.items()))
        out["samples"] = F.transform("samples", own)
    return rows.withColumns(out).drop("_kept", "_n")


def trimmed(records: DataFrame, head) -> DataFrame:
    """Records without the alternative alleles that no sample has. Records of files without genotypes stay as they are."""
    if "GT" not in head.format:
        return records
    found = counts(F.transform("samples", lambda s: s.getField("GT")), F.col("alt"))
    used = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda k: (k == 0) | (F.get(found, k) > 0))
    return without(records, head, F.when(F.array_contains("format", "GT"), used).otherwise(F.sequence(F.lit(0), F.size(found) - 1)))
