"""Variant records of several files side by side, paired by their alleles.

Records are dealt by reference and position, so that all of a site's meet in one task, which streams through
sorted sites. A site's records become sets of the same alleles first: equal allele sets of different files are
one. Sets whose files don't meet are then joined, the one in most files first and with the partner that fits
it best: one with an allele in common, else one that the modes allow. Which kinds may be side by side is the
modes' matter; a record of its file stands in exactly one row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variants

#: What may stand side by side: the same alleles only; one allele in common; also different SNPs (and MNPs), different indels, any kinds, and records without alternative alleles beside SNPs or beside indels.
EXACT, SOME, SNPS, INDELS, ANY, SNP_REF, INDEL_REF = "exact", "some", "snps", "indels", "any", "snp_ref", "indel_ref"
MODES = {EXACT, SOME, SNPS, INDELS, ANY, SNP_REF, INDEL_REF}
#: The modes that let two kinds of records stand side by side, the better fit first.
FITS = {("snp", "snp"): (3, SNPS), ("indel", "indel"): (3, INDELS), ("ref", "snp"): (2, SNP_REF), ("indel", "ref"): (2, INDEL_REF)}
KIND = {"SNP": "snp", "MNP": "snp", "INDEL": "indel", "REF": "ref"}


def fit(one: dict, other: dict, modes: frozenset[str]) -> int:
    """How well two sets of records go together: 0 not at all, 9 with equal alleles or, if not only those may, one in common."""
    best = None
    for a in one["members"]:
        for b in other["members"]:
            if a["alleles"] == b["alleles"]:
                return 9
            if EXACT in modes:
                continue
            if a["kinds"] & b["kinds"] and a["alleles"] & b["alleles"]:
                return 9
            own = max((score for x in a["kinds"] for y in b["kinds"] for score in [_allowed(x, y, modes)]), default=0)
            if not own:
                return 0  # one pair that mustn't meet keeps the sets apart
            best = own if best is None else min(best, own)
    return best or 0


def _allowed(x: str, y: str, modes: frozenset[str]) -> int:
    score, mode = FITS.get(tuple(sorted((x, y))), (1, ANY))
    return score if mode in modes or ANY in modes else 0


def paired(records: list[tuple[int, frozenset[str], frozenset[str], int]], modes: frozenset[str]) -> list[dict[int, int]]:
    """Rows of a site, file -> record, for its records (file, alleles as "ref>alt", kinds, record) in their order in each file."""
    sets: list[dict] = []
    for file, alleles, kinds, record in records:
        # Equal alleles of other files; a file's repeated record is a set of its own.
        same = next((s for s in sets if s["members"][0]["alleles"] == alleles and file not in s["rows"]), None)
        if same is None:
            sets.append({"members": [{"alleles": alleles, "kinds": kinds}], "rows": {file: record}})
        else:
            same["rows"][file] = record
    out = []
    while sets:
        top = max(sets, key=lambda s: len(s["rows"]))
        free = [(fit(top, s, modes), len(s["rows"]), -k, s) for k, s in enumerate(sets) if not s["rows"].keys() & top["rows"].keys()]
        score, _, _, mate = max(free, key=lambda x: x[:3], default=(0, 0, 0, None))
        if score:
            both = {"members": top["members"] + mate["members"], "rows": top["rows"] | mate["rows"]}
            at = min(k for k, s in enumerate(sets) if s is top or s is mate)
            sets = [both if k == at else s for k, s in enumerate(sets) if k == at or s is not top and s is not mate]
        else:
            out.append(top["rows"])
            sets = [s for s in sets if s is not top]
    return out


def side_by_side(files: dict[str, DataFrame], modes: set[str] | str = EXACT) -> DataFrame:
    """chrom, pos, row (from 0 at each site) and for each file's name an array of its record's ref and alt, null where it has none that fits.

    Files are variant records (as `sources.vcf` reads them). Modes other than EXACT imply SOME.
    """
    wanted = frozenset({modes} if isinstance(modes, str) else modes)
    if not wanted or wanted - MODES:
        raise ValueError(f"modes are some of {sorted(MODES)}, not {sorted(wanted)}")
    names, every = list(files), None
    for k, (_, rows) in enumerate(files.items()):
        alts = F.coalesce("alt", F.array(F.lit(".")))
        kinds = F.array_distinct(F.transform(alts, lambda a: variants.kind(F.col("ref"), a)))
        own = rows.withColumn("_n", F.monotonically_increasing_id()).select("chrom", "pos", F.lit(k).alias("file"), F.col("_n").alias("nth"), "ref", alts.alias("alts"), kinds.alias("kinds"))
        every = own if every is None else every.unionByName(own)
    dealt = every.repartition("chrom", "pos").sortWithinPartitions("chrom", "pos", "file", "nth")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("chrom", pa.string()), ("pos", pa.int32()), ("row", pa.int32()), *((n, pa.list_(pa.string())) for n in names)])
        site, held, out = None, [], []

        def ended() -> None:
            found = [(f, frozenset(f"{r}>{a}".upper() for a in alts), frozenset(KIND.get(x, "other") for x in kinds if x != "REF" or len(kinds) == 1), n) for n, (f, r, alts, kinds) in enumerate(held)]
            for k, rows in enumerate(paired(found, wanted)):
                cells = {names[f]: [held[n][1], *held[n][2]] for f, n in rows.items()}
                out.append({"chrom": site[0], "pos": site[1], "row": k, **cells})

        for b in batches:
            for chrom, pos, file, _, ref, alts, kinds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (chrom, pos) != site:
                    if held:
                        ended()
                    site, held = (chrom, pos), []
                held.append((file, ref, alts, kinds))
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if held:
            ended()
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return dealt.mapInArrow(run, "chrom string, pos int, row int, " + ", ".join(f"`{n}` array<string>" for n in names))
