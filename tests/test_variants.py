"""Variant text, alleles and genotypes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import alleles
from tagloom.sources import vcf

HEAD = """##fileformat=VCFv4.2
##contig=<ID=c1,length=1000>
##contig=<ID=c2>
##FILTER=<ID=q10,Description="low, quality">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, \\"all\\" of it">
##INFO=<ID=AF,Number=A,Type=Float,Description="x">
##INFO=<ID=AD,Number=R,Type=Integer,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##INFO=<ID=TX,Number=.,Type=String,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
##FORMAT=<ID=FT,Number=1,Type=String,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"""
LINES = [
    "c1\t10\trs1;rs2\tA\tC,G\t29.5\tPASS\tDP=14;AF=0.5,.;AD=1,2,3;DB;TX=a,b;XX=7;YY\tGT:PL:AD\t0/1:0,1,2,3,4,5:1,2,3\t1|1:5,4,3,2,1,0:.",
    "c1\t11\t.\tAC\t.\t.\t.\t.\tGT:FT\t0/0:ok\t.",
    "c2\t12\t.\tG\t<DEL>\t100\tq10;s5\tTX=one\tGT\t0\t./1",
    "c2\t13\t.\tG\tT\t1e-05\tPASS\tDP=-3",
]


@pytest.fixture(scope="module")
def made(spark):
    head = vcf.parsed_header(HEAD)
    return head, vcf.parsed(spark.createDataFrame([(x,) for x in [*HEAD.split("\n"), *LINES, ""]], "value string"), head)


def test_header():
    head = vcf.parsed_header(HEAD)
    assert head.info == {"DP": ("1", "Integer"), "AF": ("A", "Float"), "AD": ("R", "Integer"), "DB": ("0", "Flag"), "TX": (".", "String")}
    assert list(head.format) == ["GT", "PL", "AD", "FT"] and head.samples == ["s1", "s2"] and head.contigs == {"c1": 1000, "c2": None}
    for bad in ("no", "##fileformat=VCFv4.2\n##INFO=<ID=X,Number=1,Type=Colour>"):
        with pytest.raises(ValueError):
            vcf.parsed_header(bad)


def test_types_and_numbers(made):
    _, rows = made
    a, b, c, d = rows.orderBy("pos").collect()
    assert (a.chrom, a.pos, a.id, a.ref, a.alt, a.qual, a.filter) == ("c1", 10, ["rs1", "rs2"], "A", ["C", "G"], 29.5, ["PASS"])
    assert (a.info.DP, a.info.AF, a.info.AD, a.info.DB, a.info.TX, a.other) == (14, [0.5, None], [1, 2, 3], True, ["a", "b"], {"XX": "7", "YY": None})
    assert (a.samples[0].GT, a.samples[0].PL, a.samples[1].AD, a.samples[1].FT) == ("0/1", [0, 1, 2, 3, 4, 5], None, None)
    assert (b.id, b.alt, b.qual, b.filter, b.info.DP, b.info.DB, b.samples[0].FT, b.samples[1].GT, b.other) == (None, None, None, None, None, False, "ok", None, {})
    assert (c.filter, c.info.TX, c.samples[1].GT) == (["q10", "s5"], ["one"], "./1")
    assert (d.qual, d.format, d.samples) == (1e-05, None, [])


def test_round_trip(spark, made, tmp_path):
    head, rows = made
    text = [r.value for r in vcf.lines(rows, head).orderBy("value").collect()]
    assert text[0] == LINES[0] and text[2] == LINES[2]
    vcf.write(rows.coalesce(1), str(tmp_path / "v"), head)
    again = vcf.header(spark, str(tmp_path / "v"))
    assert (again.info, again.samples) == (head.info, head.samples)
    assert sorted(map(repr, vcf.read(spark, str(tmp_path / "v")).collect())) == sorted(map(repr, rows.collect()))
    assert vcf.read(spark, str(tmp_path / "v")).schema == rows.schema


@pytest.mark.parametrize(("gt", "kind", "found"), [("0/0", "hom_ref", [0, 0]), ("0|1", "het_ref_alt", [0, 1]), ("2/2", "hom_alt", [2, 2]), ("1/2", "het_alt", [1, 2]), ("0", "hap_ref", [0]), ("3", "hap_alt", [3]), ("./1", "unknown", [None, 1]), (".", "unknown", [None]), (None, "unknown", None), ("0/1/2", "het_ref_alt", [0, 1, 2]), ("10|0", "het_ref_alt", [10, 0])])
def test_genotypes(spark, gt, kind, found):
    c = F.lit(gt).cast("string")
    r = spark.range(1).select(alleles.kind(c).alias("k"), alleles.of(c).alias("a"), alleles.phased(c).alias("p")).first()
    assert (r.k, r.a, r.p) == (kind, found, None if gt is None else "|" in gt)


def test_counts(spark, made):
    _, rows = made
    gts = F.transform("samples", lambda s: s.getField("GT"))
    got = [r.n for r in rows.orderBy("pos").select(alleles.counts(gts, F.col("alt")).alias("n")).collect()]
    assert got == [[1, 3, 0], [2], [1, 1], [0, 0]]
    with pytest.raises(Exception, match="lacks"):
        spark.range(1).select(alleles.counts(F.array(F.lit("0/3")), F.array(F.lit("A")))).collect()
    told = alleles.known_counts(F.array(F.lit(2), F.lit(None)), F.lit(10), F.array(F.lit(0)))
    assert spark.range(1).select(told.alias("n")).first().n == [8, 2, 0]
    assert spark.range(1).select(alleles.known_counts(F.lit(None).cast("array<int>"), F.lit(10), F.array(F.lit(7))).alias("n")).first().n == [7]


def test_alleles_that_go(spark):
    rng = random.Random(6)
    head = vcf.parsed_header(HEAD)
    lines, wanted = [], []
    for k in range(40):
        n = rng.randint(0, 4)
        alts = ["C", "G", "T", "CC"][:n]
        gts = [rng.choice(["0/1", "2|2", "1/3", "0", "4/0", "./.", "0/0"]) for _ in range(2)]
        gts = [g if all(x in ".0" or int(x) <= n for x in g.replace("|", "/").split("/")) else "0/0" for g in gts]
        pairs = [(i, j) for j in range(n + 1) for i in range(j + 1)]
        used = [0, *(a for a in range(1, n + 1) if any(str(a) in g.replace("|", "/").split("/") for g in gts))]
        new = {str(a): str(i) for i, a in enumerate(used)} | {".": "."}
        pl = [10 * j + i for i, j in pairs]
        af, ad = [a / 8 for a in range(1, n + 1)], list(range(n + 1))
        text = lambda x: ",".join(map(str, x)) or "."
        lines.append(f"c1\t{k}\t.\tA\t{text(alts)}\t.\t.\tAF={text(af)};AD={text(ad)}\tGT:PL\t" + "\t".join(f"{g}:{text(pl)}" for g in gts))
        kept = [v for (i, j), v in zip(pairs, pl, strict=True) if i in used and j in used]
        wanted.append((k, [alts[a - 1] for a in used[1:]] or None, [af[a - 1] for a in used[1:]] if n else None, [ad[a] for a in used], ["".join(new.get(ch, ch) for ch in g) for g in gts], kept))
    got = alleles.trimmed(vcf.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), head), head).orderBy("pos").collect()
    assert [(r.pos, r.alt, r.info.AF, r.info.AD, [s.GT for s in r.samples], r.samples[1].PL) for r in got] == wanted
    assert got[0].info.DB is False and len(list(itertools.chain(*(r.samples for r in got)))) == 80
