import pytest
from pyspark.sql import functions as F

from tagloom.functions import cigar, flags, ranges, regions, tags, variants


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("text, dims", [("80M47S", (0, 0, 80, 47)), ("37S113M", (0, 0, 113, 37)), ("2S3M2I3M2S", (0, 2, 6, 4)), ("3M4N3M", (0, 0, 6, 0)), ("1H8M1H", (0, 0, 8, 0)), ("0M", (0, 0, 0, 0)), ("10=5X", (0, 0, 0, 0)), ("5M3D2M", (3, 0, 7, 0)), ("*", (0, 0, 0, 0)), (None, (0, 0, 0, 0)), ("foobar", (0, 0, 0, 0))])
def test_cigar_counts(spark, text, dims):
    assert tuple(spark.range(1).select(*cigar.counts(F.lit(text).cast("string"))).first()) == dims


def test_cigar_lengths(spark):
    r = one(spark, ref=cigar.reference_length(F.lit("5=2X3N4D1M2I3S")), read=cigar.query_length(F.lit("5=2X3N4D1M2I3S")), end=cigar.reference_end(F.lit(10), F.lit("*")))
    assert (r.ref, r.read, r.end) == (15, 13, 11)


@pytest.mark.parametrize("flag", [0, 4, 16, 97, 99, 145, 147, 163, 1171, 2147, 2195, 4095])
def test_flags(spark, flag):
    bits = spark.range(1).select(*flags.bits(F.lit(flag))).first()
    assert [bits[n] for n in flags.NAMES] == [flag >> i & 1 for i in range(12)]
    text = flags.text(F.lit(flag))
    r = one(spark, text=text, back=flags.parsed(text), number=flags.parsed(F.lit(hex(flag))))
    assert r.text == ",".join(w for i, w in enumerate(flags.WORDS) if flag >> i & 1)
    assert r.back == flag and r.number == flag


def test_flag_text_that_is_none(spark):
    assert one(spark, x=flags.parsed(F.lit("PAIRED,NONSENSE"))).x is None


def test_ranges(spark):
    rows = spark.createDataFrame([("a", 0, "19", 100, "80M3D2M2N5S", "ACGT"), ("b", 16, "19", 5, "10M", "*"), ("c", 4, "19", 7, None, "AC"), ("d", 20, "*", -1, "5M", "AC")], "qname string, flag int, rname string, pos int, cigar string, seq string")
    got = {r.qname: (r.seqnames, r.start, r.end, r.width, r.strand, r.qwidth) for r in ranges.to_ranges(rows).collect()}
    assert got == {"a": ("19", 100, 184, 85, "+", 4), "b": ("19", 5, 14, 10, "-", 1), "c": ("19", 1, 0, 0, "*", 2), "d": ("*", 1, 0, 0, "*", 2)}


@pytest.mark.parametrize("text, wanted", [("chr1:1,000-2,000", ("chr1", 1000, 2000)), ("chr1", ("chr1", 1, regions.END)), ("chr1:5", ("chr1", 5, regions.END)), ("chr1:5-", ("chr1", 5, regions.END)), ("HLA:01:7-9", ("HLA:01", 7, 9))])
def test_regions(spark, text, wanted):
    assert regions.parse(text) == wanted
    assert tuple(spark.range(1).select(*regions.parsed(F.lit(text))).first()) == wanted


def test_region_that_ends_early():
    with pytest.raises(ValueError):
        regions.parse("chr1:9-3")


def test_restyled(spark):
    names = spark.createDataFrame([("19",), ("X",)], "name string")
    got = regions.restyled(regions.table(spark, ["chr19:1-2", "X:3-4", "chr7:1-1"]), names).collect()
    assert sorted(r.seqnames for r in got) == ["19", "7", "X"]


def test_region_table_types(spark):
    with pytest.raises(TypeError):
        regions.table(spark, "chr1:1-2")
    with pytest.raises(TypeError):
        regions.table(spark, spark.range(1))


def test_tags(spark):
    aux = F.create_map(F.lit("Ac"), tags.value("i", F.lit(3)), F.lit("AC"), tags.value("Z", F.lit("x")), F.lit("FL"), tags.value("f", F.lit(1.5)))
    r = one(spark, a=tags.get(aux, "Ac", "i"), b=tags.get(aux, "AC"), missing=tags.get(aux, "BX"), key=tags.key(aux, "BX"), number=tags.key(aux, "Ac"), text=tags.key(aux, "Ac", any_type=True), put=F.map_keys(tags.put(aux, "Ac", "Z", F.lit("y"))), drop=F.map_keys(tags.drop(aux, "AC")))
    assert (r.a, r.b, r.missing, r.key, r.number, r.text) == (3, "x", None, "*", "*", "3")
    assert sorted(r.put) == ["AC", "Ac", "FL"] and sorted(r["drop"]) == ["Ac", "FL"]


def test_wide(spark):
    rows = spark.range(2).select("id", F.when(F.col("id") == 0, F.create_map(F.lit("ZZ"), tags.value("Z", F.lit("s")), F.lit("NM"), tags.value("i", F.lit(2**32 - 1)))).otherwise(F.create_map(F.lit("FL"), tags.value("f", F.lit(0.5)))).alias("aux"))
    wide = tags.wide(rows)
    assert wide.columns == ["id", "NM", "FL", "ZZ"]
    assert [tuple(r) for r in wide.orderBy("id").collect()] == [(0, 2**32 - 1, None, "s"), (1, None, 0.5, None)]


@pytest.mark.parametrize("ref, alt, kind", [("A", "G", "SNP"), ("AC", "GT", "MNP"), ("A", "AT", "INDEL"), ("A", None, "REF"), ("A", "]c:1]A", "INDEL"), ("A", "A[chr2:5[", "BND"), ("A", "a", "SNP"), ("AC", "ac", "REF"), ("A", "<NON_REF>", "OTHER"), ("AC", "<*>", "REF"), ("AC", "*", "OTHER"), ("A", "<INV>", "OTHER"), ("AC", "AT", "SNP"), ("ACG", "ATG", "SNP"), ("AT", "GCC", "OTHER"), ("A", "X", "REF"), ("ACT", "GT", "OTHER"), ("AGT", "T", "INDEL"), ("acg", "AC", "INDEL")])
def test_variants(spark, ref, alt, kind):
    assert one(spark, k=variants.kind(F.lit(ref), F.lit(alt).cast("string"))).k == kind
