import gzip
import os

import pytest
from pyspark.sql import functions as F

from tagloom import cli
from tagloom.operators import coordinates, index, overlap, summary
from tagloom.operators.lookup import Alignments, is_empty
from tagloom.sources import bam, bgzf, formats, intervals, sam
from tagloom.streaming import append

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr19\tLN:100000\n@SQ\tSN:chr5\tLN:5000"
TAGS = ["XA:A:c", "X0:i:0", "X1:i:-128", "X2:i:255", "X3:i:-32768", "X4:i:65535", "X5:i:-2147483648", "X6:i:4294967295", "FL:f:1.5", "FN:f:-1e+19", "ZE:Z:", "ZV:Z:some text", "HE:H:", "HX:H:1AE3", "Bc:B:c,-128,127", "BI:B:I,0,4294967295", "Bf:B:f,0.5,-2", "Ac:i:1", "AC:i:2"]
LINES = [
    "r1\t97\tchr19\t101\t60\t80M47S\tchr5\t11\t0\tACGTN\tIIIII\tBX:Z:AAA-1\tNM:i:3",
    "r1\t145\tchr5\t11\t60\t37S113M\tchr19\t101\t0\tACG\t*\tBX:Z:AAA-1",
    "r2\t99\tchr19\t151\t0\t5M2D5M\t=\t301\t160\t*\t*\tBX:Z:CCC-1\t" + "\t".join(TAGS),
    "r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t##\tQT:Z:BXZGGG",
    "r4\t16\tchr19\t40001\t37\t10=5X\t*\t0\t0\tACGTACGTACGTACG\t*\tBX:Z:GGG-1\tCB:Z:one\tUB:Z:two",
    "r5\t1024\tchr19\t101\t37\t10M\t*\t0\t0\t*\t*\tBX:Z:TTT-1",
    "r6\t0\tchr19\t101\t37\t10M\t*\t0\t0\t*\t*",
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A BAM file, written from SAM lines, and its index."""
    top = tmp_path_factory.mktemp("reads")
    rows = sam.parsed(spark.createDataFrame([(x,) for x in [*HEADER.split("\n"), *LINES]], "value string"))
    bam.write(rows.coalesce(1), str(top / "out"), header=HEADER)
    (found,) = [f for f in os.listdir(top / "out") if f.endswith(".bam")]
    path = str(top / "one.bam")
    os.rename(top / "out" / found, path)
    reads = Alignments(spark, path)
    assert reads.build_index("BX", "CB", "UB") == ["BX", "CB", "UB", "QNAME"]
    return path, reads


def canonical(line):
    core, tags = line.split("\t")[:11], sorted(line.split("\t")[11:])
    return core, tags


def test_text_survives_bam(spark, made):
    path, _ = made
    back = [r["value"] for r in sam.lines(bam.read(spark, path)).collect()]
    assert [canonical(x) for x in back] == [canonical(x) for x in LINES]


def test_values_and_types(spark, made):
    path, _ = made
    rows = {(r.qname, r.flag): r for r in bam.read(spark, path).collect()}
    r = rows["r2", 99]
    assert (r.pos, r.pnext, r.rnext, r.cigar, r.seq, r.qual) == (150, 301, "=", "5M2D5M", "*", "*")
    assert {t: r.aux[t].t for t in ("X0", "X1", "X2", "X3", "X4", "X5", "X6", "Bf", "ZE")} == {"X0": "C", "X1": "c", "X2": "C", "X3": "s", "X4": "S", "X5": "i", "X6": "I", "Bf": "Bf", "ZE": "Z"}
    assert r.aux["X6"].i == 2**32 - 1 and r.aux["BI"].ia == [0, 2**32 - 1] and r.aux["ZE"].s == "" and (r.aux["Ac"].i, r.aux["AC"].i) == (1, 2)
    assert rows["r1", 97].seq == "ACGTN" and rows["r3", 4].rname == "*"


def test_promoted_columns_splits_and_seeks(spark, made):
    path, _ = made
    whole = bam.read(spark, path, tags="BX:Z,NM:i,Bf:Bf")
    rows = whole.collect()
    assert [r.BX for r in rows][:2] == ["AAA-1", "AAA-1"] and rows[0].NM == 3 and rows[2].Bf == [0.5, -2.0]
    assert sorted(r.voffset for r in bam.read(spark, path, splits=3).collect()) == sorted(r.voffset for r in rows)
    sought = whole.filter(F.col("voffset").isin([rows[1].voffset, rows[4].voffset])).collect()
    assert [r.qname for r in sought] == ["r1", "r4"]
    assert bam.read_binary(spark, path).count() == len(LINES)
    assert bam.read(spark, path, fields="core").first().seq == "*"


def test_many_blocks(spark, tmp_path):
    n = 3000
    rows = spark.range(n).select(F.concat(F.lit("q"), "id").alias("qname"), F.lit(0).alias("flag"), F.lit("chr19").alias("rname"), F.col("id").cast("int").alias("pos"), F.lit(60).alias("mapq"), F.lit("100M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.repeat(F.lit("ACGT"), 25).alias("seq"), F.repeat(F.lit("I"), 100).alias("qual"), F.lit(None).cast("long").alias("voffset"), F.lit(None).cast("map<string,struct<t:string,i:bigint,f:double,s:string,ia:array<bigint>,fa:array<double>>>").alias("aux"))
    bam.write(rows.coalesce(1), str(tmp_path / "b"), references='[["chr19", 1000000]]')
    one, many = bam.read(spark, str(tmp_path / "b")), bam.read(spark, str(tmp_path / "b"), splits=4)
    assert many.rdd.getNumPartitions() > 1
    assert one.select("qname", "pos", "seq", "qual", "voffset").exceptAll(many.select("qname", "pos", "seq", "qual", "voffset")).isEmpty() and many.count() == n
    with open(bam.files(str(tmp_path / "b"))[0], "rb") as f:
        assert gzip.decompress(f.read())[:4] == bam.MAGIC


def test_damaged_files(spark, made, tmp_path):
    path, _ = made
    data = open(path, "rb").read()
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut short|damaged|BGZF"):
        bam.read(spark, str(tmp_path / "cut.bam")).collect()
    (tmp_path / "text.bam").write_text("no")
    for name in ("text.bam", "absent.bam"):
        with pytest.raises(ValueError):
            Alignments(spark, str(tmp_path / name))


def test_lookups(spark, made):
    _, reads = made
    assert index.available(spark, reads.index_path) == ["BX", "CB", "QNAME", "UB"]
    assert index.exists(spark, reads.index_path, "QNAME") and not index.exists(spark, reads.index_path, "BZ")
    one = reads.by_bx("AAA-1", output="table")
    assert sorted((r.flag, r.mapq, r.cigar, r.BX) for r in one.collect()) == [(97, 60, "80M47S", "AAA-1"), (145, 60, "37S113M", "AAA-1")]
    assert reads.by_bx(["AAA-1", "GGG-1", "absent", "AAA-1"]).count() == 5
    assert reads.by_bx(["AAA-1", "GGG-1", "AAA-1"], distinct_keys=True).count() == 3
    assert is_empty(reads.by_bx("absent")) and is_empty(reads.by_bx()) and reads.by_cb("one").count() == 1 and reads.by_ub("two").count() == 1
    assert reads.by_qname("r1").count() == 2
    assert "tag" in reads.by_tag("BX", "AAA-1").columns
    star = reads.by_tag("BX", ["GGG-1"], output="ranges").first()
    assert (star.seqnames, star.strand) == ("chr19", "-")


def test_region_lookups(spark, made):
    _, reads = made
    # Reads at 101 have the tags AAA-1 and TTT-1; the one without a tag adds nothing.
    assert sorted(r.BX for r in reads.by_bx(regions=["chr19:100-105"], output="table").collect()) == ["AAA-1", "AAA-1", "TTT-1"]
    assert reads.by_bx(regions=["19:100-105"]).count() == 3
    assert is_empty(reads.by_bx(regions=["chr7:1-10"]))
    # One read in two regions counts twice.
    assert reads.by_bx(regions=["chr19:100-105", "chr19:120-130"], output="table").filter("BX = 'AAA-1'").count() == 4
    given = spark.createDataFrame([("x", 1, 2, "CCC-1")], "seqnames string, start int, end int, BX string")
    assert [r.qname for r in reads.by_bx(regions=given).collect()] == ["r2"]


def test_errors(spark, made):
    path, reads = made
    with pytest.raises(ValueError, match="index"):
        reads.by_tag("BZ", "x")
    with pytest.raises(ValueError, match="not both"):
        reads.by_bx("a", ["chr1:1-2"])
    with pytest.raises(TypeError):
        reads.by_bx(5)
    with pytest.raises(TypeError):
        reads.by_tag(["BX"], "a")
    with pytest.raises(ValueError):
        reads.by_tag("BXX", "a")
    with pytest.raises(ValueError):
        index.build(reads.records, reads.index_path, ["LONG"])
    assert is_empty(reads.by_tag("BX", 5))


def test_index_of_missing_and_repeated(spark, made):
    _, reads = made
    found = index.opened(spark, reads.index_path, "BX")
    # A tag's bytes inside another tag's value are no tag.
    assert found.filter("key = '*'").count() == 2 and found.count() == len(LINES)
    before = found.count()
    reads.build_index("BX")
    assert index.opened(spark, reads.index_path, "BX").count() == before
    assert {r.key: r.n for r in index.counted(index.opened(spark, reads.index_path, 'BX')).collect()}["AAA-1"] == 2


def test_subset_and_text_files(spark, made, tmp_path):
    path, reads = made
    offsets = reads.by_bx("AAA-1", output="table").select("voffset")
    reads.write_subset(offsets, str(tmp_path / "sub"), header=HEADER)
    assert bam.read(spark, str(tmp_path / "sub")).count() == 2
    sam.write(reads.records.coalesce(1), str(tmp_path / "text"), HEADER)
    assert sam.header(spark, str(tmp_path / "text")) == HEADER
    assert [canonical(r.value) for r in sam.lines(sam.read(spark, str(tmp_path / "text"))).collect()] == [canonical(x) for x in LINES]
    assert bam.references(HEADER) == [("chr19", 100000), ("chr5", 5000)]


def test_scans_and_summaries(spark, made):
    _, reads = made
    r = reads.records
    assert overlap.scan(r, ".").count() == len(LINES) and [x.qname for x in overlap.scan(r, "*").collect()] == ["r3"]
    assert sorted(x.qname for x in overlap.scan(r, "chr19:110-110").collect()) == ["r1", "r5", "r6"]
    assert {x.rname: (x.mapped, x.unmapped) for x in summary.reference_counts(r).collect()} == {"chr19": (5, 0), "chr5": (1, 0), "*": (0, 1)}
    depth = {(x.rname, x.pos): x.depth for x in summary.depth(r).collect()}
    assert depth["chr19", 100] == 3 and depth["chr19", 154] == 2 and depth["chr19", 155] == 1 and depth["chr19", 40014] == 1 and ("chr19", 40015) not in depth
    assert summary.samples_depth({"a": r, "b": r.filter("qname = 'r6'")}).filter("rname = 'chr19' and pos = 100").first().b == 1


def test_binned_join_is_the_plain_one(spark):
    rows = spark.range(400).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("rname"), (F.col("id") * 37 % 1000).cast("int").alias("pos"), F.concat((1 + F.col("id") % 90).cast("string"), F.lit("M")).alias("cigar"), F.lit(0).alias("flag"), F.col("id").alias("voffset"))
    wanted = spark.range(60).select(F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("seqnames"), (1 + F.col("id") * 53 % 1000).alias("start"), (1 + F.col("id") * 53 % 1000 + F.col("id") % 70).alias("end"))
    for how in ("inner", "left_semi"):
        plain, binned = overlap.joined(rows, wanted, how), overlap.joined(rows, wanted, how, few=0, width=32)
        assert plain.exceptAll(binned.select(*plain.columns)).isEmpty() and plain.count() == binned.count() > 0


def test_semi_join_makes_no_pairs(spark):
    """3,000 records and 1,500 regions around one place: no join gives more rows than there are records."""
    rows = spark.range(3000).select("id", F.lit("c").alias("rname"), (F.col("id") % 40).cast("int").alias("pos"), F.lit("20M").alias("cigar"), F.lit(0).alias("flag"))
    wanted = spark.range(1500).select(F.lit("c").alias("seqnames"), (30 + F.col("id") % 20).alias("start"), (31 + F.col("id") % 20).alias("end"))
    found = overlap.joined(rows, wanted, "left_semi", few=0, width=16)
    made = []

    def walk(node):
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            made.append(metrics.apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())

    assert len(found.collect()) == 3000 - 3000 // 40 * 10
    walk(found._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 3000


def test_repeated_and_null_offsets_lose_no_row(spark):
    rows = spark.range(40).select(F.lit("c").alias("rname"), F.lit(5).alias("pos"), F.lit("9M").alias("cigar"), F.lit(0).alias("flag"), F.when(F.col("id") < 20, F.col("id") % 3).alias("voffset"))
    wanted = spark.createDataFrame([("c", 1, 9), ("c", 3, 30)], "seqnames string, start long, end long")
    for few in (0, 10):
        assert overlap.joined(rows, wanted, "left_semi", few=few, width=4).count() == 40


def test_counted_regions_are_those_of_the_join(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("rname"), (F.col("id") * 37 % 1000).cast("int").alias("pos"), F.concat((1 + F.col("id") % 90).cast("string"), F.lit("M")).alias("cigar"), F.lit(0).alias("flag"))
    wanted = spark.range(60).select(F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("seqnames"), (1 + F.col("id") * 53 % 1000).alias("start"), (1 + F.col("id") * 53 % 1000 + F.col("id") % 70).alias("end"))
    plain = {r.id: r["count"] for r in overlap.joined(rows, wanted).groupBy("id").count().collect()}
    for width in (16, 1024):
        assert {r.id: r.n_regions for r in overlap.counted(rows, wanted, width).collect()} == plain


def test_binned_intervals(spark):
    left = spark.range(50).select(F.lit("c").alias("seqnames"), (F.col("id") * 37 % 100).alias("start"), (F.col("id") * 37 % 100 + F.col("id") % 20).alias("end"), "id")
    plain = overlap.intervals(left, left)
    binned = overlap.intervals(left, left, few=3, width=8)
    assert binned.count() == plain.count() > 50 and plain.exceptAll(binned.select(*plain.columns)).isEmpty()


def test_short_intervals_are_not_repeated_by_bins(spark):
    """Where most intervals of the left side reach into a second bin, each of them is shuffled once."""
    rng = __import__("random").Random(5)
    made = lambda n, most: [("cd"[rng.randrange(2)], a := rng.randrange(-40, 300), a + rng.randrange(-3, most), k) for k in range(n)]
    schema = "seqnames string, start long, end long, id long"
    right = spark.createDataFrame(made(60, 40), schema)
    for most, generated in ((8, 1), (30, 2), (1, 2)):
        left = spark.createDataFrame([(c, a, a + 5 if most == 8 else b, k) for c, a, b, k in made(300, most)], schema)
        plain, binned = overlap.intervals(left, right), overlap.intervals(left, right, few=0, width=8)
        assert plain.exceptAll(binned.select(*plain.columns)).isEmpty() and plain.count() == binned.count() > 100
        assert binned._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == generated
    assert overlap.intervals(left.limit(0), right, few=0, width=8).isEmpty() and overlap.intervals(left, right.limit(0), few=0, width=8).isEmpty()


def test_numbers_and_missing_tags_are_found(spark, made, tmp_path):
    path, _ = made
    reads = Alignments(spark, path, str(tmp_path / "index"))
    reads.build_index("NM", "BX", "X6")
    assert [r.qname for r in reads.by_tag("NM", 3, output="table").collect()] == ["r1"]
    assert [r.qname for r in reads.by_tag("X6", 2**32 - 1, output="table").collect()] == ["r2"]
    assert sorted(r.qname for r in reads.by_bx("*", output="table").collect()) == ["r3", "r6"]


def test_interval_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# c\ntrack x\nchr1\t0\t10\tname\nchr2\t5\t6\n")
    assert [(r.seqnames, r.start, r.end) for r in intervals.read(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 1, 10), ("chr2", 6, 6)]
    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\n\nGG\n")
    assert {r.name: r.seq for r in intervals.fasta(spark, str(tmp_path / "a.fa")).collect()} == {"one": "ACGTAC", "two": "GG"}
    got = summary.subsequence(intervals.fasta(spark, str(tmp_path / "a.fa")), spark.createDataFrame([("one", 2, 5)], "seqnames string, start int, end int"))
    assert got.first().seq == "CGTA"
    (tmp_path / "n.txt").write_text("a\n\n b \n")
    assert [r.name for r in intervals.names(spark, str(tmp_path / "n.txt")).collect()] == ["a", "b"]
    assert intervals.sniff(spark, str(tmp_path / "a.fa")) == "fasta"


def test_index_follows_new_files(spark, made, tmp_path):
    _, reads = made
    rows = reads.records
    for k in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        append.follow(spark, str(tmp_path / "in"), str(tmp_path / "ix"), "BX", str(tmp_path / "cp")).awaitTermination(60)
        assert index.opened(spark, str(tmp_path / "ix"), "BX").count() == (k + 1) * len(LINES)


def test_command_line(spark, made, capsys, tmp_path):
    path, _ = made
    assert cli.main(["build", "-f", path, "-i", str(tmp_path / "ix")]) == 0
    capsys.readouterr()
    cli.main(["lookup", "-f", path, "-i", str(tmp_path / "ix"), "-n", "1", "AAA-1"])
    assert capsys.readouterr().out.startswith("r1\t")
    cli.main(["list", "-f", path, "-i", str(tmp_path / "ix")])
    assert capsys.readouterr().out.split() == ["BX", "QNAME"]


AUX = "map<string,struct<t:string,i:bigint,f:double,s:string,ia:array<bigint>,fa:array<double>>>"


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A sorted BAM file of many blocks, some of whose records fill several, written in one part, and its index."""
    path = str(tmp_path_factory.mktemp("large") / "b")
    i = F.col("id")
    long = F.when(i % 997 == 5, 200_000).when(i % 13 == 0, 300).otherwise(40).cast("int")
    bx = F.struct(F.lit("Z").alias("t"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("f"), F.concat(F.lit("B"), (i % 211).cast("string")).alias("s"), F.lit(None).cast("array<bigint>").alias("ia"), F.lit(None).cast("array<double>").alias("fa"))
    nm = F.struct(F.lit("i").alias("t"), (i % 50).alias("i"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("array<bigint>").alias("ia"), F.lit(None).cast("array<double>").alias("fa"))
    rows = spark.range(8000).select(F.concat(F.lit("q"), i).alias("qname"), F.when(i % 17 == 3, 4).otherwise(0).alias("flag"), F.when(i < 5000, "chr19").otherwise("chr5").alias("rname"), (i * 700 % 3_500_000).cast("int").alias("pos"), F.lit(60).alias("mapq"), F.concat(long.cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.substring(F.repeat(F.sha2(i.cast("string"), 256), 4000), 1, 0).alias("none"), F.translate(F.substring(F.repeat(F.sha2(i.cast("string"), 512), 1600), 1, 200_000), "0123456789abcdef", "ACGTNACGTNACGTNA").substr(F.lit(1), long).alias("seq"), F.lit("*").alias("qual"), F.create_map(F.lit("BX"), bx, F.lit("NM"), nm).cast(AUX).alias("aux"))
    bam.write(rows.drop("none").coalesce(1), path, references='[["chr19", 4000000], ["chr5", 4000000]]')
    reads = Alignments(spark, path)
    reads.build_index("BX", "NM")
    reads.build_coordinates()
    return path, reads


def test_any_split_gives_all_records_once(spark, large):
    path, _ = large
    (file,) = bam.files(path)
    whole = [(at, len(body)) for _, at, body, _ in bam.scanned(file)]
    assert len(whole) == 8000 and max(n for _, n in whole) > 2 << 16
    size = os.path.getsize(file)
    rng = __import__("random").Random(4)
    for splits in (2, 7, 40, 333):
        cuts = sorted({0, *(rng.randrange(1, size) for _ in range(splits))})
        found = [(at, len(body)) for a, b in zip(cuts, [*cuts[1:], None], strict=True) for _, at, body, _ in bam.scanned(file, a, b)]
        assert found == whole
    frame = bam.read(spark, path, split_bytes=50_000)
    assert frame.rdd.getNumPartitions() == -(-size // 50_000) and sorted(r.voffset for r in frame.select("voffset").collect()) == [at for at, _ in whole]


def test_lookups_inflate_only_their_blocks(spark, large):
    path, reads = large
    (file,) = bam.files(path)
    places = reads.records.filter("qname in ('q5', 'q6', 'q4000', 'q7990')").select("file", "voffset")
    tally = spark.sparkContext.accumulator(0)
    assert sorted(r.qname for r in bam.fetched(spark, places, tally=tally).collect()) == ["q4000", "q5", "q6", "q7990"]
    with open(file, "rb") as f:
        n, at = 0, 0
        while found := bgzf.block(f, at):
            n, at = n + 1, found[1]
    assert 0 < tally.value <= 12 < n / 3
    plan = reads.by_bx("B7", output="table")._jdf.queryExecution().toString()
    assert "BatchScan bam" not in plan and "MapInArrow" in plan
    assert {r.qname for r in reads.by_bx("B7", output="table").collect()} == {f"q{i}" for i in range(7, 8000, 211)}
    assert reads.by_tag("NM", [7, 8, 7]).count() == 480


def test_a_filter_leaves_later_reads_alone(spark, large):
    _, reads = large
    frame = reads.records
    some = [r.voffset for r in frame.select("voffset").limit(3).collect()]
    assert frame.filter(F.col("voffset").isin(some)).count() == 3
    assert frame.count() == 8000 and frame.filter(F.col("voffset") == some[0]).count() == 1 and frame.count() == 8000


def test_regions_read_only_their_chunks(spark, large):
    _, reads = large
    rng = __import__("random").Random(9)
    texts = ["chr19:1-1", "chr5", "chr19:3000000-", "chr19:1500001-1500001", "chr7:1-9"]
    for _ in range(6):
        a = rng.randrange(1, 3_500_000)
        texts.append(f"chr{rng.choice((5, 19))}:{a}-{a + rng.choice((0, 50, 3000, 200_000))}")
    every = coordinates.opened(spark, reads.index_path)
    assert every.agg(F.sum("n")).first()[0] == 8000
    for text in texts:
        wanted = sorted(r.qname for r in overlap.scan(reads.records, text).collect())
        assert sorted(r.qname for r in reads.by_region([text], output="table").collect()) == wanted
    assert sorted(r.qname for r in reads.by_region(texts, output="table").collect()) == sorted({r.qname for t in texts for r in overlap.scan(reads.records, t).collect()})
    tally = spark.sparkContext.accumulator(0)
    from tagloom.functions import regions

    assert coordinates.reads(spark, reads.index_path, regions.table(spark, ["chr5:700001-720000"]), tally=tally).count() > 10
    assert tally.value < 12
    assert sorted(r.BX for r in reads.by_bx(regions=["chr5:700001-700500"], output="table").select("BX").distinct().collect()) == sorted({r.bx for r in overlap.scan(reads.records, "chr5:700001-700500").selectExpr("element_at(aux, 'BX').s as bx").collect()})


def test_inverted_regions_overlap_nothing(spark):
    rows = spark.createDataFrame([("c", 10, "20M", 0, 1), ("c", 100, "20M", 0, 2)], "rname string, pos int, cigar string, flag int, id int")
    wanted = spark.createDataFrame([("c", 25, 15), ("c", 110, 110), ("c", 1, 0)], "seqnames string, start long, end long")
    for few in (0, 10):
        assert [r.id for r in overlap.joined(rows, wanted, few=few, width=4).collect()] == [2]
        assert [r.id for r in overlap.joined(rows, wanted, "left_semi", few=few, width=4).collect()] == [2]
        assert overlap.intervals(wanted, wanted, few=few, width=4).count() == 1
    assert [(r.id, r.n_regions) for r in overlap.counted(rows, wanted, 4).collect()] == [(2, 1)]


def test_all_ways_of_indexing_have_one_key(spark, made, capsys, tmp_path):
    path, reads = made
    assert cli.main(["build", "-f", path, "-i", str(tmp_path / "a"), "-t", "NM", "-t", "BX"]) == 0
    capsys.readouterr()
    cli.main(["lookup", "-f", path, "-i", str(tmp_path / "a"), "-t", "NM", "3"])
    assert capsys.readouterr().out.startswith("r1\t")
    reads.records.write.parquet(str(tmp_path / "in"))
    append.follow(spark, str(tmp_path / "in"), str(tmp_path / "b"), ["NM", "BX"], str(tmp_path / "cp")).awaitTermination(60)
    for name in ("NM", "BX", "QNAME"):
        one, other = (index.opened(spark, str(tmp_path / x), name).orderBy("key", "voffset").collect() for x in "ab")
        assert one == other and len(one) == len(LINES)
    assert index.counted(index.opened(spark, str(tmp_path / "b"), "NM")).filter("key = '3'").first().n == 1


def test_several_files_under_one_index(spark, made, tmp_path):
    _, reads = made
    bam.write(reads.records.repartition(3, "qname"), str(tmp_path / "m"), header=HEADER)
    both = Alignments(spark, str(tmp_path / "m"), str(tmp_path / "ix"))
    both.build_index("BX")
    assert len(bam.files(str(tmp_path / "m"))) > 1
    assert sorted(r.flag for r in both.by_bx("AAA-1", output="table").collect()) == [97, 145]
    assert sum(r.n for r in index.counted(index.opened(spark, str(tmp_path / "ix"), "BX")).collect()) == len(LINES)
    both.write_subset(both.by_bx("AAA-1", output="table").select("file", "voffset"), str(tmp_path / "sub"))
    assert bam.read(spark, str(tmp_path / "sub")).count() == 2
    with pytest.raises(ValueError):
        both.write_subset(both.by_bx("AAA-1", output="table").select("voffset"), str(tmp_path / "sub2"))


def test_files_are_read_by_what_they_hold(spark, made, tmp_path):
    path, reads = made
    sam.write(reads.records.coalesce(1), str(tmp_path / "text"), HEADER)
    (tmp_path / "v.txt").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t5\t.\tA\tC\t.\t.\t.\n")
    (tmp_path / "s.fa").write_text(">a\nACGT\n")
    (tmp_path / "odd").write_text("nothing known")
    os.rename(path, path + ".x")
    try:
        assert formats.kind(spark, path + ".x") == "bam" and formats.records(spark, path + ".x", "BX:Z").filter("BX = 'AAA-1'").count() == 2
    finally:
        os.rename(path + ".x", path)
    assert formats.kind(spark, str(tmp_path / "text")) == "sam" and formats.records(spark, str(tmp_path / "text")).count() == len(LINES)
    assert formats.records(spark, path).columns == formats.records(spark, str(tmp_path / "text")).columns
    assert formats.read(spark, str(tmp_path / "v.txt")).first().pos == 5 and formats.read(spark, str(tmp_path / "s.fa")).first().seq == "ACGT"
    for p in ("odd", "s.fa"):
        with pytest.raises(ValueError, match="text|fasta"):
            formats.records(spark, str(tmp_path / p))
