"""Queries of the alignment operators over records made from the events table, and their SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, cigar, exact, flags, ranges, regions, tags, variants
from ..operators import index, overlap, pileup, sites, summary
from ..operators.lookup import Alignments, by_keys, region_keys
from ..sources import bam, sequences, vcf

Query = Callable[[SparkSession, str], DataFrame]

READS = """
SELECT event_id, 'r' || CAST(event_id // 2 AS VARCHAR) AS qname, CAST((event_id * 37) % 4096 AS INTEGER) AS flag, event_type AS rname,
  CAST(floor(value) AS BIGINT) AS pos,
  CAST(20 + event_id % 80 AS VARCHAR) || 'M' || CAST(1 + event_id % 9 AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN 'D' ELSE 'I' END || CAST(event_id % 30 AS VARCHAR) || 'S' AS cigar,
  'BX' || CAST(user_id AS VARCHAR) || '-1' AS BX, CAST(json_extract_string(props, '$.k') AS INTEGER) AS XK
FROM events"""
REGION, LENGTH = "click:100-110", 20


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment records made from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    return e.select(
        i,
        F.concat(F.lit("r"), F.expr("event_id div 2").cast("string")).alias("qname"),
        (i * 37 % 4096).cast("int").alias("flag"),
        F.col("event_type").alias("rname"),
        F.floor("value").cast("bigint").alias("pos"),
        F.concat((20 + i % 80).cast("string"), F.lit("M"), (1 + i % 9).cast("string"), F.when(i % 3 == 0, "D").otherwise("I"), (i % 30).cast("string"), F.lit("S")).alias("cigar"),
        F.concat(F.lit("BX"), F.col("user_id").cast("string"), F.lit("-1")).alias("BX"),
        F.get_json_object("props", "$.k").cast("int").alias("XK"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as ungapped ones of LENGTH bases whose pos counts from 1, in raw coordinates."""
    return reads(spark, sf_dir).withColumns({"pos": F.col("pos") - 1, "cigar": F.lit(f"{LENGTH}M")})


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads with a tag map: BX, missing from every seventh, and XK."""
    bx = F.when(F.col("event_id") % 7 != 0, tags.value("Z", F.col("BX")))
    entries = F.array(F.struct(F.lit("BX").alias("k"), bx.alias("v")), F.struct(F.lit("XK").alias("k"), tags.value("i", F.col("XK")).alias("v")))
    return reads(spark, sf_dir).withColumn("aux", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))).withColumn("voffset", F.col("event_id") * 65536)


def some(spark: SparkSession, *texts: str) -> DataFrame:
    return regions.table(spark, list(texts))


def q01_tag_lookup(spark, sf_dir):
    return by_keys(reads(spark, sf_dir), "BX", ["BX8-1"]).select("event_id", "qname", "BX")


def q02_tag_in_list(spark, sf_dir):
    return by_keys(reads(spark, sf_dir), "BX", ["BX1-1", "BX8-1", "BX12-1", "absent"]).select("event_id", "BX")


def q03_tag_bag(spark, sf_dir):
    return by_keys(reads(spark, sf_dir), "BX", ["BX1-1", "BX8-1", "BX1-1", "absent"]).select("event_id", "BX")


def q04_region_scan(spark, sf_dir):
    return overlap.joined(placed(spark, sf_dir), some(spark, REGION)).select("event_id", (F.col("pos") + 1).alias("pos"), "BX")


def q05_region_to_tag(spark, sf_dir):
    rows = placed(spark, sf_dir)
    return by_keys(rows, "BX", region_keys(rows.withColumn("flag", F.lit(0)), "BX", some(spark, REGION))).select("event_id", "BX")


def q06_region_to_tag_distinct(spark, sf_dir):
    rows = placed(spark, sf_dir)
    return by_keys(rows, "BX", region_keys(rows.withColumn("flag", F.lit(0)), "BX", some(spark, REGION)), distinct_keys=True).select("event_id", "BX")


def q07_style_normalise(spark, sf_dir):
    rows = placed(spark, sf_dir)
    wanted = regions.restyled(some(spark, "chrview:50-60", "click:100-110", "chrnone:1-5"), rows.select(F.col("rname").alias("name")).distinct())
    return overlap.joined(rows, wanted).select("event_id", "rname")


def q08_cigar_counts(spark, sf_dir):
    return reads(spark, sf_dir).select("event_id", *cigar.counts(F.col("cigar")))


def q09_flag_bits(spark, sf_dir):
    return reads(spark, sf_dir).select("event_id", *flags.bits(F.col("flag")))


def q10_to_ranges(spark, sf_dir):
    return ranges.to_ranges(reads(spark, sf_dir)).select("event_id", "seqnames", "start", "end", "width", "strand")


def q11_unmapped_rule(spark, sf_dir):
    return ranges.to_ranges(reads(spark, sf_dir).filter(flags.has(F.col("flag"), flags.UNMAPPED))).select("event_id", "start", "end", "strand")


def q12_index_build(spark, sf_dir):
    return index.entries(tagged(spark, sf_dir), "BX")


def q13_index_missing_bucket(spark, sf_dir):
    return index.matches(index.entries(tagged(spark, sf_dir), "BX"), [tags.MISSING])


def q14_qname_lookup(spark, sf_dir):
    return by_keys(reads(spark, sf_dir), "qname", ["r5", "r77", "absent"]).select("event_id", "qname")


def q15_keys_per_tag(spark, sf_dir):
    return index.counted(index.entries(tagged(spark, sf_dir), "BX"))


def q16_region_summary(spark, sf_dir):
    return summary.region_summary(overlap.joined(placed(spark, sf_dir), some(spark, REGION)), "BX")


def q17_union_fill(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return rows.filter("event_id % 2 = 0").select("event_id", "BX").unionByName(rows.filter("event_id % 2 = 1").select("event_id", "XK"), allowMissingColumns=True)


def q18_ref_query_len(spark, sf_dir):
    c = F.col("cigar")
    return reads(spark, sf_dir).select("event_id", cigar.reference_length(c).alias("ref_len"), cigar.query_length(c).alias("query_len"), cigar.reference_end(F.col("pos"), c).alias("ref_end"))


def q19_tag_projection(spark, sf_dir):
    return tagged(spark, sf_dir).select("event_id", tags.get(F.col("aux"), "BX").alias("BX"), tags.get(F.col("aux"), "XK", "i").alias("XK"), tags.as_text(F.col("aux"), "XK").alias("xk_text"))


def q20_limit_sorted(spark, sf_dir):
    return reads(spark, sf_dir).orderBy("rname", "pos", "event_id").limit(50).select("event_id", "rname", "pos")


def q21_ref_stats(spark, sf_dir):
    return summary.reference_counts(reads(spark, sf_dir))


def q22_flag_text(spark, sf_dir):
    return reads(spark, sf_dir).select("event_id", flags.text(F.col("flag")).alias("flag_text"), flags.parsed(flags.text(F.col("flag"))).alias("flag"))


def q23_pileup_depth(spark, sf_dir):
    return summary.depth(reads(spark, sf_dir))


def q24_interval_overlap(spark, sf_dir):
    left = reads(spark, sf_dir).select(F.col("rname").alias("seqnames"), F.col("pos").alias("start"), (F.col("pos") + 5).alias("end"), F.col("event_id").alias("id"))
    right = spark.createDataFrame([("click", 1, 3, 1), ("click", 40, 60, 2), ("view", 90, 90, 3), ("purchase", 5, 20, 4)], "seqnames string, start bigint, end bigint, id bigint")
    return overlap.intervals(left, right).select("id", F.col("other_id").alias("region_id"))


def q25_multi_region_dedup(spark, sf_dir):
    return overlap.joined(placed(spark, sf_dir), some(spark, "click:100-110", "click:105-130", "view:10-30"), "left_semi").select("event_id")


def q26_cigar_star_null(spark, sf_dir):
    c = F.when(F.col("event_id") % 5 == 0, "*").otherwise(F.col("cigar"))
    return reads(spark, sf_dir).select("event_id", cigar.without_star(c).alias("cigar"))


def q27_region_parse(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(F.lit("chr"), (i % 5).cast("string"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit(":1,"), F.lpad((i % 1000).cast("string"), 3, "0"))), F.when(i % 4 == 2, "-").when(i % 4 == 3, "-2,500,000").otherwise(""))
    return reads(spark, sf_dir).select("event_id", *regions.parsed(text))


def q28_variant_type(spark, sf_dir):
    """Alleles of one to four bases cut from two texts by the read's number, and the special ones."""
    special = F.element_at(F.array(*map(F.lit, SPECIAL)), (F.col("event_id") % 10 + 1).cast("int"))
    rows = reads(spark, sf_dir).select("event_id", F.expr("substring('ACGTTGCAACGGT', cast(1 + event_id % 7 as int), cast(1 + event_id % 4 as int))").alias("ref"), F.expr("substring('ACTTaGCATCGG', cast(1 + event_id div 4 % 6 as int), cast(1 + event_id div 16 % 4 as int))").alias("alt"))
    return rows.select("event_id", variants.kind(F.col("ref"), F.when(F.col("event_id") % 11 == 0, special).otherwise(F.col("alt"))).alias("kind"))


def q31_binned_semi(spark, sf_dir):
    """Each read once that overlaps one of many regions, by bins."""
    rows = placed(spark, sf_dir).withColumn("voffset", F.lit(None).cast("bigint"))
    wanted = rows.select(F.col("rname").alias("seqnames"), (F.col("pos") + 30).alias("start"), (F.col("pos") + 31).alias("end"))
    return overlap.joined(rows, wanted, "left_semi", few=0, width=16).select("event_id")


def q29_binned_overlap(spark, sf_dir):
    rows = placed(spark, sf_dir)
    wanted = rows.select(F.col("rname").alias("seqnames"), (F.col("pos") + 1).alias("start"), (F.col("pos") + 4).alias("end"))
    return overlap.counted(rows, wanted).select("event_id", "n_regions")


def q30_tag_update(spark, sf_dir):
    changed = tags.put(tags.drop(F.col("aux"), "XK"), "NM", "i", F.col("event_id") % 3)
    return tagged(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.map_keys(changed)), ",").alias("tags"), tags.get(changed, "NM", "i").alias("nm"))


def as_bam(spark, sf_dir, parts: int = 8) -> str:
    """The path of the reads written as BAM files in the shared folder."""
    path = f"{shared(spark)}/reads-{uuid.uuid4().hex}"
    rows = tagged(spark, sf_dir).select("qname", "flag", "rname", F.col("pos").cast("int").alias("pos"), F.lit(60).alias("mapq"), "cigar", F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.lit("*").alias("seq"), F.lit("*").alias("qual"), "aux")
    bam.write(rows.repartitionByRange(parts, "rname", "pos").sortWithinPartitions("rname", "pos"), path)
    return path


def seen(records: DataFrame, *more: str) -> DataFrame:
    return records.select(*more, "qname", "flag", "rname", "pos", "cigar", tags.as_text(F.col("aux"), "BX").alias("bx"), tags.as_text(F.col("aux"), "XK").alias("xk"))


def finished(found: DataFrame, *paths: str) -> DataFrame:
    """A result, computed, without the files that it was made from."""
    spark, out = found.sparkSession, f"{shared(found.sparkSession)}/found-{uuid.uuid4().hex}"
    found.write.parquet(out)
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(found.schema).parquet(out)


def q32_bam_lookup(spark, sf_dir):
    """The reads written as BAM files, indexed, and sought by tag values and by the lack of one."""
    path = as_bam(spark, sf_dir)
    found = Alignments(spark, path, f"{path}-index")
    found.build_index("BX", "XK")
    by_value = found.by_bx(["BX8-1", "BX12-1", "*"], output="table").withColumn("by", F.lit("BX"))
    by_number = found.by_tag("XK", 7, output="table").withColumn("by", F.lit("XK"))
    return finished(seen(by_value.unionByName(by_number, allowMissingColumns=True), "by"), path, f"{path}-index")


def q33_read_after_seek(spark, sf_dir):
    """Records sought by name, a filter on places, and all records, from one DataFrame of BAM files."""
    path = as_bam(spark, sf_dir)
    reads_ = Alignments(spark, path, f"{path}-index")
    reads_.build_index("BX")
    sought = reads_.by_qname(["r5", "r77"], output="table")
    places = reads_.records.filter("qname in ('r8', 'r9')").select("file", "voffset").collect()
    here = reads_.records.filter(F.col("voffset").isin([r["voffset"] for r in places]) & F.col("file").isin([r["file"] for r in places]) & F.col("qname").isin("r8", "r9"))
    parts = [seen(x.withColumn("by", F.lit(n)), "by") for n, x in (("name", sought), ("place", here), ("all", reads_.records))]
    return finished(parts[0].union(parts[1]).union(parts[2]), path, f"{path}-index")


def q34_split_scan(spark, sf_dir):
    """All records of BAM files that are read in small ranges of bytes, with their files' and places' number checked by the count of different ones."""
    path = as_bam(spark, sf_dir)
    rows = bam.read(spark, path, split_bytes=20_000)
    return finished(seen(rows.dropDuplicates(["file", "voffset"])), path)


def q35_region_index(spark, sf_dir):
    """Mapped reads in some regions, each once, by the coordinate index."""
    path = as_bam(spark, sf_dir)
    found = Alignments(spark, path, f"{path}-index")
    found.build_coordinates()
    return finished(seen(found.by_region(["click:100-110", "click:105-130", "view:10-", "purchase"], output="table")), path, f"{path}-index")


def q36_inverted_regions(spark, sf_dir):
    """Reads by regions some of which end before they start, by broadcast, by bins, and counted."""
    rows = placed(spark, sf_dir)
    wanted = rows.select(F.col("rname").alias("seqnames"), (F.col("pos") + 30).alias("start"), (F.col("pos") + 26 + F.col("event_id") % 9).alias("end")).filter("start % 4 = 0").distinct()
    parts = [overlap.joined(rows, wanted, few=few, width=16).groupBy("event_id").agg(F.count("*").alias("n_regions")).withColumn("by", F.lit(by)) for by, few in (("few", 1 << 30), ("many", 0))]
    return parts[0].union(parts[1]).union(overlap.counted(rows, wanted, 16).select("event_id", "n_regions").withColumn("by", F.lit("count")))


def q37_binned_intervals(spark, sf_dir):
    """Pairs of intervals that overlap, by bins."""
    e = reads(spark, sf_dir).filter("rname <> 'view'")
    left = e.select(F.col("rname").alias("seqnames"), F.col("pos").alias("start"), (F.col("pos") + 5).alias("end"), F.col("event_id").alias("id"))
    right = e.groupBy(F.col("rname").alias("seqnames"), F.col("BX").alias("id")).agg(F.max("pos").alias("start"), (F.max("pos") + F.count("*") - 3).alias("end"))
    return overlap.intervals(left, right, few=0, width=8).select("id", F.col("other_id").alias("bx"))


def sequenced(spark, sf_dir):
    """The reads with bases and qualities made from their numbers."""
    c, i = F.col("cigar"), F.col("event_id").cast("string")
    n = cigar.query_length(c).cast("int")
    made = lambda text, letters: F.substr(F.repeat(F.translate(F.md5(text.cast("binary")), "0123456789abcdef", letters), 5), F.lit(1), n)
    return reads(spark, sf_dir).withColumns({"seq": made(i, "ACGTACGTACGTACGN"), "qual": made(F.concat(F.lit("q"), i), "#+5?IIIIFFFF,,::")})


def q38_base_counts(spark, sf_dir):
    """Bases of each position, of quality 20 and more."""
    return pileup.base_counts(sequenced(spark, sf_dir), least_quality=20)


def q39_mate_overlap(spark, sf_dir):
    """Positions of mates that overlap, with the qualities that are left of their bases."""
    rows = sequenced(spark, sf_dir)
    pair = F.expr("event_id div 2")
    mates = rows.withColumns({"rname": F.concat(F.lit("ref"), (pair % 7).cast("string")), "pos": (pair * 37 % 5000 + F.col("event_id") % 2 * (pair % 70)).cast("int"), "cigar": F.lit("20M2D20M"), "flag": F.when(F.col("event_id") % 2 == 0, 99).otherwise(147), "tlen": F.lit(60), "seq": F.substring(F.repeat("seq", 3), 1, 40), "qual": F.substring(F.repeat("qual", 3), 1, 40)})
    cells = pileup.stacked(mates, keep=(), overlaps=True, only=("pos", "qual"))
    return cells.groupBy("rname", "pos").agg(F.count("*").alias("n"), F.sum("qual").alias("total"), F.count_if(F.col("qual") == 0).alias("zeros"))


def q40_sequence_ranges(spark, sf_dir):
    """A FASTA file with a sequence for each user, and a range of it for each of their events, from chunks of 100 bases."""
    top = f"{shared(spark)}/fasta-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    bases = F.translate(F.md5(F.col("event_id").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    whole = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", bases.alias("b")))), lambda x: x["b"]), "\n").alias("lines"))
    whole.select(F.concat(F.lit(">u"), F.col("user_id").cast("string"), F.lit(" user\n"), "lines").alias("value")).repartition(2).write.text(f"{top}/text")
    files = [r["path"] for r in spark.read.format("binaryFile").load(f"{top}/text/*.txt").select("path").collect()]
    sequences.build(spark, ",".join(f.replace("file:///", "/") for f in files), f"{top}/chunks", chunk=100, split_bytes=50_000)
    wanted = e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("seqnames"), (F.col("event_id") % 400 - 5).alias("start"), (F.col("event_id") % 400 + F.col("event_id") % 150).alias("end"))
    return finished(sequences.fetched(spark.read.parquet(f"{top}/chunks"), wanted, 100), top)


VCF_HEAD = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="user">
##INFO=<ID=AF,Number=A,Type=Float,Description="shares">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depths">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"""


def variant_lines(spark, sf_dir):
    """Variant records as text: one or two alternative alleles and two samples for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("u"), "event_type")
    i, two = F.col("event_id"), F.col("event_id") % 3 == 0
    allele = lambda k: (F.floor(i / k) % F.when(two, 3).otherwise(2)).cast("string")
    sample = lambda a, b: F.concat(a, F.when(i % 5 == 0, "|").otherwise("/"), b, F.lit(":"), F.when(i % 7 == 0, ".").otherwise(F.concat_ws(",", (i % 11).cast("string"), (i % 13).cast("string"), F.when(two, (i % 17).cast("string")))))
    info = F.concat_ws(";", F.concat(F.lit("DP="), "u"), F.when(i % 2 == 0, F.when(two, "AF=0.25,.").otherwise("AF=0.5")), F.when(i % 4 == 0, "DB"))
    return e.select(F.concat_ws("\t", "event_type", (i + 1).cast("string"), F.when(i % 6 == 0, ".").otherwise(F.concat(F.lit("rs"), i.cast("string"))), F.lit("A"), F.when(two, "C,G").otherwise("T"), F.when(i % 10 == 0, ".").otherwise(((i % 100) / 4).cast("string")), F.lit("PASS"), info, F.lit("GT:AD"), sample(allele(1), allele(2)), sample(F.when(i % 9 == 0, ".").otherwise(allele(4)), allele(8))).alias("value"))


def q41_variant_text(spark, sf_dir):
    """Variant records written as text, read by the header's types, and seen by field."""
    path, head = f"{shared(spark)}/variants-{uuid.uuid4().hex}", vcf.parsed_header(VCF_HEAD)
    vcf.write(vcf.parsed(variant_lines(spark, sf_dir), head), path, head)
    rows = vcf.read(spark, path)
    s = lambda k, f: F.get("samples", F.lit(k)).getField(f)
    seen_ = rows.select("chrom", "pos", F.get("id", F.lit(0)).alias("id"), F.size("alt").alias("n_alt"), "qual", F.col("info.DP").alias("dp"), F.get("info.AF", F.lit(0)).alias("af"), F.size(F.coalesce("info.AF", F.array().cast("array<double>"))).alias("n_af"), F.col("info.DB").alias("db"), s(0, "GT").alias("gt"), F.get(s(1, "AD"), F.lit(1)).alias("ad"))
    return finished(seen_, path)


def q42_genotypes(spark, sf_dir):
    """Allele counts and kinds of genotypes, and what is left of alleles that some sample has."""
    head = vcf.parsed_header(VCF_HEAD)
    rows = vcf.parsed(variant_lines(spark, sf_dir), head)
    gts = F.transform("samples", lambda s: s.getField("GT"))
    counted = rows.withColumns({"n": alleles.counts(gts, F.col("alt")), "kinds": F.array_join(F.transform(gts, alleles.kind), " ")})
    left = alleles.trimmed(counted, head)
    return left.select("pos", F.array_join(F.col("n").cast("array<string>"), ",").alias("n"), "kinds", F.array_join("alt", ",").alias("alt"), F.get(gts, F.lit(1)).alias("gt"), F.array_join(F.get("samples", F.lit(0)).getField("AD").cast("array<string>"), ",").alias("ad"))


def q43_sites_side_by_side(spark, sf_dir):
    """Variants of even and of odd events of the same positions, paired by equal alleles, by an allele in common, and by position alone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("i"), "event_type")
    alts = F.array(*(F.array(*map(F.lit, a)) for a in SIDE_ALTS))
    # The even event of a pair tells the reference of both.
    rows = e.select("i", F.expr("cast(i div 2 as int)").alias("pos"), F.lit("A").alias("ref"), F.get(alts, (F.expr("i * 7 + i div 2") % len(SIDE_ALTS)).cast("int")).alias("alt")).withColumn("chrom", F.lit("c"))
    files = {n: rows.filter(F.col("i") % 2 == k).select("chrom", "pos", "ref", "alt") for k, n in enumerate(("even", "odd"))}
    text = lambda n: F.array_join(n, ",").alias(n)
    parts = [sites.side_by_side(files, m).select(F.lit(m).alias("mode"), "chrom", "pos", text("even"), text("odd")) for m in ("exact", "some", "any")]
    return parts[0].union(parts[1]).union(parts[2])


def q44_strand_bias(spark, sf_dir):
    """Fisher's exact test of strand by a base's group for each tag value's reads."""
    minus, high = F.col("flag").bitwiseAND(16) != 0, F.col("pos") >= 50
    table = reads(spark, sf_dir).groupBy("BX").agg(*(F.count_if(s & p).alias(n) for n, s, p in (("a", ~minus, high), ("b", ~minus, ~high), ("c", minus, high), ("d", minus, ~high))))
    test = table.withColumn("t", exact.fisher_of(*map(F.col, "abcd")))
    return test.select("BX", *"abcd", *(F.round(F.col("t")[n], 6).alias(n) for n in ("left", "right", "two")))


SIDE_ALTS = (("C",), ("G",), ("C", "G"), ("G", "C"), ("AT",), ("C", "AT"))


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "checkpoints")
    return top.rstrip("/")


SPECIAL = (".", "*", "X", "<*>", "<X>", "<NON_REF>", "<DEL>", "A[chr2:5[", "]c:1]A", "a")

QUERIES: dict[str, Query] = {k: f for k, f in sorted(globals().items()) if k[0] == "q" and k[1:3].isdigit()}

LENGTH_OF = lambda ops: f"CAST(coalesce(list_sum([CAST(x AS BIGINT) FOR x IN regexp_extract_all(cigar, '([0-9]+)[{ops}]', 1)]), 0) AS BIGINT)"
SEQUENCED = f"""SELECT *, CAST(regexp_extract(cigar, '^([0-9]+)M', 1) AS BIGINT) AS m, regexp_extract(cigar, '([DI])', 1) AS op, CAST(regexp_extract(cigar, 'M([0-9]+)', 1) AS BIGINT) AS k,
  substr(repeat(translate(md5(CAST(event_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGN'), 5), 1, {LENGTH_OF('MIS=X')}) AS seq,
  substr(repeat(translate(md5('q' || CAST(event_id AS VARCHAR)), '0123456789abcdef', '#+5?IIIIFFFF,,::'), 5), 1, {LENGTH_OF('MIS=X')}) AS qual FROM reads"""
KIND = "CASE WHEN {p} = '.' OR {q} = '.' THEN 'unknown' WHEN {p} = '0' AND {q} = '0' THEN 'hom_ref' WHEN {p} = '0' OR {q} = '0' THEN 'het_ref_alt' WHEN {p} = {q} THEN 'hom_alt' ELSE 'het_alt' END"
VARIANTS = """SELECT event_id, user_id, event_type, event_id % 3 = 0 AS two, CASE WHEN event_id % 5 = 0 THEN '|' ELSE '/' END AS sep, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS m,
  CAST(event_id % m AS VARCHAR) AS a, CAST(event_id // 2 % m AS VARCHAR) AS b, CASE WHEN event_id % 9 = 0 THEN '.' ELSE CAST(event_id // 4 % m AS VARCHAR) END AS c, CAST(event_id // 8 % m AS VARCHAR) AS d FROM events"""
ON_REF = f"greatest({LENGTH_OF('MDN=X')}, 1)"
SEEN = "SELECT qname, flag, rname, CAST(pos AS INTEGER) AS pos, cigar, CASE WHEN event_id % 7 <> 0 THEN BX END AS bx, CAST(XK AS VARCHAR) AS xk FROM reads"
REACHED = f"rname = 'click' AND pos <= 110 AND pos + {LENGTH} > 100"

_SQL = {
    "q01_tag_lookup": "SELECT event_id, qname, BX FROM reads WHERE BX = 'BX8-1'",
    "q02_tag_in_list": "SELECT event_id, BX FROM reads WHERE BX IN ('BX1-1', 'BX8-1', 'BX12-1', 'absent')",
    "q03_tag_bag": "SELECT event_id, BX FROM reads JOIN (VALUES ('BX1-1'), ('BX8-1'), ('BX1-1'), ('absent')) k(key) ON BX = key",
    "q04_region_scan": f"SELECT event_id, pos, BX FROM reads WHERE {REACHED}",
    "q05_region_to_tag": f"SELECT r.event_id, r.BX FROM reads r JOIN (SELECT BX FROM reads WHERE {REACHED}) k ON r.BX = k.BX",
    "q06_region_to_tag_distinct": f"SELECT event_id, BX FROM reads WHERE BX IN (SELECT BX FROM reads WHERE {REACHED})",
    "q07_style_normalise": f"SELECT event_id, rname FROM reads JOIN (VALUES ('chrview', 50, 60), ('click', 100, 110), ('chrnone', 1, 5)) k(n, a, b) ON rname = regexp_replace(n, '^chr', '') AND pos <= b AND pos + {LENGTH} > a",
    "q08_cigar_counts": f"SELECT event_id, {', '.join(f'{LENGTH_OF(op)} AS {op}' for op in 'DIMS')} FROM reads",
    "q09_flag_bits": "SELECT event_id, " + ", ".join(f'CAST((flag >> {i}) & 1 AS INTEGER) AS "{n}"' for i, n in enumerate(flags.NAMES)) + " FROM reads",
    "q10_to_ranges": f"""SELECT event_id, rname AS seqnames, a AS start, b AS "end", b - a + 1 AS width, CASE WHEN (flag & 4) <> 0 THEN '*' WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand
FROM (SELECT *, CASE WHEN (flag & 4) <> 0 THEN 1 ELSE pos END AS a, CASE WHEN (flag & 4) <> 0 THEN 0 ELSE pos + {LENGTH_OF('DM')} - 1 END AS b FROM reads)""",
    "q11_unmapped_rule": """SELECT event_id, CAST(1 AS BIGINT) AS start, CAST(0 AS BIGINT) AS "end", '*' AS strand FROM reads WHERE (flag & 4) <> 0""",
    "q12_index_build": "SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN '*' ELSE BX END AS key, event_id * 65536 AS voffset FROM reads",
    "q13_index_missing_bucket": "SELECT '*' AS key, event_id * 65536 AS voffset FROM reads WHERE event_id % 7 = 0",
    "q14_qname_lookup": "SELECT event_id, qname FROM reads WHERE qname IN ('r5', 'r77', 'absent')",
    "q15_keys_per_tag": "SELECT CASE WHEN event_id % 7 = 0 THEN '*' ELSE BX END AS key, count(*) AS n FROM reads GROUP BY ALL",
    "q16_region_summary": f"SELECT count(*) AS n_reads, count(DISTINCT BX) AS n_keys FROM reads WHERE {REACHED}",
    "q17_union_fill": "SELECT event_id, BX, CAST(NULL AS INTEGER) AS XK FROM reads WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, XK FROM reads WHERE event_id % 2 = 1",
    "q18_ref_query_len": f"SELECT event_id, {LENGTH_OF('MDN=X')} AS ref_len, {LENGTH_OF('MIS=X')} AS query_len, pos + greatest({LENGTH_OF('MDN=X')}, 1) AS ref_end FROM reads",
    "q19_tag_projection": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN BX END AS BX, CAST(XK AS BIGINT) AS XK, CAST(XK AS VARCHAR) AS xk_text FROM reads",
    "q20_limit_sorted": "SELECT event_id, rname, pos FROM reads ORDER BY rname, pos, event_id LIMIT 50",
    "q21_ref_stats": "SELECT rname, count(*) FILTER ((flag & 4) = 0) AS mapped, count(*) FILTER ((flag & 4) <> 0) AS unmapped FROM reads GROUP BY rname",
    "q22_flag_text": "SELECT event_id, concat_ws(',', " + ", ".join(f"CASE WHEN (flag & {1 << i}) <> 0 THEN '{w}' END" for i, w in enumerate(flags.WORDS)) + ") AS flag_text, flag FROM reads",
    "q23_pileup_depth": """WITH c AS (SELECT rname, pos, CAST(regexp_extract(cigar, '^([0-9]+)M', 1) AS BIGINT) AS m FROM reads WHERE (flag & 4) = 0)
SELECT rname, p AS pos, count(*) AS depth FROM (SELECT rname, unnest(generate_series(pos, pos + m - 1)) AS p FROM c) GROUP BY rname, p""",
    "q24_interval_overlap": "SELECT event_id AS id, CAST(k.id AS BIGINT) AS region_id FROM reads JOIN (VALUES ('click', 1, 3, 1), ('click', 40, 60, 2), ('view', 90, 90, 3), ('purchase', 5, 20, 4)) k(n, a, b, id) ON rname = n AND pos <= b AND pos + 5 >= a",
    "q25_multi_region_dedup": f"SELECT event_id FROM reads WHERE EXISTS (SELECT 1 FROM (VALUES ('click', 100, 110), ('click', 105, 130), ('view', 10, 30)) k(n, a, b) WHERE rname = n AND pos <= b AND pos + {LENGTH} > a)",
    "q26_cigar_star_null": "SELECT event_id, nullif(CASE WHEN event_id % 5 = 0 THEN '*' ELSE cigar END, '*') AS cigar FROM reads",
    "q27_region_parse": f"""SELECT event_id, 'chr' || CAST(event_id % 5 AS VARCHAR) AS seqnames, CASE WHEN event_id % 4 = 0 THEN CAST(1 AS BIGINT) ELSE 1000 + event_id % 1000 END AS start,
  CASE WHEN event_id % 4 = 3 THEN CAST(2500000 AS BIGINT) ELSE {regions.END} END AS "end" FROM reads""",
    "q28_variant_type": f"""WITH v AS (SELECT event_id, substr('ACGTTGCAACGGT', 1 + event_id % 7, 1 + event_id % 4) AS r, substr('ACTTaGCATCGG', 1 + event_id // 4 % 6, 1 + event_id // 16 % 4) AS plain FROM reads),
w AS (SELECT event_id, r, CASE WHEN event_id % 11 = 0 THEN [{", ".join(f"'{x}'" for x in SPECIAL)}][1 + event_id % 10] ELSE plain END AS alt, upper(alt) AS a FROM v),
x AS (SELECT *, list_min([i FOR i IN range(1, 2 + least(length(r), length(a))) IF r[i:i] <> a[i:i]]) AS f FROM w),
y AS (SELECT *, substr(r, f) AS r1, substr(a, f) AS a1 FROM x),
z AS (SELECT *, coalesce(list_min([i FOR i IN range(1, 1 + least(length(r1), length(a1))) IF r1[-i:-i] <> a1[-i:-i] OR i = least(length(r1), length(a1))]), 1) - 1 AS s FROM y),
t AS (SELECT *, length(r1) - s AS n, length(a1) - s AS m FROM z)
SELECT event_id, CASE WHEN length(r) = 1 AND length(alt) = 1 THEN CASE WHEN alt IN ('.', '*', 'X') OR r = alt THEN 'REF' ELSE 'SNP' END
  WHEN alt LIKE '<*>%' OR alt LIKE '<X>%' THEN 'REF' WHEN alt LIKE '<%' THEN 'OTHER' WHEN r = a THEN 'REF' WHEN r1 = '' AND (a1 LIKE '[%' OR a1 LIKE ']%') THEN 'BND'
  WHEN r1 = '' OR a1 = '' THEN 'INDEL' WHEN n = 1 AND m = 1 THEN 'SNP' WHEN n = 1 OR m = 1 THEN CASE WHEN r1[n:n] = a1[m:m] THEN 'INDEL' ELSE 'OTHER' END WHEN n = m THEN 'MNP' ELSE 'OTHER' END AS kind FROM t""",
    "q29_binned_overlap": f"SELECT r.event_id, count(*) AS n_regions FROM reads r JOIN reads k ON r.rname = k.rname AND r.pos <= k.pos + 3 AND r.pos + {LENGTH} > k.pos GROUP BY r.event_id",
    "q31_binned_semi": f"SELECT event_id FROM reads r WHERE EXISTS (SELECT 1 FROM reads k WHERE r.rname = k.rname AND r.pos <= k.pos + 30 AND r.pos + {LENGTH} > k.pos + 29)",
    "q32_bam_lookup": """WITH t AS (SELECT qname, flag, rname, pos, cigar, CASE WHEN event_id % 7 <> 0 THEN BX END AS bx, CAST(XK AS VARCHAR) AS xk FROM reads)
SELECT 'BX' AS by, * REPLACE (CAST(pos AS INTEGER) AS pos) FROM t WHERE coalesce(bx, '*') IN ('BX8-1', 'BX12-1', '*') UNION ALL SELECT 'XK', * REPLACE (CAST(pos AS INTEGER) AS pos) FROM t WHERE xk = '7'""",
    "q33_read_after_seek": f"""WITH t AS ({SEEN}) SELECT 'name' AS by, * FROM t WHERE qname IN ('r5', 'r77') UNION ALL SELECT 'place', * FROM t WHERE qname IN ('r8', 'r9') UNION ALL SELECT 'all', * FROM t""",
    "q34_split_scan": SEEN,
    "q35_region_index": f"""WITH t AS ({SEEN}) SELECT * FROM t WHERE (flag & 4) = 0 AND (rname = 'purchase' OR rname = 'view' AND pos + {ON_REF} > 9 OR rname = 'click' AND pos < 130 AND pos + {ON_REF} > 99)""",
    "q36_inverted_regions": f"""WITH k AS (SELECT DISTINCT rname, pos + 29 AS a, pos + 25 + event_id % 9 AS b FROM reads WHERE (pos + 29) % 4 = 0),
c AS (SELECT event_id, count(*) AS n_regions FROM reads r JOIN k ON r.rname = k.rname AND k.a <= k.b AND r.pos <= k.b AND r.pos + {LENGTH} > k.a GROUP BY event_id)
SELECT *, unnest(['few', 'many', 'count']) AS by FROM c""",
    "q37_binned_intervals": """WITH e AS (SELECT * FROM reads WHERE rname <> 'view'), k AS (SELECT rname, BX, max(pos) AS a, max(pos) + count(*) - 3 AS b FROM e GROUP BY ALL)
SELECT event_id AS id, k.BX AS bx FROM e JOIN k ON e.rname = k.rname AND k.a <= k.b AND e.pos <= k.b AND e.pos + 5 >= k.a""",
    "q38_base_counts": f"""WITH s AS ({SEQUENCED}),
cells AS (
  SELECT rname, pos + unnest(range(m)) AS pos, unnest(range(m)) AS i, seq, qual, m, op, k FROM s WHERE (flag & 4) = 0),
every AS (
  SELECT rname, pos, seq[i + 1:i + 1] AS base, ord(qual[i + 1:i + 1]) - 33 >= 20 AS good, false AS del, op = 'I' AND i = m - 1 AS ins FROM cells
  UNION ALL SELECT rname, pos + m + unnest(range(k)), NULL, false, true, false FROM s WHERE (flag & 4) = 0 AND op = 'D')
SELECT rname, pos, count(*) AS depth, {", ".join(f"count(*) FILTER (good AND base = '{b}') AS {b}" for b in "ACGTN")}, count(*) FILTER (del) AS deletions, count(*) FILTER (ins) AS insertions FROM every GROUP BY rname, pos""",
    "q39_mate_overlap": f"""WITH s AS ({SEQUENCED}),
r AS (SELECT event_id // 2 AS pair, event_id % 2 AS side, (event_id // 2) * 37 % 5000 + event_id % 2 * ((event_id // 2) % 70) AS pos, substr(repeat(seq, 3), 1, 40) AS seq, substr(repeat(qual, 3), 1, 40) AS qual FROM s),
c AS (SELECT pair, side, pos + unnest(range(20)) AS pos, unnest(range(20)) AS i, seq, qual FROM r UNION ALL SELECT pair, side, pos + 22 + unnest(range(20)), 20 + unnest(range(20)), seq, qual FROM r),
m AS (SELECT pair, side, pos, seq[i + 1:i + 1] AS base, ord(qual[i + 1:i + 1]) - 33 AS q FROM c),
j AS (SELECT a.pair, a.side, a.pos, a.base = b.base AS same, a.q AS own, b.q AS other FROM m a LEFT JOIN m b ON a.pair = b.pair AND a.pos = b.pos AND a.side <> b.side),
n AS (SELECT pair, pos, CASE WHEN other IS NULL THEN own WHEN same THEN CASE WHEN side = 0 THEN least(200, own + other) ELSE 0 END WHEN own > other OR own = other AND side = 0 THEN CAST(floor(own * 0.8::DOUBLE) AS INTEGER) ELSE 0 END AS q FROM j
  UNION ALL SELECT pair, pos + 20 + unnest(range(2)), NULL FROM r)
SELECT 'ref' || CAST(pair % 7 AS VARCHAR) AS rname, pos, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, count(*) FILTER (q = 0) AS zeros FROM n GROUP BY ALL""",
    "q40_sequence_ranges": """WITH w AS (SELECT user_id, string_agg(translate(md5(CAST(event_id AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGN'), '' ORDER BY event_id) AS whole FROM events GROUP BY user_id)
SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS seqnames, event_id % 400 - 5 AS start, event_id % 400 + event_id % 150 AS "end",
  substr(whole, CAST(greatest(event_id % 400 - 5, 1) AS BIGINT), CAST(greatest(event_id % 400 + event_id % 150 - greatest(event_id % 400 - 5, 1) + 1, 0) AS BIGINT)) AS seq FROM events JOIN w USING (user_id)""",
    "q41_variant_text": f"""WITH v AS ({VARIANTS}) SELECT event_type AS chrom, CAST(event_id + 1 AS INTEGER) AS pos, CASE WHEN event_id % 6 <> 0 THEN 'rs' || event_id END AS id, CAST(CASE WHEN two THEN 2 ELSE 1 END AS INTEGER) AS n_alt,
  CASE WHEN event_id % 10 <> 0 THEN (event_id % 100) / 4::DOUBLE END AS qual, CAST(user_id AS INTEGER) AS dp, CASE WHEN event_id % 2 = 0 THEN CASE WHEN two THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END END AS af,
  CAST(CASE WHEN event_id % 2 = 1 THEN 0 WHEN two THEN 2 ELSE 1 END AS INTEGER) AS n_af, event_id % 4 = 0 AS db, a || sep || b AS gt, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 13 AS INTEGER) END AS ad FROM v""",
    "q42_genotypes": f"""WITH v AS ({VARIANTS}),
k AS (SELECT *, [a, b, c, d] AS g, [x FOR x IN ['0', '1', '2'] IF x = '0' OR x IN (a, b, c, d)] AS kept, CASE WHEN two THEN ['C', 'G'] ELSE ['T'] END AS alts FROM v)
SELECT CAST(event_id + 1 AS INTEGER) AS pos, array_to_string([len([y FOR y IN g IF y = x]) FOR x IN CASE WHEN two THEN ['0', '1', '2'] ELSE ['0', '1'] END], ',') AS n, {KIND.format(p='a', q='b')} || ' ' || {KIND.format(p='c', q='d')} AS kinds,
  CASE WHEN len(kept) > 1 THEN array_to_string([alts[CAST(x AS BIGINT)] FOR x IN kept IF x <> '0'], ',') END AS alt,
  CASE WHEN c = '.' THEN '.' ELSE CAST(list_position(kept, c) - 1 AS VARCHAR) END || sep || CAST(list_position(kept, d) - 1 AS VARCHAR) AS gt,
  CASE WHEN event_id % 7 <> 0 THEN array_to_string([[event_id % 11, event_id % 13, event_id % 17][CAST(x AS BIGINT) + 1] FOR x IN kept], ',') END AS ad FROM k""",
    "q43_sites_side_by_side": f"""WITH v AS (SELECT event_id AS i, event_id // 2 AS pos, [{", ".join("[" + ", ".join(f"'{x}'" for x in a) + "]" for a in SIDE_ALTS)}][1 + (event_id * 7 + event_id // 2) % {len(SIDE_ALTS)}] AS alt FROM events),
p AS (SELECT coalesce(a.pos, b.pos) AS pos, 'A,' || array_to_string(a.alt, ',') AS x, 'A,' || array_to_string(b.alt, ',') AS y, list_sort(a.alt) = list_sort(b.alt) AS same, list_has_any(a.alt, b.alt) AS shared
  FROM (SELECT * FROM v WHERE i % 2 = 0) a FULL JOIN (SELECT * FROM v WHERE i % 2 = 1) b ON a.pos = b.pos),
m AS (SELECT *, unnest(['exact', 'some', 'any']) AS mode FROM p),
f AS (SELECT *, coalesce(CASE mode WHEN 'exact' THEN same WHEN 'some' THEN shared ELSE true END, false) AS fits FROM m)
SELECT mode, 'c' AS chrom, CAST(pos AS INTEGER) AS pos, x AS even, y AS odd FROM f WHERE fits OR x IS NULL OR y IS NULL
UNION ALL SELECT mode, 'c', CAST(pos AS INTEGER), CASE side WHEN 0 THEN x END, CASE side WHEN 1 THEN y END FROM f, (VALUES (0), (1)) s(side) WHERE NOT fits AND x IS NOT NULL AND y IS NOT NULL""",
    "q44_strand_bias": """WITH t AS (SELECT BX, count(*) FILTER (flag & 16 = 0 AND pos >= 50) AS a, count(*) FILTER (flag & 16 = 0 AND pos < 50) AS b, count(*) FILTER (flag & 16 <> 0 AND pos >= 50) AS c, count(*) FILTER (flag & 16 <> 0 AND pos < 50) AS d FROM reads GROUP BY BX),
k AS (SELECT *, unnest(range(0, least(r, col) + 1)) AS i FROM (SELECT *, a + b AS r, a + c AS col, a + b + c + d AS n FROM t)),
k2 AS (SELECT *, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(col + 1) + lgamma(n - col + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(r - i + 1) - lgamma(col - i + 1) - lgamma(n - r - col + i + 1)) AS p FROM k WHERE n - r - col + i >= 0),
o AS (SELECT *, max(CASE WHEN i = a THEN p END) OVER (PARTITION BY BX) AS own FROM k2)
SELECT BX, a, b, c, d, round(least(1, sum(p) FILTER (i <= a)), 6) AS left, round(least(1, sum(p) FILTER (i >= a)), 6) AS right, round(least(1, sum(p) FILTER (p <= own * (1 + 1e-7))), 6) AS two FROM o GROUP BY BX, a, b, c, d""",
    "q30_tag_update": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NM' ELSE 'BX,NM' END AS tags, event_id % 3 AS nm FROM reads",
}
SQL: dict[str, str] = {k: f"WITH reads AS ({READS})\n{v}" if not v.startswith("WITH ") else f"WITH reads AS ({READS}),\n{v[5:]}" for k, v in _SQL.items()}
