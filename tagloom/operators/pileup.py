"""Pileups: what each read has at each position of the reference, as rows.

Reads are walked by column expressions; a read's row becomes one row for each position, without its whole
sequence. Mates that overlap, and a limit on the reads that are piled up, are decided before, on rows of
reads. A limit is the only thing that needs the reads in order, and only where there are more than it allows:
there, clusters of bins are streamed in order by one task each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar, flags

#: Fixed value: the highest quality that two agreeing mates give a base.
MOST_QUALITY = 200
#: Positions of a bin in which reads are counted against a limit.
BIN = 1 << 12
#: What a read has at a position.
COLUMNS = ("pos", "base", "qual", "qpos", "indel", "is_del", "is_refskip", "is_head", "is_tail")


def segments(cigar_column: Column, pos: Column) -> Column:
    """The operations that take reference positions, each with op, n, x (its first position), y (the read's base there, from 0) and indel.

    indel is what follows the operation's last position: the bases that are inserted (also behind padding), or
    less than 0, those that are deleted. Skipped bases in front of the first match or deletion are passed over.
    """
    whole = F.when(cigar_column.rlike(cigar.VALID), cigar_column)
    n, op = (F.regexp_extract_all(whole, F.lit("([0-9]+)([MIDNSHP=XB])"), F.lit(k)) for k in (1, 2))
    ops = F.zip_with(n, op, lambda a, b: F.struct(a.cast("bigint").alias("n"), b.alias("op")))
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<struct<op:string,n:bigint,x:bigint,y:bigint,indel:bigint>>")

    def step(state, o):
        out, open_ = state["out"], state["open"]
        on_ref, on_read = o["op"].isin(*cigar.ON_REFERENCE), o["op"].isin(*cigar.ON_READ)
        last = F.element_at(out, -1)
        # An operation behind the last segment, with nothing but padding and insertions between, tells its indel.
        told = F.when(open_ & (o["op"] == "D") & (last["indel"] == 0) & ~state["padded"], -o["n"]).when(open_ & (o["op"] == "I") & ((last["indel"] == 0) | state["padded"]), last["indel"] + o["n"])
        marked = F.when(told.isNotNull(), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["op"].alias("op"), last["n"].alias("n"), last["x"].alias("x"), last["y"].alias("y"), told.alias("indel"))))).otherwise(out)
        taken = on_ref & (o["n"] > 0) & ((o["op"] != "N") | (F.size(out) > 0))
        own = F.when(taken, F.array(F.struct(o["op"].alias("op"), o["n"].alias("n"), state["x"].alias("x"), state["y"].alias("y"), zero.alias("indel")))).otherwise(none)
        return F.struct(
            (state["x"] + F.when(on_ref, o["n"]).otherwise(zero)).alias("x"),
            (state["y"] + F.when(on_read, o["n"]).otherwise(zero)).alias("y"),
            # Padding right behind a segment lets insertions add up; anything else that takes no reference ends the look-ahead.
            F.when(taken, F.lit(True)).otherwise(open_ & (o["op"].isin("P") | (state["padded"] & ~on_ref))).alias("open"),
            F.when(taken, F.lit(False)).otherwise(state["padded"] | open_ & (o["op"] == "P")).alias("padded"),
            F.concat(marked, own).alias("out"),
        )

    start = F.struct(pos.cast("bigint").alias("x"), zero.alias("y"), F.lit(False).alias("open"), F.lit(False).alias("padded"), none.alias("out"))
    return F.coalesce(F.aggregate(ops, start, step, lambda s: s["out"]), none)


def entries(records_pos: Column, cigar_column: Column, seq: Column, qual: Column, skips: bool, only: tuple[str, ...] = COLUMNS) -> Column:
    """An array of structs of some of COLUMNS for a read: bases and qualities are null where it has none."""
    last = cigar.reference_end(records_pos.cast("bigint"), cigar_column) - 1
    bases = F.when(seq.isNotNull() & (seq != "*"), F.split(seq, ""))
    quals = F.when(qual.isNotNull() & (qual != "*"), F.split(qual, ""))
    found = segments(cigar_column, records_pos)
    found = found if skips else F.filter(found, lambda s: s["op"] != "N")

    def cells(s):
        matched = s["op"].isin("M", "=", "X")
        part = lambda x: F.when(matched & (F.size(x) >= s["y"] + s["n"]), F.slice(x, (s["y"] + 1).cast("int"), s["n"].cast("int")))
        both = F.arrays_zip(F.sequence(F.lit(0).cast("bigint"), s["n"] - 1).alias("i"), F.coalesce(part(bases), F.array().cast("array<string>")).alias("b"), F.coalesce(part(quals), F.array().cast("array<string>")).alias("q"))
        def cell(e):
            made = {
                "pos": lambda: s["x"] + e["i"],
                "base": lambda: e["b"],
                "qual": lambda: F.ascii(e["q"]) - 33,
                "qpos": lambda: F.when(matched, s["y"] + e["i"]).otherwise(s["y"]),
                "indel": lambda: F.when(e["i"] == s["n"] - 1, s["indel"]).otherwise(F.lit(0).cast("bigint")),
                "is_del": lambda: ~matched,
                "is_refskip": lambda: s["op"] == "N",
                "is_head": lambda: s["x"] + e["i"] == records_pos,
                "is_tail": lambda: s["x"] + e["i"] == last,
            }
            return F.struct(*(made[c]().alias(c) for c in only))

        return F.transform(both, cell)

    return F.flatten(F.transform(found, cells))


def usable(records: DataFrame) -> DataFrame:
    """Mapped records with a reference."""
    return records.filter(~flags.has(F.col("flag"), flags.UNMAPPED) & (F.col("rname") != "*") & (F.col("pos") >= 0))


def in_order(records: DataFrame) -> list[Column]:
    """Reads of a position in their files' order; what has no place is told apart by its name and flag."""
    return [F.col(c) for c in ("file", "voffset", "qname", "flag", "cigar") if c in records.columns]


def limited(records: DataFrame, most: int, width: int = BIN) -> DataFrame:
    """The mapped records that a pile of at most `most` reads takes, in order of position.

    A read is left out if as many reads are in the pile as may be and it isn't the first that starts where it
    does; a read leaves the pile behind the position after its last. Bins that fewer reads than `most` reach
    leave none out. The others, with what reaches into them, are streamed in order; bins that one read can
    connect go to one task.
    """
    reads = usable(records)
    end = cigar.reference_end(F.col("pos").cast("bigint"), F.col("cigar"))
    nth = F.row_number().over(Window.partitionBy("rname", "pos").orderBy(*in_order(records)))
    spans = reads.select("rname", F.col("pos").cast("bigint").alias("pos"), end.alias("end"))
    spans = spans.withColumns({"low": F.floor(F.col("pos") / width), "high": F.floor(F.col("end") / width)})
    reached = spans.withColumn("bin", F.explode(F.sequence("low", "high"))).groupBy("rname", "bin").agg(F.count("*").alias("n"), F.max(F.col("high")).alias("reach"))
    deep = reached.filter(F.col("n") > most)
    # Bins are connected where a read that starts in one of the earlier ones can reach them.
    earlier = Window.partitionBy("rname").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    deep = deep.withColumn("new", (F.col("bin") > F.coalesce(F.max("reach").over(earlier), F.lit(-1))).cast("int"))
    deep = deep.select("rname", "bin", F.sum("new").over(Window.partitionBy("rname").orderBy("bin")).alias("cluster"))
    numbered = reads.withColumn("_nth", nth)
    rows = numbered.select("rname", F.col("pos").cast("bigint").alias("pos"), end.alias("end"), F.col("_nth").alias("nth"))
    rows = rows.withColumns({"low": F.floor(F.col("pos") / width), "bin": F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("end") / width)))})
    inside = rows.join(deep, ["rname", "bin"]).groupBy("rname", "cluster", "pos", "nth", "end").agg(F.max((F.col("bin") == F.col("low")).cast("int")).alias("judged"))
    inside = inside.repartition("rname", "cluster").sortWithinPartitions("rname", "cluster", "pos", "nth")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cluster, pile, at, first = None, [], None, True
        for b in batches:
            out = []
            for rname, own, pos, nth_, end_, judged in zip(*(b.column(c).to_pylist() for c in ("rname", "cluster", "pos", "nth", "end", "judged")), strict=True):
                if (rname, own) != cluster:
                    cluster, pile, at = (rname, own), [], None
                if pos != at:
                    at, first = pos, True
                    while pile and pile[0] < pos:
                        heapq.heappop(pile)
                if judged and not first and len(pile) >= most:
                    out.append((rname, pos, nth_))
                else:
                    heapq.heappush(pile, end_)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32())], ["_rname", "_pos", "_out"])

    gone = inside.mapInArrow(run, "_rname string, _pos bigint, _out int")
    kept = numbered.join(gone, (F.col("rname") == F.col("_rname")) & (F.col("pos") == F.col("_pos")) & (F.col("_nth") == F.col("_out")), "left_anti")
    return kept.drop("_nth")


def paired(records: DataFrame) -> DataFrame:
    """Mapped records with pair, a number of the name and reference, and side (0 the first, 1 its mate), both null for reads without an overlapping mate.

    Reads of proper pairs whose mate is mapped, and whose template is shorter than twice the read, are paired in
    order of position: a read with the next one of its name, if that starts before it has ended.
    """
    reads = usable(records)
    f = F.col("flag")
    may = flags.has(f, 2) & ~flags.has(f, 8) & (F.abs("tlen") < 2 * F.when(F.col("seq") == "*", 0).otherwise(F.length("seq")))
    reads = reads.withColumns({"_may": may, "_end": cigar.reference_end(F.col("pos").cast("bigint"), F.col("cigar"))})
    by = Window.partitionBy("rname", "qname", "_may").orderBy("pos", *in_order(records))
    linked = F.coalesce(F.col("_may") & (F.lag("_end").over(by) >= F.col("pos")), F.lit(False))
    runs = reads.withColumn("_linked", linked).withColumn("_run", F.sum((~F.col("_linked")).cast("int")).over(by))
    own = Window.partitionBy("rname", "qname", "_may", "_run").orderBy("pos", *in_order(records))
    k = F.row_number().over(own) - 1
    runs = runs.withColumns({"_k": k, "_last": F.lead("pos").over(own).isNull()})
    has = F.col("_may") & ((F.col("_k") % 2 == 1) | ~F.col("_last"))
    pair = F.when(has, F.struct(F.col("_run").alias("run"), F.floor(F.col("_k") / 2).alias("nth")))
    return runs.withColumns({"pair": pair, "side": F.when(has, F.col("_k") % 2)}).drop("_may", "_end", "_linked", "_run", "_k", "_last")


def stacked(records: DataFrame, keep: tuple[str, ...] = ("qname", "flag", "mapq"), most: int | None = None, overlaps: bool = False, skips: bool = True, only: tuple[str, ...] = COLUMNS) -> DataFrame:
    """rname, what is kept of a read, and COLUMNS, or some of them: a row for each mapped read and position.

    `most` limits the reads piled up at once, `skips` leaves out skipped reference positions if False. With
    `overlaps`, a base that both mates have counts in one of them: where they agree, the first gets the sum of
    both qualities, up to 200, and the other 0; where they don't, the higher one keeps four fifths, the first
    if they are equal.
    """
    reads = usable(records) if most is None else limited(records, most)
    more = [c for c in keep if c not in ("rname", "pair", "side")]
    if overlaps:
        reads = paired(reads)
        more += ["pair", "side"] + ["qname"] * ("qname" not in more)
    needed = tuple(c for c in COLUMNS if c in only or overlaps and c in ("pos", "base", "qual", "is_del"))
    cells = reads.select("rname", *more, F.explode(entries(F.col("pos"), F.col("cigar"), F.col("seq"), F.col("qual"), skips, needed)).alias("e")).select("rname", *more, *(F.col("e")[c].alias(c) for c in needed))
    if overlaps:
        cells = adjusted(cells)
    return cells.select("rname", *keep, *(c for c in COLUMNS if c in only))


def adjusted(cells: DataFrame) -> DataFrame:
    """Entries of paired reads with the qualities of the bases that both mates have moved to one of them. A group is the two entries of a pair and position."""
    two = Window.partitionBy("rname", "qname", "pair", "pos")
    side = lambda k, c: F.max(F.when((F.col("side") == k) & ~F.col("is_del") & F.col("qual").isNotNull(), F.col(c))).over(two)
    apart = cells.filter("pair is null")
    both = cells.filter("pair is not null").withColumns({"_a": side(0, "base"), "_b": side(1, "base"), "_p": side(0, "qual"), "_q": side(1, "qual")})
    p, q, first = F.col("_p"), F.col("_q"), F.col("side") == 0
    less = lambda x: F.floor(x * 0.8).cast("int")
    new = F.when(F.col("_a") == F.col("_b"), F.when(first, F.least(p + q, F.lit(MOST_QUALITY))).otherwise(0)).when(p >= q, F.when(first, less(p)).otherwise(0)).otherwise(F.when(first, 0).otherwise(less(q)))
    shared = p.isNotNull() & q.isNotNull() & ~F.col("is_del")
    both = both.withColumn("qual", F.when(shared, new).otherwise(F.col("qual")).cast("int")).drop("_a", "_b", "_p", "_q")
    return apart.unionByName(both)


def base_counts(records: DataFrame, least_quality: int = 0, most: int | None = None, overlaps: bool = False) -> DataFrame:
    """rname, pos, depth (reads, without skipped positions), A, C, G, T, N (other letters), deletions, insertions: bases of unknown quality count, those below `least_quality` don't."""
    cells = stacked(records, keep=(), most=most, overlaps=overlaps, skips=False, only=("pos", "base", "qual", "indel", "is_del"))
    good = ~F.col("is_del") & (F.col("qual").isNull() | (F.col("qual") >= least_quality))
    letter = F.upper("base")
    counts = [F.count_if(good & (letter == b)).alias(b) for b in "ACGT"]
    return cells.groupBy("rname", "pos").agg(F.count("*").alias("depth"), *counts, F.count_if(good & letter.isNotNull() & ~letter.isin(*"ACGT")).alias("N"), F.count_if(F.col("is_del")).alias("deletions"), F.count_if(F.col("indel") > 0).alias("insertions"))
