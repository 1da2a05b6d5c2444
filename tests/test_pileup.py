"""Pileups against plain versions that walk one read after another."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.operators import pileup

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, tlen int, seq string, qual string, voffset long"
CIGARS = ["10M", "4S6M2S", "5M2I5M", "3M2D7M", "4M3N6M", "2H3S4M1P2I4M", "3=2X5=", "2N5M", "5M2P3M", "3M1I2D4M", "4M2D1I3M", "2I8M", "6M3D", "1M1P1I1P2I1D3M"]


def ops(cigar):
    return [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=XB])", cigar)]


def length(cigar):
    return sum(n for n, o in ops(cigar) if o in "MIS=X")


def reads(n, seed, span=60, pairs=False):
    rng, out = random.Random(seed), []
    for i in range(n):
        name = f"q{i // 2 if pairs else i}" if i % 11 else "q0"
        c = rng.choice(CIGARS)
        m = length(c)
        flag = rng.choice([0, 16, 4, 3, 99, 147, 1, 11]) if pairs else rng.choice([0, 16, 0, 4])
        qual = "".join(chr(33 + rng.choice([0, 2, 10, 35, 93])) for _ in range(m)) if rng.random() < 0.9 else "*"
        seq = "".join(rng.choice("ACGTN") for _ in range(m)) if rng.random() < 0.95 else "*"
        out.append((name, flag, rng.choice(["a", "b"]), rng.randrange(span), 60, c, rng.choice([0, 12, -15, 40]), seq, qual if seq != "*" else "*", i << 16))
    return out


def walked(r):
    """pos -> [base, qual, qpos, indel, is_del, is_refskip] of a read."""
    _, _, _, x, _, c, _, seq, qual, _ = r
    out, y, all_ops = {}, 0, ops(c)
    begun = False
    for k, (n, o) in enumerate(all_ops):
        if o in "MD=X" or o == "N" and begun:
            begun = True
            for i in range(n):
                indel = 0
                if i == n - 1 and k + 1 < len(all_ops):
                    n2, o2 = all_ops[k + 1]
                    if o2 == "D":
                        indel = -n2
                    elif o2 == "I":
                        indel = n2
                    elif o2 == "P":
                        for n3, o3 in all_ops[k + 2 :]:
                            if o3 in "DMN=X":
                                break
                            indel += n3 if o3 == "I" else 0
                on = o in "M=X"
                out[x + i] = [seq[y + i] if on and seq != "*" else None, ord(qual[y + i]) - 33 if on and qual != "*" else None, y + i if on else y, indel, not on, o == "N"]
        if o in "MDN=X":
            x += n
        if o in "MIS=X":
            y += n
    return out, x


def mapped(rows):
    return sorted((r for r in rows if not r[1] & 4), key=lambda r: (r[2], r[3], r[9]))


def stack(frame):
    return sorted(repr((r.rname, r.qname, r.flag, r.pos, [r.base, r.qual, r.qpos, r.indel, r.is_del, r.is_refskip])) for r in frame.collect())


def test_stack_is_the_walk(spark):
    rows = reads(300, 1)
    got = pileup.stacked(spark.createDataFrame(rows, SCHEMA))
    wanted = [repr((r[2], r[0], r[1], p, e)) for r in mapped(rows) for p, e in walked(r)[0].items()]
    assert stack(got) == sorted(wanted)
    heads = got.filter("is_head").count(), got.filter("is_tail").count()
    assert heads == (sum(r[3] in walked(r)[0] for r in mapped(rows)), len(mapped(rows)))
    assert pileup.stacked(spark.createDataFrame(rows, SCHEMA), skips=False).filter("is_refskip").count() == 0
    assert pileup.stacked(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_limit(rows, most):
    kept, pile, at = [], [], None
    for r in mapped(rows):
        if (r[2], r[3]) != at:
            pile = [(n, e) for n, e in pile if n == r[2] and e >= r[3]]
            at, first = (r[2], r[3]), True
        if first or len(pile) < most:
            kept.append(r)
            pile.append((r[2], walked(r)[1]))
        first = False
    return kept


@pytest.mark.parametrize("most", [1, 3, 8, 1000])
def test_limit_is_that_of_one_pass(spark, most):
    rows = reads(250, 2, span=90)
    for width in (7, 64):
        got = pileup.limited(spark.createDataFrame(rows, SCHEMA).repartition(3), most, width)
        assert sorted(r.voffset for r in got.collect()) == sorted(r[9] for r in plain_limit(rows, most))


def plain_overlaps(rows):
    rows = mapped(rows)
    cells = {r[9]: walked(r)[0] for r in rows}
    waiting = {}
    for r in rows:
        name = (r[2], r[0])
        if r[1] & 8 or not r[1] & 2 or abs(r[6]) >= 2 * (0 if r[7] == "*" else len(r[7])):
            continue
        a = waiting.get(name)
        if a is None or walked(a)[1] < r[3]:
            waiting[name] = r
            continue
        del waiting[name]
        one, two = cells[a[9]], cells[r[9]]
        for p in set(one) & set(two):
            x, y = one[p], two[p]
            if x[4] or y[4] or x[1] is None or y[1] is None:
                continue
            if x[0] == y[0]:
                x[1], y[1] = min(200, x[1] + y[1]), 0
            elif x[1] >= y[1]:
                x[1], y[1] = int(0.8 * x[1]), 0
            else:
                x[1], y[1] = 0, int(0.8 * y[1])
    return sorted(repr((r[2], r[0], r[1], p, e)) for r in rows for p, e in cells[r[9]].items())


def test_overlapping_mates(spark):
    rows = reads(400, 3, span=25, pairs=True)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = stack(pileup.stacked(frame, overlaps=True))
    assert got == plain_overlaps(rows) != stack(pileup.stacked(frame))


def test_base_counts(spark):
    rows = reads(300, 4)
    got = {(r.rname, r.pos): r for r in pileup.base_counts(spark.createDataFrame(rows, SCHEMA), least_quality=10).collect()}
    cells = {}
    for r in mapped(rows):
        for p, e in walked(r)[0].items():
            if not e[5]:
                cells.setdefault((r[2], p), []).append(e)
    assert set(got) == set(cells)
    for at, own in cells.items():
        good = [e[0] for e in own if not e[4] and (e[1] is None or e[1] >= 10)]
        r = got[at]
        assert (r.depth, r.A, r.C, r.G, r.T, r.N, r.deletions, r.insertions) == (len(own), *(good.count(b) for b in "ACGTN"), sum(e[4] for e in own), sum(e[3] > 0 for e in own))


def test_a_stack_carries_no_whole_reads(spark):
    plan = pileup.stacked(spark.createDataFrame(reads(3, 5), SCHEMA)).select("rname", "pos", "base")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and F.__name__
