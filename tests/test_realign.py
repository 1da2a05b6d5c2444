"""Base alignment qualities against sums over all paths."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import tags
from tagloom.operators import realign
from tagloom.sources import sam, sequences

CODES = "ACGT"


def all_paths(ref, query, qual):
    """(base, place, inserted) -> the summed chance of the paths through it: each path one after another."""
    n, size = len(query), len(ref)
    end = 1 / (2 * n + 2)
    d, e = realign.OPEN, realign.EXTEND
    out = defaultdict(float)

    def emitted(i, k):
        r, q, p = ref[k], query[i], 10 ** (-qual[i] / 10)
        return 1.0 if r > 3 or q > 3 else 1 - p if r == q else p / 3

    def go(i, k, state, weight, seen):
        if i == n - 1 and state != "D":
            for x in seen:
                out[x] += weight * end
        s = 1 - end
        if i + 1 < n:
            if k + 1 < size:
                t = {"M": (1 - 2 * d) * s, "I": (1 - e) * s, "D": 1 - e}[state]
                go(i + 1, k + 1, "M", weight * t * emitted(i + 1, k + 1), [*seen, (i + 1, k + 1, False)])
            if state != "D":
                go(i + 1, k, "I", weight * (d if state == "M" else e) * s * 0.25, [*seen, (i + 1, k, True)])
        if state != "I" and i > 0 and k + 1 < size:
            go(i, k + 1, "D", weight * (d * s if state == "M" else e), seen)

    for k in range(size):
        go(0, k, "M", (1 - d) / size * emitted(0, k), [(0, k, False)])
        go(0, k, "I", d / size * 0.25, [(0, k, True)])
    return out


def test_sums_over_all_paths():
    rng = random.Random(2)
    for _ in range(25):
        n, size = rng.randint(2, 5), rng.randint(2, 6)
        ref = [rng.choice([0, 1, 2, 3, 3, 4]) for _ in range(size)]
        query = [rng.choice([0, 1, 2, 3]) for _ in range(n)]
        qual = [rng.choice([2, 10, 30]) for _ in range(n)]
        chances = all_paths(ref, query, qual)
        band = max(n, size)
        # Two reads at once, one on a longer padded reference, give what each gives alone.
        wide = np.full((2, size + 3), 4, np.int8)
        wide[0, :size], wide[1, : size + 3] = ref, ref + [0, 1, 2]
        place, kind, sure = realign.posterior(wide, np.array([size, size + 3]), np.array([query, query], np.int8), np.array([qual, qual]), band)
        for i in range(n):
            own = {x: v for x, v in chances.items() if x[0] == i}
            best = max(own.values()) / sum(own.values())
            got = own[i, place[0, i], bool(kind[0, i])] / sum(own.values())
            assert abs(got - best) < 1e-9
            wanted = 99 if best >= 1 else int(-4.343 * np.log(1 - best) + 0.499)
            assert abs(min(wanted, 99) - sure[0, i]) <= 1


def test_frames():
    assert realign.framed(100, [(50, "M")], 50) == (97, 153, 7)
    assert realign.framed(100, [(5, "S"), (40, "M"), (5, "S")], 50) == (92, 148, 7)
    assert realign.framed(100, [(10, "M"), (20, "D"), (10, "M")], 20)[2] == 23
    assert realign.framed(2, [(10, "M")], 10) == (0, 15, 7) and realign.framed(1, [(3, "M"), (5, "N"), (3, "M")], 6) is None and realign.framed(1, [(4, "S")], 4) is None


def test_reads_near_an_indel(spark, tmp_path):
    rng = random.Random(7)
    ref = "".join(rng.choice(CODES) for _ in range(400))
    ref = ref[:200] + "TTTTTTTT" + ref[200:]
    (tmp_path / "r.fa").write_text(">c\n" + "\n".join(ref[i : i + 60] for i in range(0, len(ref), 60)) + "\n")
    sequences.build(spark, str(tmp_path / "r.fa"), str(tmp_path / "chunks"), chunk=64)
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    good = ref[20:80]
    # A read that lacks five bases, but is aligned without the gap: its tail is unsure.
    gap = ref[150:178] + ref[183:195]
    lines = [
        f"good\t0\tc\t21\t60\t60M\t*\t0\t0\t{good}\t{'I' * 60}",
        f"gap\t0\tc\t151\t60\t40M\t*\t0\t0\t{gap}\t{'I' * 40}",
        f"right\t0\tc\t151\t60\t28M5D12M\t*\t0\t0\t{gap}\t{'I' * 40}",
        f"skip\t0\tc\t21\t60\t30M5N30M\t*\t0\t0\t{good}\t{'I' * 60}",
        f"none\t0\tc\t21\t60\t60M\t*\t0\t0\t{good}\t*",
        f"far\t0\td\t21\t60\t60M\t*\t0\t0\t{good}\t{'I' * 60}",
        f"un\t4\t*\t0\t0\t*\t*\t0\t0\t{good}\t{'I' * 60}",
    ]
    rows = sam.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.qname: r for r in realign.adjusted(rows, chunks, 64).collect()}
    assert len(got) == len(lines)
    quality = lambda n: [ord(x) - 33 for x in got[n].qual]
    assert min(quality("good")[5:55]) >= 38 and "ZQ" in got["good"].aux
    assert max(quality("gap")[30:38]) <= 5 and min(quality("gap")[5:20]) >= 35
    assert min(quality("right")[5:20]) >= 35 and max(quality("right")[32:38]) > 20
    for n in ("skip", "far", "un"):
        assert got[n].qual == "I" * 60 and "ZQ" not in got[n].aux
    assert got["none"].qual == "*"
    # What is lowered is told by the tag, and can be taken back and told apart from being applied.
    kept = {r.qname: r for r in realign.adjusted(rows, chunks, 64, apply=False).collect()}
    assert kept["gap"].qual == "I" * 40 and kept["gap"].aux["BQ"].s == got["gap"].aux["ZQ"].s
    again = {r.qname: r for r in realign.adjusted(spark.createDataFrame(list(kept.values()), rows.schema), chunks, 64).collect()}
    assert again["gap"].qual == got["gap"].qual and "BQ" not in again["gap"].aux
    back = {r.qname: r for r in realign.adjusted(spark.createDataFrame(list(got.values()), rows.schema), chunks, 64, apply=False).collect()}
    assert back["gap"].qual == "I" * 40 and "ZQ" not in back["gap"].aux
    extended = {r.qname: r for r in realign.adjusted(rows, chunks, 64, extend=True).collect()}
    assert extended["good"].qual == "I" * 60 or min(ord(x) - 33 for x in extended["good"].qual[5:55]) >= 38
    assert realign.adjusted(rows.filter(F.lit(False)), chunks, 64).count() == 0 and tags.MISSING == "*"
