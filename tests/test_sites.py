"""Variant records side by side."""

import random
from collections import Counter

import pytest

from tagloom.operators import sites

VARIANT = "chrom string, pos int, ref string, alt array<string>"


def rows(frame, names):
    return sorted(((r.chrom, r.pos, *(tuple(r[n]) if r[n] else None for n in names)) for r in frame.collect()), key=repr)


def test_modes_by_hand(spark):
    one = spark.createDataFrame([("c", 1, "A", ["C"]), ("c", 2, "A", ["C"]), ("c", 3, "A", ["C", "G"]), ("c", 4, "A", ["AT"]), ("c", 5, "A", None), ("c", 6, "A", ["C"]), ("c", 6, "A", ["AT"]), ("c", 7, "A", ["C"]), ("c", 7, "A", ["C"])], VARIANT)
    two = spark.createDataFrame([("c", 1, "A", ["C"]), ("c", 2, "A", ["G"]), ("c", 3, "A", ["G", "T"]), ("c", 4, "A", ["ATT"]), ("c", 5, "A", ["C"]), ("c", 6, "A", ["AT"]), ("c", 6, "A", ["G"]), ("c", 7, "A", ["C"]), ("d", 1, "A", ["C"])], VARIANT)
    together = lambda modes: {r[1] for r in rows(sites.side_by_side({"x": one, "y": two}, modes), "xy") if r[2] and r[3]}
    assert together("exact") == {1, 6, 7}
    assert together("some") == {1, 3, 6, 7}
    assert together("snps") == {1, 2, 3, 6, 7}
    assert together({"indels"}) == {1, 3, 4, 6, 7}
    assert together({"snps", "snp_ref"}) == {1, 2, 3, 5, 6, 7}
    assert together("any") == {1, 2, 3, 4, 5, 6, 7}
    exact = rows(sites.side_by_side({"x": one, "y": two}), "xy")
    assert Counter(r[1] for r in exact) == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 3, 7: 2} and ("d", 1, None, ("A", "C")) in exact
    assert ("c", 6, ("A", "AT"), ("A", "AT")) in exact and ("c", 6, ("A", "C"), None) in exact
    snps = rows(sites.side_by_side({"x": one, "y": two}, {"snps"}), "xy")
    assert ("c", 6, ("A", "AT"), ("A", "AT")) in snps and ("c", 6, ("A", "C"), ("A", "G")) in snps
    for bad in ("none", set()):
        with pytest.raises(ValueError):
            sites.side_by_side({"x": one}, bad)


@pytest.mark.parametrize("modes", [{"exact"}, {"some"}, {"snps"}, {"indels"}, {"snps", "indels"}, {"any"}, {"snps", "snp_ref", "indel_ref"}])
def test_each_record_once_and_no_rows_left_to_join(spark, modes):
    rng = random.Random(len(modes))
    files = {}
    for name in "uvw":
        own = [("c", rng.randrange(12), rng.choice(["A", "AC"]), rng.choice([None, ["C"], ["G"], ["C", "G"], ["AT"], ["ATT"], ["<DEL>"], ["G", "AT"]])) for _ in range(30)]
        files[name] = spark.createDataFrame(own, VARIANT).coalesce(1)
    got = sites.side_by_side(files, modes).collect()
    for name, frame in files.items():
        given = Counter((r.pos, r.ref, *(r.alt or ["."])) for r in frame.collect())
        assert Counter((r.pos, *r[name]) for r in got if r[name]) == given
    kinds = lambda x: {"snp" if a in ("C", "G") and x[0] == "A" else "ref" if a == "." else "other" if a == "<DEL>" else "indel" for a in x[1:]}

    def may(a, b):
        share = {f"{a[0]}>{x}" for x in a[1:]} & {f"{b[0]}>{x}" for x in b[1:]}
        if {*a} == {*b} and a[0] == b[0]:
            return True
        if "exact" in modes:
            return False
        if share or "any" in modes:
            return True
        loose = {("snp", "snp"): "snps", ("indel", "indel"): "indels", ("ref", "snp"): "snp_ref", ("indel", "ref"): "indel_ref"}
        return any(loose.get(tuple(sorted((x, y)))) in modes for x in kinds(a) for y in kinds(b)) if "AC" not in (a[0], b[0]) else None

    for r in got:
        cells = [r[n] for n in files if r[n]]
        if len(cells) == 2:
            assert may(*cells) is not False, cells
    if modes == {"any"}:
        for p in {r.pos for r in got}:
            own = [r for r in got if r.pos == p]
            filled = [{n for n in files if r[n]} for r in own]
            assert not any(a.isdisjoint(b) for k, a in enumerate(filled) for b in filled[k + 1 :])
    assert sites.side_by_side({n: f.limit(0) for n, f in files.items()}, modes).count() == 0
