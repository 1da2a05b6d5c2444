import random

import pytest
from pyspark.sql import functions as F

from tagloom.sources import sequences


def made(seed):
    rng, out, text = random.Random(seed), {}, ""
    for k in range(12):
        n = rng.choice([0, 1, 7, 64, 300, 5000])
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(n))
        width = rng.choice([1, 10, 60, 10_000])
        end = rng.choice(["\n", "\r\n"])
        text += f">s{k} about > it{end}" + "".join(seq[i : i + width] + end for i in range(0, n, width)) + ("\n" if rng.random() < 0.2 else "")
        out[f"s{k}"] = seq
    return text, out


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 20])
def test_ranges_give_each_base_once(tmp_path, split):
    text, wanted = made(split)
    path = tmp_path / "a.fa"
    path.write_bytes(text.encode())
    n, found, name, size = len(text), {}, None, 0
    for a in range(0, n, split):
        for own, at, bases, _ in sequences.pieces(str(path), a, min(a + split, n)):
            if own is not None:
                name = own
                found.setdefault(name, "")
                assert at == len(found[name])
            found[name] += bases
    assert found == wanted


def test_chunks_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sequences, "PIECE", 50)
    text, wanted = made(3)
    (tmp_path / "a.fa").write_bytes((text.rstrip("\n") + "\n>s3 again\nAAAA\n").encode())
    for split in (97, 1 << 20):
        sequences.build(spark, str(tmp_path / "a.fa"), str(tmp_path / "t"), chunk=64, split_bytes=split)
        chunks = spark.read.parquet(str(tmp_path / "t"))
        rows = chunks.orderBy("name", "chunk").collect()
        whole = {}
        for r in rows:
            assert len(r.seq) <= 64 and r.chunk == len(whole.get(r.name, "")) // 64
            whole[r.name] = whole.get(r.name, "") + r.seq
        assert whole == {k: v for k, v in wanted.items() if v}
        rng = random.Random(1)
        asked = [(f"s{rng.randrange(13)}", a := rng.randrange(-5, 5100), a + rng.randrange(-3, 200), i) for i in range(60)] + [("none", 1, 5, 60), ("s1", 1, 10**9, 61), ("s1", 1, 10**9, 62)]
        got = {r.id: r.seq for r in sequences.fetched(chunks, spark.createDataFrame(asked, "seqnames string, start long, end long, id int"), 64).collect()}
        assert len(got) == 63
        for n, a, b, i in asked:
            assert got[i] == (whole[n][max(0, a - 1) : max(0, b)] if n in whole else None)
    touched = sequences.fetched(chunks, spark.createDataFrame([("s5", 10, 12)], "seqnames string, start long, end long"), 64)
    assert touched.count() == 1
    with pytest.raises(FileNotFoundError):
        sequences.chunked(spark, str(tmp_path / "no.fa"))


def test_many_small_ranges_are_few_tasks(spark, tmp_path):
    """A range of bytes each was a task, read six times: tens of thousands of tasks are more than a driver's memory holds."""
    lines = [f">s{k}\n" + "ACGTTGCAAC\n" * (k % 40) for k in range(300)]
    (tmp_path / "a.fa").write_text("".join(lines))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("small-ranges", "")
    got = sequences.chunked(spark, str(tmp_path / "a.fa"), chunk=64, split_bytes=40).groupBy("name").agg(F.sum(F.length("seq")).alias("n")).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.name: r.n for r in got} == {f"s{k}": k % 40 * 10 for k in range(300) if k % 40}
    stages = {s for job in tracker.getJobIdsForGroup("small-ranges") for s in tracker.getJobInfo(job).stageIds}
    counts = [info.numTasks for s in stages if (info := tracker.getStageInfo(s))]
    assert counts and max(counts) <= 4 * context.defaultParallelism
