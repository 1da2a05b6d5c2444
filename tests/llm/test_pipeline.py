import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from test_text import components

import __spark_entry__
import corpus_pipeline
from tagloom.llm import common, mixing, pieces, quality, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, row int"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    common = [word() for _ in range(40)]
    rows, labels = [], []
    for i in range(300):
        kind = i % 6
        text = " ".join(rng.choice(common, 40))
        if kind == 0:
            text += " you idiot moron"
        elif kind == 1:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif kind == 2 and rows:
            text = rows[-rng.integers(1, min(9, len(rows)) + 1)][1]
        rows.append((i, text, "en", f"s{i % 4}" if i % 3 else None, len(text), "kept", 5))
        labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [rows[3], (None, "no id here", "en", "s1", 10, None, None), (900, None, None, None, None, None, None), (901, "", "en", "s0", 0, "x", 1)]
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOC).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def key(rows):
    return Counter(map(repr, map(tuple, rows)))


def test_stages(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    labels = spark.read.parquet(f"{made}/labels.parquet")
    (_, q), (_, t), (_, n), (_, m), (_, e) = corpus_pipeline.STAGES
    good = q(spark, docs, made)
    kept = {r.doc_id for r in quality.judged(docs, labels).filter("predicted = 1").collect()}
    assert good.columns == docs.columns and key(good.collect()) == key(r for r in docs.collect() if r.doc_id in kept) and 30 < docs.count() - good.count() < 70
    clean = t(spark, good, made)
    kept = {r.doc_id for r in toxicity.judged(good, labels).filter("predicted = 0").collect()}
    assert clean.columns == docs.columns and key(clean.collect()) == key(r for r in good.collect() if r.doc_id in kept) and 30 < good.count() - clean.count() < 70
    left = n(spark, clean, made).collect()
    want = components([(r.doc_id if r.doc_id is not None else -1, r.text) for r in clean.collect()])
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in left) == sorted(i for i, (_, root) in want.items() if root == i)
    frame = spark.createDataFrame(left, docs.schema)
    mixed = m(spark, frame, made)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) == 2 and set(times) <= {r.doc_id for r in left}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in left:
        sizes[r.source] += len((r.text or "").split())
        taken[r.source] += len((r.text or "").split()) * times[r.doc_id]
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 300
    tokens = e(spark, mixed, made).collect()
    assert len(tokens) == sum(times.values()) and all(r.round_trip for r in tokens)
    encoder = pieces.Encoder(pieces.load())
    text = {r.doc_id: r.text for r in left}
    assert all(r.ids_crc == zlib.crc32(encoder.encode([(text[r.doc_id] or "").encode()])[0].astype("<i4").tobytes()) for r in tokens)


def test_near_duplicates_go_by_rows(spark, made):
    """Null and repeated doc_ids are no reason to drop a row; near-duplicates with null ids are."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, words(k)) for k in range(30)]  # texts of their own under the null id
    rows += [(None, words(k) + " more") for k in range(5)]  # near-duplicates of null ids only
    rows += [(7, words(50)), (7, words(51)), (None, words(51)), (8, words(50) + " more"), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "kept", 5) for i, t in rows], "doc_id long, text string, key string, row int").repartition(3)
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, made)
    got = left.collect()
    assert left.columns == docs.columns and all((r.key, r.row) == ("kept", 5) for r in got)
    # Of two null ids either may stay, of a null id and another the other one, of two ids the smaller.
    assert Counter((r.doc_id, (r.text or "").removesuffix(" more")) for r in got) == Counter([(None, words(k)) for k in range(30)] + [(7, words(50)), (7, words(51)), (9, ""), (9, "")])


def test_mixing_goes_by_rows(spark, made):
    """A third of the ids is null, and some are repeated: each row counts for itself, and sources come near their targets."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else i // 2, " ".join(["w"] * int(rng.integers(1, 60))) + f" x{i}", f"s{i % 3 % 2}") for i in range(900)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, source string, copies string").repartition(4)
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, made)
    assert got.columns == docs.columns
    times = Counter((r.doc_id, r.text, r.source) for r in got.collect())
    assert set(times) <= set(rows) and max(times.values()) <= 2
    again = dict(corpus_pipeline.STAGES)["mixing"](spark, docs.repartition(7), made)
    assert Counter((r.doc_id, r.text, r.source) for r in again.collect()) == times
    targets = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        assert abs(sum(len(t.split()) * n for (_, t, s), n in times.items() if s == source) - target) < 70


def test_run_applies_the_stages(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, made)).collect(), out.schema)
    assert key(docs.collect()) == key(corpus_pipeline.run(spark, made).collect())


def test_empty(spark, made):
    labels = spark.read.parquet(f"{made}/labels.parquet")
    docs = spark.read.parquet(f"{made}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, made)
    assert docs.count() == 0 and labels.count()


def test_registered():
    assert {"pipeline", *(f"op{k}" for k in range(1, 11))} <= {n.split("_")[0] for n in __spark_entry__.queries()}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tasks_give_memory_back(spark):
    """What a task has freed is not held by its worker, which lives on, below something that stays."""

    def make():
        import os
        import sys

        held = [bytes(3000) for _ in range(60_000)]
        sys.stays = bytes(3000)
        return lambda batch: [pa.array([os.getpid() + 0 * len(held)] * batch.num_rows, pa.int64())]

    def holds(batches):
        import os
        import re
        import time
        from pathlib import Path

        time.sleep(0.5)  # so that all workers get some
        for b in batches:
            n = int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()] * b.num_rows, "mb": [n] * b.num_rows})

    rows = spark.range(0, 8, 1, 8)
    made = {r.pid for r in common.appended(rows, make, [T.StructField("pid", T.LongType())]).collect()}
    after = {r.pid: r.mb for r in rows.mapInArrow(holds, "pid long, mb long").collect()}
    assert made & after.keys() and max(after[p] for p in made & after.keys()) < 170
