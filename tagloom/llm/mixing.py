"""Mixing sources to target weights by balanced (cube) sampling.

Every document starts with the multiplicity r = target / source size of its source: the whole part is
taken for certain, the fractional part is an inclusion probability. The flight phase moves the
probabilities of three documents at a time along the null space of two constraints, the words and the
documents taken, until each reaches 0 or 1. It runs in blocks of a source; the two or so documents that
a block leaves open meet in the next round's blocks, until a source is down to one block, where a small
landing problem is solved by trying all roundings.

Defined results: a null text has size 0; null is a source of its own, ordered last; documents of size 0
take 0 words; repeated rows are documents of their own; an empty table gives an empty result. Columns
other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, n_words, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with target: share of all sizes dealt by weight, at most `most` times a source's size, what is above dealt again.

    The fixed point of that dealing is target = min(most * size, level * weight), and the level is the
    largest of (share - caps of the sources filled first) / (weights of the others), taken over how many
    sources are filled. One row a source, so the ordered windows see no documents.
    """
    listed = F.array(*(F.lit(float(w)) for w in weights))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = totals.withColumn("weight", F.element_at(listed, (number % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(most))
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    t = t.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.sum("source_size").over(all_rows) * F.lit(share) - F.col("filled")) / (F.sum("weight").over(all_rows) - F.col("gone"))
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(all_rows))
    return t.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """p after the flight phase: Σ size * p and Σ p stay as they are, and at most a few entries stay strictly between 0 and 1; none if land."""
    p, x, rng, eps = p.astype(float).copy(), size.astype(float), random.Random(seed), 1e-9
    wanted, counted = float(x @ p), float(p.sum())
    waiting = iter(np.flatnonzero((p > eps) & (p < 1 - eps)).tolist())
    held: list[int] = []
    while True:
        held += itertools.islice(waiting, 3 - len(held))
        if len(held) < 2:
            break
        a, b, *rest = held
        if rest:
            u = [x[b] - x[rest[0]], x[rest[0]] - x[a], x[a] - x[b]]
        elif x[a] == x[b]:
            u = [1.0, -1.0]
        else:
            break  # two documents of different sizes: no direction keeps both sums
        if not any(u):
            u = [1.0, -1.0, 0.0]
        top = max(map(abs, u))
        u = [v / top for v in u]
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(held, u, strict=True):
            p[k] += step * v
            if p[k] < eps or p[k] > 1 - eps:
                p[k] = round(p[k])
        held = [k for k in held if 0 < p[k] < 1]
    if land and held:
        def miss(ends: tuple[int, ...]) -> tuple[float, float]:
            q = p.copy()
            q[held] = ends
            return abs(float(x @ q) - wanted), abs(float(q.sum()) - counted)

        p[held] = min(itertools.product((0, 1), repeat=len(held)), key=miss)
    return p


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = 4096) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken: one row a document."""
    sized = written(n_words(docs.select("doc_id", "text", "source"), "text", "size", ["doc_id", "source"]))
    totals = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    # Repeated rows get a number each, so that a block's content doesn't depend on the order in which rows are read.
    units = sized.groupBy("doc_id", "source", "size").count().withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = totals.select(F.col("source").alias("of"), "source_size", "target", F.floor(rate).cast("double").alias("whole"), (rate - F.floor(rate)).alias("p"))
    units = units.drop("count").join(rated, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    open_, done, columns, n_round = written(units), [], units.columns, 0
    kept = [sized, totals, open_]
    while True:
        counts = open_.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")).cache()
        last = (counts.agg(F.max("blocks")).first()[0] or 1) <= 1
        dealt = open_.join(counts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(n_round)), F.col("blocks"))).withColumn("order", F.xxhash64("doc_id", "size", "nth", F.lit(-1 - n_round)))

        def fly(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["order", "doc_id", "size", "nth"], na_position="last")
            return rows.assign(p=flight(rows["size"].to_numpy(), rows["p"].to_numpy(), int(rows["order"].iloc[0]), int(rows["blocks"].iloc[0]) == 1))[columns]

        flown = written(dealt.groupBy("source", "block").applyInPandas(fly, open_.schema))
        counts.unpersist()
        kept.append(flown)
        still = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.filter(~still))
        if last:
            break
        open_, n_round = flown.filter(still), n_round + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("long")
    result = written(out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")))
    for x in kept:
        dropped(x)
    return result
