"""Packing, divergence and resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tagloom.llm import common, divergence, packing, resampling

DOCS = "doc_id long, text string, lang string, source string, length string, number int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)))), f"l{i % 2}", f"s{i % 5}" if i % 9 else None, "x", 1) for i in range(150)]
    rows += [(i, rows[7][1], "l0", "s0", None, None) for i in range(200, 240)]
    rows += [(None, None, None, None, None, None), (None, None, None, None, None, None), (301, "", "l9", "", "", 0), (3, rows[3][1], "l1", "s3", "x", 1), (302, "Word's  <|endoftext|>\ttail\n ŉ \x1c ½ " + "long " * 9000, "l1", "s2", "", 2), (303, "日本語" * 300, "l1", "s2", "", 2)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


CAPACITIES = [packing.Capacity(), packing.Capacity(64, 3, 900)]


@pytest.mark.parametrize("capacity", CAPACITIES)
def test_packing(docs, capacity):
    tokenizer = Tokenizer.from_file(packing.MODEL)
    got = packing.packed(docs, capacity).collect()
    whole = defaultdict(list)
    for r in docs.collect():
        whole[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
    wanted = []
    for i, texts in whole.items():
        for ids in texts:
            for piece, start in enumerate(range(0, len(ids), capacity.longest)):
                cut = ids[start : start + capacity.longest]
                wanted.append((i, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted(map(repr, wanted)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= capacity.tokens and len(s) <= capacity.documents and sum(packing.attention(n) for _, n in s) <= capacity.attention
    if capacity.documents > 100:
        assert len(sequences) == -(-sum(r.length for r in got) // capacity.tokens)
    assert packing.packed(docs.limit(0), capacity).count() == 0


def plain_best_fit(lengths, capacity, weights):
    """One piece after another into the sequence that is left with the least norm."""
    caps, bins = (capacity.tokens, capacity.documents, capacity.attention), []
    for n in sorted(lengths, reverse=True):
        need = (n, 1, packing.attention(n))
        fits = [b for b in bins if all(x >= y for x, y in zip(b, need, strict=True))]
        if not fits:
            fits = [list(caps)]
            bins += fits
        best = min(fits, key=lambda b: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, b, need, caps, strict=True)))
        for k in range(3):
            best[k] -= need[k]
    return len(bins)


def test_counts_give_what_single_pieces_give():
    rng = np.random.default_rng(2)
    for capacity in CAPACITIES:
        lengths = np.minimum(capacity.longest, rng.geometric(0.03, 400)).tolist()
        counts = dict(zip(*map(list, np.unique(lengths, return_counts=True)), strict=True))
        for score, weights in packing.WAYS:
            kinds = packing.placed({int(k): int(v) for k, v in counts.items()}, capacity, score, weights)
            assert sorted(n for b, h in kinds for n, k in h for _ in range(k * b)) == sorted(lengths)
            assert all(sum(n * k for n, k in h) <= capacity.tokens and sum(k for _, k in h) <= capacity.documents and sum(packing.attention(n) * k for n, k in h) <= capacity.attention for _, h in kinds)
            if score == "norm" and weights == packing.WAYS[0][1]:
                assert sum(b for b, _ in kinds) == plain_best_fit(lengths, capacity, weights)
    with pytest.raises(ValueError):
        packing.Capacity(documents=0).longest


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize(("cells", "rows", "held"), [(1 << 21, 256, 200_000), (60, 2, 10)])
def test_divergence(docs, monkeypatch, cells, rows, held):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "AT_ONCE", held)
    got = divergence.audited(docs, least=8, top=7, cells=cells, rows=rows).collect()
    n, df, groups = Counter(), Counter(), set()
    for r in docs.collect():
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r.text))
        n.update((lang, source, t) for t in found)
        df.update((lang, t) for t in set(found))
    kept = defaultdict(list)
    for (lang, t), k in df.items():
        if k >= 8:
            kept[lang].append(t)
    share = lambda c, total, v: 1 + 10**9 * (c + 5) // (total + 5 * v)
    p, q = {}, {}
    for lang, source in groups:
        total = sum(n[lang, source, t] for t in kept[lang])
        p[lang, source] = [share(n[lang, source, t], total, len(kept[lang])) for t in kept[lang]]
    for lang in {x for x, _ in groups}:
        each = [sum(n[lang, s, t] for x, s in groups if x == lang) for t in kept[lang]]
        q[lang] = [share(c, sum(each), len(each)) for c in each]
    wanted = []
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(-sum(abs(a - b) for a, b in zip(own, p[lang, s], strict=True)), s.encode(), s) for x, s in groups if x == lang and s != source]
        best = [(b - a, t.encode(), t) for t, a, b in zip(kept[lang], own, q[lang], strict=True) if n[lang, source, t] and a > b]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:7])):
            wanted += [(lang, source, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    assert sorted(wanted) == sorted(tuple(r) for r in got) and {r.part for r in got} == {"pair", "term"}
    assert divergence.audited(docs.limit(0)).count() == 0


def test_shares_don_t_overflow():
    n, total = np.array([[9 * 10**14, 0]]), np.array([[9 * 10**14 + 3]])
    assert divergence.shares(n, total, 2).tolist() == [[1 + 10**9 * (9 * 10**14 + 5) // (9 * 10**14 + 13), 1 + 5 * 10**9 // (9 * 10**14 + 13)]]


def plain_resampling(rows, target, n, buckets, fewest):
    def features(t):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return w, [" ".join(w[i : i + k]).encode() for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]

    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])
    s, t = count([x for _, x in rows]), count(target)
    every = (sum(s.values()), sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (every[0] + buckets) / ((s[b] + 1) * (every[1] + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        w, f = features(x)
        weight = sum(gain[zlib.crc32(v) % buckets] for v in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= fewest))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(drawn[: len(drawn) * 10 // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize(("n", "buckets", "fewest", "size"), [(1, 10_000, 20, 1 << 16), (1, 50, 1, 40), (3, 1000, 1, 40)])
def test_resampling(spark, docs, n, buckets, fewest, size):
    target = spark.createDataFrame([("ab cd", 1), (None, 2), ("", 3), ("Ab, abc-d 42 é", 4)], "text string, row int")
    got = resampling.resampled(docs, target, n, buckets, fewest=fewest, size=size).collect()
    wanted = plain_resampling([(r.doc_id, r.text) for r in docs.collect()], ["ab cd", None, "", "Ab, abc-d 42 é"], n, buckets, fewest)
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in got)
    assert resampling.resampled(docs.limit(0), target, n, buckets).count() == 0
    assert resampling.resampled(docs, target.limit(0), n, buckets).count() == len(got)


def test_chunks_own_each_feature_once():
    text = "Ab  cd,ef gh 12 ".encode() * 5 + b"x" * 50 + " é日本 y".encode()
    for n in (1, 2, 4):
        whole = resampling.words(text)
        for size in (1, 7, 30, 1000):
            found = Counter()
            for chunk, own in resampling.chunks(text, n, size):
                found.update(resampling.features(resampling.words(chunk), own, n))
            assert found == Counter(resampling.features(whole, len(whole), n))


def test_segments_cut_at_gaps(monkeypatch):
    text = "Ab  cd,ef\tgh 12 ".encode() * 40 + b"x" * 50 + " é日本 y".encode()
    for size in (1, 7, 64, 1000):
        parts = list(common.segments(text, divergence.GAP, size))
        assert b"".join(parts) == text and [w for p in parts for w in divergence.terms(p)] == divergence.terms(text)
    words = packing.Words(open(packing.MODEL).read())
    whole = words.piece(text)
    monkeypatch.setattr(packing, "segments", lambda t, gap: common.segments(t, gap, 30))
    assert words.ids(text) == whole and list(common.segments(b"", packing.SPACE)) == []
