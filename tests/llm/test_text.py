import hashlib
import math
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import common, contexts, digest, graph, jaccard, pieces

ODD = [(1, "The same  text"), (2, "the SAME\ttext "), (3, None), (4, ""), (5, "ﬁne Straße Å Å"), (6, "fine strasse"), (7, "x" * 3000), (7, "x" * 3000), (9, "日本語 😀  tail"), (10, "last")]
TEXT = "doc_id long, text string"


def canonical(t):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub("[\x09-\x0d\x20\x85   ]+", " ", n(n(t or "").casefold())).strip(" ")


def fingerprint(t):
    c = canonical(t).encode()
    return f"{xxhash.xxh64_intdigest(c, 42):016x}{xxhash.xxh64_intdigest(c, xxhash.xxh64_intdigest(b'tagloom', 42)):016x}"


def test_fingerprints(spark):
    docs = spark.createDataFrame([(*r, "en") for r in ODD], TEXT + ", digest string")
    got = digest.fingerprints(docs).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, fingerprint(t)) for i, t in ODD)
    assert {r.doc_id: r.class_id for r in got}[2] == 1 and {r.doc_id: r.class_id for r in got}[4] == 3
    assert digest.fingerprints(docs.limit(0)).count() == 0


def test_equal_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(digest, "wide", lambda c: F.concat(F.lit("same"), F.substring(c, 1, 1)))
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "AB"), (4, "b")], TEXT)
    got = {r.doc_id: r for r in digest.fingerprints(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and got[4].fingerprint == "sameb"
    assert [got[i].class_id for i in (1, 2, 3, 4)] == [1, 2, 1, 4]
    # "ab" and "ac" share a digest; an edited text that is one of them has its fingerprint.
    pairs = spark.createDataFrame([(1, "ab"), (2, "bb"), (3, "ac"), (4, "a"), (5, "zz")], TEXT)
    edited = {r.doc_id: r for r in digest.edited_fingerprints(pairs).collect()}
    assert edited[1].edited_fingerprint == edited[1].fingerprint == "samea-" + hashlib.sha256(b"ab").hexdigest() != edited[3].fingerprint
    assert edited[2].edited_fingerprint == "sameb" and edited[3].edited_fingerprint.startswith("samea-")


@pytest.mark.parametrize("size", [50, 8 << 20])
def test_edited_fingerprints(spark, monkeypatch, size):
    monkeypatch.setattr(digest, "BUCKET_BYTES", size)
    rows = [r for r in ODD if r[0] != 7] + [(i, f"text {i % 5} of a row") for i in range(20, 60)]
    got = {r.doc_id: r for r in digest.edited_fingerprints(spark.createDataFrame(rows, TEXT)).collect()}
    rows.sort()
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited))
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(after)))
    assert len(got) == len(rows)


def test_fingerprints_of_few(spark):
    assert digest.edited_fingerprints(spark.createDataFrame([], TEXT)).count() == 0
    one = digest.edited_fingerprints(spark.createDataFrame([(5, "abcd")], TEXT)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


@pytest.fixture(scope="module")
def table():
    return pieces.load()


def test_pieces_equal_the_library(spark, table):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for _, t in ODD] + ["  two  spaces ", "a\nb\t c\r\n", "12345 +1 (098) 555-0174", "naïve café", "w" * 200, "the theeee       end"]
    docs = spark.createDataFrame(list(enumerate(texts)), TEXT)
    got = {r.doc_id: r for r in pieces.encoded(docs).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].piece_ids) == (model.encode(t) if t else []) and got[i].round_trip and got[i].n_pieces == len(got[i].piece_ids)
    back = pieces.decoded(pieces.encoded(docs, keep=["doc_id"]), keep=["doc_id"]).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}
    relational = pieces.encode_relational(docs.filter("length(text) < 60 or text is null")).collect()
    assert relational and all(list(r.piece_ids) == list(got[r.doc_id].piece_ids) for r in relational)
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_unigram_viterbi():
    scores = {"▁": -3.0, "a": -4.0, "b": -4.0, "ab": -5.0, "▁a": -6.0, "ba": -5.5, "bab": -9.0}
    names = [*scores, *(f"<0x{b:02X}>" for b in range(256))]
    normal = np.array([True] * len(scores) + [False] * 256)
    p = pieces.Pieces(names, np.array([*scores.values(), *[0.0] * 256]), normal, {b: len(scores) + b for b in range(256)}, True)

    def best(word):
        return max(([scores[word[:k]] + best(word[k:])[0], [word[:k], *best(word[k:])[1]]] for k in range(1, len(word) + 1) if word[:k] in scores), default=[0.0, []]) if word else [0.0, []]

    for word in ("▁abab", "▁ba", "▁aabbab"):
        assert [names[i] for i in p.viterbi_one(word)] == best(word)[1]
    assert [names[i] for i in p.viterbi_one("▁é")] == ["▁", "<0xC3>", "<0xA9>"]


def components(rows, n=5, percent=75):
    sets, found = {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in sets}


def variants(rng, n):
    """Groups of copies, near-copies, chains and strangers; a passage that many share."""
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    passage, rows = [word() for _ in range(12)], []
    for g in range(n):
        base = [word() for _ in range(rng.integers(1, 60))]
        for _ in range(rng.integers(1, 9)):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = word()
            if rng.random() < 0.3:
                t += passage
            rows.append((len(rows) + 1, " ".join(t)))
            base = t if rng.random() < 0.3 else base
    return rows


@pytest.mark.parametrize("sketch, pivots", [(8, 3), (1, 1)])
def test_components_equal_brute_force(spark, monkeypatch, sketch, pivots):
    monkeypatch.setattr(jaccard, "SKETCH", sketch)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rows = variants(np.random.default_rng(7), 40) + [(1000, None), (1001, ""), (1002, "One two"), (1003, "one  TWO"), (1004, "one two three"), (1005, " \n"), (1006, "a " * 3000), (1007, "a " * 3000)]
    rows.append(rows[0])
    docs = spark.createDataFrame([(*r, 1) for r in rows], TEXT + ", n_shingles int").repartition(5)
    got = jaccard.near_components(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)


def test_components_take_few_jobs(spark):
    """Any edges, in few jobs: the driver keeps memory for every plan and every shuffle."""
    rng = np.random.default_rng(4)
    path = [(k + 1, k) if k % 3 else (k, k + 1) for k in range(200, 260)]
    star = [(500, k) for k in range(501, 600)] * 2
    edges = [*path, *star, *((int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))), (7, 7), (900, 900)]
    root = {k: k for e in edges for k in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    linked = {k for a, b in edges if a != b for k in (a, b)}
    got = [tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert sorted(got) == sorted((k, top(k)) for k in linked)
    spark.sparkContext.setJobGroup("stars", "")
    got = graph.components(spark.createDataFrame(star, "u long, v long"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.count() == 100 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("stars")) <= 10
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_no_documents_have_no_components(spark):
    assert jaccard.near_components(spark.createDataFrame([], TEXT)).count() == 0
    assert [tuple(r) for r in jaccard.near_components(spark.createDataFrame([(3, None)], TEXT)).collect()] == [(3, 0, 3)]


def test_marks_travel_in_parts(spark, monkeypatch):
    """What tells shared shingles is 16 MB, in one range for a small table; no single value is as large."""
    made = []
    monkeypatch.setattr(jaccard, "written", lambda df: made.append(common.written(df)) or made[-1])
    monkeypatch.setattr(jaccard, "dropped", lambda df: None)
    rows = [(i, " ".join(f"w{(i // 2 * 50 + j) * 7919}" for j in range(60))) for i in range(400)]
    got = jaccard.near_components(spark.createDataFrame(rows, TEXT))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i // 2 * 2 for i, _ in rows}
    sizes = [df.agg(F.max(F.octet_length("bits"))).first()[0] for df in made if "bits" in df.columns]
    assert sizes and max(sizes) <= 1 << 20


def test_context_trees(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["the", "river", "of", "stones", "Thé", "walks", "riverbank", "a"], rng.integers(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (3, "again a repeated id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], TEXT + ", base_score double").repartition(3)
    got = contexts.scored(docs, depth=3).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6), round(brute(rows, held, t), 3)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got) == want
    by_join = contexts.scored(docs, depth=3, most=0).collect()
    assert sorted(round(r.score, 3) for r in by_join) == sorted(round(r.score, 3) for r in got)
    assert contexts.scored(docs.limit(0)).count() == 0


def peak(run):
    """Most MB that Python and numpy held during a call, above those before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_context_trees_are_held_one_decision_at_a_time():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 1 << 56, 100_000).astype(np.uint64))
    n = np.ones(len(key), np.int64)
    assert peak(lambda: [len(levels) for levels in contexts.forest(key, n, 6, 2)]) < 90


def test_parts_are_spelled_a_slice_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    found = [bytes(rng.choice(list(b"abcdefghij"), rng.integers(1, 12))) for _ in range(3000)] + [b" one tw", b" one \n", b"\n"]
    c = rng.integers(0, 5, len(found))
    key, size = contexts.spelled(found, 6)
    keys, n = contexts.summed(key, np.repeat(c, size))
    values = rng.random(len(keys)).astype(np.float32)
    monkeypatch.setattr(contexts, "SPELLED", 7)
    got = contexts.gram_counts(found, c, 6)
    assert (got[0].to_numpy().view(np.uint64) == keys).all() and (got[1].to_numpy() == n).all()
    lp, whole = contexts.part_sums(found, keys, values, 6)
    each = values[np.searchsorted(keys, key)].astype(float)
    assert (whole == size).all() and (lp == np.bincount(np.repeat(np.arange(len(size)), size), each, len(size))).all()
    monkeypatch.undo()
    many = found * 200
    assert peak(lambda: contexts.part_sums(many, keys, values, 6)) < peak(lambda: contexts.spelled(many, 6)) / 2


def symbols(text, depth=3, reach=3):
    """(context, byte) of a text, the nearest context byte first."""
    words, out = (text or "").encode().lower().split(), []
    before = b""
    for w in [*words, None]:
        lead = before[-reach:] + b" "
        stream = b"\n" if w is None else w + b" "
        for k in range(len(stream)):
            seen = (lead if k < reach else b"") + stream[:k]
            out.append(((b" " * depth + seen)[::-1][:depth], stream[k]))
        before = w
    return out


_trees = {}


def brute(rows, held, text, depth=3):
    """The score by a tree of dictionaries."""
    if "t" not in _trees:
        counts = defaultdict(lambda: [0, 0])
        for i, t in rows:
            if not held(i):
                for ctx, b in symbols(t):
                    for d in range(depth + 1):
                        for bit in range(8):
                            counts[ctx[:d], bit, b >> (8 - bit)][b >> (7 - bit) & 1] += 1
        children = defaultdict(set)
        for ctx, bit, p in counts:
            if ctx:
                children[ctx[:-1], bit, p].add((ctx, bit, p))
        own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
        whole, weight = {}, {}
        for k in sorted(counts, key=lambda k: -len(k[0])):
            if len(k[0]) == depth:
                whole[k], weight[k] = own[k], 1.0
            else:
                below = sum(whole[x] for x in children[k])
                whole[k] = np.logaddexp(own[k], below) - math.log(2)
                weight[k] = math.exp(own[k] - math.log(2) - whole[k])
        _trees["t"] = counts, weight
    counts, weight = _trees["t"]
    total = 0.0
    for ctx, b in symbols(text):
        for bit in range(8):
            p = None
            for d in range(depth, -1, -1):
                k = (ctx[:d], bit, b >> (8 - bit))
                if k not in counts:
                    continue
                z, o = counts[k]
                q = (o + 0.5) / (z + o + 1)
                p = q if p is None else weight[k] * q + (1 - weight[k]) * p
            p = 0.5 if p is None else p
            total += math.log10(p if b >> (7 - bit) & 1 else 1 - p)
    return total
