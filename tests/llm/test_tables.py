import hashlib
import json
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tagloom.llm import media, mixing, urls, wrappers
from tagloom.llm.queries import RULES

PAGE = "page_id long, url string, html string"


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def test_rules_and_hosts(spark):
    found = ["http://A.example.org/es/x?y#z", "https://example.org/en/17", "http://example.org/en/2", "x://b.COM/fr/", "http://b.com/de/1", "http://b.com/frx", "http://com", "http://org", "http://notorg/", "no scheme", "", None, "http://bad.net/a://b", "http://sub.bad.net?q", "http://notbad.net/", "http://É.net/p", "ftp://h:80/p"]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(found)] + [(3, found[3], "again"), (None, None, None)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.net",), (None,), ("h:80",), ("bad.net",)], "key string")
    got = urls.judged(pages, listed, RULES).collect()
    assert len(got) == len(found) + 2
    for r in got:
        host, path = split(r.url)
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.text), default=None)
        block = any(host == h or host.endswith("." + h) for h in ("bad.net", "h:80"))
        assert (r.host, r.path, r.rule, r.listed) == (host, path, rule.text if rule else None, block)
        assert r.verdict == (rule.verdict if rule else "block" if block else "allow")
    assert urls.judged(pages.limit(0), listed, RULES).count() == 0
    assert not any(r.listed for r in urls.judged(pages, listed.limit(0), RULES).collect())


@pytest.mark.parametrize("most_bytes", [1 << 20, 300])
def test_cascade_is_exact(spark, most_bytes):
    universe = spark.range(6000).select(F.concat(F.lit("host"), "id").alias("key"))
    listed = universe.filter(F.crc32("key") % 4 == 0)
    made = urls.cascade(listed, universe, rate=0.2, most_bytes=most_bytes)
    assert (len(made.segments) > 1) == (most_bytes < 1000) and max(len(s) for s in made.segments) >= 3
    keys = universe.select("key", urls.key_hash(F.col("key")).alias("h"), (F.crc32("key") % 4 == 0).alias("y")).toPandas()
    assert (made.listed(keys.h.to_numpy().view(np.uint64)) == keys.y.to_numpy()).all()


def html(title, paragraphs, ad, extra=""):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body><div id=top>Site &amp; more</div><nav><ul><li><a href=/a>{ad}</a></ul></nav><div class='ad'>{ad}</div>{extra}<h1>{title}</h1>" + "".join(f"<p>{p}" for p in paragraphs) + "<div class=imprint>Imprint of the site</div><footer>&copy;</footer></body></html>"


def test_induced_template(spark):
    rows = [(i, "http://h.example/x", html(f"Title {i}", [f"Body  {i} &lt;b&gt; &eacute;<br>two", f"more {i}"], f"buy {i}", "<aside>see also</aside>" if i % 2 else "")) for i in range(12)]
    rows += [(100, "http://few.example/", html("One", ["only"], "x")), (101, None, None), (102, "http://h.example/", ""), (100, "http://few.example/", html("One", ["only"], "x")), (103, "u", "<p>open <b>and <i>never closed"), (104, "u", "<article><header><h1>T</h1></header><p>x<div class='comments'>nice</div><form>f</form></article>junk <nav>n</nav>")]
    got = {r.page_id: r for r in wrappers.extracted(spark.createDataFrame([(*r, "old") for r in rows], PAGE + ", text string")).collect()}
    for i in range(12):
        # "Site & more" and "Imprint" are the same on all pages of the host; they stay where the host has too few pages to tell.
        assert got[i].text == f"Title {i}\nBody {i} <b> é two\nmore {i}" and got[i].n_chars == len(got[i].text)
    assert got[100].text == "Site & more\nOne\nonly\nImprint of the site"
    assert (got[101].text, got[102].text, got[103].text, got[104].text) == ("", "", "open and never closed", "T\nx")
    assert wrappers.extracted(spark.createDataFrame([], PAGE)).count() == 0


def test_constants_inside_articles(spark):
    """What a host's pages share goes from articles too, but an article that is repeated stays."""
    page = lambda i, k: f"<nav>n{i}</nav><article><h1>Title {k}</h1><p>Body {k}</p><div class=strip>Read more on our site</div></article><div class=ad>buy {i}</div>"
    pages = spark.createDataFrame([(i, "http://a.example/", page(i, min(i, 12))) for i in range(50)], PAGE).repartition(3)
    got = wrappers.extracted(pages).collect()
    assert len(got) == 50 and all(r.text == f"Title {min(r.page_id, 12)}\nBody {min(r.page_id, 12)}" for r in got)


def test_links_of_content(spark):
    """Blocks of links go where their targets are the same on a host's pages, and stay where they vary."""
    page = lambda i: f"<div><p><a href=/inbox>Messages ({i})</a></p></div><h1><a href=/{i}>Title {i}</a></h1><p>Body {i}</p><ul><li><a href='/ref{i}'>Source {i}</a></ul>"
    pages = spark.createDataFrame([(i, "http://l.example/", page(i)) for i in range(12)], PAGE).repartition(3)
    assert {r.page_id: r.text for r in wrappers.extracted(pages).collect()} == {i: f"Title {i}\nBody {i}\nSource {i}" for i in range(12)}


def test_every_skeleton_counts(spark):
    """The template has nodes of all layouts, so what they share is found to be constant in rare ones too."""
    layouts = [(f"<div class=l{k}><p>text {k} {j}</p></div>" * (2 if k < 90 else 1)) + ("<section class=z>Our imprint</section>" if k >= 90 else "") for k in range(100) for j in range(2 if k < 90 else 1)]
    pages = spark.createDataFrame([(i, "http://many.example/", f"<html><body>{x}</body></html>") for i, x in enumerate(layouts)], PAGE).repartition(3)
    got = {r.page_id: r.text for r in wrappers.extracted(pages).collect()}
    assert len(got) == 190 and all(got[180 + k] == f"text {90 + k} 0" for k in range(10))


def test_trees():
    a, b = (wrappers.thawed(json.loads(x)) for x in ('["r", [["a", []], ["b", [["c", []]]]]]', '["r", [["x", []], ["b", [["d", []]]]]]'))
    assert wrappers.matched(a, b, {})[0] == 2
    assert wrappers.frozen(wrappers.merged(a, b)) == ("r", (("x", ()), ("a", ()), ("b", (("d", ()), ("c", ())))))
    assert wrappers.read("<div>" * 500 + "deep")[1][0][1] == "deep"
    assert wrappers.folded(wrappers.read("<ul><li>1<li>2<p>x<li>3</ul>")[0]) == ("html", (("ul", (("li", (("p", ()),)),)),))


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 500, 300)
    p = flown = np.full(300, 0.37)
    flown = mixing.flight(size, p, 1, False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2 and abs(size @ flown - size @ p) < 1e-6 and abs(flown.sum() - p.sum()) < 1e-6
    landed = mixing.flight(size, p, 1, True)
    assert set(landed) <= {0.0, 1.0} and abs(size @ landed - size @ p) <= size.max()
    chosen = np.mean([mixing.flight(size[:40], p[:40], s, True) for s in range(400)], 0)
    assert abs(chosen.mean() - 0.37) < 0.02 and chosen.min() > 0.2 and chosen.max() < 0.65  # landing favours some roundings


def dealt(sizes):
    """Targets by dealing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, rest, live = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while rest > 1e-9 and live:
        total = sum(weight[s] for s in live)
        for s in live:
            out[s] += rest * weight[s] / total
        rest = sum(max(0, out[s] - 2 * sizes[s]) for s in live)
        for s in set(live):
            if out[s] >= 2 * sizes[s]:
                out[s] = 2 * sizes[s]
                live.discard(s)
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_mixture(spark, block):
    rng = np.random.default_rng(2)
    names = ["a", "B", None, "é", "zz", "empty", "c"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 80))) if i % 50 else None, names[0] if rng.random() < 0.4 else "empty" if i % 97 == 0 else str(rng.choice(["B", "é", "zz", "c"])) if i % 9 else None) for i in range(900)]
    rows = [(i, "" if s == "empty" else t, s) for i, t, s in rows] + [rows[10], rows[10], (None, "one two", "c")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, block=block).collect()
    again = mixing.mix(docs.repartition(7), block=block).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
        longest[s] = max(longest[s], len((t or "").split()))
    want = dealt(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_images(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 64)]
    vectors += [(200 + i, vectors[7][1]) for i in range(30)]
    frame = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, image string")
    found, members = media.copies(media.pictures(frame.filter("vec_id % 20 = 0"), change=True), media.pictures(frame))
    got = defaultdict(set)
    for r in found.collect():
        got[r.query_id].add(r.class_id)
    kept = {r.id: r.class_id for r in members.collect()}
    assert kept[205] == 7 and kept[5] == 5 and 100 not in kept
    # Brute force: every descriptor of a query with every one of each picture.
    described = {i: media.described(media.decoded(media.png(media.drawn(v)))) for i, v in vectors[:60]}
    hits = total = 0
    for q in range(0, 60, 20):
        p, d = media.described(media.decoded(media.png(media.edited(media.drawn(vectors[q][1]), q))))
        for i, (t, e) in described.items():
            a, b = np.nonzero(np.bitwise_count((d[:, None, :] ^ e[None, :, :]).view(np.uint64)).sum(2) <= media.FARTHEST)
            rows = {f"{s}_{c}": x[k, j] for s, x, k in (("q", p, a), ("t", t, b)) for j, c in enumerate(("x", "y", "level", "turn"))}
            import pandas as pd

            if len(a) and media.consensus(pd.DataFrame(rows))[0] >= media.FEWEST:
                total += 1
                hits += i in got[q]
        assert q in got[q]
    assert hits >= 0.9 * total and got[200] == {7}


def test_image_pairs_equal_brute_force(spark):
    """No image pair is lost because the Hamming tables miss some of its descriptor pairs."""
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(80)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.class_id): r.inliers for r in media.copies(media.pictures(frame, change=True), media.pictures(frame))[0].collect()}
    drawn = [media.drawn(r.embedding) for r in frame.orderBy("vec_id").collect()]
    images, queries = [media.described(g.astype(np.float32)) for g in drawn], [media.described(media.edited(g, i).astype(np.float32)) for i, g in enumerate(drawn)]
    want = {}
    for q, (p, d) in enumerate(queries):
        for i, (t, e) in enumerate(images):
            a, b = np.nonzero(np.bitwise_count((d[:, None, :] ^ e[None, :, :]).view(np.uint64)).sum(2) <= media.FARTHEST)
            rows = pd.DataFrame({f"{s}_{c}": x[k, j] for s, x, k in (("q", p, a), ("t", t, b)) for j, c in enumerate(("x", "y", "level", "turn"))})
            if len(a) and (n := media.consensus(rows)[0]) >= media.FEWEST:
                want[q, i] = n
    assert got == want and len(want) > 70


def test_image_query_gives_classes(spark):
    """Matches and the class of every vector, joined by class_no."""
    rows = __spark_entry__.queries()["op2_image_copies"](spark, "/root/testdata/sf0.001").collect()
    members = {r.id: r for r in rows if r.part == "member"}
    assert members.keys() == {r.vec_id for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("size(embedding) > 0").collect()}
    matches = [r for r in rows if r.part == "match"]
    assert matches and all(r.id % 20 == 0 and r.inliers >= media.FEWEST and r.n_copies == sum(m.class_no == r.class_no for m in members.values()) for r in matches)


def test_image_meetings_are_not_shuffled(spark, monkeypatch):
    """Tiles and blocks give the same matches, and no plan has a join by descriptors' bits, whose rows grow with queries times images."""
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    one = media.copies(media.pictures(frame, change=True), media.pictures(frame))[0]
    want = sorted(map(tuple, one.drop("class_no").collect()))
    monkeypatch.setattr(media, "TILE", 7)
    assert sorted(map(tuple, media.copies(media.pictures(frame, change=True), media.pictures(frame))[0].drop("class_no").collect())) == want and len(want) > 50
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "d0" not in plan and "FlatMapCoGroupsInArrow" in plan and "Generate explode(array" not in plan


def test_image_groups_grow_with_keypoints_only(spark, monkeypatch):
    """However few pictures a tile holds, all queries are one block while their keypoints are few: each image is shuffled once. Small blocks give the same matches."""
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    found = lambda: media.copies(media.pictures(frame, change=True), media.pictures(frame))[0]
    want = sorted(map(tuple, found().drop("class_no").collect()))
    dealt, parts = [], media.parts
    monkeypatch.setattr(media, "parts", lambda *how: dealt.append(parts(*how)) or dealt[-1])
    monkeypatch.setattr(media, "TILE", 7)
    assert sorted(map(tuple, found().drop("class_no").collect())) == want and dealt == [9, 1]
    monkeypatch.setattr(media, "GROUP", 20_000)
    assert sorted(map(tuple, found().drop("class_no").collect())) == want and min(dealt[2:]) > 3


def test_pictures_of_one_size_are_described_together():
    rng = np.random.default_rng(8)
    for shape in ((96, 96), (40, 130), (25, 24), (12, 12)):
        grays = rng.integers(0, 255, (5, *shape)).astype(np.float32)
        for gray, (points, found) in zip(grays, media.described_all(grays), strict=True):
            one = media.described(gray)
            assert (one[0] == points).all() and (one[1] == found).all() and (len(found) > 0 or min(shape) < 40)


def test_image_formats():
    gray = np.arange(300, dtype=np.uint8).reshape(15, 20)
    assert (media.decoded(media.png(gray)) == gray).all()
    assert (media.decoded(b"P5 20 15 255\n" + gray.tobytes()) == gray).all()
    assert (media.decoded(b"P6\n2 1\n255\n" + bytes([0, 3, 6, 9, 9, 9])) == [[3, 9]]).all()
    assert all(media.decoded(x) is None for x in (None, b"", b"nothing", b"\x89PNG\r\n\x1a\n", b"P5 x", hashlib.sha256().digest()))


def test_images_under_one_id_and_none(spark):
    """Images are told apart by their bytes: shared and missing ids lose none."""
    rng = np.random.default_rng(8)
    pictures = [media.png(media.drawn(rng.normal(size=64).tolist())) for _ in range(4)]
    rows = [(5, pictures[0]), (5, pictures[1]), (None, pictures[2]), (7, pictures[3]), (9, pictures[3]), (None, pictures[0]), (8, None), (None, b"no picture")]
    images = spark.createDataFrame(rows, "id long, image binary")
    queries = spark.createDataFrame([(k, p) for k, p in enumerate(pictures)] + [(None, pictures[1]), (40, pictures[2])], "id long, image binary")
    found, members = media.copies(queries, images)
    classes = {r.class_no: r.class_id for r in members.collect()}
    assert sorted((r.query_id is None, r.query_id or 0, r.class_id is None, r.class_id or 0) for r in found.collect()) == [(False, 0, False, 5), (False, 1, False, 5), (False, 2, True, 0), (False, 3, False, 7), (False, 40, True, 0), (True, 0, False, 5)]
    assert members.count() == 7 and len(classes) == 5 and len({r.class_no for r in found.collect()}) == 4
    assert media.copies(queries.limit(0), images)[0].count() == 0 and media.copies(queries, images.limit(0))[0].count() == 0
