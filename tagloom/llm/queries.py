"""The queries that apply each operator, with production parameters, to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contexts, digest, divergence, jaccard, media, mixing, packing, pieces, quality, resampling, toxicity, urls, wrappers
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

RULES = (urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"), urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block"))
#: Hosts that are blocked with their subdomains where no rule fits.
BLOCKED = ("cheap-pills.example.com", "spam-farm.example.org", "casino-win.example.net", "tracker.example.net")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in BLOCKED], "key string")
    return urls.judged(table(spark, sf_dir, "pages"), listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited crops of the pictures of every vector whose id is divisible by 20, searched among the pictures of all.

    Rows of part `match` name a query's class of pictures of the same bytes and how many keypoints agree; those of
    part `member` give the class of every vector that has a picture. class_no joins them: class_id is its smallest id.
    """
    vectors = table(spark, sf_dir, "embeddings")
    found, members = media.copies(media.pictures(vectors.filter("vec_id % 20 = 0"), change=True), media.pictures(vectors))
    sizes = members.groupBy("class_no").agg(F.count("*").alias("n_copies"))
    matches = found.join(sizes, "class_no").select(F.lit("match").alias("part"), F.col("query_id").alias("id"), "class_id", "class_no", "inliers", "n_copies")
    return matches.unionByName(members.join(sizes, "class_no").select(F.lit("member").alias("part"), "id", "class_id", "class_no", "n_copies"), allowMissingColumns=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.scored(table(spark, sf_dir, "documents"))


def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_filter, op2_image_copies, op3_toxicity, op4_context_trees, op5_wrappers, op6_quality, op7_jaccard, op8_sentencepiece, op9_fingerprint, op10_mixing, op11_packing, op12_divergence, op13_resampling)}

SQL: dict[str, str] = {
    "op1_url_filter": f"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(h, p, v) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN {" OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED)} THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN fits USING (page_id)""",
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, term) AS n_lang, sum(n) OVER (PARTITION BY lang) AS every FROM grid),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (own + 5 * v) AS p, 1 + 1000000000::HUGEINT * (n_lang + 5) // (every + 5 * v) AS q FROM sums),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50""",
    "op13_resampling": r"""
WITH crcs AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS step),
every AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM every),
hexed AS (SELECT DISTINCT f, hex(f) AS h FROM w),
coded AS (SELECT f, [16 * (strpos('0123456789ABCDEF', h[2 * i + 1:2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2:2 * i + 2]) - 1 FOR i IN range(length(h) // 2)] AS bytes FROM hexed),
bucketed AS (SELECT f, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM coded, crcs),
b AS (SELECT side, row, bucket FROM w JOIN bucketed USING (f)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM b GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n),
own AS (SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS gain FROM b JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce((gain - ((gain % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    list_reduce(range(8), lambda a, i: a * 16 + strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), i + 1, 1)) - 1, 0) AS h
  FROM every LEFT JOIN own USING (row) WHERE side = 'd'),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM final LEFT JOIN ranked USING (row)""",
}
