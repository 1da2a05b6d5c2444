"""Document fingerprints: a canonical exact digest, built from Spark SQL functions only.

The canonical text is the text under Unicode compatibility composition (NFKC), full case folding and NFKC
again, with every run of white space folded to one space and none at either end. Its digest is wide:
two 64-bit xxhashes, of the text and of the text behind a mark, which give 32 hexadecimal digits. Rows
of one digest form a bucket; in buckets of several rows the canonical texts are compared byte by byte,
and where they differ each gets its SHA-256 behind the digest. Texts with the
same canonical form thus share a fingerprint, and others never do.

Defined results: a null text counts as empty, and all empty texts share a fingerprint; repeated rows and
equal doc_ids each give a row; the next document of the last is the first (of a single one, itself);
rows of equal doc_id are ordered by their text. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


#: Of Unicode's White_Space, what NFKC doesn't turn into a space.
SPACES = r"[\x09-\x0D\x20\x85\u1680\u2028\u2029]+"
#: Text in a bucket of neighbouring doc_ids, and how many buckets there may be: the list of their first doc_ids is broadcast.
BUCKET_BYTES, MOST_BUCKETS, QUANTILES = 8 << 20, 1 << 16, 256
#: Bits that tell tasks which digests several rows have: 1 MB.
SLOTS = 1 << 23


def nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def folded(text: Column) -> Column:
    """Full Unicode case folding: sharp s becomes two, and a sigma at a word's end one like the others."""
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Compatibility-composed, case-folded and composed again, white space folded. Pure ASCII needs no composition."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(nfkc(folded(nfkc(text))))
    return F.trim(F.regexp_replace(lower, SPACES, " "))


def wide(canon: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits."""
    part = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(part(canon), part(F.lit("tagloom"), canon))


def digested(docs: DataFrame) -> DataFrame:
    return docs.select("*", wide(canonical(F.coalesce("text", F.lit("")))).alias("digest"))


def buckets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, class_id) of the digests of several rows, class_id being their smallest doc_id, and (digest) of those whose canonical texts differ.

    Only texts of such digests need to be compared. Which they are goes to the tasks as a bitmap of SLOTS
    bits, whatever the number of documents; what it lets through by chance is compared with itself. Texts
    are compared as the least and the greatest of a digest, which are found before the shuffle.
    """
    several = written(digested(docs.select("doc_id", "text")).groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id")).filter("n > 1").select("digest", "class_id"))
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
    bits = several.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    rows = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("digest", wide(F.col("canon"))).withColumn("slot", slot)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = rows.join(F.broadcast(bits), F.bitmap_bucket_number("slot") == F.col("part")).filter(F.getbit(byte, (F.bitmap_bit_position("slot") % 8).cast("int")) == 1)
    differing = held.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("greatest")).filter("least <> greatest").select("digest")
    return several, written(differing)


def settled(rows: DataFrame, several: DataFrame, differing: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, whole: the canonical text's SHA-256) with fingerprint and class_id."""
    rows = rows.join(several, "digest", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    if differing.isEmpty():
        return rows.withColumn("fingerprint", F.col("digest"))
    apart = differing.withColumn("apart", F.lit(True))
    rows = rows.join(apart, "digest", "left").withColumn("fingerprint", F.when(F.col("apart"), F.concat_ws("-", "digest", "whole")).otherwise(F.col("digest"))).drop("apart")
    least = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "fingerprint").withColumn("class_id", F.col("least")).drop("least")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint, class_id: the smallest doc_id of the same canonical text."""
    canon = canonical(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", wide(canon).alias("digest"), F.sha2(canon, 256).alias("whole"))
    return settled(rows, *buckets(docs)).select("doc_id", "fingerprint", "class_id")


def followed(docs: DataFrame, extra: list[str]) -> DataFrame:
    """docs (doc_id, text, extra columns) with next_<column> of the following document in ascending doc_id, for text and extra; the first follows the last.

    Documents are dealt into buckets of neighbouring doc_ids, and each bucket also gets the first document
    of the next one, so no window spans more than a bucket and texts are shuffled once.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n_bytes, low, high = docs.agg(F.sum(F.octet_length("text")), F.min(key), F.max(key)).first()
    if low is None:
        return docs.select("*", *(F.lit(None).cast("string").alias(f"next_{c}") for c in ["text", *extra]))
    n = min(MOST_BUCKETS, 1 + (n_bytes or 0) // BUCKET_BYTES)
    parts = min(n, QUANTILES)
    bounds = docs.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 40 * QUANTILES)).first()[0] if parts > 1 else []
    edges = [low, *sorted({b for b in bounds if low < b}), high + 1]
    if len(edges) > 2:
        listed = F.array(*(F.lit(b) for b in edges[1:-1]))
        part = F.size(F.filter(listed, lambda b: b <= key))
    else:
        part = F.lit(0)
    inner = 1 + n // parts
    start = F.element_at(F.array(*(F.lit(b) for b in edges)), part + 1)
    stop = F.element_at(F.array(*(F.lit(b) for b in edges)), part + 2)
    inside = F.floor((key - start).cast("double") / (stop - start).cast("double") * inner)
    bucket = (part * inner + F.least(F.greatest(inside, F.lit(0)), F.lit(inner - 1))).cast("long")
    kept = docs.select(*docs.columns, key.alias("_key"), bucket.alias("_bucket"))

    heads = kept.groupBy("_bucket").agg(F.min("_key").alias("head"))
    order = Window.orderBy("_bucket")
    before = F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = written(heads.select("head", before.alias("before")))
    firsts = kept.join(F.broadcast(heads), F.col("_key") == F.col("head"))
    firsts = firsts.groupBy("before").agg(F.min(F.struct("text", *extra)).alias("f"))
    sentinels = firsts.select(*(F.col(f"f.{c}").alias(c) if c in ("text", *extra) else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns), F.lit(None).cast("long").alias("_key"), F.col("before").alias("_bucket"))
    in_order = Window.partitionBy("_bucket").orderBy(F.col("_key").asc_nulls_last(), "text")
    return kept.unionByName(sentinels).select("*", *(F.lead(c).over(in_order).alias(f"next_{c}") for c in ("text", *extra))).filter("_key is not null").drop("_key", "_bucket")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint and that of its text with the last half replaced by the start of the next document's.

    The digest is exact, so likeness is 1 for equal canonical texts and 0 for others.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("digest", wide(canonical(F.col("text"))))
    rows = followed(texts, ["digest"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))"))
    rows = rows.withColumn("edited_digest", wide(canonical(F.col("edited"))))

    def likeness(digest: str, text: str) -> Column:
        same = F.when(F.col("digest") == F.col(digest), canonical(F.col("text")) == canonical(F.col(text)))
        return F.coalesce(same, F.lit(False)).cast("double")

    found = buckets(docs)
    differ = not found[1].isEmpty()
    whole, edited_whole = (F.sha2(canonical(F.col(c)), 256) if differ else F.lit(None).cast("string") for c in ("text", "edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digest", whole.alias("whole"), "edited_digest", edited_whole.alias("edited_whole"), likeness("edited_digest", "edited").alias("near_edited"), likeness("next_digest", "next_text").alias("near_next"))
    rows = settled(rows, *found)
    edited = F.col("edited_digest")
    if differ:  # one form in both columns
        apart = found[1].select(F.col("digest").alias("edited_digest"), F.lit(True).alias("edited_apart"))
        rows = rows.join(apart, "edited_digest", "left")
        edited = F.when(F.col("edited_apart"), F.concat_ws("-", "edited_digest", "edited_whole")).otherwise(edited)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", edited.alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
