"""A training-data pipeline over documents: each stage's rows are written as Parquet and are the next stage's documents.

Every stage keeps the columns that it is given, whatever their names; the last returns tokens. A stage that
drops documents judges all of them. The near-duplicate and mixing stages tell rows apart whatever their doc_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm import jaccard, mixing, pieces, quality, toxicity
from tagloom.llm.common import n_words, table, written


def _kept(docs: DataFrame, scored: DataFrame, keep) -> DataFrame:
    return scored.filter(keep).select(*(_column(c) for c in docs.columns))


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside the other columns as one, so that no name of a score can clash with a column and the text goes to Python once."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "text")


def _column(name: str) -> Column:
    return F.col(name) if name == "text" else F.col("row").getField(name).alias(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, quality.scored(_packed(docs), model, ["row", "text"]), F.col("predicted") == 1)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier rejects."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, toxicity.scored(_packed(docs), model, ["row", "text"]), F.col("predicted") == 0)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of the smallest doc_id, a null one last.

    Rows are linked and dropped by a key of their own, for doc_ids may be null or repeated. It is written
    with them, so that every plan sees the same one.
    """
    keyed = written(_packed(docs).select("row", "text", F.monotonically_increasing_id().alias("key")))
    found = jaccard.near_components(keyed.select(F.col("key").alias("doc_id"), "text"))
    found = written(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("root")))
    ids = keyed.select("key", F.col("row").getField("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"]
    heads = found.join(ids, "key").groupBy("root").agg(first.alias("head"), F.count("*").alias("n")).filter("n > 1")
    gone = found.join(heads, "root").filter("key <> head").select("key")
    return keyed.join(gone, "key", "left_anti").select(*(_column(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    The mix tells rows of one doc_id, source and size apart by a number. Theirs are numbered in the order of
    their content, so that null and repeated doc_ids are rows of their own and the result doesn't depend on how
    rows are dealt out. Only keys and numbers are joined before the texts are.
    """
    keyed = written(n_words(_packed(docs).select("row", "text", F.monotonically_increasing_id().alias("key")), "text", "size", ["row", "text", "key"]))
    own = [F.col("row").getField("doc_id").alias("doc_id"), F.col("row").getField("source").alias("source")]
    same = Window.partitionBy("doc_id", "source", "size")
    rows = keyed.select("key", *own, "size", F.xxhash64("text").alias("t"), F.xxhash64("row").alias("r")).withColumn("nth", F.row_number().over(same.orderBy("t", "r", "key")))
    mixed = mixing.mix(docs).select("doc_id", "source", "size", "copies").withColumn("nth", F.row_number().over(same.orderBy("copies"))).filter("copies > 0")
    mixed = mixed.select(*(F.col(c).alias(f"_{c}") for c in mixed.columns))
    taken = rows.join(mixed, (F.col("nth") == F.col("_nth")) & (F.col("size") == F.col("_size")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")))
    repeated = keyed.join(taken.select("key", F.col("_copies").cast("int").alias("copies")), "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*(_column(c) for c in docs.columns))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids."""
    return pieces.encoded(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"])


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("sentencepiece", tokens_stage)]

#: SQL can't express the trained stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
