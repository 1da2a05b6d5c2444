"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trimmed() -> None:
    """Gives freed memory that the allocators keep back to the system: workers and the driver live on when a task or a fit has ended."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's; elsewhere there is none
        trim(0)


def trimming(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches, in slices, whose task gives memory back after each whole batch and at its end."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from sliced(whole)
            del whole
            trimmed()

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts(batches))
        trimmed()

    return all_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{top.rstrip('/')}/tagloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    trimmed()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from written() that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def appended(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """df's columns, or those in keep, then the fields, which make()'s function computes from each Arrow batch. A column of df that has a field's name gives way to it."""
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in new]
    names = [f.name for f in [*kept, *fields]]
    at = [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *columns(batch)], names)

    return df.mapInArrow(trimming(run), T.StructType([*kept, *fields]))


def sliced(batch: pa.RecordBatch, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that a worker holds few rows as Python objects at once."""
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def raw(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def segments(text: bytes, gap: re.Pattern[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about a size that end before a gap, so that a very long one is never held as words whole."""
    at = 0
    while at < len(text):
        found = gap.search(text, at + size) if len(text) - at > size else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def words(text: bytes) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased: what bytes.split() and bytes.lower() do."""
    return text.lower().split()


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; 0 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % n


def n_words(df: DataFrame, text: str, name: str, keep: list[str]) -> DataFrame:
    """keep, and the number of words of each text."""
    at = df.columns.index(text)

    def make():
        return lambda batch: [pa.array([len(b.split()) for b in raw(batch.column(at))], pa.int64())]

    return appended(df, make, [T.StructField(name, T.LongType())], keep)
