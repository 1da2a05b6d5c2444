"""Tag indexes: a folder with a table (key, file, voffset) for each tag and one for read names."""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags

QNAME = "QNAME"


def default_path(bam_file: str) -> str:
    """Beside the file, named after it."""
    return os.path.splitext(bam_file)[0] + "_index"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def available(spark: SparkSession, index_path: str) -> list[str]:
    """The names of the indexes in a folder; none if it isn't there."""
    fs, p = _folder(spark, index_path)
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(n for n in found if n == QNAME or len(n) == 2)


def exists(spark: SparkSession, index_path: str, name: str) -> bool:
    fs, p = _folder(spark, f"{index_path}/{name}")
    return bool(fs.exists(p))


def checked(name: str) -> str:
    """A tag name or QNAME; anything else is an error."""
    if name != QNAME and len(name) != 2:
        raise ValueError(f"an index is for a tag of two characters or {QNAME}: {name!r}")
    return name


def key(name: str, any_type: bool = True) -> Column:
    """A record's key: the text of a tag of any type, or of strings alone, and MISSING where it has none."""
    return F.col("qname") if name == QNAME else tags.key(F.col("aux"), name, any_type)


def entries(records: DataFrame, name: str, any_type: bool = True) -> DataFrame:
    """key, voffset and, if the records have it, file: each place once. Records without the tag have the key "*"."""
    place = [c for c in ("file", "voffset") if c in records.columns]
    return records.select(key(checked(name), any_type).alias("key"), *place).distinct()


def stored(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes rows with a key, range-partitioned and sorted by it, with Bloom filters, so that a lookup reads few row groups."""
    place = [c for c in ("file", "voffset") if c in rows.columns]
    rows.repartitionByRange("key", *place).sortWithinPartitions("key", *place).write.mode(mode).option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def build(records: DataFrame, index_path: str, names: list[str], any_type: bool = True) -> list[str]:
    """Writes an index for each name, and always one for QNAME. Building again replaces an index. Records are read once, and their keys and places kept until all indexes are written."""
    built = [*dict.fromkeys([*map(checked, names), QNAME])]
    place = [c for c in ("file", "voffset") if c in records.columns]
    keys = records.select(*place, *(key(n, any_type).alias(f"key_{k}") for k, n in enumerate(built))).persist(StorageLevel.DISK_ONLY)
    try:
        for k, name in enumerate(built):
            stored(keys.select(F.col(f"key_{k}").alias("key"), *place).distinct(), f"{index_path}/{name}")
    finally:
        keys.unpersist()
    return built


def cover(records: DataFrame, path: str, name: str) -> None:
    """Writes the records themselves clustered by a tag, so that lookups by it need no join. The last component of the path is up to the caller."""
    stored(records.withColumn("key", key(checked(name))), path)


def opened(spark: SparkSession, index_path: str, name: str) -> DataFrame:
    if not exists(spark, index_path, name):
        raise ValueError(f"there is no index {name} in {index_path}; there are {available(spark, index_path)}")
    return spark.read.schema("key string, file string, voffset bigint").option("recursiveFileLookup", "true").parquet(f"{index_path}/{name}")


def matches(entries_: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (key, voffset) for some keys, by key and place."""
    return entries_.filter(F.col("key").isin(keys)).orderBy("key", "voffset")


def counted(entries_: DataFrame) -> DataFrame:
    """key, n: how many records have each key."""
    return entries_.groupBy("key").agg(F.count("*").alias("n"))
