"""Keeps indexes up to date as new Parquet files of records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..sources import schema


def follow(spark: SparkSession, records_path: str, index_path: str, names: str | list[str], checkpoint: str) -> StreamingQuery:
    """Indexes the files that have come since the last call, each once, and stops. Keys, order and filters are those of `index.build`, and QNAME is indexed too.

    A batch's entries are a folder of their own, which a repeated batch replaces.
    """
    wanted = [*dict.fromkeys([*map(index.checked, [names] if isinstance(names, str) else names), index.QNAME])]

    def add(batch: DataFrame, number: int) -> None:
        for name in wanted:
            index.stored(index.entries(batch, name), f"{index_path}/{name}/batch-{number:09d}")

    records = spark.readStream.schema(schema.RECORD).parquet(records_path)
    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
