"""What the trained classifiers share: the bounded labelled sample, hashed words, and sparse rows in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, remainder, sliced

PUNCTUATION = b".,;:!?\"'()[]{}<>*#%&$|-_/\\~`^+=@"
#: Words whose bucket a task remembers.
REMEMBERED = 200_000


class Buckets(dict):
    """word -> hash bucket of the word without punctuation around it; -1 if nothing is left."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(PUNCTUATION)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = zlib.crc32(bare) % self.n if bare else -1
        return out

    def of(self, tokens: Iterable[bytes]) -> np.ndarray:
        """The distinct buckets of the tokens."""
        out = np.unique(np.fromiter(map(self.__getitem__, set(tokens)), np.int64))
        return out[1:] if len(out) and out[0] < 0 else out


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of at most about `most` labelled documents whose crc32 remainder by 5 isn't 0.

    The sample goes by a hash of doc_id. Its labels are broadcast: `most` bounds them. A doc_id with
    several labels counts as 1 if any is; a null label is none.
    """
    known = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max(label).alias("y"))
    share = min(1.0, most / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def gathered(sample: DataFrame, rows_of: Callable[[bytes, int], dict], schema: str) -> pa.Table:
    """What rows_of returns for each text and label of the sample, as a table on the driver; place: a row's number in an order that doesn't depend on partitions."""

    def run(batches):
        for b in chain.from_iterable(sliced(b, 100) for b in batches):
            rows = [{"doc_id": i, "y": y, **rows_of(t, y)} for i, t, y in zip(b.column("doc_id").to_pylist(), raw(b.column("text")), b.column("y").to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = _parse_datatype_string(f"doc_id long, y int, {schema}")
    arrow = to_arrow_schema(full)
    found = sample.select("doc_id", F.col("y").cast("int").alias("y"), "text").mapInArrow(run, full).toArrow()
    place = np.empty(len(found), np.int64)
    place[pc.sort_indices(found, sort_keys=[("doc_id", "ascending")]).to_numpy()] = np.arange(len(found))
    return found.append_column("place", pa.array(place))


class Rows:
    """Sparse rows: column numbers and values of all rows, one behind the other."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray] | None = None):
        size = np.fromiter(map(len, columns), np.int64, len(columns))
        self.n, self.of = len(columns), np.repeat(np.arange(len(columns)), size)
        self.col = np.concatenate(columns) if columns else np.empty(0, np.int64)
        self.val = np.ones(len(self.col)) if values is None else np.concatenate(values) if values else np.empty(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The product with a vector, or with each column of a matrix."""
        if w.ndim == 1:
            return np.bincount(self.of, self.val * w[self.col], self.n)
        return np.stack([np.bincount(self.of, self.val * w[self.col, k], self.n) for k in range(w.shape[1])], 1)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        """The transposed product."""
        return np.bincount(self.col, self.val * r[self.of], size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
