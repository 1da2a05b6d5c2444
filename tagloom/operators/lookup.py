"""Records by tag value or by region: the public entry point."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, ranges, regions, tags
from ..sources import bam
from . import coordinates, index, overlap

log = logging.getLogger(__name__)


def by_keys(records: DataFrame, column: str, keys: DataFrame | list[str], distinct_keys: bool = False) -> DataFrame:
    """Records whose column equals a key, once for each time that the key is listed, or once if distinct_keys. Keys that no record has add nothing, and null keys match nothing."""
    if isinstance(keys, list):
        if distinct_keys or len(set(keys)) == len(keys):
            return records.filter(F.col(column).isin([k for k in keys if k is not None]))
        keys = F.broadcast(records.sparkSession.createDataFrame([(k,) for k in keys], "_key string"))  # as long as the caller's list
    keys = keys.select(F.col(keys.columns[0]).alias("_key"))
    return records.join(keys, F.col(column) == F.col("_key"), "left_semi") if distinct_keys else records.join(keys, F.col(column) == F.col("_key")).drop("_key")


def region_keys(records: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The column's values of the records in some regions, one for each record and region."""
    return overlap.joined(overlap.kept(records), wanted).filter(F.col(column).isNotNull()).select(column)


class Alignments:
    """The records of alignment files with their indexes. Lookups by an index read only the places that it gives."""

    bam_file = None

    def __init__(self, spark: SparkSession, bam_file: str | None = None, index_path: str | None = None, records: DataFrame | None = None, coords: str = "raw", require_index: bool = True, include_duplicates: bool = True, **options):
        """bam_file is checked and read, or records are given in the canonical schema. coords is "raw" (pos from 0) or "one_based"."""
        if coords not in ("raw", "one_based"):
            raise ValueError(f"coords is raw or one_based, not {coords!r}")
        if records is None:
            if not bam_file or not bam.is_bam(bam_file):
                raise ValueError(f"not a BAM file: {bam_file}")
            records = bam.read(spark, bam_file, **options)
            self.bam_file = bam_file
        self.spark, self.records, self.coords = spark, records, coords
        self.options = {k: v for k, v in options.items() if k in ("tags", "fields")}
        self.index_path = index_path or (index.default_path(bam_file) if bam_file else None)
        self.require_index, self.include_duplicates = require_index, include_duplicates

    def indexes(self) -> list[str]:
        return index.available(self.spark, self.index_path) if self.index_path else []

    def build_index(self, *names: str) -> list[str]:
        """Indexes tags of all types, numbers under their text; records that lack a tag are under "*"."""
        return index.build(self.records, self.index_path, list(names))

    def build_coordinates(self) -> None:
        """Indexes where records stand on their references, so that region lookups read only what they need."""
        if not self.bam_file:
            raise ValueError("only the places in BAM files can be indexed")
        coordinates.build(self.spark, self.bam_file, self.index_path)

    def by_region(self, wanted, output: str = "ranges", verbose: bool = False) -> DataFrame:
        """Mapped records that overlap any of the regions, each once."""
        table = self._restyled(regions.table(self.spark, wanted))
        found = self._in_regions(table)
        return self._shaped(found, output)

    def references(self) -> DataFrame:
        """name: the references of the files' headers, or those that records name."""
        if not self.bam_file:
            return self.records.select(F.col("rname").alias("name")).distinct()
        return bam.reference_names(self.spark, self.bam_file)

    def _restyled(self, table: DataFrame) -> DataFrame:
        return regions.restyled(table, self.references())

    def _has_coordinates(self) -> bool:
        return bool(self.bam_file and self.index_path and coordinates.exists(self.spark, self.index_path))

    def _in_regions(self, table: DataFrame) -> DataFrame:
        if self._has_coordinates():
            return coordinates.reads(self.spark, self.index_path, table, self.include_duplicates, **self.options)
        return overlap.joined(overlap.kept(self.records, self.include_duplicates), table, "left_semi")

    def by_bx(self, values=None, regions=None, **how) -> DataFrame:
        return self._values("BX", values, regions, True, **how)

    def by_cb(self, values=None, regions=None, **how) -> DataFrame:
        return self._values("CB", values, regions, True, **how)

    def by_ub(self, values=None, regions=None, **how) -> DataFrame:
        return self._values("UB", values, regions, True, **how)

    def by_qname(self, values, **how) -> DataFrame:
        return self._values(index.QNAME, values, None, True, **how)

    def by_tag(self, tag, values=None, regions=None, **how) -> DataFrame:
        """As by_bx, for any tag; values are taken as text, and a column "tag" holds the value."""
        if not isinstance(tag, str):
            raise TypeError("the tag is one name")
        index.checked(tag)
        return self._values(tag, values, regions, False, **how)

    def _values(self, tag: str, values, wanted, strict: bool, output: str = "ranges", distinct_keys: bool = False, verbose: bool = False, mc_cores: int = 1) -> DataFrame:
        """output is "ranges" or "table". mc_cores is accepted and has no meaning here."""
        if self.require_index and not (self.index_path and index.exists(self.spark, self.index_path, tag)):
            raise ValueError(f"there is no index for {tag}; there are {self.indexes()}")
        if values is not None and wanted is not None:
            raise ValueError("give values or regions, not both")
        if output not in ("ranges", "table"):
            raise ValueError(f"output is ranges or table, not {output!r}")
        column = "tag" if not strict else tag if tag != index.QNAME else "_name"
        if values is None and wanted is None:
            return self._shaped(self._named(self.records, tag, column).filter(F.lit(False)), output)
        if wanted is not None:
            keys = self._region_keys(tag, column, wanted, verbose)
        else:
            values = [values] if isinstance(values, str) or not isinstance(values, (list, tuple, set)) else list(values)
            if strict and not all(isinstance(v, str) for v in values):
                raise TypeError("values are texts")
            keys = [None if v is None else str(v) for v in values]
        named = self._named(self._at_keys(tag, keys) if self.require_index else self.records, tag, column)
        if isinstance(keys, list):
            # Records without the tag are found under the key that the index has for them.
            named = named.withColumn("_key_of", index.key(tag))
            return self._shaped(by_keys(named, "_key_of", keys, distinct_keys).drop("_key_of"), output)
        return self._shaped(by_keys(named, column, keys, distinct_keys), output)

    def _named(self, records: DataFrame, tag: str, column: str) -> DataFrame:
        return records.withColumn(column, F.col("qname") if tag == index.QNAME else tags.as_text(F.col("aux"), tag))

    def _at_keys(self, tag: str, keys: DataFrame | list[str]) -> DataFrame:
        """The records at the places that the index has for some keys: sought in the files, or joined if the records come from elsewhere."""
        found = index.opened(self.spark, self.index_path, tag)
        if isinstance(keys, list):
            found = found.filter(F.col("key").isin([k for k in keys if k is not None]))
        else:
            found = found.join(keys.select(F.col(keys.columns[0]).alias("key")), "key", "left_semi")
        if self.bam_file:
            return bam.fetched(self.spark, found.select("file", "voffset"), **self.options)
        found = found.select(F.col("file").alias("_file"), F.col("voffset").alias("_place")).distinct()
        same = F.col("voffset").eqNullSafe(F.col("_place"))
        return self.records.join(found, same & F.col("file").eqNullSafe(F.col("_file")) if "file" in self.records.columns else same, "left_semi")

    def _region_keys(self, tag: str, column: str, wanted, verbose: bool) -> DataFrame:
        table = regions.table(self.spark, wanted)
        if tag in table.columns:
            return table.select(F.col(tag).cast("string").alias(column)).filter(F.col(column).isNotNull())
        table = self._restyled(table)
        inside = self._in_regions(table) if self._has_coordinates() else overlap.kept(self.records, self.include_duplicates)
        keys = overlap.joined(self._named(inside, tag, column), table).filter(F.col(column).isNotNull()).select(column)
        if verbose:
            n, kinds = keys.agg(F.count("*"), F.countDistinct(column)).first()
            log.info("%d reads in the regions have %d different values of %s", n, kinds, tag)
        return keys

    def _shaped(self, found: DataFrame, output: str) -> DataFrame:
        found = found.withColumn("cigar", cigar.without_star(F.col("cigar"))).drop("_name")
        if self.coords == "one_based":
            found = found.withColumn("pos", F.col("pos") + 1)
        return ranges.to_ranges(found) if output == "ranges" else found

    def write_subset(self, offsets: DataFrame, path: str, **options) -> None:
        """Writes the records at some places (voffset, and file where there are several) to BAM files. Places in BAM files are sought."""
        if self.bam_file:
            own = bam.files(self.bam_file)
            if "file" not in offsets.columns:
                if len(own) > 1:
                    raise ValueError("places in several files need a column file")
                offsets = offsets.withColumn("file", F.lit(own[0]))
            found = bam.fetched(self.spark, offsets)
        else:
            found = self.records.join(offsets, [c for c in ("file", "voffset") if c in offsets.columns and c in self.records.columns], "left_semi")
        bam.write(found, path, **options)


def is_empty(found: DataFrame) -> bool:
    """Whether a lookup found nothing."""
    return found.isEmpty()
