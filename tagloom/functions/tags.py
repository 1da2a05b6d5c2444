"""Optional tags, kept as a map from tag name to a struct of its type letter and the value of that type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: i: A-less integers of any width; f: floats; s: characters, strings and hexadecimal; ia and fa: arrays.
VALUE = "struct<t:string,i:bigint,f:double,s:string,ia:array<bigint>,fa:array<double>>"
AUX = f"map<string,{VALUE}>"
#: Type letter -> field and promoted type.
FIELD = {**dict.fromkeys("cCsSiI", ("i", "bigint")), **dict.fromkeys("fd", ("f", "double")), **dict.fromkeys("AZH", ("s", "string"))}
#: Fixed value: the key under which records without a tag are indexed.
MISSING = "*"


def get(aux: Column, tag: str, kind: str = "Z") -> Column:
    """A tag's value; null where the record lacks the tag or has it with another kind of type."""
    if kind[0] == "B":
        return F.element_at(aux, tag).getField("fa" if kind[1:] == "f" else "ia")
    return F.element_at(aux, tag).getField(FIELD[kind][0])


def as_text(aux: Column, tag: str) -> Column:
    """A tag's value as text, whatever its type."""
    v = F.element_at(aux, tag)
    arrays = F.concat_ws(",", F.coalesce(v.getField("ia").cast("array<string>"), v.getField("fa").cast("array<string>")))
    return F.coalesce(v.getField("s"), v.getField("i").cast("string"), v.getField("f").cast("string"), F.when(v.getField("ia").isNotNull() | v.getField("fa").isNotNull(), arrays))


def key(aux: Column, tag: str, any_type: bool = False) -> Column:
    """The index key of a record: the tag's string, or MISSING."""
    v = F.element_at(aux, tag)
    return F.coalesce(as_text(aux, tag) if any_type else F.when(v.getField("t") == "Z", v.getField("s")), F.lit(MISSING))


def value(kind: str, content: Column) -> Column:
    """A tag value of a type letter."""
    field = FIELD[kind][0]
    parts = {"t": F.lit(kind), "i": F.lit(None).cast("bigint"), "f": F.lit(None).cast("double"), "s": F.lit(None).cast("string"), "ia": F.lit(None).cast("array<bigint>"), "fa": F.lit(None).cast("array<double>")}
    parts[field] = content.cast(FIELD[kind][1])
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def put(aux: Column, tag: str, kind: str, content: Column) -> Column:
    """The map with a tag added or replaced."""
    return F.map_concat(drop(aux, tag), F.create_map(F.lit(tag), value(kind, content)))


def drop(aux: Column, tag: str) -> Column:
    return F.map_filter(aux, lambda k, _: k != tag)


def discovered(records: DataFrame, aux: str = "aux") -> DataFrame:
    """tag, group (0 integers, 1 floats, 2 strings, 3 arrays): each tag of the records with the widest group of its types."""
    entry = F.explode(F.map_entries(aux)).alias("e")
    group = F.when(F.col("e.value.i").isNotNull(), 0).when(F.col("e.value.f").isNotNull(), 1).when(F.col("e.value.s").isNotNull(), 2).otherwise(3)
    return records.select(entry).select(F.col("e.key").alias("tag"), group.alias("group")).groupBy("tag").agg(F.max("group").alias("group"))


def wide(records: DataFrame, aux: str = "aux") -> DataFrame:
    """The records with a column for each tag that any of them has: integers, then floats, then strings, then arrays.

    Reads the records once to find the tags. Tags that differ only in case need spark.sql.caseSensitive.
    """
    found = sorted((r["group"], r["tag"]) for r in discovered(records, aux).collect())
    columns = []
    for group, tag in found:
        v = F.element_at(F.col(aux), tag)
        columns.append((v.getField("i") if group == 0 else F.coalesce(v.getField("f"), v.getField("i").cast("double")) if group == 1 else as_text(F.col(aux), tag)).alias(tag))
    return records.select(*(c for c in records.columns if c != aux), *columns)
