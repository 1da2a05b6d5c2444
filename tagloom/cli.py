"""Command line: build an index, look up by tag, and print or write records."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.lookup import Alignments
from .sources import bam, sam


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tagloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("build", "index a BAM file by tags, read names and coordinates"), ("lookup", "print records of tag values"), ("region", "print records that share a tag value with reads in regions"), ("list", "name the indexes")):
        c = commands.add_parser(name, help=text)
        c.add_argument("-f", "--file", required=True)
        c.add_argument("-i", "--index")
        if name != "list":
            c.add_argument("-t", "--tag", **({"action": "append"} if name == "build" else {"default": "BX"}))
        if name in ("lookup", "region"):
            c.add_argument("values", nargs="+")
            c.add_argument("-n", "--limit", type=int)
            c.add_argument("-o", "--output", help="a folder for BAM files instead of text on the screen")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tagloom").getOrCreate()
    reads = Alignments(spark, a.file, a.index)
    if a.command == "build":
        print(*reads.build_index(*(a.tag or ["BX"])))
        reads.build_coordinates()
    elif a.command == "list":
        print(*reads.indexes())
    else:
        how = {"values": a.values} if a.command == "lookup" else {"regions": a.values}
        found = reads.by_tag(a.tag, output="table", **how)
        found = found.limit(a.limit) if a.limit is not None else found
        if a.output:
            bam.write(found, a.output)
        else:
            for row in sam.lines(found).toLocalIterator():
                print(row["value"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
