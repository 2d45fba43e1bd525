"""Command line: ``python -m quadloom load SOURCE STORE``, ``query STORE TEXT`` and ``export STORE TARGET``."""

from __future__ import annotations

import argparse
import sys
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.operators import profile
from quadloom.sources import ntriples, quads, turtle
from quadloom.spatial import derived

TURTLE, LINES = (".ttl", ".ttl.gz"), (".nt", ".nt.gz", ".nq", ".nq.gz")


def found_files(spark: SparkSession, source: str) -> DataFrame:
    """``(path)`` of the RDF files that aren't empty, at a path or anywhere below it."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).where("length > 0").select("path")
    ends = F.lit(False)
    for end in (*TURTLE, *LINES):
        ends = ends | F.lower("path").endswith(end)
    return listed.where(ends)


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Quads, and what couldn't be read, of files of any of the formats."""
    parts = []
    for reader, ends in ((turtle.load, TURTLE), (ntriples.load, LINES)):
        own = [p for p in paths if p.lower().endswith(ends)]
        if own:
            found, bad = reader(spark, own)
            parts.append((found, bad.select(F.concat_ws(": ", *bad.columns).alias("problem"))))
    found, bad = parts[0]
    for f, b in parts[1:]:
        found, bad = found.unionByName(f), bad.unionByName(b)
    return found, bad


def load(spark: SparkSession, paths: list[str], store: str, spatial: bool, features: bool, void: bool, subjects: bool) -> int:
    """Writes a store of files; returns the number of unreadable files and lines."""
    found, bad = read(spark, paths)
    every = derived.added(found) if spatial else found
    every = every.unionByName(derived.features(found)) if features else every
    every = every.unionByName(profile.void_quads(found)) if void else every  # of the source quads only
    quads.write(every, store, spatial, subjects)
    return bad.count()


def there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quadloom")
    try:
        parser.add_argument("--version", action="version", version=version("quadloom"))
    except PackageNotFoundError:
        parser.add_argument("--version", action="version", version="not installed as a package")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("load", help="Turtle, N-Triples or N-Quads files, or a folder of them, into a store")
    one.add_argument("source")
    one.add_argument("store")
    one.add_argument("--each", action="store_true", help="a store for each file, below STORE as the file is below SOURCE; those that are there are passed over")
    one.add_argument("--spatial", action="store_true", help="add the quads derived from WKT literals and a tile index")
    one.add_argument("--subjects", action="store_true", help="add a copy in the order of subjects, for look-ups by subject")
    one.add_argument("--features", action="store_true", help="add the shape features of WKT literals")
    one.add_argument("--void", action="store_true", help="add the description of the graphs")
    one.add_argument("--status", action="store_true", help="tell each store as it is done")
    query = commands.add_parser("query", help="SPARQL over a store")
    query.add_argument("store")
    query.add_argument("text")
    query.add_argument("--format", choices=("table", "json", "xml", "csv", "tsv", "nt", "turtle", "jsonld", "rdfxml"), default="table")
    query.add_argument("--rows", type=int, default=20, help="rows of a table shown")
    export = commands.add_parser("export", help="a store as gzipped N-Quads")
    export.add_argument("store")
    export.add_argument("target")
    export.add_argument("--per-file", type=int, default=0, help="sorted chunks of so many lines")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("quadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "load":
        paths = sorted(r.path for r in found_files(spark, args.source).collect())  # names of files only
        if not paths:
            sys.exit("no RDF files found")
        jobs = [(args.store, paths)]
        if args.each:
            root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(args.source).toUri().getPath().rstrip("/")
            jobs = []
            for p in paths:
                below = p.split(root, 1)[1].strip("/") or p.rsplit("/", 1)[1]
                end = next(e for e in (*TURTLE[::-1], *LINES[::-1]) if below.lower().endswith(e))
                jobs.append((f"{args.store.rstrip('/')}/{below[: -len(end)]}", [p]))
        rejected = skipped = 0
        for store, files in jobs:
            if args.each and there(spark, store):
                skipped += 1
                continue
            rejected += load(spark, files, store, args.spatial, args.features, args.void, args.subjects)
            if args.status:
                print(f"{store}: {len(files)} files")
        print(f"stores: {len(jobs) - skipped}, passed over: {skipped}, rejected: {rejected}")
    elif args.command == "export":
        ntriples.export(quads.read(spark, args.store).quads(), args.target, args.per_file)
    elif args.format == "table":
        Engine.store(spark, args.store).sparql(args.text).show(args.rows, truncate=False)
    else:
        sys.stdout.writelines(Engine.store(spark, args.store).document(args.text, args.format).lines())


if __name__ == "__main__":
    main()
