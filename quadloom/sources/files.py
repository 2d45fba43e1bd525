"""A folder of files as a container description: one resource per file or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.terms import DEFAULT_GRAPH

#: Media types by extension. Fixed values.
MEDIA = {
    "ttl": "text/turtle", "nq": "application/n-quads", "nt": "application/n-triples", "json": "application/json", "jsonld": "application/ld+json", "csv": "text/csv", "txt": "text/plain", "html": "text/html",
    "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "svs": "image/tiff", "tif": "image/tiff", "tiff": "image/tiff", "parquet": "application/vnd.apache.parquet", "gz": "application/gzip", "zip": "application/zip", "pdf": "application/pdf",
}
VOCAB = "urn:x-graph:files/"
#: Kinds of a resource in link descriptions. Fixed values.
LWS = "https://www.w3.org/ns/lws#"


def media_type(path):
    """Media type column by extension."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.element_at(table, F.when(ext != "", ext).otherwise(F.lit("-"))), F.lit("application/octet-stream"))


def items(spark: SparkSession, root: str) -> DataFrame:
    """``(path, parent, name, is_container, size, modified, media_type, n_items)`` of all files below a folder and of the folders above them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    files = listed.select("path", base.alias("parent"), F.lit(False).alias("is_container"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), media_type(F.col("path")).alias("media_type"))
    start = F.lit("file:" + root.rstrip("/") if root.startswith("/") else root.rstrip("/"))
    deep = F.split(F.replace(F.col("parent"), start, F.lit("")), "/")
    folders = files.select("parent").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(deep)), lambda n: F.concat(start, F.array_join(F.slice(deep, 1, n), "/")))).alias("path")).distinct()
    folders = folders.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"), F.lit(True).alias("is_container"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("media_type"))
    every = files.unionByName(folders)
    counts = every.groupBy("parent").agg(F.count(F.lit(1)).alias("n_items")).withColumnRenamed("parent", "__p")
    joined = every.join(counts, F.col("path") == F.col("__p"), "left").drop("__p")
    return joined.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("n_items", F.when(F.col("is_container"), F.coalesce("n_items", F.lit(0))))


def as_quads(described: DataFrame, base: str | None = None) -> DataFrame:
    """The same as quads (g, s, p, o), with links both ways between folders and their items.

    With ``base`` resources are named below that IRI instead of by their place, which ``sameAs`` then tells.
    """
    root = described.agg(F.min("path").alias("__root"))  # the folder above all others
    place = lambda c: F.concat(F.lit("<"), F.replace(c, F.lit(" "), F.lit("%20")), F.lit(">"))
    name = place if base is None else lambda c: F.concat(F.lit("<" + base.rstrip("/")), F.replace(F.substring(c, F.char_length("__root") + 1, F.char_length(c)), F.lit(" "), F.lit("%20")), F.lit(">"))
    text = lambda c, dt: F.concat(F.lit('"'), c.cast("string"), F.lit(f'"^^xsd:{dt}'))
    me, inside = name(F.col("path")), F.col("path") != F.col("__root")
    triples = [
        (me, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", F.when(F.col("is_container"), F.lit(f"<{VOCAB}Container>")).otherwise(F.lit(f"<{VOCAB}DataResource>"))),
        (me, VOCAB + "size", text(F.col("size"), "long")),
        (me, VOCAB + "modified", text(F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "dateTime")),
        (me, VOCAB + "mediaType", text(F.col("media_type"), "string")),
        (me, VOCAB + "totalItems", text(F.col("n_items"), "long")),
        (me, VOCAB + "partOf", F.when(inside, name(F.col("parent")))),
        (name(F.col("parent")), VOCAB + "items", F.when(inside, me)),
    ]
    if base is not None:
        triples.append((me, "http://www.w3.org/2002/07/owl#sameAs", place(F.col("path"))))
    rows = described.join(F.broadcast(root), F.lit(True)).select(F.explode(F.array(*[F.struct(s.alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o")) for s, p, o in triples])).alias("x"))  # one row
    return rows.where("x.o IS NOT NULL").select(F.lit(f"<{DEFAULT_GRAPH}>").alias("g"), "x.s", "x.p", "x.o")


def page(df: DataFrame, number: int, order: str, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of a listing in a total order."""
    return df.orderBy(order).offset((number - 1) * size).limit(size)


def page_links(df: DataFrame, number: int, base: str, size: int = 20) -> DataFrame:
    """``(total, pages, first, prev, next, last)`` of page ``number``: one row of links; no page before the first or after the last."""
    counted = df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    link = lambda n: F.concat(F.lit(f"{base}?page="), n.cast("string"))
    here = F.lit(number)
    return counted.select("total", "pages", link(F.lit(1)).alias("first"), F.when(here > 1, link(here - 1)).alias("prev"), F.when(here < F.col("pages"), link(here + 1)).alias("next"), link(F.greatest("pages", F.lit(1))).alias("last"))


def linkset(described: DataFrame) -> DataFrame:
    """``(path, json)``: for each resource a link set with its kind, the folder above, media type, size and time of change."""
    href = lambda c: F.array(F.struct(c.cast("string").alias("href")))
    some = lambda c, v=None: F.when(F.col(c).isNotNull(), href(F.col(c) if v is None else v))
    one = F.struct(
        F.col("path").alias("anchor"),
        href(F.when(F.col("is_container"), F.lit(LWS + "Container")).otherwise(F.lit(LWS + "DataResource"))).alias("type"),
        some("parent").alias("up"),
        some("media_type").alias("mediaType"),
        some("size").alias("size"),
        some("modified", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
    )
    return described.select("path", F.to_json(F.struct(F.array(one).alias("linkset"))).alias("json"))


def container(spark: SparkSession, root: str, target: str) -> None:
    """Writes all files below a folder into one table ``(name, media_type, size, content)``, names relative to the folder."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = f"file:{root.rstrip('/')}/" if root.startswith("/") else f"{root.rstrip('/')}/"
    listed.select(F.replace(F.col("path"), F.lit(start), F.lit("")).alias("name"), media_type(F.col("path")).alias("media_type"), F.col("length").alias("size"), "content").write.mode("overwrite").parquet(target)
