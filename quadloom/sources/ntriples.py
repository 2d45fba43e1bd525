"""N-Triples and N-Quads: splittable text in, canonical quads out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.terms import DEFAULT_GRAPH, RDF, XSD

_IRI, _BNODE = r"<[^<>\"{}|^`\x00-\x20]*>", r"_:[^\s<>\"]+"
_LITERAL = r"\"(?:[^\"\\\n\r]|\\.)*\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^" + _IRI + r")?"
LINE = rf"^\s*({_IRI}|{_BNODE})\s*({_IRI})\s*({_IRI}|{_BNODE}|{_LITERAL})\s*({_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"
#: Default place of the reject count.
SKIPPED = r"^\s*(?:#.*)?$"


def _unicode(c: Column) -> Column:
    """Backslash-u escapes as characters; only lines that have one pay for it."""
    decoded = F.aggregate(
        F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})"), 1)),
        c,
        lambda s, e: F.replace(s, e, F.decode(F.unhex(F.lpad(F.substring(e, 3, 8), 8, "0")), "UTF-32BE")),
    )
    return F.when(c.rlike(r"\\[uU][0-9A-Fa-f]{4}"), decoded).otherwise(c)


def _term(c: Column, scope: Column) -> Column:
    """Canonical text: short datatypes, lower-case language tags, plain strings typed, blank nodes scoped by file."""
    c = _unicode(c)
    for prefix, space in (("xsd:", XSD), ("rdf:", RDF)):
        c = F.regexp_replace(c, r'"\^\^<' + space.replace(".", r"\.") + r"([^>]*)>$", f'"^^{prefix}$1')
    tagged = c.rlike(r'^".*"@[A-Za-z0-9-]+$')
    low = F.concat(F.regexp_extract(c, r'(?s)^(".*"@)[A-Za-z0-9-]+$', 1), F.lower(F.regexp_extract(c, r"@([A-Za-z0-9-]+)$", 1)))
    return F.when(c.startswith("_:"), F.concat(F.lit("_:b"), F.substring(F.sha2(F.concat(scope, F.lit("\x1f"), c), 256), 1, 32))).when(tagged, low).when(c.rlike(r'(?s)^".*"$'), F.concat(c, F.lit("^^xsd:string"))).otherwise(c)


def parse(lines: DataFrame, text: str = "value", scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Quads (g, s, p, o) and the rejected lines of a column of N-Quads lines.

    ``scope`` is a column that tells files apart: equal blank labels of different files are different nodes.
    Comments and blank lines are neither. A line without graph is in the default graph.
    """
    where = F.col(scope) if scope else F.lit("")
    one = lines.select(F.col(text).alias("line"), where.alias("__scope"))
    groups = [F.regexp_extract("line", LINE, i) for i in range(1, 5)]
    good = one.where(F.col("line").rlike(LINE)).select(*[g.alias(f"t{i}") for i, g in enumerate(groups)], "__scope")
    t = [F.col(f"t{i}") for i in range(4)]
    quads = good.select(F.when(t[3] == "", F.lit(f"<{DEFAULT_GRAPH}>")).otherwise(_term(t[3], F.col("__scope"))).alias("g"), *[_term(t[i], F.col("__scope")).alias(c) for i, c in enumerate("spo")])
    return quads, one.where(~F.col("line").rlike(LINE) & ~F.col("line").rlike(SKIPPED)).select("line")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Quads and rejects of N-Triples or N-Quads files; ``.gz`` works, plain files are split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse(lines, "value", "file")


def to_lines(quads: DataFrame) -> DataFrame:
    """``value``: one N-Quads line per quad, datatypes written out, the default graph left out."""

    def full(c: Column) -> Column:
        for prefix, space in (("xsd:", XSD), ("rdf:", RDF)):
            c = F.regexp_replace(c, rf'"\^\^{prefix}(\w+)$', f'"^^<{space}$1>')
        return c

    g = F.when(F.col("g") != f"<{DEFAULT_GRAPH}>", F.concat(F.lit(" "), F.col("g"))).otherwise(F.lit(""))
    return quads.select(F.concat(F.col("s"), F.lit(" "), F.col("p"), F.lit(" "), full(F.col("o")), g, F.lit(" .")).alias("value"))


def export(quads: DataFrame, path: str, per_file: int = 0) -> None:
    """Writes gzipped N-Quads; with ``per_file`` in chunks of that many lines, each sorted by graph, subject, predicate and object."""
    if per_file:
        quads = quads.repartitionByRange("g", "s", "p", "o").sortWithinPartitions("g", "s", "p", "o")
    out = to_lines(quads).write.mode("overwrite").option("compression", "gzip")
    (out.option("maxRecordsPerFile", per_file) if per_file else out).text(path)
