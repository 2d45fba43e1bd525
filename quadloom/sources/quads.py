"""Materialised quads: canonical term text with typed side columns, in Parquet."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.spatial import index
from quadloom.sparql.algebra import Pattern
from quadloom.sparql.frame import Frame
from quadloom.terms import DEFAULT_GRAPH, IRI, NT, NUMERICS, Var

KEY = ["g", "s", "p", "o"]
#: Name of the copy in the order of subjects inside a store's folder.
SUBJECTS = "_subjects"
SIDE = ["o_kind", "o_lex", "o_dt", "o_lang", "o_num", "o_dec", "o_ts"]


def typed(quads: DataFrame) -> DataFrame:
    """(g, s, p, o) with the typed side columns of the object; rows with a null part fall out."""
    o = F.col("o")
    dt, lex = terms.datatype(NT, o), terms.lexical(NT, o)
    numeric = dt.isin(*sorted(NUMERICS))
    return quads.select(*KEY).dropna().select(
        *KEY,
        F.when(o.startswith("_:"), 1).when(o.startswith("<"), 2).otherwise(3).cast("tinyint").alias("o_kind"),
        lex.alias("o_lex"),
        dt.alias("o_dt"),
        F.when(dt == terms.LANG_STRING, terms.language(NT, o)).alias("o_lang"),
        F.when(numeric, lex.try_cast("double")).alias("o_num"),
        F.when(numeric, lex.try_cast("decimal(38,18)")).alias("o_dec"),
        F.when(dt.isin("xsd:dateTime", "xsd:date"), lex.try_cast("timestamp")).alias("o_ts"),
    )


def dedup(quads: DataFrame) -> DataFrame:
    """A dataset is a set: each quad once."""
    return quads.dropDuplicates(KEY)


def write(quads: DataFrame, path: str, spatial: bool = False, subjects: bool = False) -> None:
    """Store: range-partitioned by predicate and object, so that row-group statistics prune look-ups by either, zstd-compressed.

    With ``spatial`` a tile index of its WKT literals is written too, with ``subjects`` a second copy in the order
    of subjects, from which patterns with a constant subject read the row groups around it only.
    """
    ready = dedup(quads if set(SIDE) <= set(quads.columns) else typed(quads)).select(*KEY, *SIDE)
    ready.repartitionByRange("p", "o", "s").sortWithinPartitions("p", "o_num", "o", "s").write.mode("overwrite").option("compression", "zstd").parquet(path)
    if subjects:
        again = quads.sparkSession.read.parquet(path)
        again.repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o").write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{SUBJECTS}")
    if spatial:
        index.write(quads.sparkSession.read.parquet(path), path)


def read(spark: SparkSession, path: str) -> QuadSource:
    """A store as a source. One with batches of a stream isn't known to be a set before it is compacted."""
    df = spark.read.parquet(path)
    return QuadSource(df, unique="batch" not in df.columns, tiles=index.read(spark, path), subjects=index.beside(spark, path, SUBJECTS))


class QuadSource:
    """Quads of a store.

    ``union_default``: patterns outside GRAPH see the union of all graphs instead of the default graph. ``unique``:
    the table holds each quad once, so that a pattern over one graph, or one that reports the graph, needs no
    removal of repeats and with it no shuffle. ``tiles``: the tile index of all its WKT literals (``spatial.index``).
    ``subjects``: the same quads in the order of subjects.
    """

    def __init__(self, quads: DataFrame, union_default: bool = False, unique: bool = False, tiles: DataFrame | None = None, subjects: DataFrame | None = None):
        self.tiles, self.subjects = tiles, subjects
        self.spark, self.df, self.union_default, self.unique = quads.sparkSession, quads.where(" AND ".join(f"{c} IS NOT NULL" for c in KEY)), union_default, unique

    def _in(self, graph) -> DataFrame:
        if graph is None:
            return self.df.dropDuplicates(["s", "p", "o"]) if self.union_default else self.df.where(F.col("g") == f"<{DEFAULT_GRAPH}>")
        if isinstance(graph, (list, tuple)):
            return self.df.where(F.col("g").isin([f"<{g}>" for g in graph])).dropDuplicates(["s", "p", "o"])
        if isinstance(graph, IRI):
            return self.df.where(F.col("g") == f"<{graph.value}>")
        return self.df.where(F.col("g") != f"<{DEFAULT_GRAPH}>")

    def star(self, patterns: list[Pattern], graph, ranges: dict[str, list[tuple[str, float]]] | None = None) -> list[Frame]:
        return [self._one(p, graph, ranges or {}) for p in patterns]

    def _one(self, p: Pattern, graph, ranges: dict) -> Frame:
        conditions: list[Column] = []
        columns: dict[str, Column] = {}
        for term, c in ((p.s, F.col("s")), (p.p, F.col("p")), (p.o, F.col("o")), (graph if isinstance(graph, Var) else None, F.col("g"))):
            if isinstance(term, Var):
                if term.name in columns:
                    conditions.append(columns[term.name] == c)
                columns.setdefault(term.name, c)
            elif term is not None:
                conditions.append(c == F.lit(terms.canonical(term)))
        if isinstance(p.o, Var) and "o_num" in self.df.columns:
            for op, x in ranges.get(p.o.name, []):
                conditions.append({"<": F.col("o_num") < x, "<=": F.col("o_num") <= x, ">": F.col("o_num") > x, ">=": F.col("o_num") >= x}[op])
        source = copy.copy(self)
        if self.subjects is not None and not isinstance(p.s, Var):
            source.df = self.subjects
        for c in conditions:  # before any removal of duplicates, so that they reach the scan
            source.df = source.df.where(c)
        found = source._in(graph)
        if not self.unique:
            if isinstance(graph, Var):
                found = found.dropDuplicates(KEY)
            elif graph is None and not self.union_default or isinstance(graph, IRI):
                found = found.dropDuplicates(["s", "p", "o"])
        return Frame(found.select(*[c.alias(n) for n, c in columns.items()]) if columns else found.select(F.lit(1).alias("__one")), {n: NT for n in columns})

    def quads(self) -> DataFrame:
        return self.df.select(*KEY)

    def about(self, subjects: DataFrame) -> DataFrame:
        """(s, p, o) of subjects (s), in any graph."""
        return self.df.select("s", "p", "o").join(subjects, "s", "left_semi")

    def graphs(self) -> DataFrame:
        named = self.df.select("g").distinct().where(F.col("g") != f"<{DEFAULT_GRAPH}>")
        return named.select(terms.lexical(NT, F.col("g")).alias("g"))

    def nodes(self, graph) -> Frame:
        return Frame(self._in(graph).select(F.explode(F.array("s", "o")).alias("n")).distinct(), {"n": NT})
