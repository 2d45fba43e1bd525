"""Entry point: SPARQL text and quad look-ups over a source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.sparql import results
from quadloom.sparql.compiler import Compiler
from quadloom.sparql.parser import parse
from quadloom.spatial.sparql import FUNCTIONS
from quadloom.terms import IRI


class Engine:
    """Queries over a quad source; ``prefixes`` extend the built-in ones.

    ``functions`` adds filter functions by IRI: each takes the scope and the arguments of a call and returns the
    kind and the column of its value.
    """

    def __init__(self, source, prefixes: dict[str, str] | None = None, functions: dict[str, Callable] | None = None):
        self.source, self.spark, self.prefixes = source, source.spark, prefixes
        self.functions = {**FUNCTIONS, **(functions or {})}

    @classmethod
    def store(cls, spark: SparkSession, path: str) -> Engine:
        from quadloom.sources import quads

        return cls(quads.read(spark, path))

    def sparql(self, text: str) -> DataFrame:
        """SELECT gives one column per variable, ASK one boolean, CONSTRUCT and DESCRIBE s, p, o in canonical text."""
        return Compiler(self.source, self.functions).run(parse(text, self.prefixes))

    def document(self, text: str, form: str) -> results.Document:
        """The result as a document: json, xml, csv or tsv for SELECT and ASK, nt, turtle, jsonld or rdfxml for triples."""
        q, compiler = parse(text, self.prefixes), Compiler(self.source, self.functions)
        if q.form == "SELECT":
            return results.bindings(compiler.frame(q), form)
        if q.form == "ASK":
            nothing = self.spark.createDataFrame([], "value string")
            return results.Document(results.boolean(compiler.run(q).first()[0], form), nothing, "", "")
        return results.triples(compiler.run(q), form)

    def rows(self, text: str) -> Iterator:
        """Result rows one by one, partition by partition."""
        return self.sparql(text).toLocalIterator(prefetchPartitions=True)

    def stream(self, s=None, p=None, o=None) -> Iterator:
        """Quads that match, one by one."""
        return self.find(None, s, p, o).toLocalIterator(prefetchPartitions=True)

    def find(self, g=None, s=None, p=None, o=None, named_only: bool = False) -> DataFrame:
        """Quads (g, s, p, o) in canonical text that match the given terms; any graph without ``g``."""
        df = self.source.quads()
        for c, term in (("g", g), ("s", s), ("p", p), ("o", o)):
            if term is not None:
                df = df.where(F.col(c) == F.lit(terms.canonical(term)))
        return df.where(F.col("g") != f"<{terms.DEFAULT_GRAPH}>") if named_only else df

    def graphs(self) -> DataFrame:
        """Named graphs, without the default graph."""
        return self.source.graphs()

    def contains_graph(self, iri: str) -> bool:
        return not self.source.graphs().where(F.col("g") == iri).isEmpty()

    def distinct_terms(self, position: str) -> DataFrame:
        """Distinct canonical terms at g, s, p or o."""
        return self.source.quads().select(position).distinct()

    def count(self, g: IRI | None = None) -> DataFrame:
        df = self.source.quads()
        return (df.where(F.col("g") == terms.canonical(g)) if g else df).agg(F.count(F.lit(1)).alias("n"))
