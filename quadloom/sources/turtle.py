"""Turtle files: each is parsed as a whole by one task, files side by side."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadloom.sparql.parser import Parser, SparqlSyntaxError
from quadloom.terms import DEFAULT_GRAPH, BNode, Var, canonical

class TurtleParser(Parser):
    """Triples of a document. The triple syntax is that of queries, with directives and without variables."""

    def __init__(self, text: str, scope: str = ""):
        super().__init__(text, {})
        self.prefixes, self.scope = {}, scope

    def label(self, name: str) -> BNode:
        return BNode("b" + hashlib.sha256(f"{self.scope}\x1f{name}".encode()).hexdigest()[:32])

    def directive(self) -> str | None:
        """PREFIX or BASE, also with a sign before, where no literal goes before."""
        if self.peek()[0] == "lang" and self.peek()[1].lower() in ("@prefix", "@base"):
            return self.take()[1][1:].upper()
        return self.accept("PREFIX", "BASE")

    def triples(self) -> Iterator[tuple[str, str, str]]:
        while self.peek()[0] != "end":
            if word := self.directive():
                if word == "BASE":
                    self.base = self.take()[1][1:-1]
                else:
                    name = self.take()[1][:-1]
                    self.prefixes[name] = self.iri().value
                self.accept(".")
                continue
            for p in self.triples_block():
                terms = [self.label(t.name) if isinstance(t, Var) else t for t in (p.s, p.p, p.o)]
                yield tuple(canonical(t) for t in terms)
            self.expect(".")

    def verb(self):
        return self.verb_iri()

    def node(self, out):
        if self.peek()[0] == "var":
            raise SparqlSyntaxError("a variable in Turtle")
        return super().node(out)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Quads of the default graph, and (file, problem) of files that couldn't be read. Gzipped files end in ``.gz``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "s", "p", "o", "file", "problem"]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                problem, rows = None, []
                try:
                    text = (gzip.decompress(content) if file.endswith(".gz") else content).decode("utf-8")
                    for t in TurtleParser(text, file).triples():
                        rows.append((f"<{DEFAULT_GRAPH}>", *t, file, None))
                        if len(rows) >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], names)
                            rows = []
                except (ValueError, OSError) as e:
                    problem = f"{type(e).__name__}: {e}"
                if problem:
                    rows.append((None, None, None, None, file, problem))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, "g string, s string, p string, o string, file string, problem string")
    return found.where("problem IS NULL").select("g", "s", "p", "o"), found.where("problem IS NOT NULL").select("file", "problem")
