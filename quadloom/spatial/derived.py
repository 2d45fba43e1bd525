"""Quads derived from geometries: every pyramid level's text and corners, for the spatial graph and the graphs of tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.spatial import geometry, hilbert, wkt
from quadloom.terms import NT, WKT_LITERAL

SPATIAL_GRAPH, GRID, VOCAB = "urn:x-graph:spatial", "urn:x-graph:grid", "urn:x-graph:hal/"
#: Levels that have predicates of their own.
SCALES = 15


def _corners(boxes: list[tuple[float, float, float, float]]) -> np.ndarray:
    """(n, 4) curve positions of corners, ordered as by ``geometry.corners``; negative where out of range."""
    b = np.array(boxes, dtype=np.float64).reshape(-1, 4)
    x, y = b[:, [0, 0, 2, 2]].ravel(), b[:, [1, 3, 3, 1]].ravel()
    ok = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < 2.0**hilbert.BITS)
    found = hilbert.encode(np.where(ok, x, 0).astype(np.int64), np.where(ok, y, 0).astype(np.int64))
    return np.where(ok, found, -1).reshape(-1, 4)


def derive(df: DataFrame, subject: str, text: str) -> DataFrame:
    """``(g, s, p, o)``, each once, of polygon texts and their subjects in canonical text.

    ``asWKT<n>`` of level n goes to the spatial graph and to the graph of each tile that the level's polygons meet,
    four ``hilbertCorner<n>`` to the spatial graph. Unreadable, empty and null texts have none, and corners out of
    the curve's range fall out. The texts of one subject stay together, so that no shuffle of derived quads is needed.
    """
    each = df.where(F.col(subject).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(subject).alias("s")).agg(F.collect_set(text).alias("__t"))

    def quads(subjects: list[str], texts: list[list[str]]) -> Iterator[tuple[str, str, str, str]]:
        made = [list(dict.fromkeys((n, geometry.to_text(p), wkt.extent(p), tuple(geometry.tiles_of(p))) for t in ts for n, p in geometry.levels(t)[:SCALES])) for ts in texts]
        corners = iter(_corners([box for levels in made for _, _, box, _ in levels]).tolist())
        for s, levels in zip(subjects, made, strict=True):
            seen = set()
            for n, shape, _, tiles in levels:
                name, o = f"<{VOCAB}asWKT{n}>", f'"{shape}"^^<{WKT_LITERAL}>'
                yield f"<{SPATIAL_GRAPH}>", s, name, o
                for x, y in tiles:
                    yield f"<{GRID}:{n}:{x}:{y}>", s, name, o
                for h in next(corners):
                    if h >= 0 and (n, h) not in seen:
                        seen.add((n, h))
                        yield f"<{SPATIAL_GRAPH}>", s, f"<{VOCAB}hilbertCorner{n}>", f'"{h}"^^xsd:long'

    def pack(rows: list[tuple[str, str, str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["g", "s", "p", "o"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):  # blocks of subjects whose corners are found at once
                part = batch.slice(at, 256)
                for row in quads(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows.append(row)
                    if len(rows) == 20_000:
                        yield pack(rows)
                        rows = []
            yield pack(rows)

    return each.mapInArrow(run, "g string, s string, p string, o string")


def of_quads(quads: DataFrame) -> DataFrame:
    """Derived quads of all WKT literals of quads (g, s, p, o)."""
    o = F.col("o")
    return derive(quads.where(terms.datatype(NT, o) == WKT_LITERAL).select("s", terms.lexical(NT, o).alias("t")), "s", "t")


def added(quads: DataFrame) -> DataFrame:
    """Quads (g, s, p, o) with those derived from them."""
    return quads.select("g", "s", "p", "o").unionByName(of_quads(quads))


def features(quads: DataFrame) -> DataFrame:
    """Quads of the shape features of all WKT literals of quads (g, s, p, o), in the graphs of the literals. Unreadable and empty texts have none."""
    o = F.col("o")
    texts = quads.where(terms.datatype(NT, o) == WKT_LITERAL).select(F.struct("g", "s").alias("k"), terms.lexical(NT, o).alias("t")).distinct()
    found = geometry.shape_features(texts, "k", "t")
    names = ["".join(w.capitalize() for w in c.split("_")) for c in geometry.FEATURES]
    cells = F.array(*[F.struct(F.lit(f"<{VOCAB}shape2d/{n}>").alias("p"), F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"^^xsd:double')).alias("o")) for n, c in zip(names, geometry.FEATURES, strict=True)])
    return found.select("k.g", "k.s", F.explode(cells).alias("x")).where("x.o IS NOT NULL").select("g", "s", "x.p", "x.o")
