"""Tile index of a quad store: which tiles the polygon of each WKT literal meets.

A region filter in a query becomes an equi-join on tiles, which leaves only the literals near the region for the
exact test. Tiles are found from the texts as they are, so no literal that meets a region is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.spatial import geometry, hilbert, wkt
from quadloom.terms import NT, WKT_LITERAL

#: Name of the index inside a store's folder; readers of the store pass over names that start like this.
FOLDER = "_tiles"
#: A region over more tiles than this isn't looked up: it covers more than an image.
MAX_TILES = 100_000


def of_quads(quads: DataFrame) -> DataFrame:
    """``(p, s, tx, ty)``, each once, of all readable WKT literals of quads (g, s, p, o)."""
    o = F.col("o")
    texts = quads.where(terms.datatype(NT, o) == WKT_LITERAL).select("p", "s", terms.lexical(NT, o).alias("t")).distinct()
    return geometry.tiles(texts, ["p", "s"], "t").distinct()


def of_corners(df: DataFrame, subject: str, predicate: str, corners: str, text: str) -> DataFrame:
    """The same from the curve positions of the corners of the boxes, and only where these are null from the texts.

    Boxes may meet more tiles than their polygons. They are taken a pixel larger, as corners are integers.
    """
    usable = F.filter(corners, lambda v: v.isNotNull() & (v >= 0))
    rows = df.where(F.col(subject).isNotNull()).select(F.col(subject).alias("s"), F.when(F.size(usable) >= 3, usable).alias("c"), F.when(~(F.size(usable) >= 3) | F.col(corners).isNull(), F.col(text)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corner, texts = batch.column(1), batch.column(2)
            own = np.repeat(np.arange(batch.num_rows), corner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            box = np.full((4, batch.num_rows), np.nan)
            for axis, values in enumerate(hilbert.decode(corner.flatten().to_numpy(zero_copy_only=False))):
                np.fmin.at(box[axis], own, values)
                np.fmax.at(box[axis + 2], own, values)
            for i in np.flatnonzero(np.isnan(box[0]) & texts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if found := wkt.box(texts[i].as_py()):
                    box[:, i] = found
            keep = ~np.isnan(box[0])
            box[:2] -= 1
            box[2:] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), *(pa.array(np.floor(x[keep] / geometry.TILE).astype(np.int64)) for x in box)], ["s", "x0", "y0", "x1", "y1"])

    boxes = rows.mapInArrow(run, "s string, x0 long, y0 long, x1 long, y1 long")
    each = boxes.select(F.lit(predicate).alias("p"), "s", F.explode(F.sequence("x0", "x1")).alias("tx"), "y0", "y1")
    return each.select("p", "s", "tx", F.explode(F.sequence("y0", "y1")).alias("ty"))


def write(quads: DataFrame, store: str) -> None:
    """Writes the index of quads into the folder of their store, sorted so that row groups are pruned by tile."""
    of_quads(quads).repartitionByRange("tx", "ty").sortWithinPartitions("tx", "ty").write.mode("overwrite").parquet(f"{store.rstrip('/')}/{FOLDER}")


def beside(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """A table inside a store's folder, if it is there."""
    path = f"{store.rstrip('/')}/{name}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.parquet(path) if there else None


def read(spark: SparkSession, store: str) -> DataFrame | None:
    """The index of a store, if it has one."""
    return beside(spark, store, FOLDER)


def near(index: DataFrame, region: str, scale: int, predicate: str | None) -> DataFrame | None:
    """``(s)``, each once: subjects with a literal, of a predicate if given, in a tile that a region meets; null if the region can't narrow anything down."""
    found = wkt.polygons(region)
    if not found:
        return None
    found = [[r / 2.0**scale for r in p] for p in found]
    x0, y0, x1, y1 = (np.floor(v / geometry.TILE) for v in wkt.extent(found))
    if (x1 - x0 + 1) * (y1 - y0 + 1) > MAX_TILES:
        return None
    cover = index.sparkSession.createDataFrame(list(geometry.tiles_of(found)), "tx long, ty long")  # at most MAX_TILES rows
    rows = index.where(F.col("tx").between(int(x0), int(x1)) & F.col("ty").between(int(y0), int(y1)))
    rows = rows.where(F.col("p") == predicate) if predicate is not None else rows
    return rows.join(F.broadcast(cover), ["tx", "ty"], "left_semi").select("s").distinct()
