"""Points near other points and points in regions, by equi-joins on grid cells.

Nearby points: each point has one home cell and is also sent to every cell its search box touches, so
each pair meets exactly once. Regions: an adaptive coverage divides each polygon into cells that lie
wholly inside, which accept their points at once, and border cells, divided until the edges that decide an exact
even-odd test are few. Nothing is broadcast by force and no pair outside a cell is ever looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import cut
from quadloom.spatial import hilbert, wkt

#: Cell sides of the coverage are powers of four, 4**STEPS[0] to 4**STEPS[-1].
STEPS = range(2, 12)
COVER = "region long, g long, step int, cx long, cy long, inner boolean, parity boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
#: A grid cell with more points than this is joined in several parts.
HOT_CELL = 5000


def places(geometries: DataFrame) -> DataFrame:
    """``(geo_id, g, x2, y2)``: twice the centre of each geometry's box, so that halves stay integers where the corners are.

    The box is that of the corners, in any order and number; null corners in the list are skipped and an
    empty list counts as null. Without corners it is that of ``as_wkt``. Geometries with neither, with null
    ``geo_id`` or ``g``, or with unreadable or empty text have no place and fall out. A geometry loaded
    several times counts once, with the smallest of its places if they differ.
    """
    corners = F.filter("hilbert_corners", lambda v: v.isNotNull() & (v >= 0))
    one = (
        geometries.select("geo_id", "g", corners.alias("c"), "as_wkt")
        .where(F.col("geo_id").isNotNull() & F.col("g").isNotNull())
        .select("geo_id", "g", F.when(F.size("c") > 0, F.col("c")).alias("c"), F.when(~(F.size("c") > 0) | F.col("c").isNull(), F.col("as_wkt")).alias("t"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            corner = batch.column(2)
            own = np.repeat(np.arange(n), corner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            x, y = hilbert.decode(corner.flatten().to_numpy(zero_copy_only=False))
            big = np.int64(2) ** 40
            lo, hi = np.full((2, n), big), np.full((2, n), -big)
            for axis, values in enumerate((x, y)):
                np.minimum.at(lo[axis], own, values)
                np.maximum.at(hi[axis], own, values)
            place = (lo + hi).astype(np.float64)
            ok = lo[0] < big
            text = batch.column(3)
            for i in np.flatnonzero(~ok & text.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if found := wkt.box(text[i].as_py()):
                    place[:, i] = found[0] + found[2], found[1] + found[3]
                    ok[i] = True
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(place[0][ok]), pa.array(place[1][ok])], ["geo_id", "g", "x2", "y2"])

    found = one.mapInArrow(read, "geo_id long, g long, x2 double, y2 double")
    return found.groupBy("geo_id").agg(F.min(F.struct("g", "x2", "y2")).alias("at")).select("geo_id", "at.g", "at.x2", "at.y2")


def pairs_within(points: DataFrame, radius2: float) -> DataFrame:
    """``(id_a, id_b)``, smaller id first, of points ``(geo_id, g, x2, y2)`` of one ``g`` at most ``radius2`` apart, in the unit of x2 and y2.

    Each pair comes once; points at the same place are pairs too. The points of a cell of more than ``HOT_CELL`` are
    salted, and those that look for partners go to each salt, so that such a cell's pairs are the work of many tasks.
    """
    side = 4.0 * radius2
    cell = lambda c: F.floor(c / F.lit(side))
    at = ["__g", "__cx", "__cy"]
    home = points.select(F.col("geo_id").alias("__a"), F.col("g").alias("__g"), F.col("x2").alias("__ax"), F.col("y2").alias("__ay"), cell(F.col("x2")).alias("__cx"), cell(F.col("y2")).alias("__cy"))
    reach = points.select(
        F.col("geo_id").alias("__b"),
        F.col("g").alias("__g"),
        F.col("x2").alias("__bx"),
        F.col("y2").alias("__by"),
        F.explode(F.sequence(cell(F.col("x2") - radius2), cell(F.col("x2") + radius2))).alias("__cx"),
    ).select("*", F.explode(F.sequence(cell(F.col("__by") - radius2), cell(F.col("__by") + radius2))).alias("__cy"))
    hot = cut(home.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / HOT_CELL).cast("int").alias("__salts")).where(F.col("__salts") > 1))
    if not hot.isEmpty():
        salts = F.coalesce("__salts", F.lit(1))
        home = home.join(hot, at, "left").withColumn("__salt", F.pmod(F.xxhash64("__a"), salts).cast("int")).drop("__salts")
        reach = reach.join(hot, at, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
        at = [*at, "__salt"]
    dx, dy = F.col("__ax") - F.col("__bx"), F.col("__ay") - F.col("__by")
    near = home.join(reach, at).where((F.col("__a") < F.col("__b")) & (dx * dx + dy * dy <= float(radius2) ** 2))
    return near.select(F.col("__a").alias("id_a"), F.col("__b").alias("id_b"))


def _crossed(e: np.ndarray, x: float, y: float) -> np.ndarray:
    """Which edges a ray to the right from a point crosses."""
    side = (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0])
    return ((e[:, 1] > y) != (e[:, 3] > y)) & ((side > 0) == (e[:, 3] > e[:, 1]))


def _cover(region: int, g: int, text: str, fineness: int, most: int) -> Iterator[tuple]:
    """Coverage rows of one region; see ``coverage``."""
    for rings in wkt.polygons(text) or []:
        e = wkt.edges(rings)
        low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
        (x0, y0), (x1, y1) = low.min(axis=0), high.max(axis=0)
        extent = max(x1 - x0, y1 - y0, 1.0)
        step = STEPS[0]
        while step < STEPS[-1] and 4.0 ** (step + 1) <= extent / fineness:
            step += 1
        side = 4.0**step
        todo = [(step, cx, cy, np.arange(len(e))) for cx in range(int(x0 // side), int(x1 // side) + 1) for cy in range(int(y0 // side), int(y1 // side) + 1)]
        while todo:
            k, cx, cy, own = todo.pop()
            side = 4.0**k
            bx0, by0 = cx * side, cy * side
            bx1, by1 = bx0 + side, by0 + side
            # a ray to the right from the cell can only meet edges at its height that don't end left of it
            own = own[(low[own, 1] <= by1) & (high[own, 1] >= by0) & (high[own, 0] >= bx0)]
            q = e[own]
            dx, dy = q[:, 2] - q[:, 0], q[:, 3] - q[:, 1]
            corners = np.stack([dx * (y - q[:, 1]) - dy * (x - q[:, 0]) for x in (bx0, bx1) for y in (by0, by1)])
            met = (low[own, 0] <= bx1) & (corners.min(axis=0) <= 0) & (corners.max(axis=0) >= 0)
            crossed = _crossed(q, bx0 + side / 2, by0 + side / 2)
            if not met.any():
                if crossed.sum() % 2:
                    yield region, g, k, cx, cy, True, False, None
                continue
            # edges over the whole height of the cell that don't meet it are crossed from everywhere in it or from nowhere
            past = ~met & (low[own, 1] <= by0) & (high[own, 1] > by1)
            if k == STEPS[0] or len(q) - past.sum() <= most:
                yield region, g, k, cx, cy, False, bool(crossed[past].sum() % 2), [dict(zip(("x1", "y1", "x2", "y2"), row, strict=True)) for row in q[~past].tolist()]
            else:
                todo += [(k - 1, 4 * cx + i, 4 * cy + j, own) for i in range(4) for j in range(4)]


def coverage(regions: DataFrame, fineness: int = 4, most: int = 16) -> DataFrame:
    """Cells covering regions ``(region, g, as_wkt)``: ``COVER`` rows, several polygons of a region each for itself.

    A region starts with cells of a power of four at most ``1/fineness`` of its extent; a cell is divided into 16
    until it lies wholly inside or outside, or needs at most ``most`` edges, or has the smallest side. ``inner`` cells
    lie wholly inside. A border cell carries the edges that a ray to the right from some of its points can meet, and
    of the others only whether their number is odd. Null, unreadable and empty texts give no cell.
    """
    rows = regions.select("region", "g", "as_wkt").dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["region", "g", "step", "cx", "cy", "inner", "parity", "edges"]
        edge = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(edge)]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = _cover(*row, fineness, most)
                while part := list(itertools.islice(cells, 2000)):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

    return rows.mapInArrow(run, COVER)


def points_in_regions(points: DataFrame, regions: DataFrame, fineness: int = 4, most: int = 16) -> DataFrame:
    """``(geo_id, region)``, each once, for points ``(geo_id, g, x2, y2)`` in or on the border of regions of their ``g``.

    The inside of a hole is outside unless another polygon of the region covers it. Empty tables on either
    side give an empty result.
    """
    cells = cut(coverage(regions, fineness, most))
    steps = [r[0] for r in cells.select("step").distinct().collect()]  # at most len(STEPS) numbers
    at = points.join(cells.select(F.col("g").alias("__cg")).distinct(), F.col("g") == F.col("__cg"), "left_semi").select(
        "geo_id", F.col("g").alias("__g"), (F.col("x2") / 2).alias("__x"), (F.col("y2") / 2).alias("__y"), F.explode(F.array(*[F.lit(k) for k in sorted(steps)]).cast("array<int>")).alias("__step")
    )
    side = F.pow(F.lit(4.0), F.col("__step"))
    at = at.withColumns({"__cx": F.floor(F.col("__x") / side), "__cy": F.floor(F.col("__y") / side)})
    on = (F.col("__g") == F.col("g")) & (F.col("__step") == F.col("step")) & (F.col("__cx") == F.col("cx")) & (F.col("__cy") == F.col("cy"))
    met = at.join(cells, on).select("geo_id", "region", "inner", "parity", "__x", "__y", "edges")

    def side_of(e):
        return (e.x2 - e.x1) * (F.col("__y") - e.y1) - (e.y2 - e.y1) * (F.col("__x") - e.x1)

    def on_edge(e):
        return (side_of(e) == 0) & F.col("__x").between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & F.col("__y").between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))

    def crossed(e):
        return ((e.y1 > F.col("__y")) != (e.y2 > F.col("__y"))) & ((side_of(e) > 0) == (e.y2 > e.y1))

    odd = (F.size(F.filter("edges", crossed)) % 2 == 1) != F.col("parity")
    return met.where(F.col("inner") | F.exists("edges", on_edge) | odd).select("geo_id", "region").distinct()
