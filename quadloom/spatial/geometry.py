"""Polygon columns: parsing, tiles, pyramids, intersection and shape features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.runtime import cut
from quadloom.spatial import hilbert, wkt

TILE, MAX_LEVELS, MIN_AREA = 512, 20, 4.0


def without_crs(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^\s*(?:<[^>]*>|SRID=\d+;)\s*", "")


def numbers(text: Column) -> Column:
    """All coordinates of a text in order."""
    return F.regexp_extract_all(without_crs(text), F.lit(r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"), 1).cast("array<double>")


def bounds(text: Column) -> Column:
    """``struct<x0, y0, x1, y1>`` of a text, by expressions only; null for texts without a pair of numbers."""
    n = numbers(text)
    xs, ys = F.filter(n, lambda v, i: i % 2 == 0), F.filter(n, lambda v, i: i % 2 == 1)
    return F.when(F.size(n) >= 2, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def overlap(a: Column, b: Column) -> Column:
    """Whether two bounds meet; touching counts."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


@F.pandas_udf(T.BooleanType())
def _intersects(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}

    def read(text):
        if text not in seen:
            if len(seen) > 10_000:
                seen.clear()
            seen[text] = wkt.polygons(text)
        return seen[text]

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = read(x), read(y)
        out.append(None if p is None or q is None else wkt.intersects(p, q))
    return pd.Series(out, dtype="boolean")


def sf_intersects(a: Column, b: Column) -> Column:
    """Whether two polygon texts share a point; null for unreadable text.

    Both texts are read once, in Arrow batches, where bounds are compared before the exact test: bounds by
    expressions would run several regular expressions over each text and cost more than they save.
    """
    return _intersects(a, b)


def scaled(text: Column, scale: Column) -> Column:
    """The region at pyramid level ``scale``: its numbers over ``2**scale``."""
    return _scale(text, scale.cast("int"))


@F.pandas_udf(T.StringType())
def _scale(text: pd.Series, scale: pd.Series) -> pd.Series:
    def one(t, s):
        found = wkt.polygons(t)
        return None if found is None or pd.isna(s) else to_text([[r / 2.0 ** int(s) for r in p] for p in found])

    return pd.Series([one(t, s) for t, s in zip(text, scale, strict=True)], dtype="object")


def to_text(polygons: list[list[np.ndarray]]) -> str:
    """WKT of polygons."""
    num = lambda v: f"{v:.0f}" if float(v).is_integer() else repr(float(v))
    parts = ["(" + ", ".join("(" + ", ".join(f"{num(x)} {num(y)}" for x, y in r) + ")" for r in p) + ")" for p in polygons]
    if not parts:
        return "POLYGON EMPTY"
    return "POLYGON " + parts[0] if len(parts) == 1 else "MULTIPOLYGON (" + ", ".join(parts) + ")"


def parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ok, n_polygons, n_rings, n_points, x0, y0, x1, y1, degenerate)``; degenerate: unreadable, empty or fewer than four outer points."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                p = wkt.polygons(t)
                b = wkt.box(t) or (None,) * 4
                few = p is None or not p or any(len(q[0]) < 4 for q in p)
                rows.append((p is not None, len(p or ()), sum(map(len, p or ())), sum(len(r) for q in p or () for r in q), *b, few))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, types, strict=True))], [key, "ok", "n_polygons", "n_rings", "n_points", "x0", "y0", "x1", "y1", "degenerate"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ok boolean, n_polygons int, n_rings int, n_points int, x0 double, y0 double, x1 double, y1 double, degenerate boolean")


def _edges_and_corners(rings: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For boxes, as (n, 2) lower and upper corners: whether an edge of a polygon meets them, and whether the lower corner is inside."""
    x1, y1, x2, y2 = wkt.edges(rings).T
    (xl, yl), (xh, yh) = low.T[:, :, None], high.T[:, :, None]
    near = (np.minimum(x1, x2) <= xh) & (np.maximum(x1, x2) >= xl) & (np.minimum(y1, y2) <= yh) & (np.maximum(y1, y2) >= yl)
    # sides of an edge's line on which the corners of the box lie
    a, b, c, d = (x2 - x1) * (yl - y1), (x2 - x1) * (yh - y1), (y2 - y1) * (xl - x1), (y2 - y1) * (xh - x1)
    edge = near & (np.minimum(a, b) <= np.maximum(c, d)) & (np.maximum(a, b) >= np.minimum(c, d))
    crossings = ((y1 > yl) != (y2 > yl)) & ((a > c) == (y2 > y1))
    return edge.any(axis=1), crossings.sum(axis=1) % 2 == 1


def meets_boxes(rings: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which boxes share a point with a polygon: an edge meets the box, or the polygon has it inside."""
    edge, inside = _edges_and_corners(rings, low, high)
    return edge | inside


def holds_boxes(rings: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which boxes lie inside a polygon without touching its border."""
    edge, inside = _edges_and_corners(rings, low, high)
    return inside & ~edge


def tiles_of(found: list[list[np.ndarray]], size: int = TILE, exact: bool = True) -> Iterator[tuple[int, int]]:
    """``(tx, ty)`` of the tiles that polygons, at least one, or only their bounds meet. The far border of a tile belongs to the next one."""
    x0, y0, x1, y1 = (math.floor(v / size) for v in wkt.extent(found))
    wide, tall = x1 - x0 + 1, y1 - y0 + 1
    if wide * tall == 1:  # a polygon within one tile needs no test
        yield x0, y0
        return
    block = max(1, 200_000 // max(len(r) for p in found for r in p))  # bounds the memory of large polygons
    for at in range(0, wide * tall, block):
        i = np.arange(at, min(at + block, wide * tall))
        t = np.stack([x0 + i // tall, y0 + i % tall], axis=1)
        if exact:
            low = t.astype(np.float64) * size
            t = t[np.logical_or.reduce([meets_boxes(p, low, low + size) for p in found])]
        yield from map(tuple, t.tolist())


def tiles(df: DataFrame, keys: Sequence[str], text: str, size: int = TILE, exact: bool = True) -> DataFrame:
    """``(keys, tx, ty)``: tiles of a grid that polygons truly meet; touching counts. Unreadable, empty and null texts fall out."""
    chosen = df.select(*keys)
    names = [*chosen.columns, "tx", "ty"]

    def pack(batch: pa.RecordBatch, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(names) - 2)), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(len(names) - 2).to_pylist()):
                for tx, ty in tiles_of(found, size, exact) if (found := wkt.polygons(t)) else ():
                    rows.append((i, tx, ty))
                    if len(rows) == 50_000:  # polygons over many tiles don't fill the memory
                        yield pack(batch, rows)
                        rows = []
            yield pack(batch, rows)

    schema = T.StructType([*chosen.schema.fields, T.StructField("tx", T.LongType()), T.StructField("ty", T.LongType())])
    return df.select(*keys, F.col(text).alias("__t")).mapInArrow(run, schema)


def framed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(__k, __t, __b)``: key, text and bounds of each readable, not empty text."""
    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *b) for i, t in enumerate(batch.column(1).to_pylist()) if (b := wkt.box(t))]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([f[i] for f in found], pa.float64()) for i in range(1, 5))], ["__k", "__t", *sides])

    sides = ["x0", "y0", "x1", "y1"]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in sides)])
    return rows.mapInArrow(run, schema).select("__k", "__t", F.struct(*sides).alias("__b"))


def batch_intersects(geometries: DataFrame, boxes: DataFrame, key: str, box_key: str, text: str = "as_wkt", size: int = 2048) -> DataFrame:
    """``(key, box_key)``, each once, of polygons that meet boxes ``(box_key, x0, y0, x1, y1)``: an equi-join on tiles, bounds, then the exact test. Unreadable, empty and null texts fall out."""
    b = framed(geometries, key, text)
    cover = lambda df, x0, x1, y0, y1: df.select("*", F.explode(F.sequence(F.floor(x0 / size), F.floor(x1 / size))).alias("__tx")).select("*", F.explode(F.sequence(F.floor(y0 / size), F.floor(y1 / size))).alias("__ty"))
    left = cover(b, F.col("__b.x0"), F.col("__b.x1"), F.col("__b.y0"), F.col("__b.y1"))
    box = boxes.select(F.col(box_key).alias("__bk"), F.struct("x0", "y0", "x1", "y1").alias("__q"))
    right = cover(box, F.col("__q.x0"), F.col("__q.x1"), F.col("__q.y0"), F.col("__q.y1"))
    # the pair is reported from the tile of the larger of the lower corners only, so no distinct is needed
    tx, ty = F.floor(F.greatest(F.col("__b.x0"), F.col("__q.x0")) / size), F.floor(F.greatest(F.col("__b.y0"), F.col("__q.y0")) / size)
    met = left.join(right, ["__tx", "__ty"]).where(overlap(F.col("__b"), F.col("__q")) & (F.col("__tx") == tx) & (F.col("__ty") == ty))
    q = F.col("__q")
    square = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", q[a].cast("string"), q[c].cast("string")) for a, c in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]), F.lit("))"))
    whole = (F.col("__b.x0") >= q["x0"]) & (F.col("__b.x1") <= q["x1"]) & (F.col("__b.y0") >= q["y0"]) & (F.col("__b.y1") <= q["y1"])
    return met.where(whole | _intersects(F.col("__t"), square)).select(F.col("__k").alias(key), F.col("__bk").alias(box_key))


def corners(text: Column) -> Column:
    """Curve positions of the corners of the bounds: bottom left, top left, top right, bottom right."""
    b = bounds(text)
    return F.array(*[hilbert.hilbert_index(b[x], b[y]) for x, y in (("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"))])


def in_ranges(positions: DataFrame, column: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows whose position lies in one of the sorted, disjoint ranges: a search in a constant array, no join."""
    if not ranges:
        return positions.where(F.lit(False))
    lows, highs = [r[0] for r in ranges], [r[1] for r in ranges]

    @F.pandas_udf(T.BooleanType())
    def hit(v: pd.Series) -> pd.Series:
        x = v.fillna(-1).to_numpy(dtype=np.int64)
        at = np.searchsorted(lows, x, "right") - 1
        return pd.Series((at >= 0) & (x <= np.array(highs)[np.maximum(at, 0)]))

    return positions.where(F.col(column).between(lows[0], highs[-1]) & hit(F.col(column)))


def merge_ranges(df: DataFrame, low: str, high: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, low, high)``: overlapping or adjacent inclusive ranges merged. Ranges whose end comes before their start and nulls fall out.

    Gaps and islands over range partitions: what reaches in from the partitions before, and how many islands start
    there, are small tables, so the ranges of one key, or all without keys, are the work of many tasks.
    """
    keys = list(keys)
    rows = df.where(F.col(low) <= F.col(high)).select(*keys, F.col(low).cast("long").alias("__lo"), F.col(high).cast("long").alias("__hi"))
    ranged = cut(rows.repartitionByRange(*keys, "__lo").withColumn("__part", F.spark_partition_id()))  # written: the ids must not change
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "__part").orderBy("__lo", "__hi")

    def beside(left: DataFrame, small: DataFrame, column: str) -> DataFrame:
        """``left`` with a column of a table that has one row for each key and partition."""
        named = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), column)
        on = F.col("__part") == F.col("__p")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return left.join(named, on).drop("__p", *[f"__k{i}" for i in range(len(keys))])

    ends = ranged.groupBy(*keys, "__part").agg(F.max("__hi").alias("__end")).withColumn("__reach", F.max("__end").over(earlier))
    before = F.greatest(F.col("__reach"), F.max("__hi").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    marked = beside(ranged, ends, "__reach").withColumn("__before", before)
    marked = cut(marked.withColumn("__new", F.when(F.col("__before").isNull() | (F.col("__lo") > F.col("__before") + 1), 1).otherwise(0)))
    starts = marked.groupBy(*keys, "__part").agg(F.sum("__new").alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    island = F.col("__offset") + F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = beside(marked, starts, "__offset").withColumn("__island", island)
    return numbered.groupBy(*keys, "__island").agg(F.min("__lo").alias("low"), F.max("__hi").alias("high")).drop("__island")


def in_merged(positions: DataFrame, column: str, ranges: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """Rows whose position lies in one of many disjoint ranges (low, high): an equi-join on cells of the line, which longer ranges repeat for."""
    spread = ranges.select("low", "high", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor(F.col("high") / cell))).alias("__cell"))
    here = F.floor(F.col(column) / cell)
    return positions.join(spread, (here == F.col("__cell")) & F.col(column).between(F.col("low"), F.col("high")), "left_semi")


def _clean(ring: np.ndarray) -> np.ndarray:
    """A closed ring without repeated and collinear points."""
    r = ring[:-1]
    r = r[np.any(r != np.roll(r, 1, axis=0), axis=1)] if len(r) > 1 else r
    while len(r) >= 3:
        a, b = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
        turn = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
        if (turn != 0).all():
            break
        r = r[turn != 0]
        r = r[np.any(r != np.roll(r, 1, axis=0), axis=1)] if len(r) > 1 else r
    return np.vstack([r, r[:1]]) if len(r) else ring[:0]


def levels(text: str | None) -> list[tuple[int, list[list[np.ndarray]]]]:
    """Pyramid of a polygon text: level 0 snapped to integers, each further level halved and rounded, while a polygon of at least ``MIN_AREA`` is left."""
    found = wkt.polygons(text)
    out, level = [], 0
    now = [[np.floor(r + 0.5) for r in p] for p in found or []]
    while now and level < MAX_LEVELS:
        kept = []
        for p in now:
            rings = [_clean(r) for r in p]
            if len(rings[0]) >= 4 and (level == 0 or wkt.area(rings[:1]) >= MIN_AREA):
                kept.append([r for r in rings if len(r) >= 4])
        if not kept:
            break
        out.append((level, kept))
        now, level = [[np.floor(r / 2 + 0.5) for r in p] for p in kept], level + 1
    return out


def pyramid(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, level, wkt)`` for every level of every polygon."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, s, to_text(p)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s, p in levels(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [key, "level", "wkt"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, level int, wkt string")


def num_scales(width: Column, height: Column, box: Column) -> Column:
    """Halvings until the larger side fits the box."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width, height).cast("double") / box))).cast("int")


def pixels(rings: list[np.ndarray]) -> np.ndarray:
    """Per row (y, first x, last x) the runs of integer points in or on a polygon.

    Candidate spans of all rows at once: between crossings just above and just below each row, along level
    edges, and single points on edges; then overlapping spans of a row are merged by a running maximum.
    """
    e = wkt.edges(rings)
    y = np.arange(int(np.ceil(e[:, [1, 3]].min())), int(np.floor(e[:, [1, 3]].max())) + 1, dtype=np.float64)
    flat, slant = e[e[:, 1] == e[:, 3]], e[e[:, 1] != e[:, 3]]
    found = []
    for at in range(0, len(y), 4096):  # blocks of rows bound the memory of tall polygons
        rows = y[at : at + 4096, None]
        xs = slant[:, 0] + (rows - slant[:, 1]) * (slant[:, 2] - slant[:, 0]) / (slant[:, 3] - slant[:, 1])
        for crossing in ((slant[:, 1] > rows) != (slant[:, 3] > rows), (slant[:, 1] >= rows) != (slant[:, 3] >= rows)):
            ends = np.sort(np.where(crossing, xs, np.inf), axis=1)
            ends = ends[:, : ends.shape[1] // 2 * 2].reshape(len(rows), -1, 2)
            r, k = np.nonzero(np.isfinite(ends[..., 1]))
            found.append((rows[r, 0], ends[r, k, 0], ends[r, k, 1]))
        r, k = np.nonzero((np.minimum(slant[:, 1], slant[:, 3]) <= rows) & (np.maximum(slant[:, 1], slant[:, 3]) >= rows))
        found.append((rows[r, 0], xs[r, k], xs[r, k]))
    level = flat[flat[:, 1] == np.floor(flat[:, 1])]
    found.append((level[:, 1], np.minimum(level[:, 0], level[:, 2]), np.maximum(level[:, 0], level[:, 2])))
    row, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(3))
    lo, hi, row = np.ceil(lo - 1e-9).astype(np.int64), np.floor(hi + 1e-9).astype(np.int64), row.astype(np.int64)
    keep = hi >= lo
    row, lo, hi = row[keep], lo[keep], hi[keep]
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    if not len(row):
        return np.zeros((0, 3), dtype=np.int64)
    wide = np.int64(2) ** 32
    upto = np.maximum.accumulate(row * wide + hi)
    first = np.flatnonzero(np.r_[True, (row * wide + lo)[1:] > upto[:-1] + 1])
    last = np.r_[first[1:], len(row)] - 1
    return np.stack([row[first], lo[first], upto[last] - row[first] * wide], axis=1)


FEATURES = ("mesh_surface", "pixel_surface", "perimeter", "perimeter_surface_ratio", "sphericity", "spherical_disproportion", "maximum_2d_diameter", "major_axis_length", "minor_axis_length", "elongation")


def shape(found: list[list[np.ndarray]]) -> tuple[float, ...]:
    """The ten 2-D shape features of polygons taken together."""
    area = sum(wkt.area(p) for p in found)
    perimeter = float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for p in found for r in p))
    points = np.unique(np.concatenate([p[0][:-1] for p in found]), axis=0)
    far = 0.0
    for at in range(0, len(points), 1000):  # blocks of rows, so that memory stays bounded for long rings
        far = max(far, float(np.hypot(points[at : at + 1000, None, 0] - points[None, :, 0], points[at : at + 1000, None, 1] - points[None, :, 1]).max()))
    runs = np.concatenate([pixels(p) for p in found]).astype(np.float64)
    y, a, b = runs.T
    n = b - a + 1
    count = n.sum()
    sx, sxx = n * (a + b) / 2, n * (a + b) ** 2 / 4 + n * (n * n - 1) / 12
    mx, my = sx.sum() / count, (n * y).sum() / count
    cov = np.array([[sxx.sum() / count - mx * mx, (sx * y).sum() / count - mx * my], [0, (n * y * y).sum() / count - my * my]])
    half, diff = (cov[0, 0] + cov[1, 1]) / 2, np.hypot((cov[0, 0] - cov[1, 1]) / 2, cov[0, 1])
    major, minor = 4 * np.sqrt(max(half + diff, 0)), 4 * np.sqrt(max(half - diff, 0))
    round_ = 2 * np.sqrt(np.pi * area)
    return (area, float(count), perimeter, perimeter / area if area else None, round_ / perimeter if perimeter else None, perimeter / round_ if area else None, far, float(major), float(minor), float(minor / major) if major else None)


def shape_features(df: DataFrame, key: str, text: str) -> DataFrame:
    """The ten features of each polygon; unreadable, empty and null texts fall out."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *shape(p)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (p := wkt.polygons(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(1, 11))], [key, *FEATURES])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in FEATURES))


def pca_axes(text: Column) -> Column:
    """``struct<cx, cy, major, minor>`` of the outer vertices, by expressions: axis length twice the root of the sample covariance's eigenvalue."""
    n = numbers(text)
    xs = F.filter(n, lambda v, i: i % 2 == 0)
    ys = F.filter(n, lambda v, i: i % 2 == 1)
    xs, ys = F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(ys, F.lit(1), F.size(ys) - 1)
    k = F.size(xs).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mx, my = total(xs) / k, total(ys) / k
    sxx = total(F.transform(xs, lambda v: (v - mx) * (v - mx))) / (k - 1)
    syy = total(F.transform(ys, lambda v: (v - my) * (v - my))) / (k - 1)
    sxy = total(F.zip_with(xs, ys, lambda x, y: (x - mx) * (y - my))) / (k - 1)
    half, diff = (sxx + syy) / 2, F.sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)
    return F.when(k >= 3, F.struct(mx.alias("cx"), my.alias("cy"), (2 * F.sqrt(half + diff)).alias("major"), (2 * F.sqrt(F.greatest(half - diff, F.lit(0.0)))).alias("minor")))
