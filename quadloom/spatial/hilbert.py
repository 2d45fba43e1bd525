"""Hilbert curve of 2 dimensions and up to 31 bits each, vectorised over numpy arrays.

The orientation is fixed by (0,0)=0, (0,1)=1, (1,1)=2, (1,0)=3. Levels above the highest set bit only
exchange the axes, so the loops stop there and make up for the exchanges by parity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 31


def decode(index: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The points of curve positions; a negative position gives (-1, -1)."""
    t = np.asarray(index, dtype=np.int64).copy()
    bad = t < 0
    t[bad] = 0
    top = int(t.max()).bit_length() if t.size else 0
    levels = min(bits, (top + 1) // 2)
    x, y = np.zeros_like(t), np.zeros_like(t)
    for k in range(levels):
        side = np.int64(1) << k
        rx = (t >> 1) & 1
        ry = (t ^ rx) & 1
        turn = ry == 0
        flip = turn & (rx == 1)
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        x, y = x + side * rx, y + side * ry
        t >>= 2
    if (bits - levels) % 2:
        x, y = y, x
    x[bad], y[bad] = -1, -1
    return x, y


def encode(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve positions of points with coordinates from 0 to 2**bits - 1; others give -1."""
    x, y = np.asarray(x, dtype=np.int64).copy(), np.asarray(y, dtype=np.int64).copy()
    bad = (x < 0) | (y < 0) | (x >> bits > 0) | (y >> bits > 0)
    x[bad], y[bad] = 0, 0
    top = int(max(x.max(), y.max())).bit_length() if x.size else 0
    if (bits - top) % 2:
        x, y = y, x
    d = np.zeros_like(x)
    for k in range(top - 1, -1, -1):
        side = np.int64(1) << k
        rx, ry = (x >> k) & 1, (y >> k) & 1
        d += side * side * ((3 * rx) ^ ry)
        x, y = x & (side - 1), y & (side - 1)
        turn = ry == 0
        flip = turn & (rx == 1)
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    d[bad] = -1
    return d


@F.pandas_udf(T.LongType())
def _encode_udf(x: pd.Series, y: pd.Series) -> pd.Series:
    ok = x.notna() & y.notna()
    d = encode(x.fillna(-1).to_numpy(dtype=np.int64), y.fillna(-1).to_numpy(dtype=np.int64))
    return pd.Series(d, dtype="Int64").where(ok.to_numpy() & (d >= 0))


@F.pandas_udf(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))
def _decode_udf(d: pd.Series) -> pd.DataFrame:
    x, y = decode(d.fillna(-1).to_numpy(dtype=np.int64))
    bad = x < 0
    return pd.DataFrame({"x": pd.Series(x, dtype="Int64").mask(bad), "y": pd.Series(y, dtype="Int64").mask(bad)})


def hilbert_index(x: Column, y: Column) -> Column:
    """Curve position of a point column; null for nulls and coordinates out of range."""
    return _encode_udf(x.cast("long"), y.cast("long"))


def hilbert_point(index: Column) -> Column:
    """``struct<x, y>`` of a position column; null members for null or negative positions."""
    return _decode_udf(index.cast("long"))


def _cover(meets, inside, level: int, budget: int, bits: int) -> list[tuple[int, int]]:
    """Merged inclusive position ranges of the squares that meet a shape, by quadtree descent from the square of side ``2**level``.

    An aligned square of side 2**k is one run of 4**k positions. Squares inside the shape are taken whole, squares
    outside dropped, others split down to single cells. Beyond ``budget`` squares those that would be split are
    taken whole: no cell is lost, but some outside come along, so callers test what they find.
    """
    todo, taken = np.zeros((1, 2), dtype=np.int64), []
    for k in range(level, -1, -1):
        side = np.int64(1) << k
        low = todo * side
        met = meets(low, low + side - 1)
        todo, low = todo[met], low[met]
        whole = inside(low, low + side - 1) if k else np.ones(len(todo), dtype=bool)
        last = len(taken) + 4 * int((~whole).sum()) > budget
        stay = np.ones_like(whole) if last else whole
        taken += [(int(x), int(y), k) for x, y in low[stay]]
        todo = todo[~stay]
        if not len(todo):
            break
        todo = (2 * todo[:, None, :] + np.array([(0, 0), (0, 1), (1, 0), (1, 1)])).reshape(-1, 2)
    if not taken:
        return []
    cells = np.array(taken, dtype=np.int64)
    first = encode(cells[:, 0], cells[:, 1], bits) >> (2 * cells[:, 2]) << (2 * cells[:, 2])
    order = np.argsort(first)
    merged: list[tuple[int, int]] = []
    for lo, hi in zip(first[order].tolist(), (first + (np.int64(1) << (2 * cells[:, 2])) - 1)[order].tolist(), strict=True):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def cover_box(x0: int, y0: int, x1: int, y1: int, budget: int = 4096, bits: int = BITS) -> list[tuple[int, int]]:
    """Merged inclusive position ranges whose cells cover the box exactly, or loosely once ``budget`` squares are in use."""
    if x1 < x0 or y1 < y0 or x1 < 0 or y1 < 0:
        return []
    a, b = np.array([max(x0, 0), max(y0, 0)]), np.array([x1, y1])
    return _cover(lambda low, high: ((low <= b) & (high >= a)).all(axis=1), lambda low, high: ((low >= a) & (high <= b)).all(axis=1), max(x1, y1).bit_length(), budget, bits)


def cover_polygon(polygons: list[list[np.ndarray]], budget: int = 4096, bits: int = BITS) -> list[tuple[int, int]]:
    """The same for the integer points in or on the border of polygons, as of ``wkt.polygons``."""
    from quadloom.spatial import geometry, wkt

    if not polygons:
        return []
    x0, y0, x1, y1 = wkt.extent(polygons)
    if x1 < 0 or y1 < 0:
        return []

    def meets(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([geometry.meets_boxes(p, low.astype(np.float64), high.astype(np.float64)) for p in polygons])

    def inside(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([geometry.holds_boxes(p, low.astype(np.float64), high.astype(np.float64)) for p in polygons])

    return _cover(meets, inside, int(max(x1, y1)).bit_length(), budget, bits)
