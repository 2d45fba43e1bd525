"""What ranges of curve positions cover: squares, bounds, neighbours and outlines, without a look at single cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.spatial import hilbert, wkt


def squares(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, x, y, side)``: the fewest aligned squares that make up inclusive ranges; owner is the number of the range."""
    low, high = np.asarray(low, dtype=np.int64).copy(), np.asarray(high, dtype=np.int64)
    live, owners, starts, sizes = np.flatnonzero(low <= high), [], [], []
    while len(live):
        lo, left = low[live], high[live] - low[live] + 1
        k = np.zeros(len(live), dtype=np.int64)
        for _ in range(hilbert.BITS):  # the largest power of four that divides the start and fits
            side = np.int64(1) << np.minimum(2 * k + 2, 62)
            k += (k < hilbert.BITS) & (lo % side == 0) & (side <= left)
        owners.append(live)
        starts.append(lo)
        sizes.append(k)
        low[live] += np.int64(1) << (2 * k)
        live = live[low[live] <= high[live]]
    if not owners:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    owner, start, k = (np.concatenate(a) for a in (owners, starts, sizes))
    x, y = hilbert.decode(start)
    return owner, x >> k << k, y >> k << k, np.int64(1) << k


def bounds(ranges: Sequence[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """``(x0, y0, x1, y1)`` of the cells of ranges."""
    _, x, y, side = squares(*np.array(ranges, dtype=np.int64).reshape(-1, 2).T)
    return (int(x.min()), int(y.min()), int((x + side).max()) - 1, int((y + side).max()) - 1) if len(x) else None


def upper_left(ranges: Sequence[tuple[int, int]]) -> tuple[int, int] | None:
    """The cell of the smallest y, and of those the smallest x."""
    _, x, y, _ = squares(*np.array(ranges, dtype=np.int64).reshape(-1, 2).T)
    return min(zip(y.tolist(), x.tolist(), strict=True))[::-1] if len(x) else None


def fattened(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of the cells and of their neighbours at the next x and at the next y."""
    _, x, y, side = squares(*np.array(ranges, dtype=np.int64).reshape(-1, 2).T)
    boxes = [box for a, b, s in zip(x.tolist(), y.tolist(), side.tolist(), strict=True) for box in ((a, b, a + s, b + s - 1), (a, b + s, a + s - 1, b + s))]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(r for b in boxes for r in hilbert.cover_box(*b, budget=1 << 20)):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def outline(ranges: Sequence[tuple[int, int]]) -> list[list[np.ndarray]]:
    """Polygons, as of ``wkt.polygons``, around the cells of ranges, each cell being the unit square at its place; cells that meet at a corner only are apart."""
    _, x, y, side = squares(*np.array(ranges, dtype=np.int64).reshape(-1, 2).T)
    if not len(x):
        return []
    xs, ys = np.unique(np.r_[x, x + side]), np.unique(np.r_[y, y + side])
    full = np.zeros((len(xs) + 1, len(ys) + 1), dtype=bool)  # an empty frame around
    for a, b, c, d in zip(np.searchsorted(xs, x), np.searchsorted(xs, x + side), np.searchsorted(ys, y), np.searchsorted(ys, y + side), strict=True):
        full[a + 1 : b + 1, c + 1 : d + 1] = True
    # directed borders with the inside to the left
    onward: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (di, dj), (a, b) in {(0, -1): ((0, 0), (1, 0)), (1, 0): ((1, 0), (1, 1)), (0, 1): ((1, 1), (0, 1)), (-1, 0): ((0, 1), (0, 0))}.items():
        beside = np.roll(full, (-di, -dj), axis=(0, 1))
        for i, j in zip(*np.nonzero(full & ~beside), strict=True):
            onward.setdefault((i - 1 + a[0], j - 1 + a[1]), []).append((i - 1 + b[0], j - 1 + b[1]))
    rings = []
    while onward:
        start = next(iter(onward))
        ring, at, way = [start], start, None
        while True:
            ends = onward[at]
            # where two borders leave a corner, the turn to the left stays with the same cell
            to = ends[0] if len(ends) == 1 or way is None else next(e for e in ends if np.sign(e[0] - at[0]) == -way[1] and np.sign(e[1] - at[1]) == way[0])
            ends.remove(to)
            if not ends:
                del onward[at]
            way, at = (int(np.sign(to[0] - at[0])), int(np.sign(to[1] - at[1]))), to
            ring.append(at)
            if at == start:
                break
        p = np.array([(xs[i], ys[j]) for i, j in ring], dtype=np.float64)
        step = np.sign(np.diff(p, axis=0))
        bend = (step != np.roll(step, 1, axis=0)).any(axis=1)
        p = p[:-1][bend]
        rings.append(np.vstack([p, p[:1]]))
    turn = [float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) for r in rings]
    outer = [[r] for r, t in zip(rings, turn, strict=True) if t > 0]
    for hole in (r for r, t in zip(rings, turn, strict=True) if t < 0):
        inside = hole[:2].mean(axis=0) + (lambda d: np.array([d[1], -d[0]]))(np.sign(hole[1] - hole[0])) * 0.25  # just right of its first border, in the hole
        home = [o for o in outer if wkt.contains(o[:1], inside[:1], inside[1:])[0]]
        min(home, key=lambda o: wkt.area(o[:1])).append(hole)
    return outer


def range_squares(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """``(keys, x, y, side)``: the squares of the ranges of a table. Nulls and ranges whose end comes before their start have none."""
    rows = df.where(F.col(low) <= F.col(high)).select(*keys, F.col(low).cast("long").alias("__lo"), F.col(high).cast("long").alias("__hi"))
    n, kinds = len(keys), dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, *rest = squares(batch.column(n).to_numpy(), batch.column(n + 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(owner)) for c in batch.columns[:n]), *map(pa.array, rest)], [*keys, "x", "y", "side"])

    return rows.mapInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "x long, y long, side long")
