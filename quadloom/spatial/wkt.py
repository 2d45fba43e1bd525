"""Strict reader of POLYGON and MULTIPOLYGON text, with or without a CRS prefix, and exact planar tests."""

from __future__ import annotations

import re

import numpy as np

_PREFIX = re.compile(r"\s*(?:<[^>]*>|SRID=\d+;)\s*", re.I)
_HEAD = re.compile(r"\s*(MULTIPOLYGON|POLYGON)\s*(ZM|Z|M)?\s*(EMPTY\s*$|(?=\())", re.I)
_NUM = r"[-+]?(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][-+]?\d++)?"  # possessive: a broken text fails in one pass
#: A ring by the numbers of a point: x and y, and further ones that are read over.
_RING = {n: re.compile(rf"\(\s*+{_NUM}(?:\s++{_NUM}){{{n - 1}}}\s*+(?:,\s*+{_NUM}(?:\s++{_NUM}){{{n - 1}}}\s*+)*+\)") for n in (2, 3, 4)}
_ONE = re.compile(r"\(\s*R(?:\s*,\s*R)*\s*\)$")
_MANY = re.compile(r"\(\s*\(\s*R(?:\s*,\s*R)*\s*\)(?:\s*,\s*\(\s*R(?:\s*,\s*R)*\s*\))*\s*\)$")
_PART = re.compile(r"\(\s*R(?:\s*,\s*R)*\s*\)")


def polygons(text: str | None) -> list[list[np.ndarray]] | None:
    """Polygons as lists of rings (outer first), each an (n, 2) array closed at the end; Z and M are left out.

    ``None`` for null or unreadable text (unknown type, truncated, single numbers, a ring that is not
    closed or has fewer than four points); an empty list for EMPTY.
    """
    if text is None:
        return None
    if m := _PREFIX.match(text):
        text = text[m.end() :]
    m = _HEAD.match(text)
    if not m:
        return None
    if m[3]:
        return []
    body, rings, n = text[m.end() :].strip(), [], 2 + len(m[2] or "")

    def take(found: re.Match) -> str:
        rings.append(np.array(found[0][1:-1].replace(",", " ").split(), dtype=np.float64).reshape(-1, n)[:, :2])
        return "R"

    skeleton = _RING[n].sub(take, body)
    multi = m[1].upper() == "MULTIPOLYGON"
    if not (_MANY if multi else _ONE).match(skeleton):
        return None
    if any(len(r) < 4 or (r[0] != r[-1]).any() or not np.isfinite(r).all() for r in rings):
        return None
    it = iter(rings)
    parts = _PART.findall(skeleton) if multi else [skeleton]
    return [[next(it) for _ in range(part.count("R"))] for part in parts]


def box(text: str | None) -> tuple[float, float, float, float] | None:
    """Bounding box of readable, non-empty text."""
    found = polygons(text)
    return extent(found) if found else None


def extent(found: list[list[np.ndarray]]) -> tuple[float, float, float, float]:
    """Bounding box of polygons, at least one."""
    points = np.concatenate([p[0] for p in found])
    (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
    return float(x0), float(y0), float(x1), float(y1)


def edges(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 4) array of the segments of all rings."""
    return np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])


def contains(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Points in or on the border of a polygon, by even-odd crossings over all its rings."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    inside, border = np.zeros(x.shape, dtype=bool), np.zeros(x.shape, dtype=bool)
    for x1, y1, x2, y2 in edges(rings):
        side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        border |= (side == 0) & (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
        inside ^= ((y1 > y) != (y2 > y)) & ((side > 0) == (y2 > y1))
    return inside | border


def area(rings: list[np.ndarray]) -> float:
    """Area of a polygon, holes taken off."""
    parts = [abs(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())) / 2 for r in rings]
    return parts[0] - sum(parts[1:])


def segments_cross(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any segment of ``a`` meets any of ``b``; touching counts."""
    p, q = a[:, None, :], b[None, :, :]

    def side(ax, ay, bx, by, cx, cy):
        return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    d1 = side(p[..., 0], p[..., 1], p[..., 2], p[..., 3], q[..., 0], q[..., 1])
    d2 = side(p[..., 0], p[..., 1], p[..., 2], p[..., 3], q[..., 2], q[..., 3])
    d3 = side(q[..., 0], q[..., 1], q[..., 2], q[..., 3], p[..., 0], p[..., 1])
    d4 = side(q[..., 0], q[..., 1], q[..., 2], q[..., 3], p[..., 2], p[..., 3])
    overlap = (
        (np.minimum(p[..., 0], p[..., 2]) <= np.maximum(q[..., 0], q[..., 2]))
        & (np.maximum(p[..., 0], p[..., 2]) >= np.minimum(q[..., 0], q[..., 2]))
        & (np.minimum(p[..., 1], p[..., 3]) <= np.maximum(q[..., 1], q[..., 3]))
        & (np.maximum(p[..., 1], p[..., 3]) >= np.minimum(q[..., 1], q[..., 3]))
    )
    return bool((overlap & (d1 * d2 <= 0) & (d3 * d4 <= 0)).any())


def intersects(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> bool:
    """Whether two sets of polygons share a point; touching counts."""
    for p in a:
        low, high = p[0].min(axis=0), p[0].max(axis=0)
        for q in b:
            if (q[0].max(axis=0) < low).any() or (q[0].min(axis=0) > high).any():
                continue
            if segments_cross(edges(p), edges(q)):
                return True
            if contains(q, p[0][:1, 0], p[0][:1, 1])[0] or contains(p, q[0][:1, 0], q[0][:1, 1])[0]:
                return True
    return False
