"""Polygons as triangles, by ear clipping.

Cutting the corner a, b, c off a ring leaves a ring with the side a-c in place
of a-b and b-c, and the triangle holds all three. A side that two pieces share
is computed from the very same numbers in both, so it cancels in the parity of
the pieces: whatever corners are cut, and in whatever order, an odd number of
triangles holds a point exactly if the ring does, by the even-odd rule. Ears
make the triangles of a ring that doesn't cross itself free of overlaps; where
crossings leave no ear, what is left of the ring is halved again and again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Point = tuple[float, float]
#: Triangle and, for its sides from the 1st to the 2nd corner and so on, whether each is a side of the ring.
Tile = tuple[tuple[Point, Point, Point], tuple[bool, bool, bool]]


#: So many times as it has corners a ring's corners may be tried in vain before the rest is halved.
PATIENCE = 12


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _clean(ring: list[Point]) -> list[Point]:
    """Without the closing vertex and without repeats, counter-clockwise."""
    pts = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    doubled = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))
    return pts if doubled >= 0 else pts[::-1]


class _Reflex:
    """The reflex corners of a ring in square cells, about one to a cell."""

    def __init__(self, pts: list[Point]):
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        self.x0, self.y0 = min(xs), min(ys)
        side = max(1, math.isqrt(len(pts)))
        self.sx, self.sy = ((max(v) - min(v)) / side or 1.0 for v in (xs, ys))
        self.cells: dict[tuple[int, int], set[int]] = {}
        self.pts, self.all = pts, set()

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return int((x - self.x0) / self.sx), int((y - self.y0) / self.sy)

    def put(self, i: int, reflex: bool) -> None:
        if reflex != (i in self.all):
            held = self.cells.setdefault(self._cell(*self.pts[i]), set())
            (held.add if reflex else held.discard)(i)
            (self.all.add if reflex else self.all.discard)(i)

    def inside(self, a: Point, b: Point, c: Point) -> bool:
        """Whether a reflex corner other than these lies in the triangle, its sides included."""
        x0, x1, y0, y1 = min(a[0], b[0], c[0]), max(a[0], b[0], c[0]), min(a[1], b[1], c[1]), max(a[1], b[1], c[1])
        (i0, j0), (i1, j1) = self._cell(x0, y0), self._cell(x1, y1)
        if (i1 - i0 + 1) * (j1 - j0 + 1) > len(self.all):
            groups = (self.all,)
        else:
            groups = (self.cells.get((i, j), ()) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1))
        for held in groups:
            for k in held:
                p = self.pts[k]
                if x0 <= p[0] <= x1 and y0 <= p[1] <= y1 and _turn(a, b, p) >= 0 and _turn(b, c, p) >= 0 and _turn(c, a, p) >= 0 and p != a and p != b and p != c:
                    return True
        return False


def clip_ears(ring: list[Point]) -> list[Tile]:
    """Triangles of which an odd number holds a point exactly if the ring does; a simple ring's don't overlap.

    The ring is a linked list, and reflex corners lie in a grid, so an ear's
    test looks at its own surroundings. The search goes round by round: of one
    round's corners every one that is an ear is cut, and its neighbours and the
    corners that were none come again in the next, so triangles stay short.
    """
    pts = _clean(ring)
    n = len(pts)
    if n < 3:
        return []
    before, after, own = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)], [True] * n  # own: the side to the next corner
    turn = lambda i: _turn(pts[before[i]], pts[i], pts[after[i]])
    reflex = _Reflex(pts)
    for i in range(n):
        reflex.put(i, turn(i) < 0)
    out: list[Tile] = []

    def cut(i: int) -> int:
        p, q = before[i], after[i]
        out.append(((pts[p], pts[i], pts[q]), (own[p], own[i], False)))
        after[p], before[q], own[p] = q, p, False
        reflex.put(i, False)
        for k in (p, q):
            reflex.put(k, turn(k) < 0)
        return q

    def is_ear(i: int) -> bool:
        t = turn(i)
        return t == 0 or (t > 0 and not reflex.inside(pts[before[i]], pts[i], pts[after[i]]))

    left, patience, gone = n, PATIENCE * n, [False] * n
    tried, later = list(range(n)), []
    while left > 3 and patience and tried:
        found = False
        for i in tried:
            if left == 3 or not patience:
                break
            if gone[i] or i in reflex.all:
                continue
            if is_ear(i):
                p, q = before[i], cut(i)
                gone[i], found, left = True, True, left - 1
                later += [q, p]
            else:
                patience -= 1
                later.append(i)
        tried, later = (list(dict.fromkeys(later)), []) if found else ([], [])
    at = next(i for i in range(n) if not gone[i])
    rest = [at]
    while after[rest[-1]] != at:
        rest.append(after[rest[-1]])
    sides = {(i, after[i]): own[i] for i in rest}
    chains = [(0, len(rest) - 1)]
    while chains:
        i, k = chains.pop()
        if k - i > 1:
            j = (i + k) // 2
            t = rest[i], rest[j], rest[k]
            out.append(((pts[t[0]], pts[t[1]], pts[t[2]]), (sides.get(t[:2], False), sides.get(t[1:], False), sides.get((t[2], t[0]), False))))
            chains += [(i, j), (j, k)]
    return out


#: Boxes are larger than their triangles by this share of their coordinates, more than the rounding of any test.
SLACK = 1e-12
_SIDES = ", ".join(f"{v}{i} {k}" for i in range(3) for v, k in (("px", "double"), ("py", "double"), ("qx", "double"), ("qy", "double"), ("outer", "boolean")))
SCHEMA = f"region_id long, minx double, miny double, maxx double, maxy double, {_SIDES}"


def triangles(regions: DataFrame, region_id: str, rings: str) -> DataFrame:
    """One row per triangle, with its box and its three sides, each from its lower to its higher end.

    Null regions and empty rings give nothing. Rings and regions may be of any shape.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def rows(rid: int, shape: list) -> Iterator[list]:
        for ring in shape:
            for t, outer in clip_ears([(p["x"], p["y"]) for p in ring or () if p and p["x"] is not None and p["y"] is not None]):
                xs, ys = [p[0] for p in t], [p[1] for p in t]
                row = [rid, *(v - SLACK * abs(v) for v in (min(xs), min(ys))), *(v + SLACK * abs(v) for v in (max(xs), max(ys)))]
                for p, q, o in zip(t, (*t[1:], t[0]), outer):
                    lower = (p[1], p[0]) < (q[1], q[0])
                    row += [*(p if lower else q), *(q if lower else p), o]
                yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] + [pa.bool_() if x.startswith("outer") else pa.float64() for x in names[1:]]
        for b in batches:
            found = [r for rid, shape in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rows(rid, shape)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=names)

    source = regions.select(F.col(f"`{region_id}`").cast("long").alias("region_id"), F.col(f"`{rings}`").alias("rings"))
    return source.filter("region_id is not null and rings is not null").mapInArrow(run, SCHEMA)


def sides_met(x: Column, y: Column) -> tuple[Column, Column]:
    """How many sides of a triangle's row lie to the right of a point, and whether the point is on a side of the ring.

    A side reaches from its lower end, included, to its higher one, excluded, so
    a corner counts once. Shared sides give the same answer in both triangles.
    """
    right, on = F.lit(0), F.lit(False)
    for i in range(3):
        px, py, qx, qy = (F.col(f"{name}{i}") for name in ("px", "py", "qx", "qy"))
        left_of = (qx - px) * (y - py) - (qy - py) * (x - px)
        right = right + F.when((py <= y) & (y < qy) & (left_of > 0), 1).otherwise(0)
        on = on | (F.col(f"outer{i}") & (left_of == 0) & x.between(F.least(px, qx), F.greatest(px, qx)) & y.between(py, qy))
    return right, on
