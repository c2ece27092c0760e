"""Bounding-volume hierarchies that hand points and boxes to the same leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from landreach.session import Scratch

#: At most so many leaves are made (their boxes, 32 bytes each, go to every task), of about so many boxes each if that suffices.
MOST_LEAVES, PER_LEAF = 65_536, 16


@dataclass
class Tree:
    """A binary hierarchy over leaves 0..n-1; node 1 is the root, 2i and 2i+1 are the children of i."""

    boxes: np.ndarray  # (2 * size, 4): minx, miny, maxx, maxy; empty nodes are inside out
    size: int

    @classmethod
    def over(cls, leaves: np.ndarray) -> Tree:
        size = 1 << max(0, math.ceil(math.log2(max(1, len(leaves)))))
        boxes = np.tile([np.inf, np.inf, -np.inf, -np.inf], (2 * size, 1))
        boxes[size : size + len(leaves)] = leaves
        for i in range(size - 1, 0, -1):
            l, r = boxes[2 * i], boxes[2 * i + 1]
            boxes[i] = [min(l[0], r[0]), min(l[1], r[1]), max(l[2], r[2]), max(l[3], r[3])]
        return cls(boxes, size)

    def find(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of point and leaf whose box holds the point; the walk goes down one level at a time."""
        at, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        while len(at):
            b = self.boxes[node]
            hit = (x[at] >= b[:, 0]) & (y[at] >= b[:, 1]) & (x[at] <= b[:, 2]) & (y[at] <= b[:, 3])
            at, node = at[hit], node[hit]
            if not len(node) or node[0] >= self.size:
                break
            at, node = np.repeat(at, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
        return at, node - self.size

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of point and leaf that may hold what is nearest to the point.

        Boxes are tight, so each has something on every side; the greatest
        distance at which that can be bounds the nearest from above, and a box
        that begins beyond the bound is left, with all below it.
        """
        at, node, bound = np.arange(len(x)), np.ones(len(x), dtype=np.int64), np.full(len(x), np.inf)
        while len(at):
            x0, y0, x1, y1 = self.boxes[node].T
            px, py = x[at], y[at]
            with np.errstate(invalid="ignore"):
                least = np.hypot(np.maximum(np.maximum(x0 - px, px - x1), 0), np.maximum(np.maximum(y0 - py, py - y1), 0))
                left, low = px <= (x0 + x1) / 2, py <= (y0 + y1) / 2
                nx, fx, ny, fy = np.where(left, x0, x1), np.where(left, x1, x0), np.where(low, y0, y1), np.where(low, y1, y0)
                most = np.minimum(np.hypot(px - nx, py - fy), np.hypot(px - fx, py - ny))
            least, most = np.where(x0 > x1, np.inf, least), np.where(x0 > x1, np.inf, most)
            np.minimum.at(bound, at, most)
            keep = (least <= bound[at] * (1 + 1e-12)) & np.isfinite(least)
            at, node = at[keep], node[keep]
            if not len(node) or node[0] >= self.size:
                break
            at, node = np.repeat(at, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
        return at, node - self.size


def pack(boxes: DataFrame) -> tuple[DataFrame, Tree]:
    """Boxes (minx, miny, maxx, maxy) with their ``leaf``, and the tree over the leaves.

    Leaves are packed by slabs of equal counts in x and, within a slab, of equal
    counts in y (both from quantile sketches), so far outliers cost nothing.
    What reaches the driver is the slabs' bounds and the leaves' boxes, at most
    MOST_LEAVES of each, whatever the number of boxes. The boxes are made once
    and kept in the shared folder.
    """
    boxes = Scratch(boxes.sparkSession, "boxes").save(boxes)
    mid = boxes.withColumn("mx", (F.col("minx") + F.col("maxx")) / 2).withColumn("my", (F.col("miny") + F.col("maxy")) / 2)
    n = boxes.count()
    side = max(1, math.ceil(math.sqrt(min(MOST_LEAVES, n / PER_LEAF))))
    cuts = [k / side for k in range(1, side)]
    schema = T.StructType([*mid.schema.fields, T.StructField("slab", T.IntegerType())])
    xs = np.array((mid.agg(F.percentile_approx("mx", cuts, 10 * side).alias("q")).first()["q"] or []) if cuts else [], dtype=float)
    slabbed = mid.mapInArrow(_place("slab", lambda b: np.searchsorted(xs, _floats(b, "mx"), side="right")), schema)
    ys = np.full((side, max(0, side - 1)), np.inf)
    if cuts:
        for row in slabbed.groupBy("slab").agg(F.percentile_approx("my", cuts, 10 * side).alias("q")).collect():  # one row a slab
            ys[row["slab"]] = row["q"]

    def leaf(batch: pa.RecordBatch) -> np.ndarray:
        slab, my = batch.column("slab").to_numpy(zero_copy_only=False), _floats(batch, "my")
        step = np.zeros(len(my), dtype=np.int64)
        for s in np.unique(slab):
            step[slab == s] = np.searchsorted(ys[s], my[slab == s], side="right")
        return slab * side + np.where(slab % 2, side - 1 - step, step)  # back and forth, so that neighbours in number are neighbours in space

    placed = slabbed.mapInArrow(_place("leaf", leaf), T.StructType([*schema.fields, T.StructField("leaf", T.IntegerType())])).drop("mx", "my", "slab")
    leaves = np.tile([np.inf, np.inf, -np.inf, -np.inf], (side * side, 1))
    for r in placed.groupBy("leaf").agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).collect():  # at most MOST_LEAVES rows
        leaves[r[0]] = r[1:]
    return placed, Tree.over(leaves)


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def _place(name: str, of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(b).astype("i4"), pa.int32())], names=[*b.schema.names, name])

    return run


def walk(points: DataFrame, tree: Tree, x: str, y: str, near: bool = False) -> DataFrame:
    """A row for each point and each leaf whose box holds it (or may hold what is nearest to it), with ``leaf`` added."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, leaf = (shared.value.near if near else shared.value.find)(_floats(b, x), _floats(b, y))
            some = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(leaf.astype("i4"), pa.int32())], names=[*b.schema.names, "leaf"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("leaf", T.IntegerType())]))
