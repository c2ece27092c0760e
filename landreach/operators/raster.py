"""Rasters as tables of cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from landreach.operators import nearby
from landreach.session import Scratch


@dataclass(frozen=True)
class Grid:
    """The upper left corner, the size of a cell (dy is negative: row 0 lies north), and the extent."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.x0) + (col + 0.5) * self.dx, F.lit(self.y0) + (row + 0.5) * self.dy

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of a place, cut towards zero: a place up to one cell left of or above the raster falls on its edge."""
        return ((y - self.y0) / self.dy).cast("int"), ((x - self.x0) / self.dx).cast("int")


def xyz(df: DataFrame) -> DataFrame:
    """``x, y, pop`` from a table with columns x, y and z of any case; only positive values."""
    low = df.toDF(*[c.lower() for c in df.columns])
    return low.withColumnRenamed("z", "pop").select("x", "y", "pop").filter("pop > 0")


def to_cells(points: DataFrame, order: str, size: float) -> tuple[DataFrame, Grid]:
    """``row, col, value`` of x, y, pop, and the grid.

    A row or column is the rank of a coordinate among those that occur (columns
    from the west, rows from the north); of several values of a place the last
    in ``order`` stands. The distinct coordinates are ranked on their own, which
    are as few as the raster is wide or high, and joined back.
    """
    scratch = Scratch(points.sparkSession, "cells")
    last = scratch.save(points.groupBy("x", "y").agg(F.max_by("pop", order).alias("value")))
    xs, ys = _ranks(scratch, last, "x", "col", False), _ranks(scratch, last, "y", "row", True)
    cells = last.join(xs, "x").join(ys, "y").select("row", "col", "value")
    b = last.agg(F.min("x"), F.max("y")).first()
    if b[0] is None:
        return cells, Grid(0.0, 0.0, size, -size, 0, 0)
    return cells, Grid(b[0] - size / 2, b[1] + size / 2, size, -size, xs.count(), ys.count())


def _ranks(scratch: Scratch, df: DataFrame, axis: str, name: str, down: bool) -> DataFrame:
    """The distinct coordinates with their ranks, however many there are: sorted over the cluster, counted by partition, and numbered from their partition's offset."""
    order = F.col(axis).desc() if down else F.col(axis)
    part = scratch.save(df.select(axis).distinct().repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = part.groupBy("part").count()
    before = before.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return scratch.save(part.withColumn("own", own).join(F.broadcast(before), "part").select(axis, (F.col("before") + F.col("own")).cast("int").alias(name)))


def to_points(cells: DataFrame, grid: Grid) -> DataFrame:
    """``row, col, value, x, y`` of the cells above zero, at their centres."""
    x, y = grid.centre(F.col("row"), F.col("col"))
    return cells.filter("value > 0").select("row", "col", "value", x.alias("x"), y.alias("y"))


def cells_in_regions(grid: Grid, regions: DataFrame, region_key: str, rings: str) -> DataFrame:
    """``cell_id, region_id`` of every cell of the grid, stored or not, whose centre a region contains; the id is row * 2^31 + col.

    Cells are made from the rows and columns of each region's bounding box, cut
    to the grid. A region without a place, or beside the grid, has no row.
    """
    places = F.filter(F.flatten(F.filter(rings, lambda ring: ring.isNotNull())), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    box = regions.select(places.alias("p")).filter("size(p) > 0")
    at = lambda pick, axis, start, step: (pick(F.transform("p", lambda p: p[axis])) - start) / step - 0.5
    span = lambda low, high, n: (F.greatest(F.floor(low) - 1, F.lit(0)), F.least(F.ceil(high) + 1, F.lit(n - 1)))
    top, bottom = span(at(F.array_max, "y", grid.y0, grid.dy), at(F.array_min, "y", grid.y0, grid.dy), grid.height)
    left, right = span(at(F.array_min, "x", grid.x0, grid.dx), at(F.array_max, "x", grid.x0, grid.dx), grid.width)
    box = box.select(top.alias("top"), bottom.alias("bottom"), left.alias("left"), right.alias("right")).filter("top <= bottom and left <= right")
    rows = box.select("left", "right", F.explode(F.sequence("top", "bottom")).alias("row"))
    made = rows.select("row", F.explode(F.sequence("left", "right")).alias("col")).distinct()
    x, y = grid.centre(F.col("row"), F.col("col"))
    made = made.select((F.col("row") * F.lit(1 << 31) + F.col("col")).alias("cell_id"), x.alias("x"), y.alias("y"))
    return nearby.containing_regions(made, "cell_id", "x", "y", regions, region_key, rings).withColumnRenamed("point_id", "cell_id")


def sample(places: DataFrame, x: str, y: str, cells: DataFrame, grid: Grid, nodata: float | None = None, name: str = "depth") -> DataFrame:
    """The places with the value of the cell they fall in; null outside the raster, where no cell is stored, and for nodata."""
    row, col = grid.cell(F.col(x), F.col(y))
    inside = places.withColumns({"row": row, "col": col})
    kept = cells.select("row", "col", F.col("value").alias(name))
    if nodata is not None:
        kept = kept.filter(F.col(name) != nodata)
    kept = kept.filter((F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width))
    return inside.join(kept, ["row", "col"], "left").drop("row", "col")


def aggregate_to_grid(points: DataFrame, value: str, size: float, weighted: bool = False) -> DataFrame:
    """``gx, gy, population, n_source_cells, x, y`` by square cells; the place is the mean of the sources', weighted by value if asked for."""
    w = F.col(value)
    place = lambda v: F.try_divide(F.sum(F.col(v) * w), F.sum(w)) if weighted else F.avg(v)
    keyed = points.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    return keyed.groupBy("gx", "gy").agg(F.sum(w).alias("population"), F.count("*").alias("n_source_cells"), place("x").alias("x"), place("y").alias("y"))


def calibrate(cells: DataFrame, member: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells scaled so that each district's sum is its total; and the summary by district.

    ``cells``: cell_id, value. ``member``: cell_id, district_ord (a cell may lie
    in several; one that isn't in ``cells`` counts, with nothing in it). ``totals``: district_ord, group_id, census; districts of one
    group share one total and one factor. A cell of several districts takes the
    last one's factor; one without a factor keeps its value. Every district of
    ``totals`` has a row of the summary, with 0 where it has no member.
    """
    inside = member.join(cells, "cell_id", "left").groupBy("district_ord").agg(F.sum("value").alias("modeled"), F.count("*").alias("n_cells"))
    known = totals.join(inside, "district_ord", "left").fillna({"modeled": 0.0, "n_cells": 0})
    by = known.groupBy("group_id").agg(F.sum("modeled").alias("group_modeled"), F.min("census").alias("group_census"))
    factor = F.when(F.col("group_modeled") > 0, F.col("group_census") / F.col("group_modeled")).otherwise(F.lit(0.0))
    summary = known.join(by, "group_id").select("district_ord", "modeled", F.col("group_census").alias("census"), factor.alias("factor"), "n_cells", "group_modeled")
    last = member.join(summary.select("district_ord", "factor"), "district_ord").groupBy("cell_id").agg(F.max_by("factor", "district_ord").alias("factor"))
    scaled = cells.join(last, "cell_id", "left").withColumn("calibrated", F.col("value") * F.coalesce("factor", F.lit(1.0)))
    return scaled, summary
