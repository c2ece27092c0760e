"""Snapping to the nearest place, and the region of a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landreach.operators import boxes, nearby


def nearest(points: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """``key, target, distance``: for each point the nearest target in the plane (both have x, y); of equal ones the least.

    Targets are packed into a bounding-volume hierarchy. A point meets the
    leaves that may hold its nearest target, and no others, however far it lies
    from all of them. Points or targets without a place are left out; without
    targets there is no row.
    """
    placed = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    here = points.filter(placed).select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    there = targets.filter(placed).select(F.col(target), *[F.col(v).cast("double").alias(n) for v, n in (("x", "minx"), ("y", "miny"), ("x", "maxx"), ("y", "maxy"))])
    packed, tree = boxes.pack(there)
    met = boxes.walk(here, tree, "x", "y", near=True).join(packed.select("leaf", target, F.col("minx").alias("tx"), F.col("miny").alias("ty")), "leaf")
    d = F.sqrt((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")))
    best = met.groupBy(key, "x", "y").agg(F.min(F.struct(d.alias("distance"), F.col(target))).alias("b"))
    return best.select(key, f"b.{target}", "b.distance")


def with_region(points: DataFrame, key: str, x: str, y: str, regions: DataFrame, region_key: str, rings: str, name: str) -> DataFrame:
    """The points with the ``name`` of the region they lie in: one row per region where regions overlap, null where there is none."""
    found = nearby.containing_regions(points, key, x, y, regions, region_key, rings).withColumnRenamed("region_id", region_key)
    named = found.join(regions.select(F.col(region_key).cast("long").alias(region_key), name), region_key).select(F.col("point_id").alias(key), region_key, name)
    return points.join(named, key, "left")
