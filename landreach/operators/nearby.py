"""Points near other points, and the regions that contain them.

Regions are cut into triangles, and triangles (or the boxes around the places
searched for) are packed into a bounding-volume hierarchy. Points walk down the
hierarchy and meet the boxes of the leaves they reach by an equi-join on the
leaf, where each candidate is tested exactly. The join's strategy is left to
Spark, which broadcasts a side only under its size threshold and splits a leaf
that holds too many points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landreach.operators import boxes, triangles


def _points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    c = lambda name: F.col(f"`{name}`")
    out = df.select(c(key).alias("point_id"), c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    return out.filter("point_id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")


def within_distance(points: DataFrame, key: str, x: str, y: str, others: DataFrame, other_key: str, ox: str, oy: str, radius: float) -> DataFrame:
    """Distinct ``point_id, other_id, distance`` of all pairs at most ``radius`` apart in the plane.

    Rows with a null key, or a null or NaN coordinate, pair with nothing. Repeated
    rows count once. Either table empty: no rows. Other columns are ignored.
    """
    here = _points(points, key, x, y)
    there = _points(others, other_key, ox, oy).select(F.col("point_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy")).distinct()
    reach = radius * (1 + 1e-12)
    there = there.withColumns({"minx": F.col("ox") - reach, "miny": F.col("oy") - reach, "maxx": F.col("ox") + reach, "maxy": F.col("oy") + reach})
    packed, tree = boxes.pack(there)
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    met = boxes.walk(here, tree, "x", "y").join(packed.select("leaf", "other_id", "ox", "oy"), "leaf").filter(dx * dx + dy * dy <= radius * radius)
    return met.select("point_id", "other_id", F.sqrt(dx * dx + dy * dy).alias("distance")).distinct()


def containing_regions(points: DataFrame, key: str, x: str, y: str, regions: DataFrame, region_key: str, rings: str) -> DataFrame:
    """Distinct ``point_id, region_id`` of all points and regions that contain them, by the even-odd rule over all rings.

    Coordinates of points and rings must be of one frame. A point on any
    outline, of a part or of a hole, is not within the region. Regions may
    overlap: one row each; so may the parts of a region, and rings may cross
    themselves. Rows with a null key, place or shape give nothing.
    """
    here = _points(points, key, x, y).distinct()
    packed, tree = boxes.pack(triangles.triangles(regions, region_key, rings))
    right, on = triangles.sides_met(F.col("x"), F.col("y"))
    met = boxes.walk(here, tree, "x", "y").join(packed, "leaf").select("point_id", "x", "y", "region_id", (right % 2).alias("odd"), on.alias("on_line")).filter("odd = 1 or on_line")
    held = met.groupBy("point_id", "x", "y", "region_id").agg((F.sum("odd") % 2 == 1).alias("inside"), F.bool_or("on_line").alias("on_line"))
    return held.filter("inside and not on_line").select("point_id", "region_id").distinct()
