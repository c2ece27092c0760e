"""People by travel-time class over a stream of delivered results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landreach.functions import classify as c


def people_by_class(results: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """``window, drive_class, points, people`` by the time of loading, with rows later than ``late`` left out.

    ``results`` is a stream (or a table) with loaded_at, run_id, point_id,
    population and drive_flood_time_min. A row delivered again with the same
    run, point and time counts once. Null and NaN populations add no people.
    """
    once = results.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late).dropDuplicates(["run_id", "point_id", "loaded_at"])
    classed = once.withColumn("drive_class", c.time_class(F.col("drive_flood_time_min")))
    people = F.when(~F.isnan("population"), F.col("population"))
    return classed.groupBy(F.window("loaded_at", window), "drive_class").agg(F.count("*").alias("points"), F.coalesce(F.sum(people), F.lit(0.0)).alias("people"))
