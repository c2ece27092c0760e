"""Queries that write the driver's tables in each format and read them again."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from landreach.functions.crs import utm_forward
from landreach.operators import raster
from landreach.plans import geo_queries as g, geo_sql
from landreach.session import Scratch, load
from landreach.sources import formats


def _folder(spark: SparkSession) -> str:
    """A folder of the shared one; data sources of single files need it to be a path."""
    root = formats.local(Scratch(spark, "sources").root)
    Path(root).mkdir(parents=True, exist_ok=True)
    return root


def source_csv(spark: SparkSession, d: str) -> DataFrame:
    """The facilities through a CSV file with a header."""
    path = f"file://{_folder(spark)}/facilities.csv"
    formats.write_csv(load(spark, d, "facilities"), path)
    got = formats.read_csv(spark, path)
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c.lower())
    return got.select(F.col("facility_id").cast("long").alias("facility_id"), "NAMEOFFACI", number("LONGITUDE"), number("LATITUDE"), (F.col("included") == "true").alias("included"))


def source_gpkg(spark: SparkSession, d: str) -> DataFrame:
    """The placed facilities in metres through a layer of a GeoPackage, by the frame it declares."""
    path = f"{_folder(spark)}/facilities.gpkg"
    formats.register(spark)
    f = load(spark, d, "facilities").filter("LONGITUDE is not null and LATITUDE is not null")
    x, y = utm_forward(F.col("LONGITUDE"), F.col("LATITUDE"))
    shape = F.array(F.array(F.array(F.struct(x.alias("x"), y.alias("y")))))
    formats.write_layers({"facilities": f.select("facility_id", "NAMEOFFACI", "included", F.lit("Point").alias("geometry_type"), shape.alias("parts"))}, path)
    p = F.col("parts")[0][0][0]
    return formats.metres_of(spark, path).select("facility_id", "NAMEOFFACI", "included", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"))


def source_geotiff(spark: SparkSession, d: str) -> DataFrame:
    """The raster of people through a GeoTIFF of 32-bit numbers."""
    path = f"{_folder(spark)}/people.tif"
    formats.register(spark)
    cells, grid = g.cells(spark, d)
    formats.write_tiff(cells, grid, path)
    return spark.read.format("geotiff").load(path).select("row", "col", F.round("value", 4).alias("value"))


def source_xyz(spark: SparkSession, d: str) -> DataFrame:
    """The raster of people through a text table of X, Y and Z."""
    path = f"file://{_folder(spark)}/people.csv"
    cells, grid = g.cells(spark, d)
    formats.write_csv(raster.to_points(cells, grid).select(F.col("x").alias("X"), F.col("y").alias("Y"), F.col("value").alias("Z")), path)
    table = formats.read_csv(spark, path)
    got = raster.xyz(table.select(*[F.col(c).try_cast("double").alias(c) for c in table.columns]))
    return got.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("pop", 6).alias("pop"))


def source_geojson(spark: SparkSession, d: str) -> DataFrame:
    """The districts through a GeoJSON collection: the rings and vertices of each."""
    path = f"file://{_folder(spark)}/districts.json"
    pairs = F.transform("rings", lambda ring: F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("shapeName").alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates")).alias("geometry"))
    every = load(spark, d, "districts").agg(F.array_sort(F.collect_list(F.struct("district_ord", feature.alias("f")))).alias("all"))  # a fixed list of districts
    every.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("all.f").alias("features")))).write.mode("overwrite").text(path)
    got = formats.read_geojson(spark, path)
    flat = F.flatten("rings")
    total = lambda c: F.round(F.aggregate(flat, F.lit(0.0), lambda a, p: a + p[c]), 6)
    return got.select(F.col("ord").cast("int").alias("ord"), "shapeName", F.size("rings").cast("long").alias("n_rings"), F.size(flat).cast("long").alias("n_vertices"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def queries() -> dict:
    return {f.__name__: f for f in (source_csv, source_gpkg, source_geotiff, source_xyz, source_geojson)}


def oracle_sql() -> dict[str, str]:
    placed = 'f AS (SELECT * FROM facilities WHERE "LONGITUDE" IS NOT NULL AND "LATITUDE" IS NOT NULL)'
    return {
        "source_csv": 'SELECT facility_id, "NAMEOFFACI", round("LONGITUDE", 6) AS longitude, round("LATITUDE", 6) AS latitude, included FROM facilities',
        "source_gpkg": f"""WITH {placed}, {geo_sql._forward('m', 'f', 'facility_id, "NAMEOFFACI", included', '"LONGITUDE"', '"LATITUDE"')} SELECT facility_id, "NAMEOFFACI", included, round(x, 3) AS x, round(y, 3) AS y FROM m""",
        "source_geotiff": f"WITH {geo_sql._CELLS} SELECT row, col, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM cells WHERE CAST(value AS FLOAT) <> 0",
        "source_xyz": f"WITH {geo_sql._CELLS} SELECT round(lon, 6) AS x, round(lat, 6) AS y, round(value, 6) AS pop FROM centres",
        "source_geojson": """WITH n AS (SELECT *, row_number() OVER (ORDER BY district_ord) - 1 AS ord FROM districts), v AS (SELECT ord, unnest(flatten(rings)) AS p FROM n),
s AS (SELECT ord, count(*) AS n_vertices, round(sum(p.x), 6) AS sum_x, round(sum(p.y), 6) AS sum_y FROM v GROUP BY ord)
SELECT CAST(ord AS INT) AS ord, "shapeName", len(rings) AS n_rings, n_vertices, sum_x, sum_y FROM n JOIN s USING (ord)""",
    }
