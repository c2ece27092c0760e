"""All steps over files, on a little country of two districts, a road and a track."""

import json
import math
import struct

import pytest
from pyspark.sql import Row

from landreach.operators.raster import Grid
from landreach.plans import steps
from landreach.sources import formats


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("world")
    formats.register(spark)
    box = lambda x0, x1: [[x0, -18.5], [x1, -18.5], [x1, -17.5], [x0, -17.5], [x0, -18.5]]
    features = [{"type": "Feature", "properties": {"shapeName": n}, "geometry": {"type": "Polygon", "coordinates": [box(a, b)]}} for n, a, b in (("Kariba", 32.0, 33.0), ("Binga Urban", 33.0, 34.0))]
    (d / "districts.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (d / "census.csv").write_text("province,district,total\nP,Kariba Rural District,300\nP,Binga District,100\nP,Kariba Urban,7\n")
    rows = [(32.5, -18.0, 9), (32.5, -18.0, 30), (33.5, -18.0, 50), (35.5, -18.0, 0), (34.5, -18.0, 4)]
    (d / "pop.csv").write_text("X,Y,Z\n" + "".join(f"{x},{y},{z}\n" for x, y, z in rows))
    (d / "fac.csv").write_text("ID1,Province,NAMEOFFACI,OWNERSHIP,COMMENTS,LONGITUDE,LATITUDE\n,#adm1,#loc,,,,\n1,P,Good Clinic,2,,32.5,-18.0\n2,P,Police Post,2,,32.5,-18.0\n3,P,Lost Clinic,2,,abc,-18.0\n4,P,Own Clinic,7,,32.5,-18.0\n")
    line = lambda *p: [[[Row(x=float(x), y=float(y)) for x, y in p]]]
    make = lambda p: spark.createDataFrame([("LineString", p)], formats.SHAPE)
    formats.write_layers({next(iter(steps.MAJOR)): make(line((32.5, -18.0), (32.6, -18.0), (32.7, -18.0)))}, str(d / "major.gpkg"), 4326)
    formats.write_layers({"t": make(line((32.7, -18.0), (33.6, -18.0)))}, str(d / "tertiary.gpkg"), 4326)
    formats.write_layers({"u": make(line((33.6, -18.0), (34.6, -18.0)))}, str(d / "unclassified.gpkg"), 4326)
    shape = struct.pack("<i4d2ii", 3, 0, 0, 0, 0, 1, 2, 0) + struct.pack("<4d", 30.0, -19.0, 30.1, -19.0)
    (d / "wfp.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(shape) // 2) + shape)
    (d / "wfp.shx").write_bytes(b"\0" * 100 + struct.pack(">2i", 50, len(shape) // 2))
    head = struct.pack("<4BIHH", 3, 0, 0, 0, 1, 65, 9) + b"\0" * 20 + b"F_CODE_DES\0C" + b"\0" * 4 + bytes([8, 0]) + b"\0" * 14 + b"\r"
    (d / "wfp.dbf").write_bytes(head + b" Trail   ")
    grid = Grid(32.0, -17.0, 0.1, -0.1, 30, 20)
    deep = spark.createDataFrame([(10, 11, 2.0), (9, 11, 2.0)], "row int, col int, value double")  # at 33.15, the middle of the tertiary road
    formats.write_tiff(deep, grid, str(d / "flood.tif"), nodata=-1.0)
    return d


def test_all_steps(spark, world):
    d = lambda n: str(world / n)
    summary = steps.prepare_population(spark, d("pop.csv"), d("districts.json"), d("census.csv"), d("cal.tif"), d("summary"), cell_size_deg=1.0)
    assert {r.district: (r.worldpop_2020_modeled, r.census_2022, r.calibration_factor, r.n_worldpop_cells) for r in summary.collect()} == {"Kariba": (30.0, 300.0, 10.0, 1), "Binga Urban": (50.0, 100.0, 2.0, 1)}
    done = steps.filter_facilities(spark, d("fac.csv"), d("fac.gpkg"), d("all"), d("excluded"))
    assert sorted(r.NAMEOFFACI for r in done.filter("included").collect()) == ["Good Clinic"] and formats.read_csv(spark, d("excluded")).count() == 3
    points = steps.build_points(spark, d("cal.tif"), d("districts.json"), d("points"))
    got = sorted((r.district or "", round(r.population)) for r in points.collect())
    assert got == [("", 4), ("Binga Urban", 100), ("Kariba", 300)]
    roads = steps.build_roads(spark, d("major.gpkg"), d("tertiary.gpkg"), d("unclassified.gpkg"), d("wfp.shp"), d("roads"))
    assert sorted(r.source for r in roads.collect()) == ["osm_tertiary", "osm_trunk", "osm_unclassified", "zwe_roads_Trail"]
    assert steps.build_graph(spark, d("roads"), d("graph")).count() == 5
    base = steps.baseline(spark, d("graph"), d("points"), d("fac.gpkg"), d("base"))
    assert {r.drive_nearest_facility for r in base.collect()} == {"Good Clinic"}
    after = steps.flood(spark, d("graph"), d("flood.tif"), d("points"), d("fac.gpkg"), d("base"), d("after"), d("roads.gpkg"))
    cut = {r.district: r.newly_cutoff_drive for r in after.collect()}
    assert cut == {"Kariba": False, "Binga Urban": True, None: True}
    assert all(math.isinf(r.drive_flood_time_min) for r in after.filter("newly_cutoff_drive").collect())
    status = steps.combined_status(spark, d("after"), d("status"))
    assert status.filter("drive_combined_status = 'Newly cut off by flood'").count() == 2
    cases = steps.case_studies(spark, d("graph"), d("after"), d("points"), d("fac.gpkg"), d("cases.gpkg"), "Binga Urban|Nowhere")
    assert {(r["mode"], r["case"], r.n_flooded_segments_on_route) for r in cases.collect()} == {("drive", "Binga Urban", 1), ("walk", "Binga Urban", 1)}
    assert formats.layers(d("cases.gpkg")) == ["case_study_routes", "case_study_flood_cuts", "case_study_routes_walk", "case_study_flood_cuts_walk"]
    steps.main(["combined-status", "--flood", d("after"), "--out", d("again")])
    assert spark.read.parquet(d("again")).count() == status.count()
