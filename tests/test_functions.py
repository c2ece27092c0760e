import math

import pytest
from pyspark.sql import functions as F

from landreach.functions import classify as c, crs


def column(spark, kind, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("o")).collect()]


def test_time_classes(spark):
    got = column(spark, "double", [0.0, 29.999, 30.0, 59.999, 60.0, math.inf, math.nan, None], c.time_class)
    assert got == ["well-served"] * 2 + ["underserved"] * 2 + ["critical"] * 4


def test_severity(spark):
    assert column(spark, "double", [0.0, 0.299, 0.3, 0.999, 1.0, None, math.nan], c.severity) == ["light", "light", "moderate", "moderate", "severe", None, None]


def test_finite(spark):
    assert column(spark, "double", [1.0, math.inf, math.nan, None], c.finite) == [True, False, False, False]


def test_numbers(spark):
    assert column(spark, "string", ["1.5", " -2 ", "1e1", ".5", "abc", "1.0d", "0x1F", "", None], c.number) == [1.5, -2.0, 10.0, 0.5, None, None, None, None, None]


@pytest.mark.parametrize(
    ("row", "status"),
    [
        (("ZRP-Post", "2", None, 30.0, -18.0), "restricted"),
        (("zps clinic", "2", None, 30.0, -18.0), "restricted"),
        (("Policeman's Rest", "2", None, 30.0, -18.0), "included"),
        (("Clinic", "7", None, 30.0, -18.0), "private"),
        (("closed clinic", "7", None, 30.0, -18.0), "private"),
        (("Clinic", " Mine", None, 30.0, -18.0), "included"),
        (("Clinic", "zrp", None, 30.0, -18.0), "restricted"),
        (("Clinic", "42", None, 30.0, -18.0), "included"),
        (("Clinic", None, "Under Construction", 30.0, -18.0), "closed"),
        (("Clinic", None, None, None, -18.0), "nowhere"),
        (("Clinic", None, None, math.nan, -18.0), "nowhere"),
        ((None, None, None, 1.0, 1.0), "included"),
    ],
)
def test_place_status(spark, row, status):
    df = spark.createDataFrame([row], "n string, o string, k string, x double, y double")
    assert df.select(c.place_status(*[F.col(x) for x in df.columns])).first()[0] == status


def test_utm_check_points_and_round_trip(spark):
    pts = [(33.0, -18.0, 500000.0, 8009814.458), (31.05, -17.83, 293338.351, 8027545.329), (25.85, -17.93, -258823.467, 8002928.738), (28.58, -20.15, 37732.336, 7765768.779)]
    df = spark.createDataFrame(pts, "lon double, lat double, e double, n double")
    x, y = crs.utm_forward(F.col("lon"), F.col("lat"))
    for r in df.select("*", x.alias("x"), y.alias("y")).collect():
        assert (r.x, r.y) == (pytest.approx(r.e, abs=3e-3), pytest.approx(r.n, abs=3e-3))
    lon, lat = crs.utm_inverse(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.lon - r.a) < 1e-10 and abs(r.lat - r.b) < 1e-10
    none = spark.createDataFrame([(None, 1.0)], "lon double, lat double").select(*crs.utm_forward(F.col("lon"), F.col("lat"))).first()
    assert none[0] is None
