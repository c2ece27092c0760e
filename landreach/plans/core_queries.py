"""Queries on points near other points or regions (p2) and on rows that fail to parse (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landreach.functions.crs import utm_forward, utm_inverse
from landreach.operators import badrows, nearby
from landreach.session import load

NEAR_M = 1500.0
#: The list of provinces becomes part of a pattern; a longer list is refused.
MOST_WORDS = 10_000


def _near(spark: SparkSession, d: str) -> DataFrame:
    points, facilities = load(spark, d, "population_points"), load(spark, d, "facilities")
    placed = facilities.select("facility_id", *[c.alias(n) for c, n in zip(utm_forward(F.col("LONGITUDE"), F.col("LATITUDE")), ("fx", "fy"))])
    return nearby.within_distance(points, "point_id", "x", "y", placed, "facility_id", "fx", "fy", NEAR_M)


def _within(spark: SparkSession, d: str) -> DataFrame:
    points = load(spark, d, "population_points").filter("district is null and x is not null and y is not null")
    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    placed = points.select("point_id", lon.alias("lon"), lat.alias("lat"))
    return nearby.containing_regions(placed, "point_id", "lon", "lat", load(spark, d, "districts"), "district_ord", "rings")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Facilities within 1 500 m of a point, and regions that contain a point without a district."""
    near = _near(spark, d).select(F.lit("near").alias("kind"), "point_id", "other_id")
    within = _within(spark, d).select(F.lit("within").alias("kind"), "point_id", F.col("region_id").alias("other_id"))
    return near.unionByName(within)


def record_fields(spark: SparkSession, d: str) -> list[badrows.Field]:
    """The columns of a facility record; its provinces are those of district_reference."""
    found = load(spark, d, "district_reference").select("province").filter("province is not null").distinct().limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} provinces")
    return [
        badrows.Field("ID1"),
        badrows.Field("Province", "word", words=tuple(r["province"].strip() for r in found)),
        badrows.Field("NAMEOFFACI"),
        badrows.Field("TYPEOFFACI"),
        badrows.Field("OWNERSHIP"),
        badrows.Field("LONGITUDE", "number", -180.0, 180.0),
        badrows.Field("LATITUDE", "number", -90.0, 90.0),
        badrows.Field("COMMENTS"),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The failing lines of facility_lines with their reason."""
    lines = load(spark, d, "facility_lines").filter("line_no > 2")
    return badrows.split_rows(lines, "line", record_fields(spark, d), ["line_id"])[1].select("line_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of facility_lines as records."""
    lines = load(spark, d, "facility_lines").filter("line_no > 2")
    out = badrows.split_rows(lines, "line", record_fields(spark, d), ["line_id"])[0]
    return out.select("line_id", F.lower("Province").alias("province"), "LONGITUDE", "LATITUDE")


def p5_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    """How many lines fail for each reason and first broken field."""
    lines = load(spark, d, "facility_lines").filter("line_no > 2")
    bad = badrows.split_rows(lines, "line", record_fields(spark, d), ["line_id"])[1]
    return bad.groupBy("reason", "broken_field").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p5_found, p5_loaded, p5_broken_fields)}


_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_SP = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"


def _sql_value(k: int) -> str:
    fields = ",".join(f"({_FIELD})" if i == k else _FIELD for i in range(8))
    raw = f"regexp_extract(line, '^{fields}$', 1)"
    bare = f"CASE WHEN {raw} LIKE '\"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"
    return f"regexp_replace({bare}, '^{_SP}|{_SP}$', '', 'g')"


_PARSED = f"""
WITH fields AS (
  SELECT line_id, line IS NOT NULL AND regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS shaped,
         line IS NOT NULL AND regexp_full_match(line, '{_FIELD}(?:,{_FIELD}){{7}}') AS counted, line IS NULL AS missing,
         lower({_sql_value(1)}) AS province, {_sql_value(5)} AS lon, {_sql_value(6)} AS lat
  FROM facility_lines WHERE line_no > 2),
numbers AS (
  SELECT *, CASE WHEN regexp_full_match(lon, '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?') THEN TRY_CAST(lon AS DOUBLE) END AS x,
            CASE WHEN regexp_full_match(lat, '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?') THEN TRY_CAST(lat AS DOUBLE) END AS y
  FROM fields),
judged AS (
  SELECT *, CASE WHEN missing THEN 'column_count' WHEN NOT shaped THEN 'quoting' WHEN NOT counted THEN 'column_count'
                 WHEN province IN (SELECT lower(trim(province)) FROM district_reference WHERE province IS NOT NULL) AND x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 THEN NULL
                 ELSE 'invalid_value' END AS reason
  FROM numbers)
"""
_COLUMNS = ["ID1", "Province", "NAMEOFFACI", "TYPEOFFACI", "OWNERSHIP", "LONGITUDE", "LATITUDE", "COMMENTS"]
_FIRST_SHAPE = " ".join(f"WHEN NOT regexp_matches(line, '^{_FIELD}(?:,{_FIELD}){{{k}}}(?:,|$)') THEN '{name}'" for k, name in enumerate(_COLUMNS))


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _PARSED + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "p5_broken_fields": _PARSED + f"""SELECT reason, CASE WHEN missing THEN NULL WHEN reason <> 'invalid_value' THEN CASE {_FIRST_SHAPE} END
    WHEN NOT coalesce(province IN (SELECT lower(trim(province)) FROM district_reference WHERE province IS NOT NULL), FALSE) THEN 'Province'
    WHEN NOT coalesce(x BETWEEN -180 AND 180, FALSE) THEN 'LONGITUDE' ELSE 'LATITUDE' END AS broken_field, count(*) AS n
  FROM judged JOIN facility_lines USING (line_id) WHERE reason IS NOT NULL GROUP BY 1, 2""",
        "p5_loaded": _PARSED + 'SELECT line_id, province, x AS "LONGITUDE", y AS "LATITUDE" FROM judged WHERE reason IS NULL',
    }
