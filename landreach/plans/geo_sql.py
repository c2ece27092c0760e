"""SQL that gives the same rows as the queries of the accessibility chain."""

from __future__ import annotations

from landreach.functions import classify as c, crs
from landreach.plans.core_queries import NEAR_M
from landreach.plans.geo_queries import CELL_M, RASTER_DEG


def _sum(coefficients, one: str, other: str, u: str, v: str) -> str:
    return " + ".join(f"({k!r}) * {one}({2 * j} * {u}) * {other}({2 * j} * {v})" for j, k in enumerate(coefficients, 1))


def _forward(name: str, source: str, keep: str, lon: str, lat: str) -> str:
    """CTEs that end in one called ``name``: the kept columns, x and y in metres."""
    return f"""
{name}_1 AS (SELECT {keep}, sin(radians({lat})) AS s_, radians({lon} - {crs.LON0}) AS dl_ FROM {source}),
{name}_2 AS (SELECT *, sinh(atanh(s_) - {crs.C!r} * atanh({crs.C!r} * s_)) AS t_ FROM {name}_1),
{name}_3 AS (SELECT *, atan2(t_, cos(dl_)) AS xi_, atanh(sin(dl_) / sqrt(1 + t_ * t_)) AS eta_ FROM {name}_2),
{name} AS (SELECT {keep}, {crs.FALSE_EAST} + {crs.K0 * crs.RADIUS!r} * (eta_ + {_sum(crs.ALPHA, 'cos', 'sinh', 'xi_', 'eta_')}) AS x,
  {crs.FALSE_NORTH} + {crs.K0 * crs.RADIUS!r} * (xi_ + {_sum(crs.ALPHA, 'sin', 'cosh', 'xi_', 'eta_')}) AS y FROM {name}_3)"""


def _inverse(name: str, source: str, keep: str, x: str, y: str) -> str:
    """CTEs that end in one called ``name``: the kept columns, lon and lat in degrees."""
    k = repr(crs.K0 * crs.RADIUS)
    lat = " + ".join(["chi_", *(f"({d!r}) * sin({2 * j} * chi_)" for j, d in enumerate(crs.DELTA, 1))])
    return f"""
{name}_1 AS (SELECT {keep}, ({y} - {crs.FALSE_NORTH}) / {k} AS xi_, ({x} - {crs.FALSE_EAST}) / {k} AS eta_ FROM {source}),
{name}_2 AS (SELECT *, xi_ - ({_sum(crs.BETA, 'sin', 'cosh', 'xi_', 'eta_')}) AS a_, eta_ - ({_sum(crs.BETA, 'cos', 'sinh', 'xi_', 'eta_')}) AS b_ FROM {name}_1),
{name}_3 AS (SELECT *, asin(sin(a_) / cosh(b_)) AS chi_ FROM {name}_2),
{name} AS (SELECT {keep}, {crs.LON0} + degrees(atan2(sinh(b_), cos(a_))) AS lon, degrees({lat}) AS lat FROM {name}_3)"""


_POINTS = "pts AS (SELECT DISTINCT * FROM population_points)"
_SIDES = """
shapes AS (SELECT district_ord, unnest(rings) AS ring FROM districts),
sides AS (SELECT district_ord, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2
          FROM (SELECT district_ord, ring, unnest(range(1, len(ring))) AS i FROM shapes))"""


def _inside(name: str, source: str, key: str) -> str:
    """Which regions hold the places (lon, lat) of a CTE: the number of sides that a ray to the east crosses is odd."""
    return f"""
{name} AS (SELECT p.{key}, s.district_ord FROM {source} p JOIN sides s ON (s.y1 > p.lat) <> (s.y2 > p.lat)
  AND p.lon < (s.x2 - s.x1) * (p.lat - s.y1) / (s.y2 - s.y1) + s.x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


_CELLS = f"""{_POINTS},
lit AS (SELECT * FROM pts WHERE x IS NOT NULL AND population > 0 AND NOT isnan(population)),
{_inverse('ll', 'lit', 'point_id, population', 'x', 'y')},
lattice AS (SELECT point_id, population, round(floor(lon / {RASTER_DEG!r}) * {RASTER_DEG!r} + {RASTER_DEG / 2!r}, 9) AS x, round(floor(lat / {RASTER_DEG!r}) * {RASTER_DEG!r} + {RASTER_DEG / 2!r}, 9) AS y FROM ll),
lastv AS (SELECT x, y, arg_max(population, point_id) AS value FROM lattice GROUP BY x, y),
cells AS (SELECT CAST(dense_rank() OVER (ORDER BY y DESC) - 1 AS INT) AS row, CAST(dense_rank() OVER (ORDER BY x) - 1 AS INT) AS col, value FROM lastv),
grid AS (SELECT min(x) - {RASTER_DEG / 2!r} AS x0, max(y) + {RASTER_DEG / 2!r} AS y0, count(DISTINCT x) AS w, count(DISTINCT y) AS h FROM lastv),
centres AS (SELECT CAST(row AS BIGINT) * 100000 + col AS cell_id, value, x0 + (col + 0.5) * {RASTER_DEG!r} AS lon, y0 + (row + 0.5) * {-RASTER_DEG!r} AS lat FROM cells, grid WHERE value > 0)"""

_EDGES = "e AS (SELECT DISTINCT * FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND length_m > 0)"
_SEVERITY = f"CASE WHEN flood_depth_m IS NULL OR isnan(flood_depth_m) THEN NULL WHEN flood_depth_m < {c.LIGHT_BELOW} THEN 'light' WHEN flood_depth_m < {c.SEVERE_FROM} THEN 'moderate' ELSE 'severe' END"
_WEIGHT = {
    ("drive", False): "minutes",
    ("walk", False): "walk_minutes",
    ("drive", True): f"CASE WHEN {_SEVERITY} IS NULL THEN minutes WHEN {_SEVERITY} = 'light' THEN length_m / 1000 / {c.DRIVE_LIGHT_KMH} * 60 END",
    ("walk", True): f"CASE WHEN {_SEVERITY} IS NULL THEN walk_minutes WHEN {_SEVERITY} = 'light' THEN length_m / 1000 / {c.WALK_LIGHT_KMH} * 60 WHEN {_SEVERITY} = 'moderate' THEN length_m / 1000 / {c.WALK_MODERATE_KMH} * 60 END",
}


def _graph(mode: str, flood: bool, name: str, inner: str = "sum", outer: str = "max") -> str:
    return f"""
{name}_d AS (SELECT a, b, {inner}(w) AS w FROM (SELECT a, b, {_WEIGHT[mode, flood]} AS w FROM e) WHERE w IS NOT NULL GROUP BY a, b),
{name} AS (SELECT src, dst, {outer}(w) AS w FROM (SELECT a AS src, b AS dst, w FROM {name}_d UNION ALL SELECT b, a, w FROM {name}_d) GROUP BY src, dst)"""


def _reach(source: str) -> str:
    """Labels of the pieces of a CTE with a and b."""
    return f"""
links AS (SELECT a AS u, b AS v FROM {source} WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM {source} WHERE a IS NOT NULL AND b IS NOT NULL),
ids AS (SELECT a AS id FROM {source} WHERE a IS NOT NULL UNION SELECT b FROM {source} WHERE b IS NOT NULL),
reach(id, least) USING KEY (id) AS (
  SELECT id, id FROM ids UNION
  SELECT l.v, min(r.least) FROM reach r JOIN links l ON l.u = r.id JOIN recurring.reach k ON k.id = l.v WHERE r.least < k.least GROUP BY l.v)"""


_SNAPPED = f"""{_EDGES}, {_POINTS}, {_reach('e')},
main AS (SELECT id FROM reach WHERE least = (SELECT least FROM reach GROUP BY least ORDER BY count(*) DESC, least LIMIT 1)),
nodes AS (SELECT id, min(x) AS x, min(y) AS y FROM (SELECT a AS id, ax AS x, ay AS y FROM e UNION ALL SELECT b, bx, "by" FROM e) GROUP BY id),
main_nodes AS (SELECT n.* FROM nodes n JOIN main USING (id) WHERE x IS NOT NULL AND y IS NOT NULL),
fac AS (SELECT * FROM facilities WHERE included AND "LONGITUDE" IS NOT NULL AND "LATITUDE" IS NOT NULL),
{_forward('facm', 'fac', 'facility_id', '"LONGITUDE"', '"LATITUDE"')},
near_node AS (SELECT point_id, min({{'d': sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)), 'node': n.id}}) AS m FROM pts p, main_nodes n WHERE p.x IS NOT NULL AND p.y IS NOT NULL GROUP BY point_id),
snapped AS (SELECT point_id, m.node AS node, m.d AS d, m.d / 1000 / {c.WALK_KMH} * 60 AS snap_min FROM near_node),
sources AS (SELECT DISTINCT m.node AS node FROM (SELECT facility_id, min({{'d': sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)), 'node': n.id}}) AS m FROM facm p, main_nodes n GROUP BY facility_id))"""


def _paths(mode: str, flood: bool, name: str) -> str:
    return f"""{_graph(mode, flood, name + '_g')},
{name}(node, dist) USING KEY (node) AS (
  SELECT node, CAST(0 AS DOUBLE) FROM sources UNION
  SELECT g.dst, min(r.dist + g.w) FROM {name} r JOIN {name}_g g ON g.src = r.node LEFT JOIN recurring.{name} k ON k.node = g.dst
  WHERE k.dist IS NULL OR r.dist + g.w < k.dist GROUP BY g.dst)"""


def _tree(graph: str, name: str) -> str:
    """Distance, source and predecessor of every node reached; of equal distances the lesser source, then the lesser predecessor."""
    return f"""{name}(node, s) USING KEY (node) AS (
  SELECT node, {{'d': CAST(0 AS DOUBLE), 'src': node, 'pred': CAST(-1 AS BIGINT)}} FROM sources UNION
  SELECT g.dst, min({{'d': r.s.d + g.w, 'src': r.s.src, 'pred': r.node}}) FROM {name} r JOIN {graph} g ON g.src = r.node LEFT JOIN recurring.{name} k ON k.node = g.dst
  WHERE k.s IS NULL OR {{'d': r.s.d + g.w, 'src': r.s.src, 'pred': r.node}} < k.s GROUP BY g.dst)"""


def _class(t: str) -> str:
    return f"CASE WHEN {t} < 30 THEN 'well-served' WHEN {t} < 60 THEN 'underserved' ELSE 'critical' END"


def _rank(k: str) -> str:
    return f"CASE {k} WHEN 'well-served' THEN 0 WHEN 'underserved' THEN 1 WHEN 'critical' THEN 2 END"


def _times(name: str, paths: str) -> str:
    return f"{name} AS (SELECT s.point_id, coalesce(p.dist, 'inf'::DOUBLE) + s.snap_min AS t, {_class('coalesce(p.dist, ' + chr(39) + 'inf' + chr(39) + '::DOUBLE) + s.snap_min')} AS k FROM snapped s LEFT JOIN {paths} p ON p.node = s.node)"


_PEOPLE = "people AS (SELECT point_id, any_value(population) AS population, any_value(district) AS district FROM pts GROUP BY point_id)"
_STATUS = """CASE WHEN cut THEN 'Newly cut off by flood' WHEN isinf(t) AND isinf(tf) THEN 'Always cut off'
  WHEN k = 'well-served' AND kf = 'well-served' THEN 'Well-served (unaffected by flood)' WHEN delta > 0 THEN 'Degraded by flood (not cut off)' ELSE 'Persistently underserved/critical' END"""


def _both(mode: str) -> str:
    """Base and flood times of a mode in a CTE called after it."""
    return f"""{_paths(mode, False, mode + '_p')}, {_paths(mode, True, mode + '_pf')}, {_times(mode + '_b', mode + '_p')}, {_times(mode + '_f', mode + '_pf')},
{mode}_raw AS (SELECT point_id, b.t, b.k, f.t AS tf, f.k AS kf, {_rank('f.k')} - {_rank('b.k')} AS delta, NOT isinf(b.t) AND isinf(f.t) AS cut FROM {mode}_b b JOIN {mode}_f f USING (point_id)),
{mode} AS (SELECT *, {_STATUS} AS status FROM {mode}_raw)"""


_OWNER = "CASE lower(regexp_replace(\"OWNERSHIP\", '^\\s+|\\s+$', '', 'g')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in c.OWNERSHIP.items()) + " ELSE 'unknown' END"
_PLACES = f"""
judged AS (SELECT facility_id, {_OWNER} AS owner,
  CASE WHEN coalesce(regexp_matches("NAMEOFFACI", '{c.RESTRICTED}', 'i'), FALSE) OR {_OWNER} = 'restricted' THEN 'restricted'
       WHEN {_OWNER} = 'private' THEN 'private'
       WHEN coalesce(regexp_matches("NAMEOFFACI", '{c.CLOSED}', 'i'), FALSE) OR coalesce(regexp_matches("COMMENTS", '{c.CLOSED}', 'i'), FALSE) THEN 'closed'
       WHEN "LONGITUDE" IS NULL OR "LATITUDE" IS NULL OR isnan("LONGITUDE") OR isnan("LATITUDE") THEN 'nowhere' ELSE 'included' END AS status FROM facilities)"""
_RING = """
lines AS (SELECT district_ord, unnest(range(0, len(rings))) AS ring, rings FROM districts),
verts AS (SELECT district_ord, ring, unnest(range(0, len(rings[ring + 1]) - 1)) AS seq, rings[ring + 1] AS shape FROM lines),
ends AS (SELECT district_ord, ring, seq, shape[seq + 1].x AS x1, shape[seq + 1].y AS y1, shape[seq + 2].x AS x2, shape[seq + 2].y AS y2 FROM verts)"""
_METRES = f"""{_RING}, {_forward('p1', 'ends', 'district_ord, ring, seq', 'x1', 'y1')}, {_forward('p2', 'ends', 'district_ord, ring, seq', 'x2', 'y2')},
segs AS (SELECT district_ord, ring, seq, p1.x AS ax, p1.y AS ay, p2.x AS bx, p2.y AS by_, sqrt((p1.x - p2.x) ** 2 + (p1.y - p2.y) ** 2) AS length_m FROM p1 JOIN p2 USING (district_ord, ring, seq))"""
_SPEED = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in c.SPEED_KMH.items()) + f" ELSE {c.DEFAULT_KMH} END"


_FACTORS = """
totals AS (SELECT district_id AS district_ord, province, total FROM district_reference LEFT JOIN (SELECT DISTINCT record_id, district, total FROM population_census WHERE total IS NOT NULL) USING (district)),
provinces AS (SELECT province, CAST(sum(total) AS DOUBLE) AS census FROM totals GROUP BY province HAVING sum(total) IS NOT NULL),
of AS (SELECT district_id AS district_ord, province, census FROM district_reference JOIN provinces USING (province)),
modeled AS (SELECT province, sum(value) AS m FROM (SELECT i.district_ord, value FROM ins i JOIN centres USING (cell_id)) JOIN of USING (district_ord) GROUP BY province),
factors AS (SELECT district_ord, CASE WHEN m > 0 THEN census / m ELSE 0 END AS factor FROM of JOIN modeled USING (province)),
lastf AS (SELECT cell_id, arg_max(factor, district_ord) AS factor FROM ins JOIN factors USING (district_ord) GROUP BY cell_id)"""


def _node(x: str, y: str) -> str:
    return f"CAST(round_even({x} / 5, 0) AS BIGINT) * {1 << 31} + CAST(round_even({y} / 5, 0) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    w, rec = "WITH ", "WITH RECURSIVE "
    people = "coalesce(sum(CASE WHEN NOT isnan(population) THEN population END), 0)"
    both = f"{rec}{_SNAPPED}, {_both('drive')}, {_both('walk')}, {_PEOPLE}"
    drive = f"{rec}{_SNAPPED}, {_both('drive')}, {_PEOPLE}"
    base = {m: f"{rec}{_SNAPPED}, {_paths(m, False, 'p')}, {_times('t', 'p')}, {_PEOPLE}" for m in ("drive", "walk")}
    cut = """, cutoff AS (SELECT point_id, district, population, k FROM drive JOIN people USING (point_id) WHERE cut AND population IS NOT NULL AND NOT isnan(population)),
chosen AS (SELECT district FROM district_reference WHERE district IS NOT NULL),
ranked AS (SELECT 'case' AS kind, *, row_number() OVER (PARTITION BY district ORDER BY population DESC, point_id) AS n FROM cutoff WHERE district IN (FROM chosen)
  UNION ALL SELECT 'surprise', *, row_number() OVER (ORDER BY population DESC, point_id) FROM cutoff WHERE k = 'well-served' AND (district IS NULL OR district NOT IN (FROM chosen)))"""
    routes = f"""{cut},
picks AS (SELECT point_id, coalesce(district, 'None') || CASE WHEN kind = 'surprise' THEN ' (surprise)' ELSE '' END AS label FROM ranked WHERE n = 1),
{_graph('drive', False, 'rg')},
{_tree('rg', 'tree')},
way AS (
  SELECT label, node, 0 AS back FROM picks JOIN snapped USING (point_id) WHERE node IN (SELECT node FROM tree) UNION ALL
  SELECT w.label, t.s.pred, back + 1 FROM way w JOIN tree t USING (node) WHERE t.s.pred >= 0),
steps AS (SELECT label, max(back) OVER (PARTITION BY label) - back AS seq, node, x, y, lead(node) OVER w AS nxt, lead(x) OVER w AS nx, lead(y) OVER w AS ny
  FROM way JOIN nodes ON nodes.id = way.node WINDOW w AS (PARTITION BY label ORDER BY back DESC)),
hops AS (SELECT label, seq, any_value(sqrt((s.x - nx) ** 2 + (s.y - ny) ** 2)) AS hop,
    arg_max({{'depth': flood_depth_m, 'mx': (ax + bx) / 2, 'my': (ay + "by") / 2}}, {{'fwd': CASE WHEN a = s.node THEN 1 ELSE 0 END, 'id': edge_id}}) AS e
  FROM steps s LEFT JOIN e ON least(a, b) = least(s.node, nxt) AND greatest(a, b) = greatest(s.node, nxt) WHERE nxt IS NOT NULL GROUP BY label, seq)"""
    wet = "e.depth IS NOT NULL AND NOT isnan(e.depth)"
    short = "lower(trim(replace(replace(replace(d.district, ' District', ''), ' Urban', ''), ' Rural', '')))"
    return {
        "xyz_cells": f"{w}{_CELLS} SELECT row, col, round(value, 6) AS value FROM cells",
        "zonal_population": f"{w}{_CELLS}, {_SIDES}, {_inside('ins', 'centres', 'cell_id')} SELECT district_ord, round(sum(value), 4) AS modeled, count(*) AS n_cells FROM ins JOIN centres USING (cell_id) GROUP BY district_ord",
        "zonal_cells": f"""{w}{_CELLS}, {_SIDES},
full_grid AS (SELECT r * 100000 + k AS cell_id, x0 + (k + 0.5) * {RASTER_DEG!r} AS lon, y0 + (r + 0.5) * {-RASTER_DEG!r} AS lat FROM (SELECT *, unnest(range(w)) AS k FROM (SELECT *, unnest(range(h)) AS r FROM grid))),
{_inside('ins', 'full_grid', 'cell_id')},
sums AS (SELECT district_ord, sum(value) AS modeled, count(*) AS n_cells FROM ins LEFT JOIN centres USING (cell_id) GROUP BY district_ord)
SELECT district_ord, round(coalesce(modeled, 0), 4) AS modeled, coalesce(n_cells, 0) AS n_cells FROM (SELECT DISTINCT district_ord FROM districts WHERE district_ord IS NOT NULL) LEFT JOIN sums USING (district_ord)""",
        "census_first_match": f"SELECT d.district, min(p.record_id) AS record_id, arg_min(p.total, p.record_id) AS census FROM district_reference d JOIN (SELECT DISTINCT record_id, district, total FROM population_census WHERE district IS NOT NULL AND total IS NOT NULL) p ON contains(lower(p.district), {short}) GROUP BY d.district",
        "census_own_rows": """WITH c AS (SELECT DISTINCT record_id, lower(district) AS held, total FROM population_census WHERE district IS NOT NULL AND total IS NOT NULL),
f AS (SELECT district_id, regexp_replace(district, ' District$', '') AS own FROM district_reference),
t AS (SELECT district_id, 0 AS place, lower(own) AS held FROM f UNION ALL SELECT district_id, 1, lower(own) || ' district' FROM f UNION ALL SELECT district_id, 2, lower(own) || ' rural district' FROM f WHERE NOT contains(lower(own), ' urban'))
SELECT district_id, record_id, total AS census FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY place, record_id, total) AS k FROM t JOIN c USING (held)) WHERE k = 1""",
        "calibration_sums": f"""{w}{_CELLS}, {_SIDES}, {_inside('ins', 'centres', 'cell_id')}, {_FACTORS}
SELECT (SELECT round(coalesce(sum(value * coalesce(factor, 1)), 0), 2) FROM centres LEFT JOIN lastf USING (cell_id)) AS calibrated, (SELECT round(coalesce(sum(census), 0), 2) FROM provinces) AS target""",
        "census_crosswalk": "SELECT record_id, district_id, round(census_2022_total / modeled_2020, 9) AS factor, census_2022_total / modeled_2020 > 2 OR census_2022_total / modeled_2020 < 0.5 AS outlier FROM (SELECT DISTINCT * FROM district_summary WHERE census_2022_total IS NOT NULL) JOIN district_reference USING (district) WHERE modeled_2020 > 0",
        "calibrated_cells": f"""{w}{_CELLS}, {_SIDES}, {_inside('ins', 'centres', 'cell_id')},
{_FACTORS}
SELECT cell_id, round(value, 6) AS value, round(factor, 8) AS factor, round(value * coalesce(factor, 1), 4) AS calibrated FROM centres LEFT JOIN lastf USING (cell_id)""",
        "grid_points_5km": f"{w}{_POINTS} SELECT CAST(floor(x / {CELL_M}) AS BIGINT) AS gx, CAST(floor(y / {CELL_M}) AS BIGINT) AS gy, round(sum(population), 3) AS population, count(*) AS n_source_cells, round(avg(x), 7) AS x, round(avg(y), 7) AS y FROM pts WHERE x IS NOT NULL AND y IS NOT NULL AND population IS NOT NULL AND NOT isnan(population) GROUP BY ALL",
        "p2_found": f"""{w}here AS (SELECT DISTINCT point_id, x, y, district FROM population_points WHERE point_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
f AS (SELECT * FROM facilities WHERE "LONGITUDE" IS NOT NULL AND "LATITUDE" IS NOT NULL), {_forward('m', 'f', 'facility_id', '"LONGITUDE"', '"LATITUDE"')},
bare AS (SELECT * FROM here WHERE district IS NULL), {_inverse('ll', 'bare', 'point_id', 'x', 'y')}, {_SIDES}, {_inside('ins', 'll', 'point_id')}
SELECT DISTINCT 'near' AS kind, point_id, facility_id AS other_id FROM here p JOIN m ON (p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) <= {NEAR_M!r} * {NEAR_M!r}
UNION ALL SELECT DISTINCT 'within', point_id, CAST(district_ord AS BIGINT) FROM ins""",
        "points_within_district": f"{w}{_POINTS}, xy AS (SELECT * FROM pts WHERE x IS NOT NULL AND y IS NOT NULL), {_inverse('ll', 'xy', 'point_id', 'x', 'y')}, {_SIDES}, {_inside('ins', 'll', 'point_id')} SELECT pts.point_id, ins.district_ord, d.\"shapeName\" FROM pts LEFT JOIN ins USING (point_id) LEFT JOIN districts d ON d.district_ord = ins.district_ord",
        "utm_of_facilities": f"{w}f AS (SELECT * FROM facilities WHERE \"LONGITUDE\" IS NOT NULL AND \"LATITUDE\" IS NOT NULL), {_forward('m', 'f', 'facility_id', '\"LONGITUDE\"', '\"LATITUDE\"')} SELECT facility_id, round(x, 3) AS x, round(y, 3) AS y FROM m",
        "degrees_of_points": f"{w}{_POINTS}, xy AS (SELECT * FROM pts WHERE x IS NOT NULL AND y IS NOT NULL), {_inverse('ll', 'xy', 'point_id', 'x', 'y')} SELECT point_id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM ll",
        "raster_at_edges": f"{w}{_CELLS}, {_EDGES}, {_inverse('ml', 'e', 'edge_id', '((ax + bx) / 2)', '((ay + "by") / 2)')}, hit AS (SELECT edge_id, CAST(trunc((lat - y0) / {-RASTER_DEG!r}) AS INT) AS row, CAST(trunc((lon - x0) / {RASTER_DEG!r}) AS INT) AS col FROM ml, grid) SELECT edge_id, round(value, 6) AS sampled FROM hit LEFT JOIN (SELECT * FROM cells WHERE value <> 0) USING (row, col)",
        "facility_classify": f"{w}{_PLACES} SELECT facility_id, status, owner, status = 'included' AS kept FROM judged",
        "facility_reason_counts": f"{w}{_PLACES} SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM judged WHERE status <> 'included' GROUP BY status",
        "ring_segments": f"{w}{_METRES} SELECT district_ord, CAST(ring AS INT) AS ring, CAST(seq AS INT) AS seq, round(length_m, 3) AS length_m FROM segs",
        "ring_graph": f"""{w}{_METRES}, ee AS (SELECT district_ord, {_node('ax', 'ay')} AS a, {_node('bx', 'by_')} AS b, length_m FROM segs),
e AS (SELECT *, length_m / 1000 / {_SPEED.format("CASE district_ord % 3 WHEN 0 THEN 'osm_primary' WHEN 1 THEN 'zwe_roads_Trail' ELSE 'track' END")} * 60 AS minutes FROM ee WHERE a <> b AND length_m > 0),
{_graph('drive', False, 'g')} SELECT ((src % 97) + 97) % 97 AS bucket, count(*) AS n, round(sum(w), 3) AS minutes FROM g GROUP BY bucket""",
        "road_graph": f"""{w}placed AS (SELECT DISTINCT * FROM edges WHERE NOT isnan(ax) AND NOT isnan(ay) AND NOT isnan(bx) AND NOT isnan("by")),
ee AS (SELECT {_node('ax', 'ay')} AS a, {_node('bx', '"by"')} AS b, sqrt((ax - bx) ** 2 + (ay - "by") ** 2) AS length_m, source FROM placed),
ones AS (SELECT a, b, sum(length_m / 1000 / ({_SPEED.format('source')}) * 60) AS w FROM ee WHERE a <> b AND length_m > 0 GROUP BY a, b)
SELECT src, dst, round(max(w), 6) AS w FROM (SELECT a AS src, b AS dst, w FROM ones UNION ALL SELECT b, a, w FROM ones) GROUP BY src, dst""",
        "road_union": "SELECT source, count(*) AS n, round(sum(length_m) / 1000, 3) AS km FROM (SELECT DISTINCT * FROM edges) WHERE ax IS NOT NULL AND bx IS NOT NULL GROUP BY source",
        "road_class_counts": "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT DISTINCT * FROM edges) GROUP BY source",
        "road_speed_minutes": f"{w}{_EDGES} SELECT edge_id, round(length_m / 1000 / {_SPEED.format('source')} * 60, 9) AS drive_min, round(length_m / 1000 / {c.WALK_KMH} * 60, 9) AS walk_min FROM e",
        "edge_directed_sum": f"{w}{_EDGES} SELECT a, b, round(sum(minutes), 6) AS w FROM e GROUP BY a, b",
        "drive_edges": f"{w}{_EDGES}, {_graph('drive', False, 'g')} SELECT src, dst, round(w, 6) AS w FROM g",
        "drive_edges_fastest": f"{w}{_EDGES}, {_graph('drive', False, 'g', 'min', 'min')} SELECT src, dst, round(w, 6) AS w FROM g",
        "walk_edges": f"{w}{_EDGES}, {_graph('walk', False, 'g')} SELECT src, dst, round(w, 6) AS w FROM g",
        "components": f"{rec}{_reach('edges')} SELECT id AS node_id, least AS component FROM reach",
        "main_component_share": f"{rec}{_reach('edges')}, n AS (SELECT least, count(*) AS n FROM reach GROUP BY least) SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS share FROM n",
        "snap_points_main": f"{rec}{_SNAPPED} SELECT point_id, round(d, 4) AS snap_dist_m, round(snap_min, 5) AS snap_min FROM snapped",
        "sssp_drive": f"{rec}{_SNAPPED}, {_paths('drive', False, 'p')} SELECT node AS node_id, round(dist, 6) AS dist FROM p",
        "sssp_walk": f"{rec}{_SNAPPED}, {_paths('walk', False, 'p')} SELECT node AS node_id, round(dist, 6) AS dist FROM p",
        "drive_tree": f"{rec}{_SNAPPED}, {_graph('drive', False, 'rg')}, {_tree('rg', 'tree')} SELECT node AS node_id, round(s.d, 6) AS dist, s.src AS source, CASE WHEN s.pred >= 0 THEN s.pred END AS pred FROM tree",
        "nearest_places": f"""{rec}{_SNAPPED}, {_graph('drive', False, 'dg')}, {_tree('dg', 'dt')}, {_graph('walk', False, 'wg')}, {_tree('wg', 'wt')},
of_place AS (SELECT facility_id, min({{'d': sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)), 'node': n.id}}).node AS node FROM facm p, main_nodes n GROUP BY facility_id),
named AS (SELECT node, "NAMEOFFACI" AS name FROM (SELECT node, "NAMEOFFACI", row_number() OVER (PARTITION BY node ORDER BY facility_id DESC) AS k FROM of_place JOIN fac USING (facility_id)) WHERE k = 1)
SELECT point_id, a.name AS drive_nearest_facility, b.name AS walk_nearest_facility FROM snapped p LEFT JOIN dt ON dt.node = p.node LEFT JOIN named a ON a.node = dt.s.src LEFT JOIN wt ON wt.node = p.node LEFT JOIN named b ON b.node = wt.s.src""",
        "flood_drive": f"{rec}{_SNAPPED}, {_paths('drive', True, 'p')} SELECT node AS node_id, round(dist, 6) AS dist FROM p",
        "flood_walk": f"{rec}{_SNAPPED}, {_paths('walk', True, 'p')} SELECT node AS node_id, round(dist, 6) AS dist FROM p",
        "baseline_drive": f"{base['drive']} SELECT point_id, round(t, 5) AS drive_time_min, k AS drive_class FROM t",
        "baseline_walk": f"{base['walk']} SELECT point_id, round(t, 5) AS walk_time_min, k AS walk_class FROM t",
        "access_gap": f"{rec}{_SNAPPED}, {_paths('drive', False, 'p')}, {_times('td', 'p')}, {_paths('walk', False, 'q')}, {_times('tw', 'q')} SELECT point_id, {_rank('tw.k')} - {_rank('td.k')} AS access_gap FROM td JOIN tw USING (point_id)",
        "baseline_by_points": f"{base['drive']} SELECT k AS drive_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY k",
        "baseline_by_population": f"{base['drive']} SELECT k AS drive_class, round({people}, 3) AS total, round({people} / sum({people}) OVER (), 6) AS share FROM t JOIN people USING (point_id) GROUP BY k",
        "flooded_roads": f"{w}{_EDGES} SELECT edge_id, source, round(flood_depth_m, 6) AS depth_m, {_SEVERITY} AS severity, (ax + bx) / 2 AS mid_x, (ay + \"by\") / 2 AS mid_y FROM e WHERE {_SEVERITY} IS NOT NULL",
        "severity_counts": f"{w}{_EDGES} SELECT {_SEVERITY} AS severity, count(*) AS n, round(avg(CASE WHEN NOT isnan(flood_depth_m) THEN flood_depth_m END), 6) AS mean_depth FROM e GROUP BY 1",
        "penalized_drive": f"{w}{_EDGES}, {_graph('drive', True, 'g')} SELECT src, dst, round(w, 6) AS w FROM g",
        "penalized_walk": f"{w}{_EDGES}, {_graph('walk', True, 'g')} SELECT src, dst, round(w, 6) AS w FROM g",
        "flood_delta": f"{both} SELECT point_id, d.delta AS drive_flood_delta, d.cut AS newly_cutoff_drive, v.delta AS walk_flood_delta, v.cut AS newly_cutoff_walk FROM drive d JOIN walk v USING (point_id)",
        "newly_cutoff_summary": f"{both} SELECT 'drive' AS mode, count(*) AS points, round({people}, 3) AS people FROM drive JOIN people USING (point_id) WHERE cut UNION ALL SELECT 'walk', count(*), round({people}, 3) FROM walk JOIN people USING (point_id) WHERE cut",
        "combined_status_drive": f"{drive} SELECT point_id, status FROM drive",
        "combined_status_walk": f"{rec}{_SNAPPED}, {_both('walk')} SELECT point_id, status FROM walk",
        "combined_status_population": f"{drive} SELECT status, round({people}, 3) AS total, round({people} / sum({people}) OVER (), 6) AS share FROM drive JOIN people USING (point_id) GROUP BY status",
        "case_picks": f"{drive}{cut} SELECT kind, point_id, district, round(population, 3) AS population, coalesce(district, 'None') || CASE WHEN kind = 'surprise' THEN ' (surprise)' ELSE '' END AS case_label FROM ranked WHERE n = 1",
        "case_routes": f"{drive}{routes} SELECT label AS \"case\", round(sum(hop) / 1000, 4) AS baseline_dist_km, count(*) FILTER ({wet}) AS n_flooded_segments_on_route, count(*) + 1 AS n_nodes FROM hops GROUP BY label",
        "case_route_cuts": f"{drive}{routes} SELECT label AS \"case\", seq, round(e.depth, 6) AS depth_m, round(e.mx, 3) AS x, round(e.my, 3) AS y FROM hops WHERE {wet}",
        "shipped_status": f"""{w}last AS (SELECT run_id, population, drive_base_min AS t, drive_flood_time_min AS tf, drive_base_class AS k, drive_flood_class AS kf, coalesce(newly_cutoff_drive, FALSE) AS cut,
  coalesce({_rank('drive_flood_class')} - {_rank('drive_base_class')}, 0) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY run_id, point_id ORDER BY loaded_at DESC) AS n FROM flood_accessibility) WHERE n = 1)
SELECT run_id, {_STATUS.replace('isinf(t)', '(t IS NULL OR isnan(t) OR isinf(t))').replace('isinf(tf)', '(tf IS NULL OR isnan(tf) OR isinf(tf))')} AS status, count(*) AS points, round({people}, 3) AS people FROM last GROUP BY ALL""",
        "shipped_classes": f"SELECT run_date, drive_class, count(*) AS n, count(*) FILTER (drive_time_min < 'inf'::DOUBLE) AS reachable, count(*) FILTER (({_class('drive_time_min')}) = drive_class) AS agree FROM baseline_accessibility GROUP BY ALL",
    }
