"""The small network whose results are worked out by hand: parallel edges, an island, a dropped loop, a default speed."""

import math
import random

import pytest
from pyspark.sql import Row, functions as F

from landreach.functions import classify as c
from landreach.operators import graph, network, raster, report, scenario, spatial

LINES = [
    ("r1", "osm_primary", [(0, 0), (1000, 0), (2000, 0)]),
    ("r2", "osm_unclassified", [(2000, 2), (3000, 0)]),
    ("r3", "osm_primary", [(0, 0), (1000, 0)]),
    ("r4", "osm_secondary", [(2000, 0), (1000, 0)]),
    ("r5", "zwe_roads_Trail", [(10000, 10000), (10500, 10000)]),
    ("r6", "osm_primary", [(3000, 0), (3001, 1)]),
    ("r7", "foo", [(3000, 0), (3000, 1000)]),
    ("r8", "osm_primary", []),
    ("r9", "osm_primary", None),
]
DEPTH = {(1500.0, 0.0): 0.2, (2500.0, 1.0): 0.5, (3000.0, 500.0): 1.0}
#: Speeds of the worked example.
SPEEDS = {"osm_primary": 80.0, "osm_secondary": 60.0, "osm_unclassified": 20.0, "zwe_roads_Trail": 15.0}


@pytest.fixture(scope="module")
def edges(spark):
    lines = spark.createDataFrame([(k, s, None if p is None else [Row(x=float(x), y=float(y)) for x, y in p]) for k, s, p in LINES], "road string, source string, shape array<struct<x:double,y:double>>")
    segs = network.segments(lines, ["road", "source"], "shape")
    e = network.edges_of(segs, ["road", "source"]).withColumn("minutes", network.minutes(F.col("length_m"), network.speed(F.col("source"), SPEEDS, 20.0)))
    depth = spark.createDataFrame([(*k, v) for k, v in DEPTH.items()], "mx double, my double, flood_depth_m double")
    e = e.withColumns({"walk_minutes": network.minutes(F.col("length_m"), c.WALK_KMH), "mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2})
    return e.join(depth, ["mx", "my"], "left").withColumn("edge_id", F.xxhash64("road", "mx")).cache()


def node(x, y):
    return int(x // 5) * (1 << 31) + int(y // 5)


N = [node(0, 0), node(1000, 0), node(2000, 0), node(3000, 0), node(10000, 10000), node(10500, 10000), node(3000, 1000)]


def weights(df):
    return {(N.index(r.src), N.index(r.dst)): r.w for r in df.collect()}


def test_edges_and_weights(edges):
    assert edges.count() == 7
    assert weights(network.undirected(edges, "minutes")) == {
        k: pytest.approx(v, abs=1e-5) for a, b, v in ((0, 1, 1.5), (1, 2, 1.0), (2, 3, 3.000006), (3, 6, 3.0), (4, 5, 2.0)) for k in ((a, b), (b, a))
    }
    fast = weights(network.undirected(edges, "minutes", "min"))
    assert fast[0, 1] == pytest.approx(0.75) and fast[1, 2] == pytest.approx(0.75)
    drive, walk = weights(scenario.flooded(edges, "drive")), weights(scenario.flooded(edges, "walk"))
    assert drive[1, 2] == pytest.approx(6.0) and (2, 3) not in drive and (3, 6) not in drive
    assert walk[0, 1] == pytest.approx(26.666667) and walk[1, 2] == pytest.approx(40.0) and walk[2, 3] == pytest.approx(60.00012) and (3, 6) not in walk


def test_snapping_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(2.5,), (7.5,), (12.5,), (-2.5,)], "v double")
    assert [r[0] for r in df.select(network.snapped(F.col("v"), 5.0)).collect()] == [0, 10, 10, 0]


def test_the_whole_chain(spark, edges):
    nodes = network.nodes(edges)
    labels = graph.components(edges)
    assert sorted(r["count"] for r in labels.groupBy("component").count().collect()) == [2, 5]
    main = graph.main_component(labels)
    places = spark.createDataFrame([(1, "F_A", 0.0, 3.0), (2, "F_B", 1.0, 0.0), (3, "F_C", 3000.0, 1010.0)], "fid long, name string, x double, y double")
    people = spark.createDataFrame([(1, 2000.0, 300.0), (2, 10200.0, 10000.0), (3, 3000.0, -400.0), (4, None, None)], "pid long, x double, y double")
    at, places_at = scenario.snap(people, "pid", nodes, main), scenario.snap(places, "fid", nodes, main)
    assert {r.pid: (N.index(r.node_id), round(r.snap_dist_m, 4)) for r in at.collect()} == {1: (2, 300.0), 2: (6, 11525.6236), 3: (3, 400.0)}
    names = scenario.place_names(places_at, places, "fid")
    want = {
        "drive": {1: (6.5, "F_B", 11.5, "F_B", 0, False, "Well-served (unaffected by flood)"), 2: (153.674982, "F_C", 153.674982, "F_C", 0, False, "Persistently underserved/critical"), 3: (8.333333, "F_C", math.inf, None, 2, True, "Newly cut off by flood")},
        "walk": {1: (30.666693, "F_C", 70.666667, "F_B", 1, False, "Degraded by flood (not cut off)"), 2: (153.674982, "F_C", 153.674982, "F_C", 0, False, "Persistently underserved/critical"), 3: (18.666667, "F_C", 132.00012, "F_B", 2, False, "Degraded by flood (not cut off)")},
    }
    for mode in ("drive", "walk"):
        trees = [graph.shortest_paths(g, places_at.select("node_id")) for g in (network.undirected(edges, "minutes" if mode == "drive" else "walk_minutes"), scenario.flooded(edges, mode))]
        base, flood = [scenario.access(people, "pid", at, t, names, mode) for t in trees]
        both = scenario.compare(base, flood, "pid", mode)
        got = both.withColumn("status", scenario.status(both, mode)).collect()
        for r in got:
            row = (r[f"{mode}_base_min"], r[f"{mode}_base_fac"], r[f"{mode}_flood_time_min"], r[f"{mode}_flood_nearest_fac"], r[f"{mode}_flood_delta"], r[f"newly_cutoff_{mode}"], r["status"])
            assert list(row) == [pytest.approx(v, rel=1e-6) if isinstance(v, float) else v for v in want[mode][r.pid]]
        if mode == "drive":
            picks = spark.createDataFrame([(3, "P3")], "pid long, case_label string")
            lines, cuts = scenario.route_parts(picks, at, "pid", trees[0], nodes, edges)
            assert [tuple(r) for r in lines.collect()] == [("P3", pytest.approx(1.0), 1, 2)]
            assert [tuple(r) for r in cuts.select("depth_m", "x", "y").collect()] == [(1.0, 3000.0, 500.0)]


def test_case_picks(spark):
    rows = [(1, "A", 5.0, True, "critical"), (2, "A", 9.0, True, "critical"), (3, "A", 9.0, True, "critical"), (4, "B", 99.0, False, "critical"), (5, None, 3.0, True, "well-served"), (6, "C", 2.0, True, "well-served"), (7, "A", math.nan, True, "well-served"), (8, "A", None, True, "well-served")]
    df = spark.createDataFrame(rows, "pid long, district string, population double, newly_cutoff_drive boolean, drive_base_class string")
    got = scenario.case_picks(df, "pid", spark.createDataFrame([("A",), ("B",), (None,)], "district string")).collect()
    assert sorted((r.kind, r.pid, r.case_label) for r in got) == [("case", 2, "A"), ("surprise", 5, "None (surprise)")]
    assert scenario.case_picks(df.limit(0), "pid", spark.createDataFrame([("A",)], "district string")).count() == 0


def _random_graph(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.choice([1.0, 2.0, 2.5])) for _ in range(m)]


@pytest.mark.parametrize(("n", "m", "blocks"), [(40, 60, 1), (3000, 4000, 3), (3000, 2900, 2)])
def test_paths_match_plain_dijkstra(spark, n, m, blocks):
    import heapq

    links = {}
    for a, b, w in _random_graph(n + m, n, m):
        if a != b:
            links[a, b] = links[b, a] = min(w, links.get((a, b), 9))
    near = {}
    for (a, b), w in links.items():
        near.setdefault(a, []).append((b, w))
    sources = [0, 1, n // 2]
    best = {s: (0.0, s) for s in sources}
    heap = [(0.0, s, s) for s in sources]
    while heap:
        d, s, v = heapq.heappop(heap)
        if (d, s) > best[v]:
            continue
        for t, w in near.get(v, ()):
            if t not in best or (d + w, s) < best[t]:
                best[t] = (d + w, s)
                heapq.heappush(heap, (d + w, s, t))
    e = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src long, dst long, w double")
    got = graph.shortest_paths(e, spark.createDataFrame([(s,) for s in [*sources, None, 10**9]], "node_id long"), blocks).filter("node_id < 1000000").collect()
    assert {r.node_id: (r.dist, r.source) for r in got} == best
    for r in got:
        assert (r.pred is None) == (r.dist == 0.0 and r.node_id in sources)
        if r.pred is not None:
            assert best[r.pred][0] + links[r.pred, r.node_id] == r.dist


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, None), (None, 2)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [tuple(x[:2]) for x in _random_graph(3, 500, 300)]])
@pytest.mark.parametrize("share", [500_000, 40])
def test_components_match_union_find(spark, monkeypatch, rows, share):
    monkeypatch.setattr(graph, "FOREST_EDGES", share)
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        for x in (a, b):
            if x is not None:
                parent.setdefault(x, x)
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.node_id: r.component for r in got} == {x: find(x) for x in parent}


def test_routes_of_a_long_chain(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "node_id long, pred long")
    got = graph.routes(tree, spark.createDataFrame([("x", 150), ("y", 0), ("z", 999)], "case string, node_id long")).collect()
    assert sorted((r["case"], r.seq, r.node_id) for r in got) == [("x", i, i) for i in range(151)] + [("y", 0, 0)]


def test_nearest_matches_brute_force(spark):
    r = random.Random(1)
    pts = [(i, r.gauss(0, 1000), r.gauss(0, 1000)) for i in range(200)] + [(900, 1e6, 1e6), (901, None, 0.0)]
    targets = [(i, r.gauss(0, 300), r.gauss(0, 300)) for i in range(50)] + [(77, None, None)]
    got = spatial.nearest(spark.createDataFrame(pts, "pid long, x double, y double"), "pid", spark.createDataFrame(targets, "t long, x double, y double"), "t").collect()
    want = {p[0]: min((math.hypot(p[1] - t[1], p[2] - t[2]), t[0]) for t in targets if t[1] is not None) for p in pts if p[1] is not None}
    assert {x.pid: x.t for x in got} == {k: v[1] for k, v in want.items()}
    empty = spark.createDataFrame([], "t long, x double, y double")
    assert spatial.nearest(spark.createDataFrame(pts, "pid long, x double, y double"), "pid", empty, "t").count() == 0


def test_raster(spark):
    rows = [(30.0, -18.0, 1.0, 1), (30.5, -18.0, 2.0, 2), (31.0, -18.5, 4.0, 3), (30.0, -18.5, 9.0, 4), (30.0, -18.5, 5.0, 5), (29.0, -18.0, 0.0, 6)]
    made = spark.createDataFrame(rows, "X double, Y double, Z double, ord long")
    kept = raster.xyz(made.drop("ord"))
    assert kept.columns == ["x", "y", "pop"] and kept.count() == 5
    cells, grid = raster.to_cells(made.filter("Z > 0").select(F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("pop"), "ord"), "ord", 0.5)
    assert {(r.row, r.col): r.value for r in cells.collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 2): 4.0, (1, 0): 5.0}
    assert (grid.x0, grid.y0, grid.width, grid.height) == (29.75, -17.75, 3, 2)
    at = {(r.row, r.col): (r.x, r.y) for r in raster.to_points(cells, grid).collect()}
    assert at[1, 2] == (31.0, -18.5)
    places = spark.createDataFrame([(1, 30.1, -18.1), (2, 29.5, -17.6), (3, 99.0, -18.0), (4, 30.6, -18.6), (5, None, None)], "id long, x double, y double")
    got = {r.id: r.depth for r in raster.sample(places, "x", "y", cells, grid, nodata=4.0).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: None}  # 2 lies within a cell left of and above the raster
    member = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1)], "cell_id long, district_ord long")
    values = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 30.0), (4, 7.0)], "cell_id long, value double")
    totals = spark.createDataFrame([(0, "g0", 40.0), (1, "g1", 20.0)], "district_ord long, group_id string, census double")
    scaled, summary = raster.calibrate(values, member, totals)
    assert {r.district_ord: (r.modeled, r.factor, r.n_cells) for r in summary.collect()} == {0: (20.0, 2.0, 2), 1: (40.0, 0.5, 2)}
    assert {r.cell_id: r.calibrated for r in scaled.collect()} == {1: 20.0, 2: 5.0, 3: 15.0, 4: 7.0}
    joint = spark.createDataFrame([(0, "g", 30.0), (1, "g", 30.0)], "district_ord long, group_id string, census double")
    assert {r.factor for r in raster.calibrate(values, member, joint)[1].collect()} == {0.5}
    grid5 = raster.aggregate_to_grid(spark.createDataFrame([(-1.0, 0.0, 1.0), (4999.9, 0.0, 3.0), (100.0, 0.0, 1.0), (5000.0, 1.0, 1.0)], "x double, y double, pop double"), "pop", 5000.0)
    assert {(r.gx, r.gy): (r.population, r.n_source_cells) for r in grid5.collect()} == {(-1, 0): (1.0, 1), (0, 0): (4.0, 2), (1, 0): (1.0, 1)}
    heavy = raster.aggregate_to_grid(spark.createDataFrame([(0.0, 0.0, 3.0), (4.0, 0.0, 1.0)], "x double, y double, pop double"), "pop", 5000.0, weighted=True)
    assert heavy.first().x == 1.0


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("b", None), (None, 3.0)], "k string, v double")
    assert [(r.k, r.n) for r in report.value_counts(df, "k").collect()] == [("a", 2), (None, 1), ("b", 1)]
    assert {r.k: (r.total, r.share) for r in report.sums_by(df, "k", "v").collect()} == {"a": (1.0, 0.25), "b": (0.0, 0.0), None: (3.0, 0.75)}
