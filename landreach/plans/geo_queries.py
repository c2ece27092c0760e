"""Queries of the accessibility chain over the driver's tables."""

from __future__ import annotations

import threading
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from landreach.functions import classify as c
from landreach.functions.crs import utm_forward, utm_inverse
from landreach.operators import graph, network, nearby, raster, report, scenario, spatial
from landreach.plans import steps
from landreach.session import Scratch, load

CELL_M = 5_000.0
RASTER_DEG = 1 / 12


def r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


# --- inputs, without repeated rows


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between two different nodes; an unsampled depth is null."""
    e = load(spark, d, "edges").filter("a is not null and b is not null and a <> b and length_m > 0").distinct()
    return e.withColumn("flood_depth_m", F.when(~F.isnan("flood_depth_m"), F.col("flood_depth_m")))


def points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "population_points").distinct()


def places(spark: SparkSession, d: str) -> DataFrame:
    """Included facilities with their place in metres."""
    f = load(spark, d, "facilities").filter("included and LONGITUDE is not null and LATITUDE is not null")
    x, y = utm_forward(F.col("LONGITUDE"), F.col("LATITUDE"))
    return f.select("facility_id", "NAMEOFFACI", x.alias("x"), y.alias("y"))


def cells(spark: SparkSession, d: str) -> tuple[DataFrame, raster.Grid]:
    """A raster of people, from the points' places on a lattice of a twelfth of a degree (the last point of a cell stands)."""
    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    at = points(spark, d).filter("x is not null and population > 0 and not isnan(population)")
    snap = lambda v: F.round(F.floor(v / RASTER_DEG) * RASTER_DEG + RASTER_DEG / 2, 9)
    return raster.to_cells(at.select(snap(lon).alias("x"), snap(lat).alias("y"), F.col("population").alias("pop"), "point_id"), "point_id", RASTER_DEG)


class Chain:
    """The steps of the chain that several queries share; each is computed once and kept in the shared folder.

    Steps that don't need each other run side by side; one that two others need
    at once is computed by the first, and the second waits.
    """

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d, self.kept = spark, d, {}
        self.scratch = Scratch(spark, "chain")
        self.locks: dict[str, threading.Lock] = {}

    def keep(self, name: str, make) -> DataFrame:
        with self.locks.setdefault(name, threading.Lock()):
            if name not in self.kept:
                self.kept[name] = self.scratch.save(make())
        return self.kept[name]

    def beside(self, make) -> Future:
        """Begins a step in a thread of its own."""
        pool = ThreadPoolExecutor(1)
        begun = pool.submit(make)
        pool.shutdown(wait=False)
        return begun

    @property
    def edges(self) -> DataFrame:
        return self.keep("edges", lambda: edges(self.spark, self.d))

    @property
    def nodes(self) -> DataFrame:
        return self.keep("nodes", lambda: network.nodes(self.edges))

    @property
    def main(self) -> DataFrame:
        return self.keep("main", lambda: graph.main_component(graph.components(self.edges)))

    @property
    def at(self) -> DataFrame:
        return self.keep("at", lambda: scenario.snap(points(self.spark, self.d), "point_id", self.nodes, self.main))

    @property
    def places_at(self) -> DataFrame:
        return self.keep("places_at", lambda: scenario.snap(places(self.spark, self.d), "facility_id", self.nodes, self.main))

    @property
    def names(self) -> DataFrame:
        return self.keep("names", lambda: scenario.place_names(self.places_at, places(self.spark, self.d).select("facility_id", "NAMEOFFACI").withColumnRenamed("NAMEOFFACI", "name"), "facility_id"))

    def paths(self, mode: str, flood: bool) -> DataFrame:
        def store() -> graph.Stored:
            g = scenario.flooded(self.edges, mode) if flood else network.undirected(self.edges, "minutes" if mode == "drive" else "walk_minutes")
            return graph.store(g, places=self.nodes)

        def make() -> DataFrame:
            stored, at = self.beside(store), self.places_at
            return graph.search(stored.result(), at.select("node_id"))

        return self.keep(f"paths {mode} {flood}", make)

    def access(self, mode: str, flood: bool = False) -> DataFrame:
        def make() -> DataFrame:
            beside = [self.beside(lambda: self.at), self.beside(lambda: self.names)]
            paths = self.paths(mode, flood)
            at, names = (b.result() for b in beside)
            return scenario.access(points(self.spark, self.d).select("point_id").distinct(), "point_id", at, paths, names, mode)

        return self.keep(f"access {mode} {flood}", make)

    def compared(self, mode: str) -> DataFrame:
        return self.keep(f"compared {mode}", lambda: self._compare(mode))

    def _compare(self, mode: str) -> DataFrame:
        both = scenario.compare(self.access(mode), self.access(mode, True), "point_id", mode)
        return both.withColumn("status", scenario.status(both, mode))

    def people(self) -> DataFrame:
        return points(self.spark, self.d).select("point_id", "population", "district").dropDuplicates(["point_id"])


# --- raster and population


def xyz_cells(spark, d):
    got, _ = cells(spark, d)
    return got.select("row", "col", r("value"))


def zonal_population(spark, d):
    """People by district, and the cells that hold any; those of the full grid are in zonal_cells."""
    got, grid = cells(spark, d)
    at = raster.to_points(got, grid).withColumn("id", F.col("row").cast("long") * 100_000 + F.col("col"))
    inside = nearby.containing_regions(at, "id", "x", "y", load(spark, d, "districts"), "district_ord", "rings")
    sums = inside.join(at.select(F.col("id").alias("point_id"), "value"), "point_id").groupBy(F.col("region_id").cast("int").alias("district_ord"))
    return sums.agg(F.sum("value").alias("modeled"), F.count("*").alias("n_cells")).select("district_ord", r("modeled", 4), "n_cells")


def zonal_cells(spark, d):
    """People and cells by district over the full grid, empty cells too; a district without cells keeps a row."""
    got, grid = cells(spark, d)
    districts = load(spark, d, "districts")
    values = got.filter("value > 0").select((F.col("row").cast("long") * F.lit(1 << 31) + F.col("col")).alias("cell_id"), "value")
    inside = raster.cells_in_regions(grid, districts, "district_ord", "rings").join(values, "cell_id", "left")
    sums = inside.groupBy(F.col("region_id").cast("int").alias("district_ord")).agg(F.sum("value").alias("modeled"), F.count("*").alias("n_cells"))
    every = districts.select(F.col("district_ord").cast("int").alias("district_ord")).filter("district_ord is not null").distinct()
    return every.join(sums, "district_ord", "left").fillna({"modeled": 0.0, "n_cells": 0}).select("district_ord", r("modeled", 4), "n_cells")


def census_first_match(spark, d):
    """For each listed district the first census row whose name contains its short name, case ignored."""
    named = load(spark, d, "district_reference").select(F.col("district_id").alias("ord"), "district")
    census = load(spark, d, "population_census").filter("district is not null and total is not null").select("record_id", "district", "total").distinct()
    found = steps.census_of(named, census, "district", "district", "total", {}, [], "record_id")
    return found.groupBy(F.col("group_id").alias("district")).agg(F.min("n").alias("record_id"), F.min_by("census", "n").cast("long").alias("census"))


def census_own_rows(spark, d):
    """For each listed district the census row of exactly its name, with or without the word district."""
    named = load(spark, d, "district_reference").select(F.col("district_id").alias("ord"), "district")
    census = load(spark, d, "population_census").filter("district is not null and total is not null").select("record_id", "district", "total").distinct()
    found = steps.census_of(named, census, "district", "district", "total", {}, [], "record_id", "crosswalk")
    return found.select(F.col("ord").alias("district_id"), F.col("n").alias("record_id"), F.col("census").cast("long").alias("census"))


def census_crosswalk(spark, d):
    """Calibration factors of listed names that the census writes exactly: total over modelled, and those far from 1."""
    summary = load(spark, d, "district_summary").filter("district is not null and census_2022_total is not null").distinct()
    known = load(spark, d, "district_reference").select("district_id", "district", "province")
    ok = summary.join(F.broadcast(known), "district").filter("modeled_2020 > 0")
    factor = F.col("census_2022_total") / F.col("modeled_2020")
    return ok.select("record_id", "district_id", F.round(factor, 9).alias("factor"), ((factor > 2) | (factor < 0.5)).alias("outlier"))


def _calibrated(spark, d):
    got, grid = cells(spark, d)
    at = raster.to_points(got, grid).withColumn("cell_id", F.col("row").cast("long") * 100_000 + F.col("col"))
    member = nearby.containing_regions(at, "cell_id", "x", "y", load(spark, d, "districts"), "district_ord", "rings").select(F.col("point_id").alias("cell_id"), F.col("region_id").alias("district_ord"))
    ref = load(spark, d, "district_reference")
    total = load(spark, d, "population_census").filter("total is not null").select("record_id", "district", "total").distinct()
    by = ref.select(F.col("district_id").cast("long").alias("district_ord"), "province", "district").join(total, "district", "left")
    totals = by.groupBy("district_ord", F.col("province").alias("group_id")).agg(F.sum("total").cast("double").alias("t"))
    group = totals.groupBy("group_id").agg(F.sum("t").alias("census"))
    totals = totals.select("district_ord", "group_id").join(group, "group_id").filter("census is not null")
    scaled, _ = raster.calibrate(at.select("cell_id", "value"), member, totals)
    return scaled, totals


def calibrated_cells(spark, d):
    """Cells scaled to census totals; districts of one province share a factor."""
    scaled, _ = _calibrated(spark, d)
    return scaled.select("cell_id", r("value"), F.round("factor", 8).alias("factor"), r("calibrated", 4))


def calibration_sums(spark, d):
    """The sum of the scaled cells beside the sum of the totals."""
    return steps.calibration_sums(*_calibrated(spark, d)).select(r("calibrated", 2), r("target", 2))


def grid_points_5km(spark, d):
    at = points(spark, d).filter("x is not null and y is not null and population is not null and not isnan(population)")
    return raster.aggregate_to_grid(at, "population", CELL_M).select("gx", "gy", r("population", 3), "n_source_cells", r("x", 7), r("y", 7))


def points_within_district(spark, d):
    at = points(spark, d)
    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    at = at.select("point_id", lon.alias("lon"), lat.alias("lat"))
    out = spatial.with_region(at, "point_id", "lon", "lat", load(spark, d, "districts"), "district_ord", "rings", "shapeName")
    return out.select("point_id", F.col("district_ord").cast("int").alias("district_ord"), "shapeName")


def utm_of_facilities(spark, d):
    x, y = utm_forward(F.col("LONGITUDE"), F.col("LATITUDE"))
    return load(spark, d, "facilities").filter("LONGITUDE is not null and LATITUDE is not null").select("facility_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def degrees_of_points(spark, d):
    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    return points(spark, d).filter("x is not null and y is not null").select("point_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


def raster_at_edges(spark, d):
    """The cell value at each edge's midpoint."""
    got, grid = cells(spark, d)
    e = edges(spark, d)
    lon, lat = utm_inverse((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    out = raster.sample(e.select("edge_id", lon.alias("lon"), lat.alias("lat")), "lon", "lat", got, grid, 0.0, "sampled")
    return out.select("edge_id", r("sampled"))


# --- facilities


def _classified(spark, d):
    f = load(spark, d, "facilities")
    return f.withColumns({"status": c.place_status(*[F.col(x) for x in ("NAMEOFFACI", "OWNERSHIP", "COMMENTS", "LONGITUDE", "LATITUDE")]), "owner": c.ownership(F.col("OWNERSHIP"))})


def facility_classify(spark, d):
    return _classified(spark, d).select("facility_id", "status", "owner", (F.col("status") == "included").alias("kept"))


def facility_reason_counts(spark, d):
    out = report.value_counts(_classified(spark, d).filter("status <> 'included'"), "status")
    return out.select("status", "n", r("share"))


# --- network


def ring_segments(spark, d):
    """The district outlines as lines: their segments in metres."""
    lines = load(spark, d, "districts").select("district_ord", F.posexplode("rings").alias("ring", "shape"))
    s = network.segments(lines, ["district_ord", "ring"], "shape")
    ax, ay = utm_forward(F.col("ax"), F.col("ay"))
    bx, by = utm_forward(F.col("bx"), F.col("by"))
    return s.select("district_ord", "ring", "seq", F.hypot(ax - bx, ay - by).alias("length_m")).select("district_ord", "ring", "seq", r("length_m", 3))


def ring_graph(spark, d):
    """A graph from the district outlines: snapped nodes, and minutes at the speed of the outline's class."""
    lines = load(spark, d, "districts").select("district_ord", F.posexplode("rings").alias("ring", "shape"))
    s = network.segments(lines, ["district_ord", "ring"], "shape")
    ax, ay = utm_forward(F.col("ax"), F.col("ay"))
    bx, by = utm_forward(F.col("bx"), F.col("by"))
    metres = Scratch(spark, "rings").save(s.select("district_ord", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")))
    e = network.edges_of(metres, ["district_ord"])
    source = F.when(F.col("district_ord") % 3 == 0, "osm_primary").when(F.col("district_ord") % 3 == 1, "zwe_roads_Trail").otherwise("track")
    e = e.withColumn("minutes", network.minutes(F.col("length_m"), network.speed(source, c.SPEED_KMH, c.DEFAULT_KMH)))
    g = network.undirected(e, "minutes")
    return g.groupBy(F.pmod("src", F.lit(97)).alias("bucket")).agg(F.count("*").alias("n"), F.sum("w").alias("minutes")).select("bucket", "n", r("minutes", 3))


def road_graph(spark, d):
    """The graph from all rows of the network's table: ids from the snapped ends, and minutes at the speed of the row's class."""
    given = load(spark, d, "edges").distinct().select("source", "ax", "ay", "bx", "by")
    e = network.edges_of(given.filter(" and ".join(f"not isnan({x})" for x in ("ax", "ay", "bx", "by"))), ["source"])
    e = e.withColumn("minutes", network.minutes(F.col("length_m"), network.speed(F.col("source"), c.SPEED_KMH, c.DEFAULT_KMH)))
    return network.undirected(e, "minutes").select("src", "dst", r("w"))


def road_union(spark, d):
    """Road classes kept in separate parts and put together again, with empty and unplaced ones left out."""
    e = load(spark, d, "edges").distinct().filter("ax is not null and bx is not null")
    parts = [e.filter(F.col("source") == s) for s in c.SPEED_KMH] + [e.filter(~F.coalesce(F.col("source").isin(list(c.SPEED_KMH)), F.lit(False)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source").agg(F.count("*").alias("n"), (F.sum("length_m") / 1000).alias("km")).select("source", "n", r("km", 3))


def road_class_counts(spark, d):
    return report.value_counts(load(spark, d, "edges").distinct(), "source").select("source", "n", r("share"))


def road_speed_minutes(spark, d):
    e = edges(spark, d)
    m = network.minutes(F.col("length_m"), network.speed(F.col("source"), c.SPEED_KMH, c.DEFAULT_KMH))
    w = network.minutes(F.col("length_m"), c.WALK_KMH)
    return e.select("edge_id", F.round(m, 9).alias("drive_min"), F.round(w, 9).alias("walk_min"))


def edge_directed_sum(spark, d):
    return network.directed(edges(spark, d), "minutes").select("a", "b", r("w"))


def drive_edges(spark, d):
    return network.undirected(edges(spark, d), "minutes").select("src", "dst", r("w"))


def drive_edges_fastest(spark, d):
    return network.undirected(edges(spark, d), "minutes", "min").select("src", "dst", r("w"))


def walk_edges(spark, d):
    return network.undirected(edges(spark, d), "walk_minutes").select("src", "dst", r("w"))


def components(spark, d):
    return graph.components(load(spark, d, "edges").select("a", "b"))


def main_component_share(spark, d):
    n = components(spark, d).groupBy("component").count()
    return n.agg(F.count("*").alias("components"), F.max("count").alias("largest"), F.round(F.max("count") / F.sum("count"), 6).alias("share"))


def snap_points_main(spark, d):
    out = Chain(spark, d).at
    return out.select("point_id", r("snap_dist_m", 4), r("snap_min", 5))


def sssp_drive(spark, d):
    return Chain(spark, d).paths("drive", False).select("node_id", r("dist"))


def sssp_walk(spark, d):
    return Chain(spark, d).paths("walk", False).select("node_id", r("dist"))


def drive_tree(spark, d):
    """For every node that a place reaches by car: the place's node, and the node before it on the way."""
    return Chain(spark, d).paths("drive", False).select("node_id", r("dist"), "source", "pred")


def nearest_places(spark, d):
    """The name of the nearest place of every point, by car and on foot."""
    k = Chain(spark, d)
    name = lambda m: k.access(m).select("point_id", f"{m}_nearest_facility")
    return name("drive").join(name("walk"), "point_id")


# --- scenarios


def baseline_drive(spark, d):
    return Chain(spark, d).access("drive").select("point_id", r("drive_time_min", 5), "drive_class")


def baseline_walk(spark, d):
    return Chain(spark, d).access("walk").select("point_id", r("walk_time_min", 5), "walk_class")


def access_gap(spark, d):
    k = Chain(spark, d)
    both = k.access("drive").join(k.access("walk"), "point_id")
    return both.select("point_id", (c.class_rank(F.col("walk_class")) - c.class_rank(F.col("drive_class"))).alias("access_gap"))


def baseline_by_points(spark, d):
    return report.value_counts(Chain(spark, d).access("drive"), "drive_class").select("drive_class", "n", r("share"))


def baseline_by_population(spark, d):
    """People by travel-time class, by car."""
    k = Chain(spark, d)
    return report.sums_by(k.access("drive").join(k.people(), "point_id"), "drive_class", "population").select("drive_class", r("total", 3), r("share"))


def flooded_roads(spark, d):
    wet = edges(spark, d).withColumn("severity", c.severity(F.col("flood_depth_m"))).filter("severity is not null")
    return wet.select("edge_id", "source", F.round("flood_depth_m", 6).alias("depth_m"), "severity", ((F.col("ax") + F.col("bx")) / 2).alias("mid_x"), ((F.col("ay") + F.col("by")) / 2).alias("mid_y"))


def severity_counts(spark, d):
    e = edges(spark, d).withColumn("severity", c.severity(F.col("flood_depth_m")))
    return e.groupBy("severity").agg(F.count("*").alias("n"), F.round(F.avg("flood_depth_m"), 6).alias("mean_depth"))


def penalized_drive(spark, d):
    return scenario.flooded(edges(spark, d), "drive").select("src", "dst", r("w"))


def penalized_walk(spark, d):
    return scenario.flooded(edges(spark, d), "walk").select("src", "dst", r("w"))


def flood_drive(spark, d):
    return Chain(spark, d).paths("drive", True).select("node_id", r("dist"))


def flood_walk(spark, d):
    return Chain(spark, d).paths("walk", True).select("node_id", r("dist"))


def flood_delta(spark, d):
    k = Chain(spark, d)
    a = k.compared("drive").select("point_id", "drive_flood_delta", "newly_cutoff_drive")
    return a.join(k.compared("walk").select("point_id", "walk_flood_delta", "newly_cutoff_walk"), "point_id")


def newly_cutoff_summary(spark, d):
    k = Chain(spark, d)
    parts = [k.compared(m).join(k.people(), "point_id").filter(f"newly_cutoff_{m}").agg(F.lit(m).alias("mode"), F.count("*").alias("points"), F.coalesce(F.sum(F.when(~F.isnan("population"), F.col("population"))), F.lit(0.0)).alias("people")) for m in ("drive", "walk")]
    return parts[0].unionByName(parts[1]).select("mode", "points", r("people", 3))


def combined_status_drive(spark, d):
    return Chain(spark, d).compared("drive").select("point_id", "status")


def combined_status_walk(spark, d):
    return Chain(spark, d).compared("walk").select("point_id", "status")


def combined_status_population(spark, d):
    k = Chain(spark, d)
    return report.sums_by(k.compared("drive").join(k.people(), "point_id"), "status", "population").select("status", r("total", 3), r("share"))


def _picks(k: Chain):
    """Cases of every listed district."""
    return scenario.case_picks(k.compared("drive").join(k.people(), "point_id"), "point_id", load(k.spark, k.d, "district_reference").select("district"))


def case_picks(spark, d):
    return _picks(Chain(spark, d)).select("kind", "point_id", "district", r("population", 3), "case_label")


def case_routes(spark, d):
    k = Chain(spark, d)
    lines, _ = scenario.route_parts(_picks(k), k.at, "point_id", k.paths("drive", False), k.nodes, k.edges)
    return lines.select("case", r("baseline_dist_km", 4), "n_flooded_segments_on_route", "n_nodes")


def case_route_cuts(spark, d):
    k = Chain(spark, d)
    _, cuts = scenario.route_parts(_picks(k), k.at, "point_id", k.paths("drive", False), k.nodes, k.edges)
    return cuts.select("case", "seq", r("depth_m"), r("x", 3), r("y", 3))


# --- reports over the shipped results


def shipped_status(spark, d):
    """People by combined status over the delivered flood results, the latest delivery of each point and run."""
    f = load(spark, d, "flood_accessibility")
    cols = ["population", "newly_cutoff_drive", "drive_base_min", "drive_flood_time_min", "drive_base_class", "drive_flood_class"]
    last = f.groupBy("run_id", "point_id").agg(F.max(F.struct("loaded_at", *cols)).alias("s")).select("run_id", "s.*")
    return last.withColumn("status", scenario.status(last, "drive")).groupBy("run_id", "status").agg(F.count("*").alias("points"), F.round(F.coalesce(F.sum(F.when(~F.isnan("population"), F.col("population"))), F.lit(0.0)), 3).alias("people"))


def shipped_classes(spark, d):
    b = load(spark, d, "baseline_accessibility")
    return b.groupBy("run_date", "drive_class").agg(F.count("*").alias("n"), F.count_if(c.finite(F.col("drive_time_min"))).alias("reachable"), F.count_if(c.time_class(F.col("drive_time_min")) == F.col("drive_class")).alias("agree"))


QUERIES = [
    xyz_cells, zonal_population, zonal_cells, census_first_match, census_own_rows, census_crosswalk, calibrated_cells, calibration_sums, grid_points_5km, points_within_district, utm_of_facilities, degrees_of_points,
    raster_at_edges, facility_classify, facility_reason_counts, ring_segments, ring_graph, road_graph, road_union, road_class_counts, road_speed_minutes, edge_directed_sum,
    drive_edges, drive_edges_fastest, walk_edges, components, main_component_share, snap_points_main, sssp_drive, sssp_walk, drive_tree, nearest_places, baseline_drive, baseline_walk, access_gap,
    baseline_by_points, baseline_by_population, flooded_roads, severity_counts, penalized_drive, penalized_walk, flood_drive, flood_walk, flood_delta, newly_cutoff_summary,
    combined_status_drive, combined_status_walk, combined_status_population, case_picks, case_routes, case_route_cuts, shipped_status, shipped_classes,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
