"""The steps of the chain over files, as functions and on the command line (``python -m landreach STEP --option value``).

Steps hand tables on as Parquet; GeoPackage, GeoTIFF and CSV are written where a
step's result is meant for other programs.
"""

from __future__ import annotations

import argparse
import inspect
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landreach.functions import classify as c
from landreach.functions.crs import utm_forward, utm_inverse
from landreach.operators import graph, network, raster, report, scenario, spatial
from landreach.session import Scratch, get_spark
from landreach.sources import formats

#: Names of districts that the census writes otherwise, and districts that share one census total.
CROSSWALK = {"Centenary/ Muzarabani": "Muzarabani District", "Kadoma Urban": "Kadoma District"}
JOINT = [["Harare", "Harare Rural"]]
#: Names of districts whose own census row is written otherwise.
RESPELT = {"Chirumhanzu": "Chirumanzu", "Shurugwi Town": "Shurugwi Urban", "Harare": "Harare Urban"}
#: The districts of the case studies, and the layers of major roads.
CASES = ["Centenary/ Muzarabani", "Kariba", "Chipinge", "Binga", "Tsholotsho"]
MAJOR = {"highway_trunk_Zimbabwe_8b7797": "osm_trunk", "highway_primary_Zimbabwe_e9267f": "osm_primary", "highway_secondary_Zimbabwe_820beb": "osm_secondary"}


def _point(x: str, y: str):
    """Geometry columns of a point."""
    return F.lit("Point").alias("geometry_type"), F.array(F.array(F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))).alias("parts")


def census_of(districts: DataFrame, census: DataFrame, name: str, field: str, total: str, crosswalk: dict[str, str], joint: list[list[str]], order: Column | str | None = None, match: str = "first_substring") -> DataFrame:
    """``ord, group_id, n, census``: for each district the census row it takes its total from; a group takes its head's.

    ``first_substring``: the first row, by ``order`` (n), whose name contains the
    district's short name, case ignored. Pairs are found by an equi-join: a name
    that contains a text contains its rarest run of three letters (or the whole
    text, if that is shorter), so each text is looked up by that run alone and
    then compared. ``crosswalk``: the row of exactly that name, of the name with
    " District", or, for a name that isn't urban, with " Rural District", in this
    order; names that the list writes otherwise are in RESPELT.
    """
    head = {m: g[0] for g in joint for m in g}
    table = lambda d, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in d.items() for x in pair]), key) if d else F.lit(None).cast("string")
    grouped = districts.select("ord", F.col(name).alias("name"), F.coalesce(table(head, F.col(name)), F.col(name)).alias("group_id"), table(head, F.col(name)).isNotNull().alias("joined")).filter("name is not null")
    rows = census.filter(F.col(field).isNotNull()).select(F.lower(field).alias("held"), F.col(total).cast("double").alias("census"), (F.monotonically_increasing_id() if order is None else F.col(order) if isinstance(order, str) else order).alias("n"))
    if match == "crosswalk":
        base = F.lower(F.coalesce(table(RESPELT, F.col("group_id")), F.regexp_replace("group_id", " District$", "")))
        forms = [base, F.concat(base, F.lit(" district")), F.when(~F.contains(base, F.lit(" urban")), F.concat(base, F.lit(" rural district")))]
        tried = grouped.select("ord", "group_id", F.posexplode(F.array(*forms)).alias("place", "held")).filter("held is not null")
        best = F.min(F.struct("place", "n", "census")).alias("b")
        return tried.join(rows, "held").groupBy("ord", "group_id").agg(best).select("ord", "group_id", "b.n", "b.census")
    spelt = F.coalesce(table(crosswalk, F.col("group_id")), F.col("group_id"))
    short = F.trim(F.replace(F.replace(F.replace(spelt, F.lit(" District"), F.lit("")), F.lit(" Urban"), F.lit("")), F.lit(" Rural"), F.lit("")))
    texts = grouped.select("ord", "group_id", F.lower(F.when(F.col("joined"), spelt).otherwise(short)).alias("text"))
    runs = lambda c, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(k)))
    every = F.array_distinct(F.flatten(F.array(*[runs(F.col("held"), k) for k in (1, 2, 3)])))
    grams = rows.select("held").distinct().select("held", F.explode(every).alias("gram"))
    often = grams.groupBy("gram").count()
    own = texts.select("text").distinct().select("text", F.explode(F.array_distinct(F.when(F.length("text") < 3, F.array("text")).otherwise(runs(F.col("text"), 3)))).alias("gram"))
    rarest = own.join(often, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram")).alias("g")).select("text", "g.gram")
    met = rarest.join(grams, "gram").filter(F.contains("held", "text")).select("text", "held")
    hits = texts.join(met, "text").join(rows, "held")
    return hits.groupBy("ord", "group_id").agg(F.min("n").alias("n"), F.min_by("census", "n").alias("census"))


def prepare_population(spark: SparkSession, xyz: str, districts: str, census: str, out_raster: str, out_summary: str, cell_size_deg: float = 1 / 120, district_name_field: str = "shapeName", census_district_field: str = "district", census_population_field: str = "total", match: str = "first_substring") -> DataFrame:
    """Scales a population raster to the census, district by district; writes the raster and the summary, and says what doesn't fit.

    ``match``: first_substring or crosswalk, see ``census_of``.
    """
    table = formats.read_csv(spark, xyz)
    numbers = raster.xyz(table.select(*[F.col(x).try_cast("double").alias(x) for x in table.columns])).withColumn("n", F.monotonically_increasing_id())
    cells, grid = raster.to_cells(numbers, "n", cell_size_deg)
    scratch = Scratch(spark, "population")
    at = scratch.save(raster.to_points(cells, grid).withColumn("cell_id", F.col("row").cast("long") * (1 << 31) + F.col("col")))
    shapes = formats.read_geojson(spark, districts, district_name_field)
    member = raster.cells_in_regions(grid, shapes, "ord", "rings").withColumnRenamed("region_id", "district_ord")
    listed = formats.read_csv(spark, census)
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())  # as the file has them, however it was split
    totals = scratch.save(census_of(shapes, listed, district_name_field, census_district_field, census_population_field, CROSSWALK, JOINT, order, match).drop("n").withColumnRenamed("ord", "district_ord"))
    scaled, summary = raster.calibrate(at.select("cell_id", "value"), scratch.save(member), totals)
    scaled = scratch.save(scaled)
    done = scaled.select(F.shiftright("cell_id", 31).cast("int").alias("row"), F.col("cell_id").bitwiseAND((1 << 31) - 1).cast("int").alias("col"), F.col("calibrated").alias("value"))
    formats.write_tiff(done, grid, out_raster)
    named = shapes.select(F.col("ord").alias("district_ord"), F.col(district_name_field).alias("district")).join(summary, "district_ord")
    named = named.filter(~F.col("district").isin([m for g in JOINT for m in g]) | (F.col("group_modeled") > 0))  # a joint group without people has no factor and no row
    result = named.select("district", F.col("modeled").alias("worldpop_2020_modeled"), F.col("census").alias("census_2022"), F.col("factor").alias("calibration_factor"), F.col("n_cells").alias("n_worldpop_cells"))
    formats.write_csv(result.coalesce(1), out_summary)
    _said("districts without a census row", shapes.select(F.col("ord").alias("district_ord"), district_name_field).join(totals, "district_ord", "left_anti").select(district_name_field))
    _said("factors far from 1", result.filter("calibration_factor > 2 or calibration_factor < 0.5").select("district", "calibration_factor"))
    _said("sum of cells and of totals", calibration_sums(scaled, totals))
    return result


def calibration_sums(scaled: DataFrame, totals: DataFrame) -> DataFrame:
    """``calibrated, target``: the sum of the scaled cells, and of the totals, each group's once."""
    target = totals.groupBy("group_id").agg(F.min("census").alias("census")).agg(F.coalesce(F.sum("census"), F.lit(0.0)).alias("target"))
    return scaled.agg(F.coalesce(F.sum("calibrated"), F.lit(0.0)).alias("calibrated")).join(target)  # one row each


def _said(what: str, df: DataFrame) -> None:
    print(f"{what}:")
    df.show(100, truncate=False)


def shipped_names(summary: DataFrame) -> DataFrame:
    """A summary under the column names of the delivered file."""
    return summary.select("district", F.col("worldpop_2020_modeled").alias("modeled_2020"), F.col("census_2022").alias("census_2022_total"), F.col("calibration_factor").alias("calib_factor"), F.lit("census_2022_district").alias("source"))


def filter_facilities(spark: SparkSession, facilities_csv: str, out_gpkg: str, out_all_csv: str, out_excluded_csv: str) -> DataFrame:
    """Classifies the facility list; writes all rows, the excluded ones, and the included ones as points in metres."""
    df = formats.read_facilities(spark, facilities_csv)
    for col in ("NAMEOFFACI", "OWNERSHIP", "COMMENTS", "LONGITUDE", "LATITUDE"):
        if col not in df.columns:
            df = df.withColumn(col, F.lit(None).cast("string"))
    status = c.place_status(F.col("NAMEOFFACI"), F.col("OWNERSHIP"), F.col("COMMENTS"), c.number(F.col("LONGITUDE")), c.number(F.col("LATITUDE")))
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in c.REASONS.items() for x in pair]), status)
    done = df.withColumns({"included": status == "included", "exclusion_reason": reason, "ownership_category": c.ownership(F.col("OWNERSHIP"))})
    formats.write_csv(done, out_all_csv)
    formats.write_csv(done.filter("not included"), out_excluded_csv)
    x, y = utm_forward(c.number(F.col("LONGITUDE")), c.number(F.col("LATITUDE")))
    kept = done.filter("included").withColumns({"x": x, "y": y})
    formats.write_layers({"health_facilities": kept.select(*done.columns, *_point("x", "y"))}, out_gpkg)
    return done


def build_points(spark: SparkSession, raster_tif: str, districts: str, out: str, grid_size_m: float = 5000.0, district_name_field: str = "shapeName", weighted: bool = False, dedupe_districts: bool = False, out_gpkg: str = "") -> DataFrame:
    """The raster's people on a coarse grid of points, each with its district, or with one row for each of several (with ``dedupe_districts`` the first)."""
    formats.register(spark)
    cells = raster.to_points(spark.read.format("geotiff").load(raster_tif), formats.tiff_grid(raster_tif))
    x, y = utm_forward(F.col("x"), F.col("y"))
    scratch = Scratch(spark, "points")
    at = scratch.save(cells.select("value", x.alias("x"), y.alias("y")))
    grid = raster.aggregate_to_grid(at, "value", grid_size_m, weighted).withColumn("point_id", F.xxhash64("gx", "gy"))
    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    grid = scratch.save(grid.withColumns({"lon": lon, "lat": lat}))
    shapes = formats.read_geojson(spark, districts, district_name_field)
    named = spatial.with_region(grid, "point_id", "lon", "lat", shapes, "ord", "rings", district_name_field)
    if dedupe_districts:
        named = named.groupBy("point_id", "population", "n_source_cells", "x", "y").agg(F.min_by(district_name_field, "ord").alias(district_name_field))
    done = named.select("point_id", "population", F.col(district_name_field).alias("district"), "n_source_cells", "x", "y")
    done.write.mode("overwrite").parquet(out)
    return _layer(spark.read.parquet(out), out_gpkg, "population_points")


def _layer(df: DataFrame, out_gpkg: str, layer: str) -> DataFrame:
    """The same rows; a layer of points of them is written if a file is named."""
    if out_gpkg:
        formats.write_layers({layer: df.select("*", *_point("x", "y"))}, out_gpkg)
    return df


def build_roads(spark: SparkSession, osm_major: str, osm_tertiary: str, osm_unclassified: str, wfp_roads: str, out: str, out_gpkg: str = "") -> DataFrame:
    """All road sources under one column of classes, in metres whatever frame each declares; empty shapes left out."""
    formats.register(spark)
    parts = [formats.in_metres(formats.read_layers(spark, osm_major, MAJOR), formats.srid_of(osm_major, next((x for x in MAJOR if x in formats.layers(osm_major)), None)))]
    for path, label in ((osm_tertiary, "osm_tertiary"), (osm_unclassified, "osm_unclassified")):
        parts.append(formats.in_metres(spark.read.format("gpkg").load(path).select(F.lit(label).alias("source"), "geometry_type", "parts"), formats.srid_of(path)))
    label = F.when(F.col("F_CODE_DES") == "Trail", "zwe_roads_Trail").otherwise("zwe_roads_Road")
    parts.append(formats.in_metres(spark.read.format("shapefile").load(wfp_roads).select(label.alias("source"), "geometry_type", "parts"), formats.srid_of(wfp_roads)))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    lines = merged.filter("parts is not null and size(parts) > 0").withColumn("road", F.monotonically_increasing_id()).select("road", "source", F.posexplode("parts").alias("part", "p")).select("road", "source", "part", F.col("p")[0].alias("shape"))

    lines.filter("size(shape) > 0").write.mode("overwrite").parquet(out)
    done = spark.read.parquet(out)
    if out_gpkg:
        formats.write_layers({"road_network": done.select("source", F.lit("LineString").alias("geometry_type"), F.array(F.array("shape")).alias("parts"))}, out_gpkg)
    return done


def _roads(spark: SparkSession, roads: str, fallback: str) -> DataFrame:
    """``road, source, part, shape`` from the step before, or from GeoPackages by pattern, in the order of their names, or else from the one given instead."""
    if not roads.endswith(".gpkg"):
        return spark.read.parquet(roads)
    formats.register(spark)
    merged = formats.read_parts(spark, roads, fallback, formats.metres_of)
    lines = merged.filter("parts is not null and size(parts) > 0").withColumn("road", F.monotonically_increasing_id())
    return lines.select("road", "source", F.posexplode("parts").alias("part", "p")).select("road", "source", "part", F.col("p")[0].alias("shape"))


def build_graph(spark: SparkSession, roads: str, out_dir: str, snap_tolerance_m: float = 5.0, fallback: str = "") -> DataFrame:
    """Edges with driving and walking minutes, nodes, each mode's graph, and the main piece of the network.

    ``roads`` is what build-roads wrote, or a pattern of GeoPackages, with ``fallback`` if nothing matches.
    """
    segs = network.segments(_roads(spark, roads, fallback), ["road", "source", "part"], "shape")
    e = network.edges_of(segs, ["source"], snap_tolerance_m)
    e = e.withColumns({"edge_id": F.monotonically_increasing_id(), "minutes": network.minutes(F.col("length_m"), network.speed(F.col("source"), c.SPEED_KMH, c.DEFAULT_KMH)), "walk_minutes": network.minutes(F.col("length_m"), c.WALK_KMH)})
    e.write.mode("overwrite").parquet(f"{out_dir}/edges")
    e = spark.read.parquet(f"{out_dir}/edges")
    ends = network.ends_of(segs, snap_tolerance_m)  # the node of a segment that gives no edge is a node, and a piece of its own
    network.nodes(ends).withColumns({"x": network.snapped(F.col("x"), snap_tolerance_m), "y": network.snapped(F.col("y"), snap_tolerance_m)}).write.mode("overwrite").parquet(f"{out_dir}/nodes")
    for mode, w in (("drive", "minutes"), ("walk", "walk_minutes")):
        network.undirected(e, w).write.mode("overwrite").parquet(f"{out_dir}/graph_{mode}")
    labels = Scratch(spark, "graph").save(graph.components(ends))
    graph.main_component(labels).write.mode("overwrite").parquet(f"{out_dir}/main")
    sizes = labels.groupBy("component").count()
    _said("pieces of the network", sizes.agg(F.count("*").alias("pieces"), F.max("count").alias("largest"), (F.max("count") / F.sum("count")).alias("share")))
    return e


class _Net:
    """What the later steps share: the graph, and the points and facilities on its main piece."""

    def __init__(self, spark: SparkSession, graph_dir: str, points: str, facilities: str):
        formats.register(spark)
        read = spark.read.parquet
        self.edges, self.nodes, self.main = (read(f"{graph_dir}/{n}") for n in ("edges", "nodes", "main"))
        self.points = read(points)
        raw = spark.read.format("gpkg").load(facilities)
        label = "NAMEOFFACI" if "NAMEOFFACI" in raw.columns else raw.columns[0]
        place = F.col("parts")[0][0][0]
        self.places = Scratch(spark, "places").save(raw.select(F.monotonically_increasing_id().alias("fid"), F.col(label).cast("string").alias("name"), place["x"].alias("x"), place["y"].alias("y")))
        scratch = Scratch(spark, "net")
        self.at, self.places_at = (scratch.save(scenario.snap(df, key, self.nodes, self.main)) for df, key in ((self.points, "point_id"), (self.places, "fid")))
        self.names = scenario.place_names(self.places_at, self.places.select("fid", "name"), "fid")

    def tree(self, g: DataFrame) -> DataFrame:
        return graph.shortest_paths(g, self.places_at.select("node_id"), places=self.nodes)


def baseline(spark: SparkSession, graph_dir: str, points: str, facilities: str, out: str, out_gpkg: str = "") -> DataFrame:
    """Travel time, class and nearest facility of every point, by car and on foot; the search trees are kept for routes."""
    net, out_df = _Net(spark, graph_dir, points, facilities), None
    for mode in ("drive", "walk"):
        net.tree(spark.read.parquet(f"{graph_dir}/graph_{mode}")).write.mode("overwrite").parquet(f"{graph_dir}/baseline_{mode}")
        got = scenario.access(net.points, "point_id", net.at, spark.read.parquet(f"{graph_dir}/baseline_{mode}"), net.names, mode)
        out_df = got if out_df is None else out_df.join(got, "point_id")
    done = out_df.join(net.at.select("point_id", "snap_dist_m"), "point_id").join(net.points.select("point_id", "population", "district", "x", "y"), "point_id")
    done.withColumn("access_gap", c.class_rank(F.col("walk_class")) - c.class_rank(F.col("drive_class"))).write.mode("overwrite").parquet(out)
    return _layer(spark.read.parquet(out), out_gpkg, "baseline_accessibility")


def flood(spark: SparkSession, graph_dir: str, flood_raster: str, points: str, facilities: str, baseline: str, out: str, out_roads: str, out_gpkg: str = "") -> DataFrame:
    """The same under a flood: depths at the edges' midpoints, slower or closed roads, and the change of every point."""
    net, grid = _Net(spark, graph_dir, points, facilities), formats.tiff_grid(flood_raster)
    cells = spark.read.format("geotiff").load(flood_raster)
    lon, lat = utm_inverse((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    wet = raster.sample(net.edges.withColumns({"lon": lon, "lat": lat}), "lon", "lat", cells, grid, None, "flood_depth_m").drop("lon", "lat")
    wet.write.mode("overwrite").parquet(f"{graph_dir}/flooded_edges")
    wet = spark.read.parquet(f"{graph_dir}/flooded_edges")
    line = F.array(F.array(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))))
    roads = wet.withColumn("severity", c.severity(F.col("flood_depth_m"))).filter("severity is not null")
    formats.write_layers({"flooded_roads": roads.select("source", F.col("flood_depth_m").alias("depth_m"), "severity", F.lit("LineString").alias("geometry_type"), line.alias("parts"))}, out_roads)
    base, out_df = spark.read.parquet(baseline), None
    for mode in ("drive", "walk"):
        net.tree(scenario.flooded(wet, mode)).write.mode("overwrite").parquet(f"{graph_dir}/flood_{mode}")
        got = scenario.compare(base, scenario.access(net.points, "point_id", net.at, spark.read.parquet(f"{graph_dir}/flood_{mode}"), net.names, mode), "point_id", mode)
        out_df = got if out_df is None else out_df.join(got, "point_id")
    out_df.join(net.points.select("point_id", "population", "district", "x", "y"), "point_id").write.mode("overwrite").parquet(out)
    _said("flooded roads", wet.agg(F.count("flood_depth_m").alias("edges"), F.round(100 * F.count("flood_depth_m") / F.count("*"), 2).alias("percent"), F.avg("flood_depth_m").alias("mean_depth_m")))
    return _layer(spark.read.parquet(out), out_gpkg, "flood_accessibility")


def combined_status(spark: SparkSession, flood: str, out: str, out_gpkg: str = "") -> DataFrame:
    """One status per point and mode, from both scenarios."""
    df = spark.read.parquet(flood)
    keep = [x for x in ("point_id", "population", "district", "x", "y") if x in df.columns]
    done = df.select(*keep, *[e for m in ("drive", "walk") for e in (scenario.status(df, m).alias(f"{m}_combined_status"), F.col(f"{m}_base_min"), F.col(f"{m}_flood_time_min"))])
    done.write.mode("overwrite").parquet(out)
    return _layer(spark.read.parquet(out), out_gpkg, "combined_status")


def case_studies(spark: SparkSession, graph_dir: str, flood: str, points: str, facilities: str, out: str, districts: str = "", min_depth: float = 0.0) -> DataFrame:
    """Routes of the case studies, by car and on foot, and where the flood cuts them: four layers of one file.

    A cut counts from ``min_depth`` metres on; by default every depth does.
    """
    net, df = _Net(spark, graph_dir, points, facilities), spark.read.parquet(flood)
    named = [x for x in districts.split("|") if x] or CASES
    picks = Scratch(spark, "cases").save(scenario.case_picks(df, "point_id", spark.createDataFrame([(n,) for n in named], "district string")))
    edges, layers, out_df = spark.read.parquet(f"{graph_dir}/flooded_edges"), {}, None
    for mode in ("drive", "walk"):
        tree = spark.read.parquet(f"{graph_dir}/baseline_{mode}")
        lines, cuts = scenario.route_parts(picks, net.at, "point_id", tree, net.nodes, edges, min_depth or None)
        way = graph.routes(tree, picks.join(net.at, "point_id").select(F.col("case_label").alias("case"), "node_id")).join(net.nodes, "node_id")
        shape = way.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))  # one route's nodes
        shape = shape.select("case", F.when(F.size("v") > 1, F.lit("LineString")).alias("geometry_type"), F.when(F.size("v") > 1, F.array(F.array(F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))).alias("parts"))
        facts = picks.join(df.select("point_id", F.col(f"{mode}_base_fac").alias("nearest_facility"), F.col(f"{mode}_base_min").alias("baseline_time_min")), "point_id")
        got = facts.select(F.col("case_label").alias("case"), "district", F.col("population").alias("population_at_point"), "nearest_facility", "baseline_time_min").join(lines, "case", "left").join(shape, "case", "left")
        tail = "" if mode == "drive" else "_walk"
        layers[f"case_study_routes{tail}"] = got.withColumnRenamed("case", "case_label").drop("n_nodes")
        layers[f"case_study_flood_cuts{tail}"] = cuts.select(F.col("case").alias("case_label"), "depth_m", *_point("x", "y"))
        out_df = got.withColumn("mode", F.lit(mode)) if out_df is None else out_df.unionByName(got.withColumn("mode", F.lit(mode)))
    formats.write_layers(layers, out)
    return out_df


def reports(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """What is printed at the end of a step: points and people by a column."""
    order = c.CLASSES if column.endswith("_class") else None
    out = {"points": report.value_counts(df, column, order)}
    if "population" in df.columns:
        out["people"] = report.sums_by(df, column, "population", order)
    return out


STEPS = {f.__name__.replace("_", "-"): f for f in (prepare_population, filter_facilities, build_points, build_roads, build_graph, baseline, flood, combined_status, case_studies)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="landreach", description=__doc__)
    sub = parser.add_subparsers(dest="step", required=True)
    for name, f in STEPS.items():
        p = sub.add_parser(name, help=(f.__doc__ or "").strip().split("\n")[0])
        for k, v in list(inspect.signature(f).parameters.items())[1:]:
            kind = {"float": float, "bool": lambda s: s.lower() in ("1", "true", "yes")}.get(str(v.annotation), str)
            p.add_argument(f"--{k.replace('_', '-')}", type=kind, required=v.default is v.empty, default=None if v.default is v.empty else v.default)
    args = vars(parser.parse_args(argv))
    step = STEPS[args.pop("step")]
    for k, v in args.items():
        if k.startswith("out") and v and "://" not in v:
            Path(v).parent.mkdir(parents=True, exist_ok=True)
    df = step(SparkSession.getActiveSession() or get_spark(), **args)
    for column in ("exclusion_reason", "drive_class", "walk_class", "drive_combined_status", "walk_combined_status", "source"):
        if column in df.columns:
            for table in reports(df, column).values():
                table.show(50, truncate=False)
