"""Travel times before and under a flood, their comparison, and case studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landreach.functions import classify as c
from landreach.operators import graph, network, spatial


def snap(points: DataFrame, key: str, nodes: DataFrame, main: DataFrame) -> DataFrame:
    """``key, node_id, snap_dist_m, snap_min``: the nearest node of the main component and the walk to it."""
    near = spatial.nearest(points, key, nodes.join(main, "node_id", "left_semi"), "node_id")
    return near.select(key, "node_id", F.col("distance").alias("snap_dist_m"), network.minutes(F.col("distance"), c.WALK_KMH).alias("snap_min"))


def place_names(snapped: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``source, name``: of several places on a node the last one's name."""
    return snapped.join(names, key).groupBy(F.col("node_id").alias("source")).agg(F.max_by("name", key).alias("name"))


def access(points: DataFrame, key: str, at: DataFrame, paths: DataFrame, names: DataFrame, mode: str) -> DataFrame:
    """``key`` with the mode's time (network time plus the walk to it; +inf if unreachable), class and nearest place."""
    out = points.select(key).join(at, key).join(paths.select("node_id", "dist", "source"), "node_id", "left").join(names, "source", "left")
    t = F.coalesce(F.col("dist"), F.lit(c.INF)) + F.col("snap_min")
    return out.select(key, t.alias(f"{mode}_time_min"), c.time_class(t).alias(f"{mode}_class"), F.col("name").alias(f"{mode}_nearest_facility"))


def flooded(edges: DataFrame, mode: str, parallel: str = "sum_max") -> DataFrame:
    """The mode's graph under the flood, built anew from all edges."""
    base = "minutes" if mode == "drive" else "walk_minutes"
    hit = edges.withColumn("w", c.flood_minutes(mode, F.col(base), F.col("length_m"), F.col("flood_depth_m")))
    return network.undirected(hit, "w", parallel)


def compare(base: DataFrame, flood: DataFrame, key: str, mode: str) -> DataFrame:
    """Both scenarios of a mode side by side, the change of class, and who is newly cut off."""
    new = flood.select(key, *[F.col(f"{mode}_{a}").alias(f"{mode}_flood_{b}") for a, b in (("time_min", "time_min"), ("class", "class"), ("nearest_facility", "nearest_fac"))])
    old = base.select(key, *[F.col(f"{mode}_{a}").alias(f"{mode}_base_{b}") for a, b in (("time_min", "min"), ("class", "class"), ("nearest_facility", "fac"))])
    both = old.join(new, key)
    return both.withColumns({
        f"{mode}_flood_delta": c.class_rank(F.col(f"{mode}_flood_class")) - c.class_rank(F.col(f"{mode}_base_class")),
        f"newly_cutoff_{mode}": c.finite(F.col(f"{mode}_base_min")) & ~c.finite(F.col(f"{mode}_flood_time_min")),
    })


def status(df: DataFrame, mode: str) -> Column:
    return c.combined_status(*[F.col(x) for x in (f"newly_cutoff_{mode}", f"{mode}_base_min", f"{mode}_flood_time_min", f"{mode}_base_class", f"{mode}_flood_class")])


def case_picks(df: DataFrame, key: str, districts: DataFrame) -> DataFrame:
    """In each named district the newly cut off point of most people, and one more, well served before, from anywhere else.

    Null and NaN populations aren't picked; of equal ones the least key is. A
    point without a district may be the extra one. ``districts`` is a table of
    names, in ``district``, of any length. Each group keeps one row by a partial
    aggregation, whatever its size.
    """
    known = districts.select(F.col("district")).filter("district is not null").distinct()
    cut = df.filter(F.col("newly_cutoff_drive") & F.col("population").isNotNull() & ~F.isnan("population"))
    first = F.min_by(F.struct(key, "district", "population"), F.struct(-F.col("population"), F.col(key))).alias("r")
    named = cut.join(known, "district", "left_semi").groupBy("district").agg(first).select(F.lit("case").alias("kind"), "r.*")
    other = cut.filter(F.col("drive_base_class") == c.CLASSES[0]).join(known, "district", "left_anti")
    extra = other.agg(first).filter("r is not null").select(F.lit("surprise").alias("kind"), "r.*")
    label = F.concat(F.coalesce("district", F.lit("None")), F.when(F.col("kind") == "surprise", " (surprise)").otherwise(""))
    return named.unionByName(extra).withColumn("case_label", label)


def route_parts(picks: DataFrame, at: DataFrame, key: str, tree: DataFrame, nodes: DataFrame, edges: DataFrame, min_depth: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Each case's route (length, number of flooded segments) and the places where it is cut.

    The edge between two nodes is the last stored one in the route's direction,
    or else the last in the other. With ``min_depth`` only depths from there on
    count as flooded.
    """
    starts = picks.join(at, key).select(F.col("case_label").alias("case"), "node_id")
    way = graph.routes(tree, starts).join(nodes, "node_id")
    w = Window.partitionBy("case").orderBy("seq")  # one window per route
    hops = way.withColumns({n: F.lead(m).over(w) for n, m in (("to", "node_id"), ("tx", "x"), ("ty", "y"))}).filter("`to` is not null")
    hops = hops.withColumns({"lo": F.least("node_id", "to"), "hi": F.greatest("node_id", "to"), "hop": F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))})
    cand = edges.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    met = hops.join(cand, ["lo", "hi"], "left").groupBy("case", "seq").agg(
        F.first("hop").alias("hop"), F.max_by(F.struct("flood_depth_m", "ax", "ay", "bx", "by"), F.struct((F.col("a") == F.col("node_id")).cast("int"), "edge_id")).alias("e")
    )
    wet = c.severity(F.col("e.flood_depth_m")).isNotNull()
    met = met.withColumn("wet", wet if min_depth is None else wet & (F.col("e.flood_depth_m") >= min_depth))
    lines = met.groupBy("case").agg((F.sum("hop") / 1000).alias("baseline_dist_km"), F.count_if("wet").alias("n_flooded_segments_on_route"), (F.count("*") + 1).alias("n_nodes"))
    cuts = met.filter("wet").select("case", "seq", F.col("e.flood_depth_m").alias("depth_m"), ((F.col("e.ax") + F.col("e.bx")) / 2).alias("x"), ((F.col("e.ay") + F.col("e.by")) / 2).alias("y"))
    return lines, cuts
