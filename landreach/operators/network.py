"""From lines to a weighted, undirected graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def snapped(v: Column, tolerance: float) -> Column:
    """The nearest multiple of the tolerance, halves to the even one."""
    return F.rint(v / tolerance) * tolerance


def segments(lines: DataFrame, key: list[str], shape: str) -> DataFrame:
    """``key..., seq, ax, ay, bx, by``: the pairs of neighbouring vertices of each line (an array of x, y), without a shuffle.

    Null, empty and single-vertex lines give none.
    """
    pairs = F.zip_with(F.slice(shape, F.lit(1), F.greatest(F.size(shape) - 1, F.lit(0))), F.slice(shape, F.lit(2), F.greatest(F.size(shape) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    rows = lines.filter(F.size(shape) > 1).select(*key, F.posexplode(pairs).alias("seq", "s"))
    return rows.select(*key, "seq", F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by"))


def ends_of(segs: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """All segments with ``a, b``, the ids of their snapped ends, which may be one node.

    An id is made from the snapped place itself, so it needs no numbering over
    the cluster and is the same in every run.
    """
    node = lambda x, y: (snapped(F.col(x), tolerance) / tolerance).cast("long") * F.lit(1 << 31) + (snapped(F.col(y), tolerance) / tolerance).cast("long")
    return segs.withColumns({"a": node("ax", "ay"), "b": node("bx", "by")})


def edges_of(segs: DataFrame, keep: list[str], tolerance: float = 5.0) -> DataFrame:
    """Segments with ``a, b`` (ids of their snapped ends) and ``length_m`` (between the ends as given).

    Segments that fall onto one node, or have no length, give no edge; their
    nodes are among those of ``ends_of``.
    """
    out = ends_of(segs, tolerance).withColumn("length_m", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    return out.filter("a <> b and length_m > 0").select(*keep, "a", "b", "ax", "ay", "bx", "by", "length_m")


def minutes(length_m: Column, kmh: Column | float) -> Column:
    return length_m / 1000.0 / kmh * 60.0


def speed(source: Column, speeds: dict[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in speeds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(default))


def directed(edges: DataFrame, weight: str, parallel: str = "sum") -> DataFrame:
    """``a, b, w``: parallel edges of one direction summed, or the least of them."""
    agg = {"sum": F.sum, "min": F.min}[parallel]
    return edges.filter(F.col(weight).isNotNull()).groupBy("a", "b").agg(agg(weight).alias("w"))


def undirected(edges: DataFrame, weight: str, parallel: str = "sum_max") -> DataFrame:
    """``src, dst, w`` in both directions.

    ``sum_max``: parallel edges of a direction add up, and the slower direction
    holds for both; ``min``: the fastest of all. Edges of null weight, with a
    null end or from a node to itself are left out.
    """
    one = directed(edges.filter("a is not null and b is not null and a <> b"), weight, "min" if parallel == "min" else "sum")
    both = one.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))))
    return both.groupBy("src", "dst").agg((F.min if parallel == "min" else F.max)("w").alias("w"))


def nodes(edges: DataFrame) -> DataFrame:
    """``node_id, x, y`` of every end that has an id and a place; isolated ends are nodes too."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(n).alias("node_id"), F.col(f"{n}x").alias("x"), F.col(f"{n}y").alias("y")) for n in ("a", "b")])))
    return ends.filter("node_id is not null").groupBy("node_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
