"""Connected components by low-diameter decomposition.

Miller, Peng and Xu, "Parallel graph decompositions using random shifts"
(SPAA 2013): every vertex draws an exponential shift; clusters grow from the
vertices of the largest shifts, all at one hop a round, and a vertex joins the
cluster that reaches it first. Clusters contract to super-vertices, and the
edges between clusters make the next, smaller graph.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landreach.session import Scratch

#: Rounds in which clusters of one level grow, and the rate of the shifts.
ROUNDS, RATE = 4, 0.5
#: The recursion ends in one task when no more edges than this are left between clusters.
BASE_EDGES = 5_000
#: A vertex's state is one number, its time of arrival above the cluster's head; heads take so many bits.
_BITS = 56
#: Bytes of a partition, as it is shuffled, that a join may hold in a hash table; and the settings that say so.
MOST_HASHED = 64 << 20
_LOCAL_MAP, _ADVISED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _start(node: Column, level: int) -> Column:
    """The round in which a vertex starts a cluster of its own, unless one has reached it."""
    u = (F.pmod(F.xxhash64(node, F.lit(level)), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
    return F.greatest(F.lit(0), F.floor(ROUNDS + F.log(u) / RATE)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node_id, group_id`` of every distinct non-null node; group_id is the group's smallest node.

    A row with one end null links nothing, but its other end is a node; a row of
    a node to itself likewise. Repeated and turned-round rows count once. An
    empty table gives an empty result; other columns are ignored. Ids that
    don't fit in 56 bits (or are negative) are numbered anew, in their order.

    Each level takes one shuffle of its edges by source, and ROUNDS partial
    aggregations of what the sources tell their targets: a hub's links are
    combined before they are shuffled. The expected size falls by a constant
    factor a level; the last BASE_EDGES edges, a fixed bound, are decomposed by
    the same steps in one task's memory. All tables are written to the shared
    folder; only the number of edges left reaches the driver.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.col(f"`{a}`").cast("long").alias("a"), F.col(f"`{b}`").cast("long").alias("b"))
    low, high = ends.agg(F.min(F.least("a", "b")), F.max(F.greatest("a", "b"))).first()
    if low is None or (low >= 0 and high < 1 << _BITS):
        return _decompose(scratch, ends)
    nodes = ends.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()
    numbers = scratch.save(_in_order(nodes))
    named = ends.withColumn("row", F.monotonically_increasing_id())
    for end in ("a", "b"):
        named = named.join(numbers.select(F.col("id").alias(end), F.col("number").alias(f"n{end}")), end, "left")
    found = _decompose(scratch, named.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    for old, new in (("node_id", "node"), ("group_id", "group")):
        found = found.join(numbers.select(F.col("number").alias(old), F.col("id").alias(new)), old)
    return found.select(F.col("node").alias("node_id"), F.col("group").alias("group_id"))


@contextlib.contextmanager
def _hashed_where_small(spark: SparkSession) -> Iterator[None]:
    """Within: a join hashes a side whose partitions are all known to be of a size that fits a task, instead of sorting both; others are sorted, and spill."""
    old, advised = spark.conf.get(_LOCAL_MAP, None), spark.conf.get(_ADVISED, None)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    spark.conf.set(_LOCAL_MAP, f"{max(MOST_HASHED, size(advised) if advised else 0)}b")  # below the advised size of partitions it isn't looked at
    try:
        yield
    finally:
        spark.conf.set(_LOCAL_MAP, old) if old else spark.conf.unset(_LOCAL_MAP)


def _in_order(nodes: DataFrame) -> DataFrame:
    """``id, number``: numbers that rise with the ids."""
    return nodes.repartitionByRange("id").sortWithinPartitions("id").withColumn("number", F.monotonically_increasing_id())


def _part(scratch: Scratch, clusters: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clusters with an edge to another, and those without: these are whole components, and their label stands."""
    active = live.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("more", F.lit(True))
    kept = scratch.save(clusters.join(active, "id", "left"))
    return kept.filter("more").select("id", "least"), kept.filter("more is null").select("id", "least")


def _decompose(scratch: Scratch, ends: DataFrame) -> DataFrame:
    with _hashed_where_small(ends.sparkSession):
        return _levels(scratch, ends)


def _levels(scratch: Scratch, ends: DataFrame) -> DataFrame:
    pairs = ends.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    live = scratch.save(pairs)
    linked = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    nodes = ends.select(F.explode(F.array("a", "b")).alias("id"), F.when(linked, True).alias("more")).filter("id is not null").groupBy("id").agg(F.max("more").alias("more"))
    nodes = scratch.save(nodes)
    vertices, alone = (nodes.filter(f"more is {k} null").select("id", F.col("id").alias("least")) for k in ("not", ""))
    states: list[DataFrame] = []
    done = [alone]
    hop = 1 << _BITS
    while live.count() > BASE_EDGES:
        # a vertex also tells itself, which costs it no time: so the state is read once a round
        links = live.select(F.inline(F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("u", "v"), ("v", "u"))])))
        links = links.unionByName(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")))
        arrival = F.col("s") + F.when(F.col("src") == F.col("dst"), 0).otherwise(hop)
        state = vertices.select("id", (_start(F.col("id"), len(states)) * hop + F.col("id")).alias("s"))
        for _ in range(ROUNDS):
            state = links.join(state, F.col("src") == F.col("id")).groupBy("dst").agg(F.min(arrival).alias("s")).withColumnRenamed("dst", "id")
        state = scratch.save(state.select("id", F.col("s").bitwiseAND(hop - 1).alias("head")))
        states.append(state)
        of_u, of_v = state.select(F.col("id").alias("u"), F.col("head").alias("hu")), state.select(F.col("id").alias("v"), F.col("head").alias("hv"))
        crossing = live.join(of_u, "u").join(of_v, "v").filter("hu <> hv")
        nxt = scratch.save(crossing.select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v")).distinct())
        named = state.join(vertices, "id") if len(states) > 1 else state.withColumn("least", F.col("id"))
        grown = named.groupBy("head").agg(F.min("least").alias("least")).withColumnRenamed("head", "id")
        vertices, alone = _part(scratch, grown, nxt)
        done.append(alone)
        scratch.drop(live)
        live = nxt
    one = F.lit(0).alias("one")
    label = live.select(one, "u", "v").groupBy("one").cogroup(vertices.select(one, "id", "least").groupBy("one")).applyInArrow(_base, "id long, least long")
    for k in range(len(states) - 1, -1, -1):
        label = states[k].join(label.unionByName(done[k + 1]).withColumnRenamed("id", "head"), "head").select("id", "least")
    label = scratch.save(label.unionByName(done[0]).select(F.col("id").alias("node_id"), F.col("least").alias("group_id")))
    scratch.drop(live, nodes, *states)
    return label


def _base(links: pa.Table, held: pa.Table) -> pa.Table:
    """The end of the recursion: the same decomposition of at most BASE_EDGES edges, level by level, in memory."""
    ids, least = held.column("id").to_numpy(), held.column("least").to_numpy()
    order = np.argsort(ids)
    ids, least = ids[order], least[order]
    of = np.arange(len(ids))  # the cluster of each vertex, by the place of its head
    u, v = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("u", "v"))
    rng = np.random.default_rng(len(ids))
    hop = np.int64(1) << 40
    while len(u):
        start = np.maximum(0, np.floor(ROUNDS - rng.exponential(1 / RATE, len(ids)))).astype(np.int64)
        key = start * hop + np.arange(len(ids))
        for _ in range(ROUNDS):
            new = key.copy()
            np.minimum.at(new, u, key[v] + hop)
            np.minimum.at(new, v, key[u] + hop)
            key = new
        head = key & (hop - 1)
        of = head[of]
        u, v = head[u], head[v]
        apart = u != v
        pairs = np.unique(np.stack([np.minimum(u, v)[apart], np.maximum(u, v)[apart]]), axis=1)
        u, v = pairs
    label = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(label, of, least)
    return pa.table([pa.array(ids), pa.array(label[of])], names=["id", "least"])
