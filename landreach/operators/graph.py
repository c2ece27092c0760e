"""Components, shortest paths from many sources, and routes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from landreach.session import Scratch

#: Directed edges of one block of the shortest-path search, and links of one task's part in the components: a task's work.
BLOCK_EDGES, FOREST_EDGES = 500_000, 500_000
#: A block also holds the nodes around it, as far as this share of its width; what is right at a border so needs no round of its own.
MARGIN = 0.08


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of one task's links, each as a star around its least node.

    Every round hooks the greater root of each link to the least it meets, then
    halves all ways to the roots until none is left.
    """
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    ends = np.stack([np.concatenate(x) for x in zip(*parts)])
    ids, at = np.unique(ends, return_inverse=True)
    u, v = at.reshape(ends.shape)
    root = np.arange(len(ids))
    while True:
        hi, lo = np.maximum(root[u], root[v]), np.minimum(root[u], root[v])
        apart = hi != lo
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while not np.array_equal(root, up := root[root]):
            root = up
    k = np.flatnonzero(root != np.arange(len(ids)))
    yield from pa.table({"u": pa.array(ids[k]), "v": pa.array(ids[root[k]])}).to_batches(max_chunksize=100_000)


def components(edges: DataFrame) -> DataFrame:
    """``node_id, component`` (the smallest node of the piece) from ``a, b``, by large and small stars.

    Each task first folds its share of the links, of near node ids, into stars;
    one task's fold of all there is left is the result. Until then every round
    links each node's greater neighbours to its least one, and its lesser ones,
    so what is left of long chains folds in a logarithmic number of rounds.
    Rows with a null end make their other end a node.
    """
    scratch = Scratch(edges.sparkSession, "stars")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node_id")).filter("node_id is not null").distinct()
    links = scratch.save(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct())
    before = None
    while True:
        parts = max(1, math.ceil(links.count() / FOREST_EDGES))
        folded = scratch.save(links.repartitionByRange(parts, "v").mapInArrow(_forest, "u long, v long"))
        scratch.drop(links)
        links = folded
        if parts == 1:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))).filter("u <> v").distinct()
        new = scratch.save(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(links)
        links = new
        if state == before:
            break
        before = state
    return nodes.join(links.select(F.col("u").alias("node_id"), F.col("v").alias("component")), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def main_component(labels: DataFrame) -> DataFrame:
    """The nodes of the largest component; of equal ones, of that with the least label."""
    size = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return labels.join(F.broadcast(size), "component", "left_semi").select("node_id")


_PACKED = "block int, ids binary, first binary, target binary, weight binary, home binary, lent binary, holder binary"
_KINDS = {"ids": "i8", "first": "i8", "target": "i4", "weight": "f8", "home": "i4", "lent": "i4", "holder": "i4"}


def _pack(links: pa.Table) -> pa.Table:
    """One row of a block's edges: its nodes, where each node's edges begin, their targets and weights, each node's home block, and which other blocks hold nodes of its own.

    A row without a weight says the last: its node is also held by the block ``there``.
    """
    src, dst, w, here, there = (links.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "w", "here", "there"))
    own = links.column("block")[0].as_py()
    edge = ~np.isnan(w)
    ids = np.unique(np.concatenate([src, dst]))
    source, target = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    home = np.full(len(ids), own)
    home[source], home[target[edge]] = here, there[edge]
    lent, holder = source[~edge], there[~edge]
    source, target, w = source[edge], target[edge], w[edge]
    order = np.argsort(source, kind="stable")
    held = {"ids": ids, "first": np.searchsorted(source[order], np.arange(len(ids) + 1)), "target": target[order], "weight": w[order], "home": home, "lent": lent, "holder": holder}
    return pa.table({"block": pa.array([own], pa.int32()), **{k: pa.array([np.ascontiguousarray(held[k], dtype=t).tobytes()], pa.binary()) for k, t in _KINDS.items()}})


#: What is known of a block's nodes: its state after a round (told is false), or what another block has found for some of them.
_KNOWN = "block int, told boolean, ids binary, dist binary, source binary, pred binary, own binary"
_TYPES = {"ids": "i8", "dist": "f8", "source": "i8", "pred": "i8", "own": "?"}


def _known(rows: list[tuple]) -> pa.Table:
    """Rows from (block, told, ids, dist, source, pred, own)."""
    arrays = [pa.array([np.ascontiguousarray(r[k + 2], dtype=t).tobytes() for r in rows], pa.binary()) for k, t in enumerate(_TYPES.values())]
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), *arrays], names=["block", "told", *_TYPES])


def _begin(sources: pa.Table) -> pa.Table:
    """A block's sources, as if told by another block."""
    ids, first = np.unique(sources.column("node_id").to_numpy(), return_index=True)
    block = sources.column("block")[0].as_py()
    return _known([(block, True, ids, np.zeros(len(ids)), ids, np.full(len(ids), -1), sources.column("here").to_numpy()[first] == block)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states' own nodes as rows."""
    for b in batches:
        for k in range(b.num_rows):
            ids, dist, source, pred, own = (np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in _TYPES.items())
            ids, dist, source, pred = ids[own], dist[own], source[own], pred[own]
            yield from pa.table({"node_id": ids, "dist": dist, "source": source, "pred": pa.array(pred, mask=pred < 0)}).to_batches(max_chunksize=100_000)


def _search(packed: pa.Table, known: pa.Table) -> pa.Table:
    """Shortest paths within one block, from the nodes that have news, until nothing gets better.

    ``known`` holds the block's state after its last round and what other blocks
    have told it since. Out come the new state, and a row for each other block
    that is told what got better: a node's home block, of any of its nodes, and
    from the home block those that hold it too. Nodes are
    settled in steps of distance, all edges of a step at once; within a step a
    node may be settled again. Of equal distances the lesser source stands, then
    the lesser predecessor.
    """
    none = np.iinfo(np.int64).max
    node, d0, h0, p0, mine = (np.concatenate([np.frombuffer(v.as_buffer(), t) for v in known.column(c)]) for c, t in _TYPES.items())
    fresh = np.repeat(known.column("told").to_numpy().astype(bool), [len(v.as_buffer()) // 8 for v in known.column("ids")])
    ids, first, target, weight, block, lent, holder = (np.frombuffer(packed.column(k)[0].as_buffer(), t) if packed.num_rows else np.zeros(k == "first", t) for k, t in _KINDS.items())
    own = known.column("block")[0].as_py()
    lone = np.setdiff1d(node, ids)  # without edges in the block
    if len(lone):
        every = np.concatenate([ids, lone])
        order = np.argsort(every)
        place = np.argsort(order)
        ids, block = every[order], np.concatenate([block, np.where(np.isin(lone, node[mine]), own, -1)])[order]
        degree = np.concatenate([np.diff(first), np.zeros(len(lone), "i8")])[order]
        begin = np.concatenate([first[:-1], np.zeros(len(lone), "i8")])[order]
        e = np.repeat(begin - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
        first, target, weight, lent = np.r_[0, np.cumsum(degree)], place[target[e]], weight[e], place[lent]
    dist, head, pred = np.full(len(ids), np.inf), np.full(len(ids), none), np.full(len(ids), -1)
    active, changed = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    o = np.lexsort((p0, h0, d0, node))
    o = o[np.r_[True, node[o][1:] != node[o][:-1]]]
    at = np.searchsorted(ids, node[o])
    dist[at], head[at], pred[at] = d0[o], h0[o], p0[o]
    active[at[fresh[o]]] = True
    step = 4 * weight.mean() if len(weight) else 1.0
    while True:
        front = np.flatnonzero(active)
        if not len(front):
            break
        front = front[dist[front] <= dist[front].min() + step]
        active[front] = False
        degree = first[front + 1] - first[front]
        e = np.repeat(first[front] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
        t, d, h, p = target[e], np.repeat(dist[front], degree) + weight[e], np.repeat(head[front], degree), np.repeat(ids[front], degree)
        keep = d <= dist[t]
        t, d, h, p = t[keep], d[keep], h[keep], p[keep]
        o = np.lexsort((p, h, d, t))
        t, d, h, p = t[o], d[o], h[o], p[o]
        best = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
        t, d, h, p = t[best], d[best], h[best], p[best]
        nearer = (d < dist[t]) | ((d == dist[t]) & (h < head[t]))
        other = (d == dist[t]) & (h == head[t]) & (p < pred[t])
        put = nearer | other
        dist[t[put]], head[t[put]], pred[t[put]] = d[put], h[put], p[put]
        changed[t[put]] = True
        active[t[nearer]] = True
    part = lambda to, told, k: (to, told, ids[k], dist[k], head[k], pred[k], block[k] == own)
    away, shared = np.flatnonzero(changed & (block != own)), changed[lent]
    node, to = np.concatenate([away, lent[shared]]), np.concatenate([block[away], holder[shared]])
    return _known([part(own, False, np.isfinite(dist)), *[part(b, True, node[to == b]) for b in np.unique(to)]])


def _cells(places: DataFrame, blocks: int) -> DataFrame:
    """``node_id, block, others``: about so many cells of equal counts of nodes, by x and then, within each slab, by y, and the other cells within MARGIN.

    Nodes without a place are in block 0 only.
    """
    across = max(1, round(math.sqrt(blocks)))
    down = math.ceil(blocks / across)
    sketch = lambda v, n: F.percentile_approx(v, [0.05, *[k / n for k in range(1, n)], 0.95], 20 * n)
    known = places.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    wide = known.agg(sketch("x", across).alias("x"), sketch("y", down).alias("y")).first()
    xs = sorted(set(wide["x"][1:-1])) if wide["x"] else []
    above = lambda v, cuts: F.size(F.filter(cuts, lambda c: v > c))
    slab = lambda x: above(x, F.array(*map(F.lit, xs))) if xs else F.lit(0)
    cuts = {r["slab"]: sorted(set(r["q"][1:-1])) for r in known.groupBy(slab(F.col("x")).alias("slab")).agg(sketch("y", down).alias("q")).collect()} if down > 1 else {}  # a row a slab
    table = F.create_map(*[v for k, c in cuts.items() for v in (F.lit(k), F.array(*map(F.lit, c)))]) if cuts else None
    at = lambda x, y: slab(x) * down + (F.coalesce(above(y, F.try_element_at(table, slab(x))), F.lit(0)) if cuts else 0)
    if not wide["x"]:
        return places.select("node_id", F.lit(0).alias("block"), F.array().cast("array<int>").alias("others"))
    mx, my = (MARGIN * (v[-1] - v[0]) / 0.9 / n for v, n in ((wide["x"], across), (wide["y"], down)))
    near = F.array(*[at(F.col("x") + i * mx, F.col("y") + j * my) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    own = F.when(placed, at(F.col("x"), F.col("y"))).otherwise(0)
    return places.select("node_id", own.alias("block"), F.when(placed, F.array_except(F.array_distinct(near), F.array(own))).otherwise(F.array().cast("array<int>")).alias("others"))


@dataclass
class Stored:
    """A graph whose blocks are stored, each as a row of packed arrays in a bucket; ``of`` has each node's home block and those that hold it too, if there are several."""

    packed: DataFrame
    of: DataFrame | None
    blocks: int


def store(edges: DataFrame, blocks: int | None = None, places: DataFrame | None = None) -> Stored:
    """Stores a graph of ``src, dst, w`` for searches; weights must not be negative.

    Nodes lie in blocks of about BLOCK_EDGES edges: cells of equal counts by
    their ``places`` (node_id, x, y), or stretches of their numbers where no
    places are given. Edges are shuffled to their blocks once.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    edges = scratch.save(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double").alias("w")))
    if blocks is None:
        blocks = max(1, math.ceil(edges.count() / BLOCK_EDGES))
    of, put = None, edges.withColumns({"block": F.lit(0), "here": F.lit(0), "there": F.lit(0)})
    if blocks > 1:
        if places is None:
            places = edges.select(F.col("src").alias("node_id")).distinct().select("node_id", F.col("node_id").cast("double").alias("x"), F.lit(0.0).alias("y"))
        of = scratch.save(_cells(places, blocks))
        ends = of.select(F.col("node_id").alias("dst"), F.col("block").alias("there"))
        begin = of.select(F.col("node_id").alias("src"), F.col("block").alias("here"), "others")
        put = edges.join(begin, "src", "left").join(ends, "dst", "left").fillna(0, ["here", "there"])
        every = F.array_union(F.array("here"), F.coalesce("others", F.array().cast("array<int>")))
        put = put.select("src", "dst", "w", F.explode(every).alias("block"), "here", "there")
        lent = of.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(math.nan).alias("w"), "block", F.col("block").alias("here"), F.explode("others").alias("there"))
        put = put.unionByName(lent)
    packed = scratch.bucket(put.groupBy("block").applyInArrow(_pack, _PACKED), "block", blocks)
    scratch.drop(edges)
    return Stored(packed, of, blocks)


def shortest_paths(edges: DataFrame, sources: DataFrame, blocks: int | None = None, places: DataFrame | None = None) -> DataFrame:
    """``node_id, dist, source, pred`` of every node that some source reaches: ``store`` and ``search`` in one."""
    return search(store(edges, blocks, places), sources)


def search(graph: Stored, sources: DataFrame) -> DataFrame:
    """``node_id, dist, source, pred`` of every node that some source (``node_id``) reaches.

    Of equal distances the lesser source, then the lesser predecessor stands;
    a source has distance 0 and no predecessor. Nodes that no source reaches
    have no row.

    A round runs the search to the end within each block that has news, all
    blocks at once, and tells other blocks only what got better of the nodes
    they hold; it takes as many rounds as the best paths cross blocks beyond
    their margins, not as they have edges. No round shuffles an edge.
    """
    packed, blocks = graph.packed, graph.blocks
    start = sources.select(F.col("node_id").cast("long")).filter("node_id is not null").distinct()
    if graph.of is None:
        start = start.withColumns({"block": F.lit(0), "here": F.lit(0)})
    else:
        every = F.array_union(F.array(F.coalesce("block", F.lit(0))), F.coalesce("others", F.array().cast("array<int>")))
        start = start.join(graph.of, "node_id", "left").select("node_id", F.explode(every).alias("block"), F.coalesce("block", F.lit(0)).alias("here"))
    scratch = Scratch(packed.sparkSession, "search")
    tables = [scratch.save(start.groupBy("block").applyInArrow(_begin, _KNOWN))]
    last: dict[int, int] = {}  # the round of each block's last state
    while True:
        news = [r["block"] for r in tables[-1].filter("told").select("block").distinct().collect()]  # at most a row a block
        if not news:
            break
        known = tables[-1].filter("told").unionByName(_states(tables, {b: last[b] for b in news if b in last}))
        tables.append(scratch.save(packed.filter(F.col("block").isin(news)).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_search, _KNOWN)))
        last |= dict.fromkeys(news, len(tables) - 1)
        if blocks == 1:
            break
    return _states(tables, last).mapInArrow(_rows, "node_id long, dist double, source long, pred long")


def _states(tables: list[DataFrame], of: dict[int, int]) -> DataFrame:
    """The states of some blocks, each from the round it was last searched in."""
    out = tables[0].filter("not told")  # none
    for n in sorted(set(of.values())):
        out = out.unionByName(tables[n].filter(~F.col("told") & F.col("block").isin([b for b, k in of.items() if k == n])))
    return out


def routes(tree: DataFrame, starts: DataFrame, key: str = "case") -> DataFrame:
    """``key, seq, node_id``: the way from each start's source (seq 0) to the start, along the predecessors.

    Every round doubles the stretch that is known: each node's 1st, 2nd, 4th ...
    ancestor comes from joining the table of ancestors with itself, so a route
    of n nodes takes log n rounds. A start that no source reaches has no row.
    """
    scratch = Scratch(tree.sparkSession, "routes")
    jump = scratch.save(tree.select("node_id", F.col("pred").alias("up")))
    found = scratch.save(starts.select(key, "node_id", F.lit(0).cast("long").alias("back")).join(tree.select("node_id"), "node_id", "left_semi").select(key, "node_id", "back"))
    step = 1
    while True:
        far = found.join(jump, "node_id").filter("up is not null").select(key, F.col("up").alias("node_id"), (F.col("back") + step).alias("back"))
        grown = scratch.save(far)
        if grown.isEmpty():
            break
        found = scratch.save(found.unionByName(grown))
        j2 = jump.filter("up is not null")
        jump = scratch.save(j2.join(jump.select(F.col("node_id").alias("up"), F.col("up").alias("upper")), "up").select("node_id", F.col("upper").alias("up")))
        step *= 2
    length = found.groupBy(key).agg(F.max("back").alias("last"))
    return found.join(length, key).select(key, (F.col("last") - F.col("back")).alias("seq"), "node_id")
