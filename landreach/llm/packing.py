"""Filling containers of fixed capacity, by best fit under conflicts."""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from landreach.llm.bpe import token_counts

#: Items are packed in blocks of about so many, each in one task; what a block leaves unused is less than a container or two.
BLOCK = 4_000


class Bins:
    """Open containers in the order of their room, each with a bitmap of its sources and one of its duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (room, number)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The number of the container the item goes to.

        The search begins at the tightest container with room enough and goes
        on to the next until one is compatible: without the item's source and
        without its cluster. If there is none, a new one is opened.
        """
        for k in range(bisect.bisect_left(self.order, (size, -1)), len(self.order)):
            n = self.order[k][1]
            if not (self.clusters[n] & cluster or self.sources[n] & source):
                break
        else:
            k = -1
        if k < 0:
            n, room = len(self.sources), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
        else:
            room, n = self.order.pop(k)
        self.sources[n] |= source
        self.clusters[n] |= cluster
        if room > size:
            bisect.insort(self.order, (room - size, n))
        return n


def pack(items: list[tuple], capacity: int) -> list[tuple]:
    """``(id, piece, start, size, number)`` for items ``(id, size, source, cluster)``; larger ones first.

    An item larger than the capacity fills containers of its own, and its rest
    is packed like any other. Items of size 0 take no room.
    """
    sources: dict = {}
    clusters: dict = {}
    bit = lambda seen, v: 1 << seen.setdefault(v, len(seen)) if v is not None else 0
    bins, out, rests = Bins(capacity), [], []
    whole = 0
    for key, size, source, cluster in items:
        full = size // capacity if size > capacity else 0
        for piece in range(full):
            out.append((key, piece, piece * capacity, capacity, -1 - whole))
            whole += 1
        rest = size - full * capacity
        if rest or not full:
            rests.append((rest, key, full, source, cluster))
    rests.sort(key=lambda r: (-r[0], r[1]))
    alone = {c for c, n in _often(r[4] for r in rests).items() if n == 1}
    for rest, key, piece, source, cluster in rests:
        n = bins.place(rest, bit(sources, source), 0 if cluster in alone else bit(clusters, cluster))
        out.append((key, piece, piece * capacity, rest, n))
    opened = len(bins.sources)
    return [(*o[:4], o[4] if o[4] >= 0 else opened - 1 - o[4]) for o in out]


def _often(values) -> dict:
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    return seen


def containers(df: DataFrame, vocabulary: str, capacity: int, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """``key, piece, start, tokens, container``: a row for each document, or for each piece of one longer than the capacity.

    Pieces start at a multiple of the capacity, in tokens. Null and empty texts
    have no tokens and take no room. Ids must be distinct. The containers'
    numbers are distinct over all blocks.

    Two documents of one source never share a container, nor do two of one
    duplicate cluster; a new container is opened rather than that. ``cluster``
    names a column of clusters found before (of near duplicates, say); without
    it equal texts are a cluster. A null source or cluster conflicts with
    nothing. Items without tokens are in no cluster.

    Documents meet in blocks by a hash of their id, as rows of a few numbers;
    the number of blocks follows the number of documents, so no task's share
    grows with the corpus. Documents of different blocks can't meet in a
    container; those of one block are kept apart by the bitmaps.
    """
    blocks = max(1, math.ceil(df.count() / BLOCK))
    c = lambda n: F.col(f"`{n}`")
    rows = df.select(c(key).alias("id"), F.xxhash64(c(source)).alias("of_source"), c(source).isNull().alias("no_source"), F.xxhash64(c(cluster or text)).alias("of_cluster"), c(cluster or text).isNull().alias("no_cluster"), c(text).alias("text"))
    sized = token_counts(rows, vocabulary, ["id", "of_source", "no_source", "of_cluster", "no_cluster"])
    sized = sized.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        items = [
            (i, t or 0, None if none else s, x if t and not free else None)
            for i, t, s, none, x, free in zip(*(table.column(n).to_pylist() for n in ("id", "tokens", "of_source", "no_source", "of_cluster", "no_cluster")))
        ]
        packed = pack(items, capacity)
        ids, piece, start, tokens, n = zip(*packed)
        numbers = pa.array([(block << 32) + x for x in n], pa.int64())
        return pa.table([pa.array(ids, table.schema.field("id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(tokens, pa.int64()), numbers], names=[key, "piece", "start", "tokens", "container"])

    kind = df.schema[key].dataType.simpleString()
    return sized.groupBy("block").applyInArrow(run, f"`{key}` {kind}, piece int, start long, tokens long, container long")
