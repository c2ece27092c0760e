"""Top N rows of every group by merging sorted runs with a tree of losers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from landreach.session import Scratch

#: Runs that are merged at once.
FAN = 64


class LoserTree:
    """Merges k sorted sources; each inner node keeps the loser of its match.

    ``heads`` holds the current key of every source, None once it has run dry.
    Replacing the winner's head costs one match per level.
    """

    def __init__(self, heads: list):
        self.heads = heads
        self.k = len(heads)
        self.nodes = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None:
            return False
        return b is None or (a, i) < (b, j)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            held = self.nodes[node]
            if held < 0:
                self.nodes[node] = i
                return
            if self._beats(held, i):
                self.nodes[node], i = i, held
            node //= 2
        self.nodes[0] = i

    @property
    def winner(self) -> int:
        return self.nodes[0]

    def replace(self, key) -> None:
        i = self.nodes[0]
        self.heads[i] = key
        self._play(i)


def merge_group(runs: list[list[tuple]], n: int) -> list[tuple]:
    """The first n entries of the merged runs; what lies behind them is never looked at."""
    runs = [r for r in runs if r]
    if not runs:
        return []
    at = [0] * len(runs)
    tree = LoserTree([r[0] for r in runs])
    out = []
    while len(out) < n:
        w = tree.winner
        if tree.heads[w] is None:
            break
        out.append(tree.heads[w])
        at[w] += 1
        tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    return out


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or the first of name_1, name_2 ... that isn't taken (case ignored)."""
    used = {c.lower() for c in taken}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(used) + 2))) if x.lower() not in used)


def _keys(batch: pa.RecordBatch | pa.Table, names: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in names)))


def _heads_of_runs(group: list[str], n: int):
    """Reads one sorted run; hands on the first n rows of a group, then seeks to the next group."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            keep = []
            for key in _keys(batch, group):
                seen = seen + 1 if key == last else 1
                last = key
                keep.append(seen <= n)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return read


def _merge_runs(group: list[str], run: str, score: str, tie: str, n: int, rank: str):
    """Reads a bucket ordered by group, run and score, and merges the runs of each group."""

    def first_of(part: pa.Table) -> Iterator[tuple[list[int], int]]:
        keys, at = _keys(part, group), 0
        entries = list(zip(_keys(part, [run]), part.column(score).to_pylist(), part.column(tie).to_pylist()))
        while at < len(keys):
            runs: dict[tuple, list[tuple]] = {}
            key = keys[at]
            while at < len(keys) and keys[at] == key:
                of, s, t = entries[at]
                runs.setdefault(of, []).append((-s, t, at))
                at += 1
            yield [e[2] for e in merge_group(list(runs.values()), n)], at

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.Table) -> Iterator[pa.RecordBatch]:
            take, ranks = [], []
            for rows, _ in first_of(part):
                take += rows
                ranks += range(1, len(rows) + 1)
            done = part.drop_columns([run]).take(pa.array(take, pa.int64()))
            yield from done.append_column(rank, pa.array(ranks, pa.int64())).combine_chunks().to_batches()

        held: list[pa.Table] = []  # the rows of a group that isn't at its end
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            keys = _keys(part, group)
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if cut or keys[0] != last:
                ready = [*held, part.slice(0, cut)]
                if sum(map(len, ready)):
                    yield from out(pa.concat_tables(ready))
                held, part = [], part.slice(cut)
            held.append(part)
            last = keys[-1]
        if held:
            yield from out(pa.concat_tables(held))

    return read


def top_n(df: DataFrame, group: list[str], score: str, tie: str, n: int, buckets: int | None = None) -> DataFrame:
    """The n rows of highest ``score`` in every group; equal scores go by smaller ``tie``.

    Adds ``rank`` (1 is first), under the next free name if the table has a
    column of that name. Rows whose group columns, score or tie are null, or
    whose score is NaN, don't compete. Exact repeats compete as separate rows:
    remove them before, if they are not meant to. An empty table gives an empty
    result. All columns are kept.

    The input's partitions become runs ordered by group and score, which are
    stored in the shared folder. A run holds only its first n rows per group, for
    no row behind them can be among the group's first n; a group of any size so
    shrinks to n rows per run before anything is shuffled. Runs of a group meet
    in a bucket by the group's hash, and a tree of losers merges them until n
    rows are out. Of more than FAN runs, FAN at a time are merged to one first,
    so that no task gets more than FAN times n rows of a group.
    """
    run, rank = fresh("run_no", df.columns), fresh("rank", df.columns)
    c = lambda name: F.col(f"`{name}`")
    for name in (*group, score, tie):
        df = df.filter(c(name).isNotNull())
    df = df.filter(~F.isnan(c(score).cast("double")))
    by, down = [c(g) for g in group], [c(score).desc(), c(tie)]
    scratch = Scratch(df.sparkSession, "top")
    runs = scratch.save(df.sortWithinPartitions(*by, *down).mapInArrow(_heads_of_runs(group, n), df.schema).withColumn(run, F.spark_partition_id()))
    schema = T.StructType([*df.schema.fields, T.StructField(rank, T.LongType())])
    many = (runs.agg(F.max(c(run))).first()[0] or 0) + 1

    def merged(rows: DataFrame, *more) -> DataFrame:
        met = (rows.repartition(buckets, *by, *more) if buckets else rows.repartition(*by, *more)).sortWithinPartitions(*by, *more, c(run), *down)
        return met.mapInArrow(_merge_runs([*group, *[next_run] * len(more)], run, score, tie, n, rank), T.StructType([*[f for f in rows.schema.fields if f.name != run], T.StructField(rank, T.LongType())]))

    next_run = fresh("next_run", [*df.columns, run, rank])
    while many > FAN:
        runs = merged(runs.withColumn(next_run, F.floor(c(run) / FAN).cast("int")), c(next_run)).drop(rank).withColumnRenamed(next_run, run)
        many = -(-many // FAN)
    return merged(runs).select(*[c(f.name) for f in schema.fields])


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key: the one of the latest version; a null version is the earliest.

    Rows of equal key and version are the same in all columns kept, or else the
    greatest of them, compared column by column, stands.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.max(F.struct(F.col(f"`{version}`"), *[F.col(f"`{c}`") for c in rest if c != version])).alias("__best")
    return df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(best).select(*[F.col(f"`{k}`") for k in key], *[F.col(f"__best.`{c}`") for c in rest])
