"""Exact percentiles of every group by one distributed sort and positions counted per partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from landreach.session import Scratch


def measures_long(df: DataFrame, key: list[str], group: list[str], measures: list[str], counted: bool = True) -> DataFrame:
    """``group..., measure, value, n``: how often each value occurs in each group.

    Rows equal in ``key`` and in all measures are one delivery and count once
    (their group columns are taken from the greatest of them, nulls last). NaN
    and null values are left out, +inf stays and sorts last. This is the form in
    which results are kept and combined: the sum of ``n`` over several such
    tables is the table of their union, so days, partitions or regions add up
    without any error. Not ``counted``, a value may have several rows: the same
    counts in more rows, one shuffle less.
    """
    c = lambda name: F.col(f"`{name}`")
    rest = [g for g in group if g not in key]
    once = df.select(*dict.fromkeys([*key, *group, *measures])).groupBy(*[c(k) for k in key], *[c(m) for m in measures])
    once = once.agg(*[F.max(c(g)).alias(g) for g in rest]) if rest else once.agg(F.lit(1).alias("one"))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), c(m).cast("double").alias("value")) for m in measures])
    long = once.select(*[c(g) for g in group], F.inline(pairs)).filter("value is not null and not isnan(value)")
    if not counted:
        return long.withColumn("n", F.lit(1).cast("long"))
    return long.groupBy(*[c(g) for g in group], "measure", "value").agg(F.count("*").alias("n"))


def percentiles(counts: DataFrame, group: list[str], at: list[float], spans: list[list[str]] | None = None) -> DataFrame:
    """``group..., n, p, value, error_bound`` from a table of ``group..., value, n``.

    The value at p is that at position p * (n - 1) of the ordered values,
    counted from 0, with linear interpolation between the two neighbours; the
    error bound is 0. Where both neighbours are equal (+inf included) there is
    no interpolation, and between a finite value and +inf any part of the way is
    +inf. Null group values make a group of their own. An empty table gives an
    empty result.

    ``spans`` are lists of columns of ``group`` to group by, each giving its own
    rows with null in the columns it leaves out (day by day and over all days,
    say); by default there is one, the whole group.

    The counts are sorted once over the cluster, by a hash of the columns that
    all spans share and by value, which puts the values of every group of every
    span in their order. Each partition numbers its own stretch of every group;
    the sums of the earlier partitions are the stretch's offset. A target
    position so belongs to exactly one partition. A group of any size spans as
    many partitions as the sort gives it, and no task sees more than its stretch.
    """
    spans = spans or [group]
    scratch = Scratch(counts.sparkSession, "percentiles")
    shared = [g for g in group if all(g in s for s in spans)]
    c = lambda g: F.col(f"`{g}`")
    marked = counts.select(*map(c, group), F.col("value").cast("double").alias("value"), F.col("n").cast("long").alias("n"), F.xxhash64(F.lit(0), *map(c, shared)).alias("h"))
    ordered = marked.repartitionByRange("h", "value").sortWithinPartitions("h", "value")
    schema = T.StructType([*marked.schema.fields, T.StructField("part", T.IntegerType()), *[T.StructField(f"upto{i}", T.LongType()) for i in range(len(spans))]])
    kept = scratch.save(ordered.mapInArrow(_number(spans), schema))
    found = None
    for i, span in enumerate(spans):
        rows = _span(kept, [f"`{g}`" for g in span], span, f"upto{i}", at)
        kinds = dict(counts.dtypes)
        rows = rows.select(*[c(g) if g in span else F.lit(None).cast(kinds[g]).alias(g) for g in group], "n", "p", "value", F.lit(0.0).alias("error_bound"))
        found = rows if found is None else found.unionByName(rows)
    out = scratch.save(found)
    scratch.drop(kept)
    return out


def _span(kept: DataFrame, keys: list[str], group: list[str], upto: str, at: list[float]) -> DataFrame:
    """One span's percentiles, from rows numbered within each partition and group."""
    w = Window.partitionBy(*keys)
    sums = kept.groupBy("part", *keys).agg(F.max(upto).alias("held"))
    offsets = sums.withColumn("offset", F.sum("held").over(w.orderBy("part")) - F.col("held")).withColumn("total", F.sum("held").over(w))
    wanted = offsets.withColumn("p", F.explode(F.array(*map(F.lit, at)))).withColumn("place", F.col("p") * (F.col("total") - 1))
    wanted = wanted.withColumn("target", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    wanted = wanted.filter("offset <= target and target < offset + held")
    wanted = wanted.select(*[F.col(f"`{g}`").alias(f"of_{k}") for k, g in enumerate(group)], F.col("part").alias("in_part"), F.col("total"), "p", "place", "target", (F.col("target") - F.col("offset")).alias("own"))
    same = [F.col("part") == F.col("in_part"), *[F.col(f"`{g}`").eqNullSafe(F.col(f"of_{k}")) for k, g in enumerate(group)]]
    met = kept.join(wanted, [*same, F.col(upto) > F.col("own"), F.col(upto) - F.col("n") <= F.col("own")])
    met = met.select(*keys, F.col("total").alias("n"), "p", "place", "target", "value")
    ends = met.groupBy(*keys, "n", "p", "place").agg(F.min_by("value", "target").alias("lo"), F.max_by("value", "target").alias("hi"))
    part = F.col("place") - F.floor("place")
    value = F.when((F.col("lo") == F.col("hi")) | (part == 0), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * part)
    return ends.select(*keys, "n", "p", value.alias("value"))


def _number(spans: list[list[str]]):
    """Adds ``part``, and for each span ``upto``: the sum of n within the partition's stretch of the group, this row included.

    Rows come ordered by h, so only the sums of the last h are carried on.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        carried: list[dict] = [{} for _ in spans]
        for batch in batches:
            if not batch.num_rows:
                continue
            h, n = batch.column("h").to_numpy(), batch.column("n").to_numpy()
            made = []
            for i, span in enumerate(spans):
                code = np.zeros(len(n), dtype=np.int64)
                for v in (batch.column(g).dictionary_encode(null_encoding="encode") for g in span):
                    code = code * len(v.dictionary) + v.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
                sums = np.cumsum(n[order])
                before = np.r_[0, sums][first]
                ends = np.r_[first[1:], len(n)] - 1
                key = lambda row: tuple(batch.column(g)[row].as_py() for g in span)  # noqa: B023, E731
                old = carried[i]
                for k in np.flatnonzero(h[order[first]] == last) if old else ():
                    before[k] -= old.get(key(int(order[first[k]])), 0)
                upto = np.empty(len(n), dtype=np.int64)
                upto[order] = sums - np.repeat(before, np.diff(np.r_[first, len(n)]))
                kept = dict(old) if h[-1] == last else {}
                for k in np.flatnonzero(h[order[ends]] == h[-1]):
                    kept[key(int(order[ends[k]]))] = int(upto[order[ends[k]]])
                carried[i] = kept
                made.append(pa.array(upto, pa.int64()))
            last = h[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part), pa.int32()), *made], names=[*batch.schema.names, "part", *[f"upto{i}" for i in range(len(spans))]])

    return read
