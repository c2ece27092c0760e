"""Counts, shares and sums by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def value_counts(df: DataFrame, column: str, order: list[str] | None = None) -> DataFrame:
    """``column, n, share``: how often each value occurs, nulls included; in the given order, or else the most frequent first."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return _with_share(out, "n").orderBy(*([_place(column, order)] if order else [F.desc("n")]), column)


def sums_by(df: DataFrame, column: str, amount: str, order: list[str] | None = None) -> DataFrame:
    """``column, total, share``: the amount summed by class, in the given order or else by name; null and NaN amounts add nothing."""
    value = F.when(~F.isnan(amount), F.col(amount))
    out = df.groupBy(column).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    return _with_share(out, "total").orderBy(*([_place(column, order)] if order else []), column)


def _place(column: str, order: list[str]) -> Column:
    """The value's place in a list; values that aren't in it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def _with_share(out: DataFrame, amount: str) -> DataFrame:
    """The whole is one row, added to every class."""
    whole = out.agg(F.sum(amount).cast("double").alias("whole"))
    return out.join(F.broadcast(whole)).withColumn("share", F.try_divide(F.col(amount).cast("double"), "whole")).drop("whole")
