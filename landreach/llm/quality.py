"""Statistics of a document's text, and a rule list that tells prose and code from lists, tables and junk."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from landreach.llm import lines
from landreach.llm.fitted import RULES
from landreach.llm.words import COMMON

#: Kinds of lines that make a case of a document if they hold more than half of its characters.
KINDS = ("junk", "table", "list")


def line_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line that isn't blank, with what is counted in it and what the rules test (``lines.COUNTS`` and ``lines.FEATURES``).

    Whole texts are read, batch by batch, as arrays of characters; nothing is
    shuffled. A null, empty or blank text has one row of zeros.
    """
    common = frozenset(w.encode() for w in COMMON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                yield lines.table(some.column(0), some.column(1), key, common)

    made = [T.StructField(k, T.LongType()) for k in lines.COUNTS] + [T.StructField(k, T.FloatType()) for k in lines.FEATURES]
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, T.StructType([df.schema[key], *made]))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def _sums(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sums over each document's lines; the lines of a document meet within their partition before anything is shuffled."""
    rows = line_table(df, key, text).withColumn("kind", F.expr(RULES))
    sums = [F.sum(k).alias(k) for k in lines.COUNTS] + [F.count_if(F.col("size") > 0).alias("lines")]
    sums += [F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)).alias(f"{k}_chars") for k in KINDS]
    return rows.groupBy(F.col(f"`{key}`")).agg(*sums)


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, ratios and shares; 0 for a null, empty or blank text.

    Words are what stands between blanks (tab to carriage return, and space); a
    symbol is neither letter, number nor blank; a line that isn't blank counts as
    punctuated if its last character ends a sentence, and as repeated in a run of
    three or more that are equal but for surrounding blanks and a comment sign.
    A share of characters counts each line with its line break. Ids must be distinct.
    """
    return _sums(df, key, text).select(
        F.col(f"`{key}`"),
        F.col("words").alias("word_count"),
        _share("solid", "words").alias("mean_word_length"),
        _share("symbols", "solid").alias("symbol_ratio"),
        _share("digits", "solid").alias("digit_ratio"),
        _share("stops", "lines").alias("punctuated_lines"),
        _share("known", "words").alias("common_words"),
        _share("size", "lines").alias("mean_line_length"),
        _share("again", "size").alias("repeat_share"),
        *[_share(f"{k}_chars", "size").alias(f"{k}_share") for k in KINDS],
    )


def kinds(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind`` of the documents more than half of whose characters lie in lines of one kind, by the fitted rules; others have no row.

    Null, empty and blank texts are none.
    """
    case = F.lit(None).cast("string")
    for k in KINDS:
        case = F.when(2 * F.col(f"{k}_chars") > F.col("size"), k).otherwise(case)
    return _sums(df, key, text).select(F.col(f"`{key}`"), case.alias("kind")).filter("kind is not null")
