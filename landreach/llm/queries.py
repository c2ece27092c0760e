"""The queries of this folder's operators, and SQL that gives the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from landreach.llm import bpe, canonical, components as cc, lines, packing, percentiles as pc, quality, topn
from landreach.llm.words import COMMON
from landreach.session import load

MEASURES = ["snap_dist_m", "drive_time_min", "walk_time_min"]
CAPACITY = 2_048
AT = [0.5, 0.9, 0.99]


def _typed(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "population_census").select("record_id", "district").unionByName(load(spark, d, "district_summary").select("record_id", "district"))
    return canonical.match(rows, "record_id", "district", load(spark, d, "district_reference"), "district_id", "district", "alt_names", "province")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The listed district that each freely typed one stands for, -1 for none."""
    return _typed(spark, d).select("record_id", "district_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The typed values that stand for no listed district, with their frequency."""
    return _typed(spark, d).filter("district_id = -1").groupBy("district").agg(F.count("*").alias("n"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The form from which days are combined: counted values of each district and day."""
    return pc.measures_long(load(spark, d, "baseline_accessibility"), ["point_id", "run_date"], ["district", "run_date"], MEASURES)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th and 99th percentile of each district and run_date, and of each district over all dates (run_date null).

    Rows without a district make a group of their own.
    """
    days = pc.measures_long(load(spark, d, "baseline_accessibility"), ["point_id", "run_date"], ["district", "run_date"], MEASURES, counted=False)
    out = pc.percentiles(days, ["district", "run_date", "measure"], AT, [["district", "run_date", "measure"], ["district", "measure"]])
    return out.select("district", "run_date", "measure", "n", "p", F.round("value", 6).alias("value"), "error_bound")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten newly cut off points of the largest population in each run and district."""
    flood = load(spark, d, "flood_accessibility").select("run_id", "point_id", "population", "district", "newly_cutoff_drive", "loaded_at")
    cut = topn.latest(flood, ["run_id", "point_id"], "loaded_at").filter("newly_cutoff_drive").select("run_id", "point_id", "population", "district")
    return topn.top_n(cut, ["run_id", "district"], "population", "point_id", 10).select("run_id", "district", "point_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every node of edges with the smallest node it is linked to."""
    return cc.components(load(spark, d, "edges"))


def vocabulary() -> str:
    """Where the public tokenizers lie; LANDREACH_TOKENIZERS names another folder."""
    return os.environ.get("LANDREACH_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k: empty for an empty text, null for a null one."""
    return bpe.token_ids(load(spark, d, "documents"), vocabulary())


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of 2 048 tokens that each document, or piece of a longer one, goes to."""
    return packing.containers(load(spark, d, "documents"), vocabulary(), CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled: their number, the least number that could do, the share of unused space, and how often two documents of one source, or two equal ones, share a container."""
    texts = load(spark, d, "documents").select("doc_id", "source", F.when(F.length("text") > 0, F.xxhash64("text")).alias("cluster"))
    held = p8_containers(spark, d).join(texts, "doc_id").groupBy("container")
    twice = lambda c: (F.count(c) - F.count_distinct(c)).alias(f"{c}_conflicts")
    held = held.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"), twice("source"), twice("cluster"))
    total = held.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.avg("items").alias("mean_items"), F.sum("source_conflicts").alias("source_conflicts"), F.sum("cluster_conflicts").alias("cluster_conflicts"))
    return total.withColumn("least_containers", F.ceil(F.col("tokens") / CAPACITY)).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are mostly list, table or junk."""
    return quality.kinds(load(spark, d, "documents"))


def _rounded(out: DataFrame, columns: list[str]) -> DataFrame:
    kept = dict(out.dtypes)
    return out.select("doc_id", *[F.round(c, 6).alias(c) if kept[c] == "double" else F.col(c) for c in columns])


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every document's text."""
    names = ["word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "mean_line_length", "repeat_share"]
    return _rounded(quality.statistics(load(spark, d, "documents")), names)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of every document's characters that lie in lines of each kind."""
    return _rounded(quality.statistics(load(spark, d, "documents")), [f"{k}_share" for k in quality.KINDS])


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_unmatched, p3_percentiles, p3_counts, p4_found, p6_found, p7_ids, p8_containers, p8_fill, p9_found, p9_statistics, p9_shares)}


_P3 = """
WITH once AS (
  SELECT point_id, run_date, snap_dist_m, drive_time_min, walk_time_min, max(district) AS district
  FROM baseline_accessibility GROUP BY point_id, run_date, snap_dist_m, drive_time_min, walk_time_min),
long AS (
  SELECT district, run_date, 'snap_dist_m' AS measure, snap_dist_m AS v FROM once
  UNION ALL SELECT district, run_date, 'drive_time_min', drive_time_min FROM once
  UNION ALL SELECT district, run_date, 'walk_time_min', walk_time_min FROM once),
kept AS (SELECT * FROM long WHERE v IS NOT NULL AND NOT isnan(v)),
both_spans AS (
  SELECT 'day' AS span, district, run_date, measure, v FROM kept
  UNION ALL SELECT 'all', district, CAST(NULL AS DATE), measure, v FROM kept),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY span, district, run_date, measure ORDER BY v) - 1 AS k,
         count(*) OVER (PARTITION BY span, district, run_date, measure) AS n
  FROM both_spans),
placed AS (SELECT *, p * (n - 1) AS place FROM numbered, (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS p)),
ends AS (
  SELECT span, district, run_date, measure, n, p, place,
         max(CASE WHEN k = floor(place) THEN v END) AS lo, max(CASE WHEN k = ceil(place) THEN v END) AS hi
  FROM placed GROUP BY span, district, run_date, measure, n, p, place)
SELECT district, run_date, measure, n, p,
       round(CASE WHEN lo = hi OR place = floor(place) THEN lo ELSE lo + (hi - lo) * (place - floor(place)) END, 6) AS value,
       CAST(0 AS DOUBLE) AS error_bound
FROM ends
"""

_P3_COUNTS = _P3[: _P3.index("both_spans AS")].rstrip().rstrip(",") + " SELECT district, run_date, measure, v AS value, count(*) AS n FROM kept GROUP BY ALL"

_P4 = """
WITH last AS (
  SELECT * FROM (SELECT run_id, point_id, population, district, newly_cutoff_drive,
                        row_number() OVER (PARTITION BY run_id, point_id ORDER BY loaded_at DESC NULLS LAST) AS k
                 FROM flood_accessibility) WHERE k = 1),
ranked AS (
  SELECT run_id, district, point_id,
         row_number() OVER (PARTITION BY run_id, district ORDER BY population DESC, point_id) AS k
  FROM last
  WHERE newly_cutoff_drive AND population IS NOT NULL AND NOT isnan(population) AND district IS NOT NULL)
SELECT run_id, district, point_id FROM ranked WHERE k <= 10
"""

_P6 = """
WITH RECURSIVE pairs AS (
  SELECT a AS u, b AS v FROM edges WHERE a IS NOT NULL AND b IS NOT NULL
  UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
nodes AS (SELECT a AS id FROM edges WHERE a IS NOT NULL UNION SELECT b FROM edges WHERE b IS NOT NULL),
reach(id, least) USING KEY (id) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT p.v, min(r.least) FROM reach r JOIN pairs p ON p.u = r.id JOIN recurring.reach k ON k.id = p.v
  WHERE r.least < k.least GROUP BY p.v)
SELECT id AS node_id, least AS group_id FROM reach
"""


_BLANK = "[\\t-\\r ]"
_P9 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM texts),
bare AS (SELECT *, regexp_replace(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '^#{_BLANK}+', '') AS m FROM parts WHERE regexp_matches(line, '[^\\t-\\r ]')),
marked AS (SELECT *, coalesce(m <> lag(m) OVER (PARTITION BY doc_id ORDER BY i), TRUE) AS new FROM bare),
numbered AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS long FROM numbered),
sums AS (
  SELECT doc_id, sum(length(line) + 1) AS size, count(*) AS lines, sum(length(regexp_replace(line, '{_BLANK}', '', 'g'))) AS solid,
         sum(length(regexp_replace(line, '[\\p{{L}}\\p{{N}}\\t-\\r ]', '', 'g'))) AS symbols, sum(length(regexp_replace(line, '[^0-9]', '', 'g'))) AS digits,
         sum(CASE WHEN contains('{lines.STOPS}', right(m, 1)) THEN 1 ELSE 0 END) AS stops, sum(CASE WHEN long >= 3 THEN length(line) + 1 ELSE 0 END) AS again
  FROM runs GROUP BY doc_id),
words AS (
  SELECT doc_id, count(*) AS words, count(*) FILTER (w IN ({", ".join(f"'{w}'" for w in COMMON)})) AS known
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[^\\t-\\r ]+')) AS w FROM texts) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(words, 0) AS BIGINT) AS word_count, round(coalesce(solid / words, 0), 6) AS mean_word_length, round(coalesce(symbols / solid, 0), 6) AS symbol_ratio,
       round(coalesce(digits / solid, 0), 6) AS digit_ratio, round(coalesce(stops / lines, 0), 6) AS punctuated_lines, round(coalesce(known / words, 0), 6) AS common_words,
       round(coalesce(size / lines, 0), 6) AS mean_line_length, round(coalesce(again / size, 0), 6) AS repeat_share
FROM texts LEFT JOIN sums USING (doc_id) LEFT JOIN words USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_percentiles": _P3, "p3_counts": _P3_COUNTS, "p4_found": _P4, "p6_found": _P6, "p9_statistics": _P9}
