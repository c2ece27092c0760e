"""Mapping freely typed names to a list, by a prefix-filtered set-similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from landreach.llm import names
from landreach.session import Scratch

#: The list goes to every task; a longer one is refused.
MOST_ENTRIES = 100_000
#: Least Jaccard similarity of two names' runs of three letters to be looked at, and how many tokens (as far as the similarity
#: asks for so many) the prefixes of two names must share.
SIMILAR, SHARED = 0.25, 2
#: A value stands for the nearest name if it takes at most so many edits of its letters, or of their folded form.
EDITS, FOLDED_EDITS = 3, 2


def tokens(core: str) -> list[str]:
    """The different runs of three letters of the folded name, its ends marked; there are fewer than 28 * 28 * 28."""
    s = f"^^{names.fold(core)}$$"
    return list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))


class Entries:
    """What each core of the list means: an entry for each kind and way."""

    def __init__(self, rows: list[tuple[int, str, list[str] | None]], wholes: list[str]):
        self.reader = names.Reader(wholes)
        self.meaning: dict[str, dict[tuple[str, str], int]] = {}
        for entry, name, _ in rows:
            kind, way, core = self.reader.read(name)
            self.meaning.setdefault(core, {}).setdefault(("urban" if kind == "urban" else "", way), entry)
        for entry, _, others in rows:
            for other in others or ():
                kind, way, core = self.reader.read(other)
                if core not in self.meaning:
                    self.meaning[core] = {("*", "*"): entry}

    def resolve(self, core: str, near: str | None, kind: str, way: str) -> int:
        """The entry that a value with this core, nearest to the listed core ``near``, stands for, or -1."""
        held = self.meaning.get(near) if near is not None else None
        if not held:
            return -1
        if ("*", "*") in held:
            return held["*", "*"]
        kind = "urban" if kind == "urban" else ""
        if not way and not any(w == "" for _, w in held) and core[:-1] == near:  # an initial typed against the name
            way = {v[2]: k for k, v in names.WAYS.items()}.get(core[-1:], "")
        return held.get((kind, way), -1)


def candidates(cores: DataFrame, listed: list[str]) -> DataFrame:
    """``core, near, jaccard`` of all pairs of a core and a listed name of Jaccard similarity SIMILAR or more.

    Runs of three letters are ordered by their rarity over all cores and names.
    Two sets that are similar enough share SHARED runs (or as many as the
    similarity asks for, if that is fewer) among the rarest of each, so only
    those prefixes are joined; pairs whose sizes, or places of the shared runs,
    rule the similarity out are dropped before it is computed exactly.
    """
    spark = cores.sparkSession
    here = spark.createDataFrame([(n,) for n in listed], "core string")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for c in b.column(0).to_pylist() for t in tokens(c)], pa.string())], names=["token"])

    found = cores.unionByName(here).mapInArrow(explode, "token string").groupBy("token").count().collect()  # fewer than 28 * 28 * 28 rows
    order = {r["token"]: k for k, r in enumerate(sorted(found, key=lambda r: (r["count"], r["token"])))}

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for core in b.column(0).to_pylist():
                ids = sorted(order[t] for t in tokens(core))
                for place, token in enumerate(ids[: len(ids) - math.ceil(SIMILAR * len(ids)) + SHARED]):
                    out.append((core, ids, token, place))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["core", "ids", "token", "place"])

    shape = "core string, ids array<int>, token int, place int"
    left = cores.mapInArrow(prefixes, shape)
    right = here.mapInArrow(prefixes, shape).select(F.col("core").alias("near"), F.col("ids").alias("near_ids"), "token", F.col("place").alias("near_place"))
    a, b = F.size("ids"), F.size("near_ids")
    asked = SIMILAR / (1 + SIMILAR) * (a + b)
    left_over = F.least(a - F.col("place"), b - F.col("near_place"))
    met = left.join(right, "token").filter((b >= SIMILAR * a) & (a >= SIMILAR * b) & (left_over >= F.least(asked, F.lit(1.0))))
    # the first shared token's place bounds what can follow it
    pairs = met.groupBy("core", "near").agg(F.count("*").alias("n"), F.max(left_over).alias("room"), F.first("ids").alias("ids"), F.first("near_ids").alias("near_ids"))
    pairs = pairs.filter((F.col("n") >= F.least(F.lit(SHARED), F.ceil(asked))) & (F.col("room") >= asked))
    shared = F.size(F.array_intersect("ids", "near_ids"))
    return pairs.withColumn("jaccard", shared / (a + b - shared)).filter(F.col("jaccard") >= SIMILAR).select("core", "near", "jaccard")


def nearest(cores: DataFrame, listed: list[str]) -> DataFrame:
    """``core, near``: for each core (distinct) the listed name that it stands for; a core without one has no row.

    Of the candidates within so many edits as a name of that length may have,
    the one of the greatest similarity stands; of equal ones that of fewer
    edits, and if those are equal too there is no match.
    """

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for core, near in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = min(names.distance(core, near, EDITS + 1), names.distance(core.replace("rn", "m"), near, EDITS + 1) + 1)
                folded = names.distance(names.fold(core), names.fold(near), FOLDED_EDITS + 1)
                # short names take fewer edits: one in every three letters
                out.append(min(raw, folded) if min(raw, folded) <= len(near) // 3 and (raw <= EDITS or folded <= FOLDED_EDITS) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "edits"])

    close = candidates(cores, listed).mapInArrow(edits, "core string, near string, jaccard double, edits int").filter("edits is not null")
    by = Window.partitionBy("core")
    ranked = close.withColumns({"k": F.row_number().over(by.orderBy(F.desc("jaccard"), "edits", "near")), "ties": F.count("*").over(by.partitionBy("core", "edits", "jaccard"))})
    return ranked.filter("k = 1 and ties = 1").select("core", "near")


def match(values: DataFrame, key: str, value: str, listed: DataFrame, entry: str, name: str, others: str, whole: str) -> DataFrame:
    """``key, value, entry``: the listed entry that each value stands for, -1 for none.

    Null and blank values, and those equal to a listed name, are left out. Of
    rows of one key the least value stands. A name without a word for its kind,
    or with a rural one, means the entry that isn't urban; a name that is listed
    only with ways (north ...) needs one. An empty list maps everything to -1.
    Each different value is read and looked up once, in a table of its own that
    is kept in the shared folder; rows are joined to it by their value, where a
    hot value's rows are split by Spark.
    """
    rows = [tuple(r) for r in listed.select(entry, name, others, whole).limit(MOST_ENTRIES + 1).collect()]
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the list has more than {MOST_ENTRIES} entries")
    entries = Entries([r[:3] for r in rows if r[1] is not None], [r[3] for r in rows if r[3] is not None])
    c = lambda n: F.col(f"`{n}`")
    exact = listed.select(c(name).alias("value")).filter("value is not null").distinct()
    cases = values.select(c(key).alias("key"), c(value).alias("value")).filter(F.col("key").isNotNull() & F.col("value").rlike(r"(?U)\S"))
    cases = cases.join(F.broadcast(exact), "value", "left_anti").groupBy("key").agg(F.min("value").alias("value"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*map(entries.reader.read, b.column(0).to_pylist()))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.string()) for x in columns]], names=["value", "kind", "way", "core"])

    scratch = Scratch(values.sparkSession, "canonical")
    taken = scratch.save(cases.select("value").distinct().mapInArrow(read, "value string, kind string, way string, core string"))
    found = taken.join(nearest(scratch.save(taken.select("core").distinct()), list(entries.meaning)), "core", "left")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [entries.resolve(*x) for x in zip(*(b.column(n).to_pylist() for n in ("core", "near", "kind", "way")))]
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(out, pa.int32())], names=["value", "entry"])

    meant = found.mapInArrow(resolve, "value string, entry int")
    return cases.join(meant, "value").select(F.col("key").alias(key), F.col("value").alias(value), F.col("entry").alias(entry))
