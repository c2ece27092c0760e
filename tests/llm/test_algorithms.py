import math
import random

import pytest

from landreach.llm import canonical, components as cc, names, percentiles as pc, topn


# --- top n


@pytest.mark.parametrize("k", [1, 2, 3, 7, 8, 20])
def test_loser_tree_merges_in_order(k):
    r = random.Random(k)
    runs = [sorted((r.randrange(9), r.randrange(9), i * 100 + j) for j in range(r.randrange(12))) for i in range(k)]
    want = sorted(x for run in runs for x in run)
    assert topn.merge_group(runs, 10**6) == want
    assert topn.merge_group(runs, 4) == want[:4]


def test_loser_tree_of_nothing():
    assert topn.merge_group([], 3) == [] and topn.merge_group([[], []], 3) == []


def test_top_n_matches_sorting(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), r.choice([None, 1, 2]), r.choice([1.0, 2.0, 2.0, math.nan, None, r.random()]), i, "x" * (i % 3), i) for i in range(3000)]
    rows += [("hot", 1, 5.0, 10_000 + i, None, 0) for i in range(3000)] + [(None, 1, 9.0, 1, None, 0), ("a", 1, 9.0, None, None, 0)]
    df = spark.createDataFrame(rows, "g string, h int, score double, tie long, rank string, run_no long").repartition(7)
    got = topn.top_n(df, ["g", "h"], "score", "tie", 10)
    assert got.columns == [*df.columns, "rank_1"]
    want = {}
    for row in rows:
        if None not in row[:4] and not math.isnan(row[2]):
            want.setdefault(row[:2], []).append((-row[2], row[3]))
    best = {(*g, k + 1): t for g, v in want.items() for k, (_, t) in enumerate(sorted(v)[:10])}
    assert {(x.g, x.h, x.rank_1): x.tie for x in got.collect()} == best
    assert topn.top_n(df.limit(0), ["g"], "score", "tie", 3).count() == 0


def test_repeats_compete_and_the_latest_stands(spark):
    rows = [("a", 1, 5.0, 1), ("a", 1, 5.0, 1), ("a", 1, 7.0, 2), ("a", 2, 1.0, None), ("a", 2, 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, k long, v double, at long")
    assert topn.top_n(df, ["g"], "v", "k", 3).count() == 3
    assert sorted((r.k, r.v) for r in topn.latest(df, ["k"], "at").collect()) == [(1, 7.0), (2, 2.0)]


# --- components


def union_find(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in rows:
        for x in (a, b):
            if x is not None:
                parent.setdefault(x, x)
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _rows(seed):
    r = random.Random(seed)
    return [(r.randrange(400), r.randrange(400)) for _ in range(250)]


@pytest.mark.parametrize(
    "rows",
    [[], [(1, 1)], [(None, None)], [(1, None), (None, 2), (2, 2)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 300)] * 2, [(i + 1, i) for i in range(0, 60, 2)], _rows(1), [(-5, 1 << 60), (1 << 60, 7), (9, 9)]],
)
@pytest.mark.parametrize("base", [50_000, 0])
def test_components_match_union_find(spark, monkeypatch, rows, base):
    monkeypatch.setattr(cc, "BASE_EDGES", base)
    df = spark.createDataFrame([(*x, "extra") for x in rows], "a long, b long, node_id string")
    got = cc.components(df).collect()
    assert len(got) == len({r.node_id for r in got}) and {r.node_id: r.group_id for r in got} == union_find(rows)


# --- percentiles


def exact(values, p):
    v = sorted(values)
    place = p * (len(v) - 1)
    lo, hi = v[math.floor(place)], v[math.ceil(place)]
    return lo if lo == hi or place == int(place) else lo + (hi - lo) * (place - math.floor(place))


def test_percentiles_match_sorting(spark):
    r = random.Random(6)
    rows = [(i, r.randrange(3), r.choice(["a", "b", None]), r.choice([None, math.nan, math.inf, 0.0, float(r.randrange(5)), r.expovariate(0.1)])) for i in range(4000)]
    rows += [(i, 9, "hot", float(i % 7)) for i in range(4000)]
    df = spark.createDataFrame(rows + rows[:500], "id long, day int, g string, v double")
    counts = pc.measures_long(df, ["id", "day"], ["g", "day"], ["v"])
    by, every = {}, {}
    for _, day, g, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault((g, day), []).append(v)
            every.setdefault(g, []).append(v)
    got = {(x.g, x.day, x.p): (x.value, x.n, x.error_bound) for x in pc.percentiles(counts, ["g", "day", "measure"], [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got == {(*k, p): (exact(v, p), len(v), 0.0) for k, v in by.items() for p in (0.0, 0.5, 0.9, 1.0)}
    summed = counts.groupBy("g", "measure", "value").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    assert {(x.g, x.p): x.value for x in pc.percentiles(summed, ["g", "measure"], [0.5]).collect()} == {(g, 0.5): exact(v, 0.5) for g, v in every.items()}
    assert pc.percentiles(counts.limit(0), ["g", "day", "measure"], [0.5]).count() == 0


def test_spans_share_one_sort(spark):
    r = random.Random(3)
    rows = [(r.choice("ab") if r.random() < 0.9 else None, r.randrange(5), "m", r.choice([1.0, 2.5, math.inf, r.random()]), r.randrange(1, 4)) for _ in range(2_000)]
    counts = spark.createDataFrame(rows, "g string, day int, measure string, value double, n long").repartition(7)
    got = {(x.g, x.day, x.p): (x.n, x.value) for x in pc.percentiles(counts, ["g", "day", "measure"], [0.1, 0.5], [["g", "day", "measure"], ["g", "measure"]]).collect()}
    days = {(x.g, x.day, x.p): (x.n, x.value) for x in pc.percentiles(counts, ["g", "day", "measure"], [0.1, 0.5]).collect()}
    every = {(x.g, None, x.p): (x.n, x.value) for x in pc.percentiles(counts.drop("day"), ["g", "measure"], [0.1, 0.5]).collect()}
    assert got == days | every and len(got) == 3 * 6 * 2


def test_many_runs_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(topn, "FAN", 3)
    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", f"g{i % 5}"]), r.randrange(40), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, score int, id long").repartition(20)
    got = {(x.g, x["rank"]): (x.score, x.id) for x in topn.top_n(df, ["g"], "score", "id", 4).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        for k, (_, s, i) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:4], 1):
            want[g, k] = (s, i)
    assert got == want


def test_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 7, 8, 9.0), (2, "a", 4.0, 7, 8, 9.0)], "id long, g string, v double, n int, part int, value double")
    got = pc.percentiles(pc.measures_long(df, ["id"], ["g"], ["v"]), ["g", "measure"], [0.5]).collect()
    assert [(r.g, r.measure, r.n, r.value) for r in got] == [("a", "v", 2, 3.0)]
    listed = spark.createDataFrame([(0, "A", "Ashdown", None, "x")], "entry int, whole string, name string, others array<string>, core string")
    typed = spark.createDataFrame([(1, "ashdwn", "y", "z")], "k long, typed string, core string, near string")
    assert canonical.match(typed, "k", "typed", listed, "entry", "name", "others", "whole").first().entry == 0


# --- names


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("abc", "acb", 1), ("abc", "abd", 1), ("abc", "", 3), ("kitten", "sitting", 3), ("abcdef", "zzzzzz", 4)])
def test_distance(a, b, d):
    assert names.distance(a, b, 3) == d and names.distance(b, a, 3) == d


LIST = [
    (0, "Alpha", "Ashdown", ["Old Ashwick"]), (1, "Alpha", "Ashdown Urban", []), (2, "Beta", "Mirrowfield", None), (3, "Beta", "Tarnbridge North", []), (4, "Beta", "Tarnbridge South", []), (5, None, "Velmouth", ["Kestrelhold"]),
]
VALUES = [
    ("ashdown", 0), ("Ashdown Rural District", 0), ("ÁSHDÓWN (Urban)", 1), ("Urban, Ashdwon", 1), ("A s h down Urb.", 1), ("Ashd0wn R.D.C.", 0), ("  \"Ashdown District\"", 0), ("AshdownUrban", 1), ("Old Ashwik Dist.", 0),
    ("Mirowfield / Beta", 2), ("Mirrovfield, Beta", 2), ("Мirrowfield RDC", 2), ("District: Mirrrowfield", 2), ("Mirrowfield Urban", -1), ("Tarnbridge N.", 3), ("South Tambridge", 4), ("Tarnbridge District", -1), ("TARNBRIDGE STH", 4), ("Tarnbridge​, South", 4),
    ("Kestrelhold", 5), ("Velmoth Town Council", 5), ("Alpha Province", -1), ("Beta total", -1), ("unknown", -1), ("?", -1), ("Rural District", -1), ("Harrowgate", -1), ("Ashenford Urban", -1), ("x" * 5000, -1),
]


def test_names_are_mapped(spark):
    listed = spark.createDataFrame(LIST, "entry int, whole string, name string, others array<string>")
    rows = [(i, v) for i, (v, _) in enumerate(VALUES)] + [(0, "ashdown"), (900, None), (901, "  \t"), (902, "Ashdown"), (None, "ashdwn"), (903, "　")]
    got = canonical.match(spark.createDataFrame(rows, "k long, typed string"), "k", "typed", listed, "entry", "name", "others", "whole")
    assert got.columns == ["k", "typed", "entry"]
    assert {VALUES[r.k][0]: r.entry for r in got.collect()} == dict(VALUES)
    none = canonical.match(spark.createDataFrame(rows[:3], "k long, typed string"), "k", "typed", listed.limit(0), "entry", "name", "others", "whole")
    assert {r.entry for r in none.collect()} == {-1}
    assert canonical.match(spark.createDataFrame([], "k long, typed string"), "k", "typed", listed, "entry", "name", "others", "whole").count() == 0


def test_prefix_join_finds_all_similar_pairs(spark):
    """Every listed name within reach by edits has pairs of letters enough in common to be joined."""
    r = random.Random(8)
    listed = ["".join(r.choice(["ba", "ro", "ston", "field", "mer", "ki", "ul"]) for _ in range(4)) for _ in range(40)]
    listed = [x for x in dict.fromkeys(listed) if len(x) > 7]
    typed = []
    for x in listed:
        i = r.randrange(1, len(x) - 1)
        typed += [x[:i] + x[i + 1 :], x[:i] + r.choice("aeiou") + x[i:], x[: i - 1] + x[i] + x[i - 1] + x[i + 1 :]]
    got = {c.core: c.near for c in canonical.nearest(spark.createDataFrame([(t,) for t in typed], "core string"), listed).collect()}
    for t in typed:
        near = sorted((min(names.distance(t, x, 9), names.distance(names.fold(t), names.fold(x), 9)), x) for x in listed)
        if near[0][0] < near[1][0]:
            assert got.get(t) == near[0][1]
