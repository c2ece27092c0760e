import random

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from landreach.llm import bpe, labelled, packing, quality, queries, rules

tiktoken = pytest.importorskip("tiktoken")
VOCABULARY = queries.vocabulary()


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})


def texts():
    r = random.Random(4)
    kinds = ["abcdefghij ", "0123456789 .,", "éüßøñ ", "данные слова ", "数据模型。", "🙂🚀 ", "\t\n\r \x0b\x1c\x85\xa0 　", "'sdmtlvre ", "+/=ABCDEFabcdef0123456789", "½²Ⅷ٣ ", "​﻿́"]
    out = ["", " ", "  ", "\n\n", "it's we'll 'S don't\n\n ", "<|endoftext|>", "a" * 5000, "x " * 2000, "=" * 3000, "\x00\x01", "aaá"]
    for _ in range(400):
        out.append("".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(1, 120))))
    return out


def test_ids_match_the_public_encoder(reference):
    own = bpe.encoder(VOCABULARY)
    for t in texts():
        assert own.encode(t).tolist() == reference.encode_ordinary(t) and own.count(t) == len(reference.encode_ordinary(t))


def test_full_stores_are_cleared(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KEPT", 5)
    own = bpe.TextEncoder(VOCABULARY)
    for t in texts()[:80]:
        assert own.encode(t).tolist() == reference.encode_ordinary(t) and own.count(t) == len(own.encode(t))


def test_ids_of_a_table(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(-1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.token_ids(df, VOCABULARY).collect()}
    assert got.pop(-1) is None and got[0] == [] and got == {i: reference.encode_ordinary(t) for i, t, _ in rows if t is not None}
    assert bpe.token_ids(df, VOCABULARY).schema["ids"].dataType.simpleString() == "array<int>"
    assert bpe.token_ids(df.limit(0), VOCABULARY).count() == 0


# --- packing


def check(items, packed, capacity):
    """Whole, without a gap, within the capacity; split only if larger; equal texts apart."""
    pieces, bins = {}, {}
    for key, piece, start, size, n in packed:
        pieces.setdefault(key, []).append((piece, start, size))
        bins.setdefault(n, []).append((key, size))
    cluster = {i: c for i, _, _, c in items}
    for key, size, _, _ in items:
        own = sorted(pieces.pop(key))
        assert [p for p, _, _ in own] == list(range(len(own))) and [s for _, s, _ in own] == [k * capacity for k in range(len(own))]
        assert sum(s for _, _, s in own) == size and (len(own) == 1 or size > capacity)
    assert not pieces
    for held in bins.values():
        assert sum(s for _, s in held) <= capacity
        marks = [cluster[k] for k, _ in held if cluster[k] is not None]
        assert len(marks) == len(set(marks))
    assert sorted(bins) == list(range(len(bins)))
    return bins


def test_packing():
    r = random.Random(2)
    items = [(i, r.choice([0, 1, 100, 2047, 2048, 2049, 4096, 9000, r.randrange(1, 3000)]), r.randrange(9), None) for i in range(800)]
    bins = check(items, packing.pack(items, 2048), 2048)
    assert len(bins) <= sum(x[1] for x in items) / 2048 * 1.03 + 1
    assert packing.pack([], 2048) == []


def test_equal_texts_never_meet_and_sources_are_spread():
    items = [(i, 10, 0, 7) for i in range(50)]
    assert len(check(items, packing.pack(items, 100), 100)) == 50
    items = [(i, 50, i % 2, None) for i in range(40)]
    source = {i: s for i, _, s, _ in items}
    bins = check(items, packing.pack(items, 100), 100)
    assert len(bins) == 20 and all(len({source[k] for k, _ in held}) == 2 for held in bins.values())
    items = [(i, 50, 0, None) for i in range(40)]  # one source only: a container each
    assert len(check(items, packing.pack(items, 100), 100)) == 40


def test_containers_of_a_table(spark):
    words = "one two three four five six seven "
    rows = [(i, words * (i % 40), f"s{i % 3}", "x") for i in range(300)] + [(1000, None, None, "x"), (1001, "", "s0", "x"), (1002, words * 900, "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, container string")
    got = packing.containers(df, VOCABULARY, 256).collect()
    own = bpe.encoder(VOCABULARY)
    fill, total = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
    assert max(fill.values()) <= 256 and total == {i: own.count(t) if t else 0 for i, t, _, _ in rows}
    assert packing.containers(df.limit(0), VOCABULARY, 256).count() == 0
    of = {i: (s, t) for i, t, s, _ in rows}
    held: dict = {}
    for r in got:
        held.setdefault(r.container, []).append(of[r.doc_id])
    for items in held.values():
        sources, texts = [s for s, _ in items if s is not None], [t for _, t in items if t]
        assert len(sources) == len(set(sources)) and len(texts) == len(set(texts))
    near = packing.containers(df.withColumn("c", F.expr("doc_id % 2")), VOCABULARY, 256, cluster="c").filter("tokens > 0").groupBy("container").count()
    assert near.agg({"count": "max"}).first()[0] <= 2  # one of each cluster


# --- quality


BLOCKS = [
    ("text", "We went down to the harbour early, before the boats came in.\nNobody was there yet; the nets were still wet from the night, and it smelled of tar."),
    ("text", "import csv\n\ndef read(path, skip=2):\n    with open(path) as f:\n        rows = list(csv.reader(f))\n    return [r for r in rows[skip:] if len(r) > 3]"),
    ("list", "- apples\n- two lemons\n- brown bread\n- salt\n- a jar of honey\n- olive oil\n- soap"),
    ("table", "city,year,rain,days\nOslo,2001,812.5,113\nBergen,2001,2250.1,201\nBodo,2001,1020.7,180\nHamar,2001,590.0,98"),
    ("table", "| city | rain |\n| --- | --- |\n| Oslo | 812.5 |\n| Bergen | 2250.1 |\n| Bodo | 1020.7 |"),
    ("junk", "\n".join("q8Zr0vKx2LmN9sTbUe4WyHj7PcAdGf1R5oQiVtXk3EzYwMhJ6uBnSlDgCpF+8aOr/IqT0xZv1LsK" for _ in range(2)) + "\nA9sTbUe4Wyq8Zr0vKx2LmNHj7PcAdGf1R5oQiVtXk3EzYwMhJ6uBnSlDgCpF+8aOr/IqT0xZv1Ls"),
    ("junk", "\n".join(f"1999-03-0{k} 04:1{k}:22,10{k} INFO pump-{k} valve.main: step={k}81 t=0.4{k}19" for k in range(1, 8))),
    ("text", "In the end it rained all week, so the count was never finished. What would we have found?"),
]


def test_kinds_of_lines(spark):
    """Of one document of all sorts of parts: most characters of each part are of its kind."""
    df = spark.createDataFrame([(1, "\n\n".join(b for _, b in BLOCKS))], "doc_id long, text string")
    got = [tuple(r) for r in quality.line_table(df).selectExpr("size", f"coalesce({quality.RULES}, 'text')").collect()]
    for kind, block in BLOCKS:
        n = sum(1 for x in block.split("\n") if x)
        part, got = got[:n], got[n:]
        assert 2 * sum(size for size, k in part if k == kind) > sum(size for size, _ in part), (kind, block, part)
    assert not got


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(1, "The cat is here.\n\nNo 42", "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t", "x"), (5, "waiting for it\n" * 9 + "end", "x")], "doc_id long, text string, word_count string")
    got = {r.doc_id: r for r in quality.statistics(df).collect()}
    a = got[1]
    assert (a.word_count, a.mean_word_length, a.symbol_ratio, a.punctuated_lines) == (6, pytest.approx(17 / 6), pytest.approx(1 / 17), 0.5)
    assert (a.digit_ratio, a.common_words) == (pytest.approx(2 / 17), pytest.approx(3 / 6))  # the, is, no
    assert all(got[k].word_count == 0 and got[k].mean_word_length == 0.0 for k in (2, 3, 4))
    assert got[5].repeat_share > 0.9
    assert quality.statistics(df.limit(0)).count() == 0


def test_long_and_hard_texts(spark):
    hard = ["a " * 200_000, "x" * 300_000, "same line here\n" * 100_000, "a,b" * 60_000, "  ".join(["q"] * 60_000), "| " * 90_000, "%" * 90_000, "12 " * 90_000]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    assert quality.statistics(df).count() == len(hard)


def test_rules_on_held_out_documents(spark):
    made = labelled.lines(500, seed=99)  # the rules were fitted on another seed
    size = lambda t: [len(x) + 1 for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
    want = {}
    for i, (text, kinds) in enumerate(made):
        n = size(text)
        want[i] = next((k for k in quality.KINDS if 2 * sum(s for s, x in zip(n, kinds) if x == k) > sum(n)), "none")
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(made)] + [(10_000, None), (10_001, "")], "doc_id long, text string")
    got = {r.doc_id: r.kind for r in quality.kinds(df).collect()}
    assert sum(got.get(i, "none") == k for i, k in want.items()) / len(want) > 0.95 and 10_000 not in got and 10_001 not in got


def test_the_fit_is_the_one_kept():
    from landreach.llm import fit, words

    assert rules.to_sql(fit.fit(frozenset(w.encode() for w in words.COMMON))).split() == quality.RULES.split()


def test_stretches_do_not_change_the_counts(monkeypatch):
    from landreach.llm import lines

    texts = [m[0] for m in labelled.lines(40, 3)] + ["", None, "x" * 5000, "\n\n", "a\n" * 3000]
    whole = lines.of_texts(texts, frozenset([b"the"]))
    monkeypatch.setattr(lines, "STRETCH", 1000)
    for k, v in lines.of_texts(texts, frozenset([b"the"])).items():
        assert np.array_equal(v, whole[k]), k


def test_rule_induction():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(900), "b": rng.random(900)}
    y = np.where(x["a"] > 0.7, "p", np.where(x["b"] < 0.2, "q", "none"))
    found = rules.induce(x, y, ["p", "q"])
    out = np.full(900, "none")
    for r in reversed(found):
        out[r.covers(x)] = r.kind
    assert (out == y).mean() > 0.97 and rules.to_sql([]) == "NULL"
    assert rules.to_sql([rules.Rule("p", (("a", ">=", 0.5), ("b", "<=", 0.25)))]) == "CASE WHEN a >= 0.5D AND b <= 0.25D THEN 'p' ELSE NULL END"


def test_queries_against_sql(spark, data):
    from oracle import compare, database

    con = database(data)
    for name, sql in queries.oracle_sql().items():
        assert compare(queries.queries()[name](spark, data), con, sql) == "", name
    assert isinstance(queries.p8_fill(spark, data).first(), Row)
