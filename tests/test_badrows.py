import csv
import io
import random

import pytest

from landreach.operators.badrows import Field, classify, split_rows

FIELDS = [Field("id"), Field("province", "word", words=("North", "Upper (East)")), Field("x", "number", -180, 180), Field("note")]
CASES = [
    ("1,North,12.5,ok", None, None),
    ('"1","north "," 12.5 ","say ""hi"", now\nplease"', None, None),
    ("1, UPPER (EAST) ,+1.8e2,", None, None),
    ("1,North,.5,", None, None),
    ("1,North,5.,\r", None, None),
    ("1,North,180.1,", "invalid_value", "x"),
    ("1,North,1e400,", "invalid_value", "x"),
    ("1,North,0x1F,", "invalid_value", "x"),
    ("1,North,1.2.3,", "invalid_value", "x"),
    ("1,North,−1,", "invalid_value", "x"),
    ("1,North,١,", "invalid_value", "x"),
    ("1,North,,", "invalid_value", "x"),
    ("1,South,abc,", "invalid_value", "province"),
    ("1,,1,", "invalid_value", "province"),
    ("1,North,1", "column_count", "note"),
    ("1,North,1,a,b", "column_count", None),
    ("1;North;1;", "column_count", "province"),
    ("", "column_count", "province"),
    (None, "column_count", None),
    ('1,No"rth,1,', "quoting", "province"),
    ('1,"North,1,a', "quoting", "province"),
    ('1,North,1,"a" ', "quoting", "note"),
    ('1,North,1, "a"', "quoting", "note"),
    ('"1"",North,1,', "quoting", "id"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, c[0], "kept") for i, c in enumerate(CASES)], "k long, line string, id string")
    got = {r.k: (r.reason, r.broken_field) for r in classify(df, "line", FIELDS).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}
    good, bad = split_rows(df, "line", FIELDS, ["k"])
    assert good.count() + bad.count() == len(CASES)
    rows = {r.k: r for r in good.collect()}
    assert rows[1].note == 'say "hi", now\nplease' and rows[1].province == "north" and rows[1].x == 12.5 and rows[2].x == 180.0


def test_long_lines_do_not_overflow(spark):
    lines = ["1,North,1," + "a" * 500_000, "1,North,1," + "," * 300_000, '1,North,1,"' + '""' * 300_000 + '"', '"' * 300_001]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    assert [r.reason for r in classify(df, "line", FIELDS).orderBy("k").collect()] == [None, "column_count", None, "quoting"]


def test_empty_table_and_no_words(spark):
    assert classify(spark.createDataFrame([], "line string"), "line", FIELDS).count() == 0
    df = spark.createDataFrame([("1,North",)], "line string")
    assert classify(df, "line", [Field("id"), Field("p", "word")]).first().reason == "invalid_value"


def test_agrees_with_the_csv_module(spark):
    r = random.Random(9)
    rows = [[r.choice(["", "a", "a,b", 'q"q', "x\ny"]) for _ in range(r.randint(1, 6))] for _ in range(300)]
    made = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        made.append((len(made), out.getvalue()))
    fields = [Field("a"), Field("b"), Field("c")]
    good, bad = split_rows(spark.createDataFrame(made, "k long, line string"), "line", fields, ["k"])
    assert {x.k: [x.a, x.b, x.c] for x in good.collect()} == {i: row for i, row in enumerate(rows) if len(row) == 3}
    assert {x.reason for x in bad.collect()} == {"column_count"}


def test_columns_of_the_same_names_are_replaced(spark):
    df = spark.createDataFrame([("1,North,1,a", "x", "y", "z")], "line string, reason string, broken_field string, province string")
    row = classify(df, "line", FIELDS).first()
    assert (row.reason, row.broken_field, row.province) == (None, None, "z")
    good, bad = split_rows(df, "line", FIELDS, [])
    assert good.first().province == "North" and bad.count() == 0
