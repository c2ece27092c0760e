"""Delimited rows that fail to parse, set aside with the reason, by regular expressions made from a schema.

One anchored pattern per schema matches a whole valid row. Rows it refuses go
through patterns of growing prefixes of the row, first of its fields' shape, then
of their values; the first prefix that fails gives the reason and the broken field.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: White space that may surround a value, as a class's contents.
SPACE = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
#: A field of any content: quoted, with inner quotes doubled, or free of quotes and commas. It can be read one way only,
#: so it never gives back what it took, and a row of any length takes one pass.
ANY = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


@dataclass(frozen=True)
class Field:
    """A column of a record: ``kind`` is text, number (between ``low`` and ``high``) or word (one of ``words``, case ignored)."""

    name: str
    kind: str = "text"
    low: float | None = None
    high: float | None = None
    words: tuple[str, ...] = ()

    def pattern(self) -> str:
        if self.kind == "text":
            return ANY
        if self.kind == "number":
            core = NUMBER
        else:
            core = "(?iu:" + "|".join(re.sub(r"([^\w ])", r"\\\1", w).replace('"', '""') for w in sorted(self.words)) + ")" if self.words else "(?!)"
        inner = f"[{SPACE}]*+{core}[{SPACE}]*+"
        return f'(?:"{inner}"|{inner})(?=,|\\z)'


def _row(patterns: list[str]) -> str:
    return r"\A" + ",".join(patterns)


def _capture(fields: list[Field], k: int) -> str:
    return _row([f"({ANY})" if i == k else ANY for i in range(len(fields))]) + r"\z"


def _value(line: Column, fields: list[Field], k: int) -> Column:
    """The k-th field of a well-formed row, without its quotes; empty if the row isn't one."""
    raw = F.regexp_extract(line, _capture(fields, k), 1)
    return F.when(raw.startswith('"'), F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)


def value(line: Column, fields: list[Field], k: int) -> Column:
    """The k-th field of a well-formed row, without its quotes; null if the row isn't one."""
    return F.when(line.rlike(_row([ANY] * len(fields)) + r"\z"), _value(line, fields, k))


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _out_of_range(line: Column, fields: list[Field]) -> list[Column]:
    out = []
    for k, f in enumerate(fields):
        if f.kind == "number" and (f.low is not None or f.high is not None):
            n = _bare(_value(line, fields, k)).try_cast("double")
            out.append(F.coalesce((n < f.low) | (n > f.high) | F.isnan(n), F.lit(False)).alias(f.name))
    return out


def classify(df: DataFrame, line: str, fields: list[Field]) -> DataFrame:
    """Adds ``reason`` (null for a valid row: quoting, column_count or invalid_value, the first that applies) and ``broken_field``.

    A null line has no fields: column_count. An empty line has one. The broken
    field is the first whose prefix fails, or null where the row merely has too
    many fields. Quoted fields may hold commas and line breaks. Other columns are
    kept; one that is itself called reason or broken_field is replaced.
    """
    text = F.col(f"`{line}`")
    typed, n = [f.pattern() for f in fields], len(fields)
    wide = dict(zip([f.name for f in fields if f.kind == "number" and (f.low is not None or f.high is not None)], _out_of_range(text, fields)))
    far = F.lit(False)
    for c in wide.values():
        far = far | c
    whole = text.rlike(_row(typed) + r"\z") & ~far
    fails = lambda reason, name: F.struct(F.lit(reason).alias("reason"), F.lit(name).cast("string").alias("broken_field"))
    # prefixes of the fields' shape: one that fails after a row that ended is a field too few, any other a broken quote
    found = F.when(text.isNull(), fails("column_count", None))
    for k, f in enumerate(fields):
        ended = text.rlike(_row([ANY] * k) + r"\z") if k else F.lit(False)
        found = found.when(~text.rlike(_row([ANY] * (k + 1)) + r"(?=,|\z)"), F.when(ended, fails("column_count", f.name)).otherwise(fails("quoting", f.name)))
    # all fields are there: what follows them is too much, and may be broken itself
    found = found.when(~text.rlike(_row([ANY] * n) + r"\z"), F.when(text.rlike(_row([ANY] * n) + rf"(?:,{ANY})*+\z"), fails("column_count", None)).otherwise(fails("quoting", None)))
    # prefixes of the fields' values
    for k, f in enumerate(fields):
        broken = ~text.rlike(_row(typed[: k + 1]) + r"(?=,|\z)")
        if f.kind != "text":
            found = found.when(broken | wide[f.name] if f.name in wide else broken, fails("invalid_value", f.name))
    out = df.withColumn("__outcome", F.when(text.isNotNull() & whole, None).otherwise(found))
    return out.withColumns({"reason": F.col("__outcome.reason"), "broken_field": F.col("__outcome.broken_field")}).drop("__outcome")


def split_rows(df: DataFrame, line: str, fields: list[Field], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Loaded rows (``keep`` and a column per field: numbers as doubles, words trimmed) and failing rows (``keep``, line, reason, broken_field)."""
    marked = classify(df, line, fields)
    text = F.col(f"`{line}`")
    columns = []
    for k, f in enumerate(fields):
        v = value(text, fields, k)
        v = _bare(v).try_cast("double") if f.kind == "number" else _bare(v) if f.kind == "word" else v
        columns.append(v.alias(f.name))
    kept = [F.col(f"`{c}`") for c in keep]
    return marked.filter("reason is null").select(*kept, *columns), marked.filter("reason is not null").select(*kept, text, "reason", "broken_field")
