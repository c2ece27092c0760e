"""Counts of every line of a text, taken from arrays of its characters."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bits of a character's classes. Space is what separates words: tab to carriage return, and the space itself.
SPACE, LETTER, NUMBER, UPPER, VOWEL, CONSONANT, WIDE, SEPARATOR, CODE, STOP, ANGLE, EQUAL = (1 << k for k in range(12))
#: Signs that end a sentence, that separate values, and that are common in code.
STOPS, SEPARATORS, CODES = ".!?:;…。！？؟।", ",;|&\t", "()[]{}=<>\"'_+*#@%\\/$^~`"
#: Texts are looked at in stretches of whole lines of about so many characters.
STRETCH = 400_000
#: What is summed up over a document, and what rules may test in a line.
COUNTS = ["size", "words", "solid", "symbols", "digits", "stops", "known", "again"]
FEATURES = [
    "n", "letters", "numbers", "marks", "upper", "word_count", "word_length", "longest", "separators", "gaps", "numeric", "code", "angles", "equals", "first_mark", "first_number", "stop", "vowels",
    "switches", "clusters", "mixed", "run", "alike", "near_n", "near_separators", "near_gaps", "near_numeric", "near_code", "near_stop", "near_first_mark", "near_alike",
]
#: Neighbouring lines, on either side, that a line's near_ values are the mean of.
NEAR = 2


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.array(list(map(unicodedata.category, map(chr, range(0x110000)))))
    first = kinds.astype("U1")
    table = np.where(first == "L", LETTER, 0) + np.where(first == "N", NUMBER, 0) + np.where(kinds == "Lu", UPPER, 0)
    table[0x80:] |= WIDE
    for signs, bit in ((STOPS, STOP), (SEPARATORS, SEPARATOR), (CODES, CODE), ("<>", ANGLE), ("=", EQUAL), ("aeiouyAEIOUY", VOWEL), ("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ", CONSONANT)):
        table[[ord(s) for s in signs]] |= bit
    table[[9, 10, 11, 12, 13, 32]] |= SPACE
    return table.astype(np.uint16)


@functools.lru_cache(1)
def _factors() -> np.ndarray:
    return np.random.default_rng(1).integers(1, 1 << 63, 4096, dtype=np.uint64)


def _stretch(text: str) -> dict[str, np.ndarray]:
    """Counts of each line of a text that ends with a line break."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    f = _classes()[codes]
    space = (f & SPACE) != 0
    ends = np.flatnonzero(codes == 10)
    begins = np.r_[0, ends[:-1] + 1]
    upto = lambda flags: np.r_[0, np.cumsum(flags, dtype=np.int64)]
    has = lambda bits: (f & bits) != 0
    w0 = np.flatnonzero(~space & np.r_[True, space[:-1]])
    w1 = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    lo, hi = np.searchsorted(w0, begins), np.searchsorted(w0, ends)  # words of each line: lo up to hi
    solid_all = upto(~space)
    out = {"size": ends - begins + 1, "all_words": hi - lo, "solid": solid_all[ends] - solid_all[begins]}
    if len(w0):  # one comment sign before a line isn't part of it
        sign = (lo < hi) & (codes[np.minimum(w0[np.minimum(lo, len(w0) - 1)], len(codes) - 1)] == 35) & (w1[np.minimum(lo, len(w0) - 1)] - w0[np.minimum(lo, len(w0) - 1)] == 1)
        lo = lo + (sign & (hi - lo > 1))
    some = lo < hi
    a, b = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    a[some], b[some] = w0[lo[some]], w1[hi[some] - 1]
    within = lambda flags, x=a, y=b: (lambda c: c[y] - c[x])(upto(flags))
    letter, number = has(LETTER), has(NUMBER)
    mark = ~letter & ~number & ~space
    out |= {"n": b - a, "letters": within(letter), "numbers": within(number), "marks": within(mark), "upper": within(has(UPPER)), "code": within(has(CODE)), "angles": within(has(ANGLE)), "equals": within(has(EQUAL)), "separators": within(has(SEPARATOR)), "vowels": within(has(VOWEL)), "latin": within(has(VOWEL | CONSONANT))}
    out |= {"symbols": within(mark, begins, ends), "digits": within((codes >= 48) & (codes <= 57), begins, ends)}
    cons = has(CONSONANT)
    five = cons.copy()
    for k in range(1, 5):
        five[k:] &= cons[:-k]
        five[:k] = False
    out["clusters"] = within(five)
    kind = np.select([space, has(UPPER), letter & ~has(WIDE), letter, number], [0, 1, 2, 3, 4], 5).astype(np.int8)
    other = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    out["switches"] = within(np.r_[False, other])
    wide = has(WIDE)
    out["mixed"] = within(np.r_[False, (wide[1:] != wide[:-1]) & ~space[1:] & ~space[:-1]])
    words = hi - lo
    out["word_count"] = words
    first, last = np.where(some, a, 0), np.where(some, b - 1, 0)
    out |= {"first_mark": some & mark[first], "first_number": some & number[first], "stop": some & has(STOP)[last]}
    size = w1 - w0
    out["longest"] = np.zeros(len(ends), np.int64)
    line = np.repeat(np.arange(len(ends)), words)
    k = np.arange(len(line)) + np.repeat(lo - np.r_[0, np.cumsum(words)[:-1]], words)  # each counted word's number
    np.maximum.at(out["longest"], line, size[k])
    cl, cn = upto(letter), upto(number)
    numeric = (cn[w1[k]] > cn[w0[k]]) & (cl[w1[k]] - cl[w0[k]] <= (cn[w1[k]] - cn[w0[k]]) / 4)
    out["numeric"] = np.bincount(line, numeric, len(ends)).astype(np.int64)
    apart = np.r_[w0[k][1:] - w1[k][:-1] > 1, False] & np.r_[line[1:] == line[:-1], False]
    out["gaps"] = np.bincount(line, apart, len(ends)).astype(np.int64)
    at = np.arange(len(codes)) - np.repeat(a, out["size"])
    with np.errstate(over="ignore"):
        h = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * _factors()[at & 4095], dtype=np.uint64)]
        out["hash"] = np.where(some, h[b] - h[a], np.uint64(0))
    return out


def _stretches(texts: list[str]) -> Iterator[str]:
    """The texts, each ended by a line break, in stretches of whole lines."""
    held, size = [], 0
    for t in texts:
        at = 0
        t += "\n"
        while at < len(t):
            to = len(t) if len(t) - at <= STRETCH else t.rfind("\n", at, at + STRETCH) + 1 or t.index("\n", at) + 1
            part = t[at:to] if at or to < len(t) else t
            if size and size + len(part) > STRETCH:
                yield "".join(held)
                held, size = [], 0
            held.append(part)
            size += len(part)
            at = to
    if held:
        yield "".join(held)


def of_texts(texts: list[str | None], common: frozenset[bytes]) -> dict[str, np.ndarray]:
    """``doc`` (the text's place), COUNTS and FEATURES of every line that isn't blank; a text without any has one row of zeros."""
    texts = [t or "" for t in texts]
    parts = [_stretch(s) for s in _stretches(texts)]
    c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
    if not c:
        return {"doc": np.zeros(0, np.int64), **{k: np.zeros(0) for k in [*COUNTS, *FEATURES]}}
    doc = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
    full = c["n"] > 0
    start = np.r_[True, doc[1:] != doc[:-1]]
    none = ~np.isin(doc, doc[full]) & start
    keep = full | none
    doc, c = doc[keep], {k: v[keep] for k, v in c.items()}
    full, start = full[keep], np.r_[True, doc[1:] != doc[:-1]]
    new = start | np.r_[True, c["hash"][1:] != c["hash"][:-1]] | np.r_[True, c["n"][1:] != c["n"][:-1]]
    of = np.cumsum(new) - 1
    run = np.bincount(of)[of]
    n, words = np.maximum(c["n"], 1), np.maximum(c["word_count"], 1)
    letters = np.maximum(c["letters"], 1)
    same = ~start & np.r_[False, (c["word_count"][1:] == c["word_count"][:-1]) & (c["separators"][1:] == c["separators"][:-1]) & (c["gaps"][1:] == c["gaps"][:-1])]
    alike = same | np.r_[same[1:], False]
    x = {
        "n": c["n"], "letters": c["letters"] / n, "numbers": c["numbers"] / n, "marks": c["marks"] / n, "upper": c["upper"] / letters, "word_count": c["word_count"],
        "word_length": (c["letters"] + c["numbers"] + c["marks"]) / words, "longest": c["longest"], "separators": c["separators"] / words, "gaps": c["gaps"] / words,
        "numeric": c["numeric"] / words, "code": c["code"] / n, "angles": c["angles"] / n, "equals": c["equals"] / n, "first_mark": c["first_mark"], "first_number": c["first_number"], "stop": c["stop"],
        "vowels": np.where(c["latin"] > 0, c["vowels"] / np.maximum(c["latin"], 1), 0.4), "switches": c["switches"] / n, "clusters": c["clusters"] / np.maximum(c["latin"], 1),
        "mixed": c["mixed"] / n, "run": run, "alike": alike,
    }
    begin = np.maximum.accumulate(np.where(start, np.arange(len(doc)), 0))
    end = np.r_[np.flatnonzero(start)[1:], len(doc)][np.cumsum(start) - 1]
    lo, hi = np.maximum(np.arange(len(doc)) - NEAR, begin), np.minimum(np.arange(len(doc)) + NEAR + 1, end)
    for k in ("n", "separators", "gaps", "numeric", "code", "stop", "first_mark", "alike"):
        sums = np.r_[0, np.cumsum(np.minimum(x[k], 1000) if k == "n" else x[k], dtype=float)]
        x[f"near_{k}"] = (sums[hi] - sums[lo]) / (hi - lo)
    known = np.array([sum(map(common.__contains__, t.lower().encode("utf-8", "surrogatepass").split())) for t in texts], dtype=np.int64)
    counts = {"size": np.where(full, c["size"], 0), "words": c["all_words"], "solid": c["solid"], "symbols": c["symbols"], "digits": c["digits"], "stops": c["stop"], "known": np.where(start, known[doc], 0), "again": np.where((run >= 3) & full, c["size"], 0)}
    return {"doc": doc, **{k: counts[k].astype(np.int64) for k in COUNTS}, **{k: np.asarray(x[k], dtype=np.float32) for k in FEATURES}}


def table(keys: pa.Array, texts: pa.Array, key: str, common: frozenset[bytes]) -> pa.RecordBatch:
    """The rows of one batch of documents."""
    got = of_texts(texts.to_pylist(), common)
    doc = got.pop("doc")
    columns = [pa.array(v, pa.int64() if k in COUNTS else pa.float32()) for k, v in got.items()]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(doc, pa.int64())), *columns], names=[key, *got])
