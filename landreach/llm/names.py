"""Freely typed place names: folding to plain letters, and taking off what isn't the name."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other alphabets, and signs, that are typed for Latin letters they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "0": "o", "1": "l", "3": "e", "4": "a",
    "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l", "!": "i",
}
#: Spellings of one sound or shape, brought to one form in this order.
SPELLINGS = (("ph", "f"), ("oo", "u"), ("ck", "k"), ("c", "k"), ("w", "v"), ("z", "s"), ("y", "i"))
#: Words that say what kind of unit a name means, longest first when taken off.
URBAN, RURAL = ("urban district", "urban dist", "urban", "urbn", "urb"), ("rural district", "rurl dist", "rural dist", "rural", "rurl", "r d c")
PLAIN = ("districts", "district", "district of", "dist", "distr", "rdc", "town council", "local board")
WAYS = {"north": ("north", "nth", "n"), "south": ("south", "sth", "s"), "east": ("east", "est", "e"), "west": ("west", "wst", "w")}
#: Where a way's initial or short form is typed against the name.
JOINED = re.compile(r"(?<=[a-z])(?=(?:[NSEW]|Nth|Sth)\.?\s*$)")


class _Letters(dict):
    """What each character stands for; made when it is first met."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", chr(code)).casefold():
            c = LOOKALIKES.get(c, c)
            if unicodedata.category(c[0]) not in ("Mn", "Cf"):
                out.append(c if c.isascii() and c.isalpha() else " ")
        self[code] = made = "".join(out)
        return made


_letters = _Letters()


def letters(text: str) -> str:
    """Lower-case Latin letters and single spaces; accents, look-alikes and invisible signs resolved."""
    return " ".join(text.translate(_letters).split())


def plain(text: str) -> str:
    """Plain letters, without spaces."""
    return letters(text).replace(" ", "")


def fold(text: str) -> str:
    """Plain letters in one spelling of each sound, none doubled."""
    s = plain(text)
    for old, new in SPELLINGS:
        s = s.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", s)


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


class Reader:
    """Takes a typed value apart: kind (urban, rural or none), way (north ... or none) and the core in plain letters.

    ``wholes`` are names of larger units, which may follow a name and which
    alone, or as a total, mean no entry.
    """

    def __init__(self, wholes: list[str]):
        self.wholes = sorted({plain(w) for w in wholes}, key=len, reverse=True)
        kinds = [(plain(w), "urban") for w in URBAN] + [(plain(w), "rural") for w in RURAL] + [(plain(w), "") for w in PLAIN]
        self.tails = sorted(set(kinds), key=lambda k: -len(k[0]))
        self.heads = [k for k in self.tails if k[0] in {plain(w) for w in ("district of", "district", "urban", "rural")}]
        self.ways = sorted(((plain(w), way) for way, ws in WAYS.items() for w in ws), key=lambda k: -len(k[0]))
        self.long_ways = [k for k in self.ways if len(k[0]) > 3]

    def _whole(self, text: str) -> bool:
        return bool(text) and (text in self.wholes or any(distance(text, w, 2) <= min(2, len(w) // 4) for w in self.wholes))

    def read(self, value: str) -> tuple[str, str, str]:
        value = JOINED.sub(" ", value)
        parts = [p for p in re.split(r"[,/:]", value) if plain(p)]
        if len(parts) == 2 and self._whole(plain(parts[1])):
            value = parts[0]
        spaced = letters(value).split()
        s = plain(value)
        kind = way = ""
        if len(spaced) > 1 and spaced[-1] in ("n", "s", "e", "w"):  # an initial is a way only as a word of its own
            way = {v[2][0]: k for k, v in WAYS.items()}[spaced[-1]]
            s = plain(" ".join(spaced[:-1]))
        changed = True
        while changed:
            changed = False
            for text, k in self.tails:
                if s.endswith(text) and len(s) > len(text) + 2:
                    s, kind, changed = s[: -len(text)], kind or k, True
                    break
            for text, k in self.heads:
                if s.startswith(text) and len(s) > len(text) + 2:
                    s, kind, changed = s[len(text) :], kind or k, True
                    break
            for text, k in self.long_ways if not way else ():
                if s.endswith(text) and len(s) > len(text) + 2:
                    s, way, changed = s[: -len(text)], k, True
                    break
                if s.startswith(text) and len(s) > len(text) + 2:
                    s, way, changed = s[len(text) :], k, True
                    break
            if not way and not changed and len(spaced) > 1:
                for text, k in self.ways:
                    if len(text) == 3 and s.endswith(text) and plain(spaced[-1]) == text:
                        s, way, changed = s[:-3], k, True
                        break
        return kind, way, s
