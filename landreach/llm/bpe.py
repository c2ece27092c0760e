"""Exact byte-level BPE of a public vocabulary, by automaton and backtracking.

A piece's bytes are mapped to Latin-1 characters, so that pyahocorasick can
search them. The longest token that starts at each place is tried first; it
stands if the pair of the token before and itself could come out of BPE side by
side (which is memoised), and if not, a shorter token that also ends on a
reachable place is tried. The encoding that passes every pair is the one that
BPE's merges give, and each place is refused at most once, so the work is linear
in the bytes. Published by van Antwerpen and Neubeck, "So many tokens, so little
time: introducing a faster, more flexible byte-pair tokenizer" (2024).
"""

from __future__ import annotations

import base64
import os
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

#: The vocabulary's splitting pattern as published with it, and the characters its \\s stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A worker's memory: how many different stretches it keeps, and how long they may be.
KEPT, KEPT_CHARS = 250_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairEncoder:
    """Encodes pieces; ``ranks`` has the id of every token, which is also its merge's priority."""

    def __init__(self, ranks: dict[bytes, int]):
        self.id_of = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text_of = {v: k for k, v in self.id_of.items()}
        self.length = {i: len(text) for text, i in self.id_of.items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}  # cleared when it has grown large

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; the token twice, if it is a single byte.

        Of all ways to cut a token in two, BPE's is the one whose later half is
        not taken apart by the merges that come before.
        """
        got = self.halves.get(token)
        if got is None:
            text = self.text_of[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:  # plain merging, once per token of the vocabulary that is ever asked for
                best, at = None, -1
                for i in range(len(parts) - 1):
                    rank = self.id_of.get(parts[i] + parts[i + 1])
                    if rank is not None and rank < token and (best is None or rank < best):
                        best, at = rank, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = (self.id_of[parts[0]], self.id_of[parts[1]]) if len(parts) == 2 else (token, token)
            self.halves[token] = got
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side, without a merge across their border."""
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            got = self.fits[left, right] = self._compatible(left, right)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        limit = sys.maxsize
        while True:
            across = self.id_of.get(self.text_of[a] + self.text_of[b])
            if across is not None and across < limit:
                return False
            (a1, a2), (b1, b2) = self.split(a), self.split(b)
            # take back the later of the two merges; a pair found then must have come later still
            if (a > b or b1 == b) and a1 != a:
                limit, a = a, a2
            elif b1 != b:
                limit, b = b + 1, b1
            else:
                return True

    def encode(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        whole = self.id_of.get(text)
        if whole is not None:
            return [whole]
        return self._search(text)

    def longest(self, text: str) -> list[int]:
        """At every place the id of the longest token that starts there."""
        out, length = [0] * len(text), self.length
        reach = [0] * len(text)
        for end, token in self.automaton.iter(text):
            n = length[token]
            start = end + 1 - n
            if n > reach[start]:
                reach[start], out[start] = n, token
        return out

    def _search(self, text: str) -> list[int]:
        n, length, compatible, fits = len(text), self.length, self.compatible, self.fits
        longest = self.longest(text)
        dead = bytearray(n + 1)
        tokens: list[int] = []
        at, last = 0, -1
        token: int | None = longest[0]
        while at < n:
            while token is not None:
                end = at + length[token]
                if not dead[end] and (last < 0 or (fits[last, token] if (last, token) in fits else compatible(last, token))):
                    break
                token = self.next_shorter(token)
            if token is None:
                dead[at] = 1
                if not tokens:
                    raise ValueError("a byte is missing from the vocabulary")
                token = tokens.pop()
                at -= length[token]
                token = self.next_shorter(token)
                last = tokens[-1] if tokens else -1
                continue
            tokens.append(token)
            last, at = token, end
            if at < n:
                token = longest[at]
        return tokens

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a true prefix of this one."""
        got = self.shorter.get(token, -1)
        if got == -1:
            text, got = self.text_of[token], None
            for k in range(len(text) - 1, 0, -1):
                got = self.id_of.get(text[:k])
                if got is not None:
                    break
            self.shorter[token] = got
        return got


class TextEncoder:
    """Encodes whole texts, stretch by stretch.

    A stretch is white space and the characters up to the next white space. The
    splitting pattern never crosses a stretch's end and sees nothing beyond it,
    so equal stretches have equal ids, which are looked up. Long stretches
    (images, blobs) aren't kept.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        self.pairs = BytePairEncoder(read_ranks(path))
        self.pieces = regex.compile(pattern)
        # the same pattern for ASCII text, where the classes are short and the standard library is faster
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii_pieces = re.compile(plain.replace(r"[^\s", r"[^\t-\r ").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]"))
        self.stretches = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.of_piece: dict[str, list[int]] = {}
        self.packed: dict[str, bytes] = {}
        self.counted: dict[str, int] = {}

    def stretch(self, text: str) -> list[int]:
        out: list[int] = []
        kept = self.of_piece
        for piece in (self.ascii_pieces if text.isascii() else self.pieces).findall(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.pairs.encode(piece.encode("utf-8", "replace"))
                if len(piece) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as int32."""
        kept, found = self.packed, []
        for part in self.stretches.findall(text):
            got = kept.get(part)
            if got is None:
                got = np.array(self.stretch(part), "<i4").tobytes()
                if len(part) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[part] = got
            found.append(got)
        return np.frombuffer(b"".join(found), "<i4")

    def count(self, text: str) -> int:
        """How many ids a text has."""
        kept, total = self.counted, 0
        for part in self.stretches.findall(text):
            got = kept.get(part)
            if got is None:
                got = len(self.stretch(part))
                if len(part) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[part] = got
            total += got
        return total


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def _handed_out(df: DataFrame, vocabulary: str) -> str:
    """Sends the file to every executor, once a session, and gives its name there."""
    sc = df.sparkSession.sparkContext
    if (sc.applicationId, vocabulary) not in _sent:
        sc.addFile(vocabulary)
        _sent.add((sc.applicationId, vocabulary))
    return os.path.basename(vocabulary)


_sent: set[tuple[str, str]] = set()


def token_ids(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: each row's text as token ids, without special tokens.

    ``vocabulary`` is the path of a .tiktoken file that the driver can read;
    Spark hands it to the executors. An empty text gives an empty list, a null text a null. Special tokens'
    strings in a text are ordinary text. Rows are independent; nothing is
    shuffled, and only the two columns are read.
    """
    name = _handed_out(df, vocabulary)
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids, offsets, full, total = [], [], [], 0
                for t in some.column(1):
                    t = t.as_py()
                    offsets.append(total)
                    full.append(t is not None)
                    if t:
                        ids.append(enc.encode(t))
                        total += len(ids[-1])
                offsets.append(total)
                values = pa.array(np.concatenate(ids) if ids else np.array([], "i4"), pa.int32())
                places = pa.array(np.array(offsets, "i4"), pa.int32(), mask=np.array([not x for x in full] + [False]))
                kind = pa.list_(pa.field("element", pa.int32(), False))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(places, values, type=kind)], names=[key, "ids"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def token_counts(df: DataFrame, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep..., tokens``: how many ids each text has; null for a null text, 0 for an empty one."""
    name = _handed_out(df, vocabulary)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = (t.as_py() for t in batch.column(len(keep)))
            counts = pa.array([None if t is None else enc.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, "tokens"])

    return df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`")).mapInArrow(run, schema)
