"""Exact token counts of every prefix of a text, by prefix dynamic programming.

A byte-pair encoding is the one sequence of tokens in which every two neighbours are what the encoder makes of their
joined bytes. So the last token of a prefix is the token that ends there and fits the last token of the prefix before
it, and the count is that prefix's count plus one: a table over positions, filled once from left to right, has the
counts of all prefixes. Tables are kept for word-like units and put together for texts.

A prefix is cut into words like a text of its own: at its end white space stays in one piece, an unfinished contraction
is an apostrophe and letters, and the string of a special token, which is one token when complete, is ordinary text
until then. The index stores the change of the count at each character; questions about truncation and budgets are
answered from it, and nothing is encoded again.

Null and empty texts: no characters, no tokens. Null and repeated ids: each row is a row. Very long texts: their units
are taken in portions; a text's changes (two bytes a character) are held at once. Ties cannot arise. Empty table: no
rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice
from operator import sub

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import text_slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
UNITS_AT_ONCE = 200_000
MEMO_ENTRIES = 400_000
PAIR_ENTRIES = 4_000_000
CHANGE = np.dtype(np.int16)
INDEX = "doc_id long, n_bytes long, n_chars long, n_tokens long, changes binary"

_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
# pieces as the vocabulary cuts them, but white space of two and more characters together with what follows
_UNITS = regex.compile(rf"{_CONTRACTION}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+ (?:{_WORD})|\s+[^\S ](?:{_CONTRACTION}|{_WORD})|\s+")
_RUN = regex.compile(r"\s*")
_RUN_STARTS = frozenset(" \t\n\x0b\x0c\r")
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
LATE_LEAD = 0xD5  # first byte of the first character that `late_characters` may hold


@functools.cache
def late_characters() -> regex.Pattern:
    """Letters and digits of newer Unicode versions than the vocabulary's library knows; to it they are symbols."""
    known = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    late = [ord(c) for c in known if unicodedata.category(c) == "Cn"]
    ranges, start = [], None
    for c, following in zip(late, [*late[1:], -1]):
        start = c if start is None else start
        if following != c + 1:
            ranges.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return regex.compile(f"[{''.join(ranges)}]") if ranges else regex.compile(r"(?!)")


class PrefixCounter:
    """Prefix counts of texts under one byte-level vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        pretokenizer = content.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pretokenizer.get("type") != "ByteLevel" or content.get("normalizer") or pretokenizer.get("add_prefix_space"):
            raise ValueError(f"{path}: byte-level pair encodings without normalisation are supported")
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        if any(t[k] for t in content["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: special tokens must match literally")
        letters = _byte_letters()
        self.ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tokens = {i: token for token, i in self.ranks.items()}
        self._encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._ends = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            if len(token) > 0xFF:
                raise ValueError(f"{path}: tokens of more than 255 bytes are not supported")
            self._ends.add_word(token.decode("latin-1"), i << 8 | len(token))
        self._ends.make_automaton()
        self._fits: dict[int, bool] = {}
        self._units = _Memo(self._unit)

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their joined bytes are encoded."""
        if len(self._fits) >= PAIR_ENTRIES:
            self._fits.clear()
        joined = self.tokens[left] + self.tokens[right]
        fits = self._fits[left << 17 | right] = joined not in self.ranks and self._encoder._core_bpe.encode_single_piece(joined) == [left, right]
        return fits

    def table(self, piece: bytes) -> list[int]:
        """Token counts of the first 1, 2, ... bytes of a piece that is encoded as a whole."""
        counts, last, fits, filled = [0] * (len(piece) + 1), [-1] * (len(piece) + 1), self._fits.get, 0
        for at, packed in self._ends.iter(piece.decode("latin-1")):  # all tokens that end here, the longest first
            if at < filled:
                continue
            start = at + 1 - (packed & 0xFF)
            if start:
                left = last[start]
                known = fits(left << 17 | packed >> 8)
                if not (known or known is None and self._neighbours(left, packed >> 8)):
                    continue
            filled = at + 1
            counts[filled], last[filled] = counts[start] + 1, packed >> 8
        if 0 in counts[1:]:
            raise AssertionError("a prefix has no encoding")
        return counts[1:]

    def _characters(self, piece: str) -> list[int]:
        """Counts of the first 1, 2, ... characters of a piece."""
        data = piece.encode()
        counts = self.table(data)
        if len(data) == len(piece):
            return counts
        return [count for count, byte in zip(counts, data[1:] + b" ") if byte & 0xC0 != 0x80]

    def _plain(self, unit: str) -> list[int]:
        """Counts of the characters of a piece without leading white space."""
        if len(unit) == 3 and unit in _LONG_CONTRACTIONS:
            return [1, 1 + self._characters(unit[1])[0], self._characters(unit)[-1]]
        return self._characters(unit)

    def _unit(self, unit: str) -> bytes:
        """Changes of the count at each character of a unit."""
        run = _RUN.match(unit).end() if unit[0] in _RUN_STARTS or not unit.isascii() else 0
        if run < 2 or run == len(unit):
            counts = self._plain(unit)
        else:  # a run of white space loses its last character to what follows
            counts, space = self._characters(unit[:run]), unit[run - 1]
            before = counts[run - 2]
            if space == " ":
                counts += [before + c for c in self._characters(unit[run - 1 :])[1:]]
            else:
                before += self._characters(space)[-1]
                counts += [before + c for c in self._plain(unit[run:])]
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def _ordinary(self, text: str, seen: str) -> bytes:
        """Changes at each character of a text without special tokens; `seen` is the text as its library reads it."""
        if seen is text and len(text) <= UNITS_AT_ONCE:
            return b"".join(map(self._units.__getitem__, _UNITS.findall(text)))
        found, out = _UNITS.finditer(seen), []
        while portion := [text[m.start() : m.end()] for m in islice(found, UNITS_AT_ONCE)]:
            out.append(b"".join(map(self._units.__getitem__, portion)))
        return b"".join(out)

    def changes(self, text: str | None) -> np.ndarray:
        """The change of the token count at each character: their sum up to a place is the count of that prefix."""
        if not text:
            return np.empty(0, CHANGE)
        seen = text
        if not text.isascii() and np.frombuffer(text.encode(), np.uint8).max() >= LATE_LEAD:
            late = late_characters()
            seen = late.sub("\u2603", text) if late.search(text) else text
        marks = [m.span() for m in self.special.finditer(text)] if self.special and self.special.search(text) else []
        if not marks:
            return np.frombuffer(self._ordinary(text, seen), CHANGE)
        out, start = [], 0
        for first, end in marks:  # ordinary text until the last character, then one token after what came before
            part = np.frombuffer(self._ordinary(text[start : end - 1], seen[start : end - 1]), CHANGE).astype(np.int64)
            before = int(part[: first - start].sum())
            out += [part, [before + 1 - int(part.sum())]]
            start = end
        out.append(np.frombuffer(self._ordinary(text[start:], seen[start:]), CHANGE))
        return np.concatenate(out).astype(CHANGE)


class _Memo(dict):
    """Results by unit, forgotten when there are too many."""

    def __init__(self, compute):
        super().__init__()
        self._compute = compute

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[unit] = self._compute(unit)
        return value


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One for each Python worker; the file comes with the installed package, so every executor has it."""
    return PrefixCounter(path)


def prefix_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and the changes of the count (16 bits for each character). Write it once, and
    `prefix_tokens`, `longest_prefix` and `answers` need no text and no vocabulary."""
    path = public_tokenizers.path(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in text_slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [own.changes(t) for t in texts]
            columns = [
                batch.column(0),
                pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([int(f.sum(dtype=np.int64)) for f in found], pa.int64()),
                pa.array([f.tobytes() for f in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, INDEX)


def prefix_tokens(changes: bytes, chars: int) -> int:
    """Tokens of the first `chars` characters of a text, from its changes."""
    return int(np.frombuffer(changes, CHANGE)[: max(chars, 0)].sum(dtype=np.int64))


def longest_prefix(changes: bytes, limit: int) -> tuple[int, int]:
    """Characters and tokens of the longest prefix of at most `limit` tokens. Counts may fall as a text goes on."""
    counts = np.cumsum(np.frombuffer(changes, CHANGE), dtype=np.int64)
    within = np.flatnonzero(counts <= limit)
    return (int(within[-1]) + 1, int(counts[within[-1]])) if len(within) and limit >= 0 else (0, 0)


ANSWERS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long, kept_tokens long"


def answers(index: DataFrame, limit: int = LIMIT) -> DataFrame:
    """For each text whether it has more than `limit` tokens, and its longest prefix that has not."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, chars = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            # a text within the limit is kept whole, else its changes tell where to cut
            kept = [
                (c, t) if t <= limit else longest_prefix(changes.as_buffer(), limit)
                for t, c, changes in zip(tokens, chars, batch.column(4))
            ]
            columns = [
                batch.column(0),
                batch.column(1),
                batch.column(2),
                pa.array([t > limit for t in tokens], pa.bool_()),
                pa.array([c for c, _ in kept], pa.int64()),
                pa.array([t for _, t in kept], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ANSWERS.split(", ")])

    return index.select("doc_id", "n_bytes", "n_tokens", "n_chars", "changes").mapInArrow(rows, ANSWERS)


def tokens_at(index: DataFrame, places: DataFrame) -> DataFrame:
    """Tokens of given prefixes: places (doc_id, chars) against an index, joined on doc_id; null ids match nothing.

    Places of one document meet one index row each; adaptive execution splits a document that is asked for very often.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix_tokens(c.as_buffer(), p.as_py() or 0) for p, c in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "chars", "n_tokens"])

    joined = places.select("doc_id", F.col("chars").cast("long").alias("chars")).join(index.select("doc_id", "changes"), "doc_id")
    return joined.select("doc_id", "chars", "changes").mapInArrow(rows, "doc_id long, chars long, n_tokens long")
