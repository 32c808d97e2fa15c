"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at full stops, question and exclamation marks and line ends; long ones are cut again after
words that a hash picks, so cuts depend on the words around them and a passage pasted into the middle of a sentence is
cut as elsewhere. Every run of at least `sentences` consecutive sentences with at least `min_words` words (the shortest
such run from each start) is hashed. Runs found more than once keep their first place, by (doc_id, text digest,
position); the sentences of all other places go.

Texts are cut and hashed once; their run hashes are stored as numbers beside them. A bitmap of fixed size then picks the
places of runs that repeat, so unique runs are not sent a second time (its false finds are counted as unique later), and
a bitmap of the documents with spans picks the texts that are joined and cut: all others pass as they are.

A run that is found very often is no hot key: at most `HOT_RUNS` runs can hold more than that part of all places, and the
first places of those are broadcast. All other runs are joined by hash.

Null and empty texts have no sentences and stay as they are. Rows that repeat id and text are one document: they get
the same result. A null doc_id comes first. A run that repeats inside one document counts like any other. Extra columns
are not read. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import (
    WHITE, in_slices, is_member, membership, mixed, null_safe_join, separators, split_by, stored, text_key, text_slices,
    word_hashes,
)

SENTENCES = 3
MIN_WORDS = 16
CUT_EVERY = 6
HOT_RUNS = 1000
ENDS = separators(b".!?")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sentences(raw: bytes, cut_every: int = CUT_EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte offset, number of words, hash) of every sentence of a text."""
    data = np.frombuffer(raw, np.uint8)
    blank = WHITE[data]
    if blank.all():
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64)
    edge = np.diff(np.concatenate(([1], blank, [1])).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = word_hashes(data, ~blank, begin)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    stop = ENDS[data[end - 1]]
    stop[:-1] |= lines[begin[1:]] > lines[end[:-1]]
    stop |= mixed(hashes) % np.uint64(cut_every) == 0
    stop[-1] = True
    last = np.flatnonzero(stop)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(hashes)) - np.repeat(first, last - first + 1)
    each = mixed(hashes ^ mixed((place.astype(np.uint64) + np.uint64(1)) * _STEP))
    return begin[first], last - first + 1, np.add.reduceat(each, first)


def runs(sizes: np.ndarray, hashes: np.ndarray, least: int = SENTENCES, min_words: int = MIN_WORDS):
    """(hash, first sentence, last sentence) of the shortest sufficient run from every start."""
    n = len(sizes)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    start = np.arange(n)
    last = np.maximum(start + least - 1, np.searchsorted(upto, upto[:-1] + min_words) - 1)
    start, last = start[last < n], last[last < n]
    out = np.zeros(len(start), np.uint64)
    for k in range(int((last - start).max()) + 1 if len(start) else 0):
        on = start + k <= last
        out[on] += mixed(hashes[(start + k)[on]] ^ mixed(np.array([k + 7], np.uint64) * _STEP))
    return mixed(out), start, last


def hashed(docs: DataFrame, least: int, min_words: int) -> DataFrame:
    """doc_id, key, text, doc (a hash of id and key), n_sentences, runs, lasts: the runs start at sentences 0, 1, ..."""
    schema = "doc_id long, key binary, text string, doc long, n_sentences long, runs array<long>, lasts array<int>"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            totals, found, lasts = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for value in batch.column(2):
                _, sizes, hashes = sentences((value.as_py() or "").encode())
                run, _, last = runs(sizes, hashes, least, min_words)
                totals.append(len(sizes))
                found.append(run)
                lasts.append(last)
            offsets = pa.array(np.cumsum([len(x) for x in found]), pa.int32())
            lists = [np.concatenate(found).view(np.int64), np.concatenate(lasts).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(totals, pa.int64()), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists]],
                names=[*batch.schema.names, "n_sentences", "runs", "lasts"],
            )

    return docs.select("doc_id", "key", "text", F.xxhash64("doc_id", "key").alias("doc")).mapInArrow(emit, schema)


def places(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """run, doc_id, key, first, last for the runs in a bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            lists = batch.column(2)
            hashes, last = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            first = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = is_member(shared.value, hashes.view(np.uint64))
            at = pa.array(row[hit], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[hit], pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(first[hit], pa.int32()), pa.array(last[hit], pa.int32())],
                names=["run", "doc_id", "key", "first", "last"],
            )

    return texts.select("doc_id", "key", "runs", "lasts").mapInArrow(emit, "run long, doc_id long, key binary, first int, last int")


def not_first(found: DataFrame) -> DataFrame:
    """The places of runs that are found more than once, without the first one of each."""
    here = F.struct("doc_id", "key", "first")
    firsts = found.groupBy("run").agg(F.min(here).alias("kept"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(firsts, "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = firsts.where(F.col("n") * HOT_RUNS > total).select("run", "kept")  # fewer than HOT_RUNS rows
    usual = found.join(F.broadcast(hot.select("run")), "run", "left_anti").join(firsts.drop("n"), "run")
    return usual.unionByName(found.join(F.broadcast(hot), "run")).where(here != F.col("kept"))


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the sentences of the spans; number of sentences, and of removed ones."""
    begin, _, hashes = sentences(raw)
    gone = np.zeros(len(hashes), bool)
    for first, last in spans:
        gone[first : last + 1] = True
    if not gone.any():
        return raw, len(hashes), 0
    ends = np.concatenate((begin[1:], [len(raw)]))
    parts = [raw[: begin[0]]] + [raw[b:e] for b, e, g in zip(begin, ends, gone, strict=True) if not g]
    return b"".join(parts), len(hashes), int(gone.sum())


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least: int = SENTENCES, min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, text, n_sentences, n_removed for every row."""
    key = F.unhex(text_key(text))  # 16 bytes in the order of the digest
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"), F.col(text).alias("text"))
    texts = stored(hashed(docs, least, min_words), "runs", "zstd")
    counts = texts.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    found = stored(places(texts, membership(counts.where("n > 1"), "run")), "places")
    spans = not_first(found).groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = stored(spans, "spans")
    marked = membership(spans.select(F.xxhash64("doc_id", "key").alias("doc")), "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            made, removed = [], []
            for value, found in zip(batch.column(1), batch.column(3), strict=True):
                whole = value.as_py()
                raw, _, k = without((whole or "").encode(), [(s["first"], s["last"]) for s in found.as_py() or []])
                made.append(raw.decode() if k else whole)
                removed.append(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.string()), batch.column(2), pa.array(removed, pa.int64())],
                names=["doc_id", "text", "n_sentences", "n_removed"],
            )

    maybe, others = split_by(texts.select("doc_id", "key", "text", "doc", "n_sentences"), marked, "doc")
    both = null_safe_join(maybe, spans, ["doc_id", "key"], "left").select("doc_id", "text", "n_sentences", "spans")
    out = both.mapInArrow(cut, "doc_id long, text string, n_sentences long, n_removed long")
    return out.unionByName(others.select("doc_id", "text", "n_sentences", F.lit(0).cast("long").alias("n_removed")))
