"""Shared parts: words, hashing, stored intermediate tables, connected components, membership bitmaps.

A document is known by its id together with a 128-bit digest of its text, so null and repeated ids keep rows apart;
rows that repeat both are the same document.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.session import scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS_AT_ONCE = 256
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MEMO_ENTRIES = 300_000
MASK = (1 << 64) - 1


def ascii_lower(value: Column) -> Column:
    return F.translate(value, UPPER, UPPER.lower())


def id_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def text_key(text: str) -> Column:
    """128 bits of a text as hex; an absent text and an empty one are the same."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def ship(spark: SparkSession) -> None:
    """Batches of a size for long texts; the package goes to executors whose Python does not find it by itself."""
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, "500")  # texts can be long: the default of 10,000 rows may not fit
    package = Path(__file__).resolve().parents[1]
    context, root = spark.sparkContext, str(package.parent)
    if root in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] or getattr(context, "_opsight", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="run-package-"), "opsight"), "zip", root, package.name)
    context.addPyFile(archive)
    context._opsight = True


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The frame written to the shared folder and read back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").parquet(path, compression=compression)
    if _held:
        _held[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_held: list[list] = []  # what the blocks of `released` have made so far


def broadcasted(context, value):
    """A broadcast that leaves the executors with the block of `released` that it is made in."""
    shared = context.broadcast(value)
    if _held:
        _held[-1].append(shared)
    return shared


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Stored tables and broadcasts made inside go when the block ends; its results must be stored before (`kept`)."""
    _held.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for made in _held.pop():
            if isinstance(made, str):
                path = jvm.org.apache.hadoop.fs.Path(made)
                path.getFileSystem(conf).delete(path, True)
            else:
                made.unpersist()


def kept(df: DataFrame, label: str) -> DataFrame:
    """`stored`, for the results of a block of `released`: they belong to the block around it."""
    inner = _held.pop()
    try:
        return stored(df, label)
    finally:
        _held.append(inner)


def null_safe_join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of the same names in which null equals null; the left side's columns stay."""
    right = right.withColumnsRenamed({n: f"__right_{n}" for n in names})
    test = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"__right_{n}")) for n in names])
    return left.join(right, test, how).drop(*[f"__right_{n}" for n in names])


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made of one batch of long texts stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


SLICE_BYTES = 2 << 20
CHUNK_BYTES = 32 << 10  # what is made of so many bytes stays in a processor's cache


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, end to end, and where each starts; null texts are empty."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each come to `SLICE_BYTES`, or to one long text."""
    for batch in batches:
        _, offsets = text_column(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def separators(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


WHITE = separators(b" \t\n\x0b\x0c\r")
_POWERS = np.multiply.accumulate(np.full(1 << 16, 0xD1342543DE82EF95, np.uint64))


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte, the same for A-Z as for a-z."""
    values = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([b])) for b in range(256)), np.uint64).copy()
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()


def flat_words(column: pa.Array, blank: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts of a column, and the number of words of each text.

    A word is a maximal run of bytes that are not `blank`; its hash is a polynomial in its bytes, scrambled.
    """
    data, offsets = text_column(column)
    free = ~blank[data]
    begins = free.copy()
    begins[1:] &= ~free[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = free[edges]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    return word_hashes(data, free, starts), counts


def word_hashes(data: np.ndarray, free: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that start at the given bytes; `free` marks the bytes of words."""
    out = np.empty(len(starts), np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK_BYTES)))
        low, high = starts[at], starts[upto] if upto < len(starts) else len(data)
        part = starts[at:upto] - low
        place = np.arange(high - low)
        place -= np.repeat(part, lengths[at:upto])
        value = np.take(_VALUES, data[low:high])
        if high - low > 0xFFFF:
            value *= _POWERS[place & 0xFFFF]
            value *= (place >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        else:
            value *= np.take(_POWERS, place)
        value *= free[low:high]
        out[at:upto] = np.add.reduceat(value, part)
        at = upto
    return mixed(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once; for short arrays quicker than `np.unique`."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to a number of entries."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_ENTRIES:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than ASCII white space, A-Z in lower case."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).lower().split()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words; fewer words count as one run; no words, none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : n - size + 1 + k])
    return out


BITMAP_BITS = 1 << 26


def membership(df: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the 64-bit values of a column: at most `bits` bits come to the driver, however many rows there are.

    It has no false negatives, so it may only save work: what passes it must still be joined.
    """
    words = (
        df.where(F.col(column).isNotNull())
        .select(F.pmod(F.col(column), F.lit(bits)).alias("slot"))
        .selectExpr("cast(slot div 32 as int) AS at", "shiftleft(1L, cast(slot % 32 as int)) AS bit")
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(bits // 32, np.uint32)
    out[words["at"].to_numpy()] = words["bit"].to_numpy().astype(np.uint32)
    return out


def is_member(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values (unsigned views of the signed column) may be in the bitmap."""
    slot = values & np.uint64(len(bitmap) * 32 - 1)
    return (bitmap[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def split_by(df: DataFrame, bitmap: np.ndarray, column: str) -> tuple[DataFrame, DataFrame]:
    """(the rows whose 64-bit value may be in a bitmap, all others), so that only the former need an exact join."""
    shared = broadcasted(df.sparkSession.sparkContext, bitmap)

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        return pd.Series(is_member(shared.value, values.to_numpy(np.int64).view(np.uint64)))

    hit = found(column)
    return df.where(hit), df.where(~hit)


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that its links reach.

    Alternating large-star and small-star steps on columns a, b of any ordered type. Each step is a shuffle of the
    edges; stars are built by a minimum per node, which is combined before the shuffle, so no neighbour list is
    gathered. Every round is written to the shared folder.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), label)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.withColumnRenamed("m", "b")).distinct()
        after = stored(small, label)
        # settled when every larger end has one smaller end, which is nobody's larger end
        seen = after.agg(F.count("*").alias("n"), F.count_distinct("a").alias("k")).first()
        chained = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        now = after
        if seen["n"] == seen["k"] and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

