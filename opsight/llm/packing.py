"""Best-fit packing by a plan over the histogram of lengths.

Documents become token ids with an end id, and only documents longer than a sequence are cut, so that all pieces but
the first are full. Best-fit-decreasing then runs over the *counts* of the lengths: there are at most `size` of them,
so the plan has a bounded number of rows whatever the number of documents. Pieces get a rank within their length by
two-level counting (no length is gathered in one task) and take the slot that the plan has for that rank.

Nulls, empty texts: one piece with the end id alone. Ties: pieces of one length are interchangeable; they take slots
in the order of (bucket, doc_id, piece, crc). Repeated rows: each row is packed. Empty table: no rows. Extra columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.llm.common import in_slices, stored
from opsight.llm.tokens import library_ids

SEQUENCE = 1024
END_ID = 2
BUCKET_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLAN = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("length", "rank_from", "rank_to", "first_sequence", "per_sequence", "offset")]
)


def tokenised(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken", size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Pieces of whole documents: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    path, rank_path = public_tokenizers.path(vocabulary), public_tokenizers.path(ranks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            if with_ids:
                out["ids"] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(library_ids(path, rank_path, value.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(ids) % size or size
                for piece, end in enumerate(range(first, len(ids) + 1, size)):
                    start = max(0, end - size)
                    part = ids[start:end]
                    out["doc_id"].append(key)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(end - start)
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out)
            )

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, schema)


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts: (length, rank_from, rank_to, first_sequence, per_sequence, offset).

    Pieces of `length` with a rank in [rank_from, rank_to) go, `per_sequence` to each, into the sequences from
    `first_sequence` on, starting at `offset`. Open sequences are held as ranges with equal free space; one length
    splits at most one range for each free space, so the number of ranges stays below a multiple of `size`.
    """
    rows, opened = [], 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> ranges of sequences
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        for space in sorted(s for s, ranges in free.items() if s >= length and ranges):
            kept = []
            for first, n in free[space]:
                if not left:
                    kept.append((first, n))
                    continue
                each = space // length
                full = min(n, left // each)
                if full:
                    rows.append((length, rank, rank + full * each, first, each, size - space))
                    if space > each * length:
                        free[space - each * length].append((first, full))
                    rank, left = rank + full * each, left - full * each
                if full < n and left:  # the last sequence takes what is left
                    rows.append((length, rank, rank + left, first + full, left, size - space))
                    free[space - left * length].append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    kept.append((first + full, n - full))
            free[space] = kept
        each = size // length
        if full := left // each:
            rows.append((length, rank, rank + full * each, opened, each, 0))
            if size > each * length:
                free[size - each * length].append((opened, full))
            rank, left, opened = rank + full * each, left - full * each, opened + full
        if left:
            rows.append((length, rank, rank + left, opened, left, 0))
            free[size - left * length].append((opened, 1))
            opened += 1
    return rows


def packed(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = stored(pieces, "pieces")
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per_bucket = stored(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    slots = spark.createDataFrame(plan(counts, size), _PLAN)  # bounded by `size`, see plan()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("at", F.row_number().over(inside) - 1)
        .join(base, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("at"))
    )
    slots = slots.withColumnRenamed("length", "slot_length").withColumnRenamed("offset", "slot_offset")
    within = (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1)
    place = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(slots), within).select(
        *pieces.columns,
        (F.col("first_sequence") + F.expr("(rank - rank_from) div per_sequence")).alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(place, F.col("per_sequence")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return packed(tokenised(docs, doc_id, text, **options), options.get("size", SEQUENCE))
