"""Tokeniser fertility rules: characters per token, byte-fallback share and token entropy, with bands per language.

A public byte-level vocabulary cuts the whole text into tokens; a public piece vocabulary tells which characters it can
only write byte by byte. Bands come from all documents of a language (of a script where the language is null): a
document is rejected when a measure lies more than `reach` quartile ranges outside the quartiles. Groups with fewer
than `min_group` measured documents have no bands and reject nothing.

Null and empty texts have no words and fail the base rule. Ties and repeated rows: each row is judged alone, bands count
every row. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import WordHashes, in_slices, mixed, stored
from opsight.llm.tokens import token_ids

MEASURES = ("chars_per_token", "fallback_share", "entropy_share")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REACH = 4.0
MIN_GROUP = 20
FALLBACK_FLOOR = 0.02
FEATURES = (
    "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, entropy_share double"
)


@functools.cache
def piece_characters(path: str) -> frozenset[str]:
    """Single characters that a piece vocabulary has a piece for."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(p for i in range(pieces.get_piece_size()) if len(p := pieces.id_to_piece(i)) == 1) | {" ", "\n"}


def repeat_words(hashes: np.ndarray) -> int:
    """Words in 3-word windows found twice or more, the first included."""
    n = len(hashes)
    if n < 4:
        return 0
    runs = mixed(mixed(mixed(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def script_of(characters: Counter) -> str:
    """The script of most letters, by the first word of their Unicode names."""
    scripts: Counter = Counter()
    for c, n in characters.items():
        if c.isalpha():
            scripts[unicodedata.name(c, "UNKNOWN").split()[0]] += n
    return min(scripts, key=lambda s: (-scripts[s], s)) if scripts else "NONE"


def measured(text: str | None, vocabulary: str, pieces: str, words: WordHashes) -> tuple:
    """Base counts and measures of one whole text."""
    text = text or ""
    raw = text.encode()
    found = raw.split()
    characters = Counter(text)
    known = piece_characters(pieces)
    lost = sum(n * len(c.encode()) for c, n in characters.items() if c not in known)
    ids = token_ids(vocabulary, text)
    n = len(ids)
    entropy = 0.0
    if n > 1:
        counts = np.unique(ids, return_counts=True)[1] / n
        entropy = float(-(counts * np.log2(counts)).sum() / math.log2(n))
    return (
        script_of(characters),
        len(found),
        sum(c for x, c in characters.items() if x not in " \t\n\r\x0b\x0c"),
        sum(characters[c] for c in SYMBOLS),
        duplicate_lines(raw),
        repeat_words(words.of(found)),
        n,
        len(text) / n if n else 0.0,
        lost / len(raw) if raw else 0.0,
        entropy,
    )


def features(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *,
    vocabulary: str = "byte_bpe_multi_50k.tiktoken", pieces: str = "piece_bpe_32k.model",
) -> DataFrame:
    """Base counts and measures of every row in one pass."""
    paths = public_tokenizers.path(vocabulary), public_tokenizers.path(pieces)
    names = [f.split()[0] for f in FEATURES.split(", ")]
    kinds = [pa.string()] + [pa.int64()] * 6 + [pa.float64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in in_slices(batches):
            rows = [measured(value.as_py(), *paths, words) for value in batch.column(2)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    return rows.mapInArrow(run, FEATURES)


def bands(measures: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """grp, and <measure>_low, <measure>_high over all documents of a group that pass the base rule."""
    usable = measures.where("NOT base_failed")
    cuts = usable.groupBy("grp").agg(
        F.count("*").alias("n"), *[F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 2000).alias(m) for m in MEASURES]
    ).where(F.col("n") >= min_group)
    out = [F.col("grp")]
    for m in MEASURES:
        low, high = F.col(m)[0], F.col(m)[1]
        width = F.greatest((high - low) * reach, F.lit(FALLBACK_FLOOR) if m == "fallback_share" else F.abs(high) * 0.05)
        out += [(low - width).alias(f"{m}_low"), (high + width).alias(f"{m}_high")]
    return cuts.select(*out)


def judged(measures: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """Features with base_failed, reasons and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    group = F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"))
    measures = stored(measures.withColumns({"base_failed": failed, "grp": group}), "fertility")
    # one row per language or script; a language with a third of all rows is split by the adaptive skew join
    both = measures.join(bands(measures, reach, min_group), "grp", "left")
    outside = [F.when(~F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(m)) for m in MEASURES]
    reasons = F.filter(F.array(*outside), lambda r: r.isNotNull())
    return both.withColumn("reasons", reasons).select(
        *[f.split()[0] for f in FEATURES.split(", ")], "base_failed", "reasons",
        (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"),
    )
