"""Phrase collocations by direct-address tiling.

Words get ids; the most frequent ones of a language are ranked, so a pair of them is a cell of a matrix that is split
into square tiles. A task counts busy tiles densely (`bincount` over the cells of a tile, kept for the whole task) and
all other pairs as sorted coordinate lists; Spark adds both up by phrase, so counts are exact whatever was dense.
Frequent pairs are ranked again and become the left side of the next level: a phrase of k words is a pair of a phrase of
k - 1 words and a word. A phrase can only be frequent if both its ends of k - 1 words are, which a bitmap tells; a
bitmap that fills up costs counting, not results.

Ids are 64-bit hashes of words. Words that share one are found over the whole word table and get ids of their own.

Null text: no words. Null language: `und`. Empty pieces, texts, tables: nothing. Very long texts are cut where a piece
ends. Repeated rows count each time. Ties go to the shortest first part, then to the larger count, then to UTF-8 order of
the phrase. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.llm.common import BITMAP_BITS, MASK, is_member, membership, mixed, separators, ship, stored, text_column, text_slices, word_hashes

MIN_COUNT = 30
WORDS = 4
TOP = 2000
SCORE = 2_000_000
INSIDE_PERCENT = 80
UNKNOWN = "und"
HEAD_ROWS = 1 << 16  # ranked phrases of all languages together
HEAD = 4096  # ranked phrases of a language
TILE = 512
DENSE_SHARE = 16  # a tile becomes dense when a portion of text has a hit for every so many cells
TILES_HELD = 16
ROWS_OUT = 1 << 15
PORTION_BYTES = 2 << 20
BLANK = separators(b" \t")
BREAK = separators(b".,;:!?\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)


class Portion(NamedTuple):
    """Texts end to end, where each starts, and the language of each."""

    data: np.ndarray
    offsets: np.ndarray
    langs: list[str]


def cut_at_breaks(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of a long text that end where a piece ends; no phrase reaches across."""
    breaks = np.flatnonzero(BREAK[data])
    start = 0
    while start < len(data):
        if start + size >= len(data):
            end = len(data)
        else:
            at = int(np.searchsorted(breaks, start + size, side="right"))
            inside = at and breaks[at - 1] >= start
            end = int(breaks[at - 1] if inside else breaks[at] if at < len(breaks) else len(data) - 1) + 1
        yield data[start:end]
        start = end


def portions(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[Portion]:
    """Texts (column 0) with their languages (column 1) in portions of about `size` bytes."""
    size = size or PORTION_BYTES
    parts, lengths, langs, held = [], [], [], 0
    for batch in text_slices(batches, 0):
        data, offsets = text_column(batch.column(0))
        names = [n if n is not None else UNKNOWN for n in batch.column(1).to_pylist()]
        if batch.num_rows == 1 and len(data) > size:
            for part in cut_at_breaks(data, size):
                yield Portion(part, np.array([0, len(part)]), names)
            continue
        parts.append(data)
        lengths.append(np.diff(offsets))
        langs += names
        held += len(data)
        if held >= size:
            yield Portion(np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(lengths))), langs)
            parts, lengths, langs, held = [], [], [], 0
    if langs:
        yield Portion(np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(lengths))), langs)


class Tokens(NamedTuple):
    """Words of a portion: id, place and length in bytes, text they stand in, whether the next word is in the same piece."""

    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    linked: np.ndarray


def words_of(portion: Portion, ambiguous: np.ndarray) -> Tokens:
    data, offsets, _ = portion
    broken = BREAK[data]
    free = ~(broken | BLANK[data])
    begins = free.copy()
    begins[1:] &= ~free[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = free[edges]
    starts = np.flatnonzero(begins)
    text = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(np.flatnonzero(~free), len(data))
    ends = np.minimum(ends[np.searchsorted(ends, starts)], offsets[text + 1])
    piece = np.cumsum(broken)[starts] if len(data) else starts
    linked = np.zeros(len(starts), bool)
    linked[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    ids = word_hashes(data, free, starts)
    if len(ambiguous):
        for at in np.flatnonzero(np.isin(ids, ambiguous)):
            ids[at] = xxhash.xxh64_intdigest(LOWER[data[starts[at] : ends[at]]].tobytes(), seed=42)
    return Tokens(ids, starts, ends - starts, text, linked)


def lang_codes(portion: Portion) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct languages, the number of each text's one, and a 64-bit value for each language."""
    names = sorted(set(portion.langs))
    number = {n: i for i, n in enumerate(names)}
    values = np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in names], np.uint64)
    return names, np.array([number[n] for n in portion.langs], np.int64), values


def grouped(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of equal rows, by sorting on keys; rows with equal keys are compared by all columns."""
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [(c := column[order])[1:] != c[:-1] for column in columns])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that need little memory on both sides of the pipe."""
    for start in range(0, batch.num_rows, ROWS_OUT):
        yield batch.slice(start, ROWS_OUT)


# --- words -----------------------------------------------------------------------------------------------------------


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, hash, n for the distinct words of each portion."""
    nothing = np.empty(0, np.uint64)
    for portion in portions(batches):
        found = words_of(portion, nothing)
        names, numbers, values = lang_codes(portion)
        lang = numbers[found.text]
        keys = mixed(mixed(found.ids + values[lang]) + found.lengths.astype(np.uint64) * STEP)
        at, n = grouped(keys, lang, found.ids, found.lengths)
        lengths = found.lengths[at]
        offsets = np.append(0, np.cumsum(lengths))
        where = np.arange(offsets[-1]) + np.repeat(found.starts[at] - offsets[:-1], lengths)
        text = LOWER[portion.data[where]]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
        columns = [pa.array(names).take(pa.array(lang[at])), words.cast(pa.string()), pa.array(found.ids[at].view(np.int64)), pa.array(n)]
        yield from small(pa.RecordBatch.from_arrays(columns, names=["lang", "word", "hash", "n"]))


def word_table(texts: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Frequent words (lang, w1, f, phrase), all word occurrences by language, and hashes that several words share."""
    counted = texts.mapInArrow(word_rows, "lang string, word string, hash long, n long")
    words = stored(counted.groupBy("lang", "word", "hash").agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    other = F.xxhash64("word")
    shared = words.groupBy("hash").agg(F.min(other).alias("low"), F.max(other).alias("high"), F.max("f").alias("f"))
    shared = [r["hash"] for r in shared.where(f"low <> high AND f >= {min_count}").select("hash").toLocalIterator()]  # rare
    own = F.when(F.col("hash").isin(shared), other).otherwise(F.col("hash")) if shared else F.col("hash")
    frequent = words.where(f"f >= {min_count}").select("lang", own.alias("w1"), "f", F.col("word").alias("phrase"))
    return frequent, totals, np.array([h & MASK for h in shared], np.uint64)


# --- phrases ---------------------------------------------------------------------------------------------------------


def phrase_keys(first: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for each run of `size` words, from keys of single words; runs across pieces are for the caller to skip."""
    keys = first
    for k in range(1, size):
        keys = mixed(keys[:-1] * STEP + ids[k:])
    return keys


class Heads(NamedTuple):
    """Ranked phrases: sorted keys with rank and language number; the word ids of language l and rank r are row
    `starts[l] + r` of `words`."""

    keys: np.ndarray
    ranks: np.ndarray
    langs: list[str]
    lang_of: np.ndarray
    starts: np.ndarray
    words: np.ndarray


def single_keys(langs: list[str], ids: np.ndarray) -> np.ndarray:
    values = {n: np.uint64(xxhash.xxh3_64_intdigest(n.encode())) for n in set(langs)}
    return mixed(ids + np.array([values[n] for n in langs], np.uint64))


def keys_of_rows(langs: list[str], columns: list[np.ndarray]) -> np.ndarray:
    keys = single_keys(langs, columns[0]) if langs else np.empty(0, np.uint64)
    for column in columns[1:]:
        keys = mixed(keys * STEP + column)
    return keys


def ranked(level: DataFrame, size: int, langs: list[str] | None = None) -> Heads:
    """The phrases to address directly: the most frequent ones of all languages, ranked by language.

    A histogram of frequencies finds the lowest frequency class above which there are at most `HEAD_ROWS`; only those
    rows come to the driver. `langs`: languages as another level numbered them.
    """
    names = [f"w{k}" for k in range(1, size + 1)]
    classed = level.withColumn("class", F.floor(F.log2("f") * 8))
    bound, held = None, 0
    for row in sorted(classed.groupBy("class").agg(F.count("*").alias("n")).collect(), reverse=True):  # at most 512 classes
        held += row["n"]
        if held > HEAD_ROWS:
            break
        bound = row["class"]
    rows = classed.where(F.col("class") >= bound if bound is not None else F.lit(False)).select("lang", "f", *names).toArrow()
    rows = rows.sort_by([("f", "descending"), *[(n, "ascending") for n in ("lang", *names)]])
    found, columns = rows["lang"].to_pylist(), [rows[n].to_numpy().view(np.uint64) for n in names]
    langs = sorted(set(found)) if langs is None else langs
    number = {n: i for i, n in enumerate(langs)}
    lang_of = np.array([number.get(n, -1) for n in found], np.int64)
    by_lang = np.argsort(lang_of, kind="stable")  # rows of a language stay in order of frequency
    starts = np.searchsorted(lang_of[by_lang], np.arange(len(langs) + 1))
    ranks = np.full(len(found), -1)
    ranks[by_lang] = np.arange(len(found)) - np.append(starts, 0)[lang_of[by_lang]]
    ranks[(lang_of < 0) | (ranks >= HEAD)] = -1
    keys = keys_of_rows(found, columns)
    order = np.argsort(keys)
    return Heads(keys[order], ranks[order], langs, lang_of[order], starts, np.stack(columns, 1)[by_lang])


def rank_of(heads: Heads, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (-1: none) and language number of each key."""
    if not len(heads.keys):
        return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(heads.keys, keys), len(heads.keys) - 1)
    return np.where(heads.keys[at] == keys, heads.ranks[at], -1), heads.lang_of[at]


def frequent_bitmap(level: DataFrame, size: int) -> np.ndarray:
    """Keys of the frequent phrases as a bitmap, sized by their number."""
    names = [f"w{k}" for k in range(1, size + 1)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(1, size + 1)]
            found = keys_of_rows(batch.column(0).to_pylist(), columns)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

    bits = 1 << 20
    n = level.count()
    while bits < 16 * n and bits < BITMAP_BITS:
        bits *= 2
    return membership(level.select("lang", *names).mapInArrow(keys, "key long"), "key", bits)


class Tiles:
    """Dense counts of the busy tiles of one task."""

    def __init__(self):
        self.held: dict[tuple[int, int, int], np.ndarray] = {}

    def count(self, lang: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Add pairs of ranks that fall into dense tiles; returns which did not."""
        side = HEAD // TILE
        tile = (lang * side + left // TILE) * side + right // TILE
        cell = (left % TILE) * TILE + right % TILE
        rest = np.ones(len(tile), bool)
        order = np.argsort(tile, kind="stable")
        first = np.flatnonzero(np.diff(tile[order], prepend=-1))
        for start, end in zip(first, np.append(first[1:], len(order))):
            here = order[start:end]
            key = (int(lang[here[0]]), int(left[here[0]] // TILE), int(right[here[0]] // TILE))
            if key not in self.held:
                if end - start < TILE * TILE // DENSE_SHARE or len(self.held) >= TILES_HELD:
                    continue
                self.held[key] = np.zeros(TILE * TILE, np.int64)
            self.held[key] += np.bincount(cell[here], minlength=TILE * TILE)
            rest[here] = False
        return rest

    def rows(self, lefts: Heads, words: Heads) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Language, word ids and counts of the cells that are not zero."""
        for (lang, top, side), counts in self.held.items():
            cells = np.flatnonzero(counts)
            left, right = top * TILE + cells // TILE, side * TILE + cells % TILE
            ids = np.concatenate([lefts.words[lefts.starts[lang] + left].T, words.words[words.starts[lang] + right].T])
            yield lefts.langs[lang], ids, counts[cells]


def phrase_counts(texts: DataFrame, size: int, min_count: int, lefts: Heads, words: Heads, bitmap: np.ndarray, ambiguous: np.ndarray) -> DataFrame:
    """lang, w1 to w<size> and f of all phrases of `size` words that occur `min_count` times; stored."""
    shared = texts.sparkSession.sparkContext.broadcast((lefts, words, bitmap, ambiguous))
    names = [f"w{k}" for k in range(1, size + 1)]

    def batch_of(langs: pa.Array, ids: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([langs, *[pa.array(c.view(np.int64)) for c in ids], pa.array(n)], names=["lang", *names, "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, words, bitmap, ambiguous = shared.value
        tiles = Tiles()
        for portion in portions(batches):
            found = words_of(portion, ambiguous)
            if len(found.ids) < size:
                continue
            langs, numbers, values = lang_codes(portion)
            lang = numbers[found.text]
            single = mixed(found.ids + values[lang])
            keys = phrase_keys(single, found.ids, size - 1)
            frequent = is_member(bitmap, keys)
            whole = frequent[:-1] & frequent[1:]
            for k in range(size - 1):
                whole &= found.linked[k : len(whole) + k]
            at = np.flatnonzero(whole)
            left, left_lang = rank_of(lefts, keys[at])
            right, _ = rank_of(words, single[at + size - 1])
            dense = np.flatnonzero((left >= 0) & (right >= 0))
            keep = np.ones(len(at), bool)
            keep[dense] = tiles.count(left_lang[dense], left[dense], right[dense])
            at = at[keep]
            columns = [found.ids[at + k] for k in range(size)]
            first, n = grouped(mixed(keys[at] * STEP + columns[-1]), lang[at], *columns)
            yield from small(batch_of(pa.array(langs).take(pa.array(lang[at][first])), [c[first] for c in columns], n))
        for name, ids, n in tiles.rows(lefts, words):
            yield from small(batch_of(pa.array([name]).take(pa.array(np.zeros(len(n), np.int8))), list(np.ascontiguousarray(ids)), n))

    schema = ", ".join(["lang string", *[f"{n} long" for n in names], "n long"])
    counted = texts.mapInArrow(rows, schema).groupBy("lang", *names).agg(F.sum("n").alias("f")).where(f"f >= {min_count}")
    counted = stored(counted, f"phrases{size}")
    shared.destroy()
    return counted


# --- scores ----------------------------------------------------------------------------------------------------------


def _renamed(level: DataFrame, offset: int, size: int, side: str, keep: list[str]) -> DataFrame:
    """A level as one side of the next one: its words are words offset + 1 and on."""
    words = [F.col(f"w{k}").alias(f"w{k + offset}") for k in range(1, size + 1)]
    return level.select("lang", *words, *[F.col(c).alias(f"{side}_{c}") for c in keep])


def extended(counted: DataFrame, below: DataFrame, size: int) -> DataFrame:
    """Phrases of `size` words with the counts of their parts, from the level below: one row each for both ends.

    `first`, `head`, `tail`, `last`: counts of the first word, of all but the last, of all but the first, of the last.
    """
    keep = ["f", "phrase", "last_word", "first", "head", "tail", "last"]
    left = _renamed(below, 0, size - 1, "l", keep)
    right = _renamed(below, 1, size - 1, "r", keep)
    both = counted.join(left, ["lang", *[f"w{k}" for k in range(1, size)]]).join(right, ["lang", *[f"w{k}" for k in range(2, size + 1)]])
    cuts = {
        2: [("l_f", "r_f")],
        3: [("l_first", "r_f"), ("l_f", "r_last")],
        4: [("l_first", "r_f"), ("l_head", "r_tail"), ("l_f", "r_last")],
    }[size]
    scored = [
        F.struct(score("f", a, b).alias("score"), F.lit(k).alias("k"), F.col(a).alias("l"), F.col(b).alias("r"))
        for k, (a, b) in enumerate(cuts, 1)
    ]
    return both.select(
        "lang",
        *[f"w{k}" for k in range(1, size + 1)],
        "f",
        F.concat_ws(" ", "l_phrase", "r_last_word").alias("phrase"),
        F.col("r_last_word").alias("last_word"),
        F.col("l_first").alias("first"),
        F.col("l_f").alias("head"),
        F.col("r_f").alias("tail"),
        F.col("r_last").alias("last"),
        F.array_min(F.array(*scored)).alias("best"),
    )


def score(f: str, left: str, right: str) -> Column:
    """floor(SCORE * f / (left + right)): whole-number division of decimals, which hold products beyond 64 bits."""
    total = " + ".join(f"CAST({c} AS decimal(19,0))" for c in (left, right))
    return F.expr(f"CAST({SCORE} AS decimal(7,0)) * CAST({f} AS decimal(19,0)) DIV ({total})")


def outside(level: DataFrame, longer: DataFrame | None, size: int) -> DataFrame:
    """Phrases that no longer one covers too well. Of longer ones those of one word more suffice: they occur at least
    as often as anything they lie in."""
    if longer is None:
        return level
    words = [f"w{k}" for k in range(1, size + 1)]
    ends = [longer.select("lang", *[F.col(f"w{k + o}").alias(f"w{k}") for k in range(1, size + 1)], "f") for o in (0, 1)]
    most = ends[0].unionByName(ends[1]).groupBy("lang", *words).agg(F.max("f").alias("most"))
    covered = f"CAST(100 AS decimal(3,0)) * CAST(most AS decimal(19,0)) >= CAST({INSIDE_PERCENT} AS decimal(3,0)) * CAST(f AS decimal(19,0))"
    return level.join(most, ["lang", *words], "left").where(f"most IS NULL OR NOT ({covered})")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", *, min_count: int = MIN_COUNT, words: int = WORDS, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language (all of them with `top=None`)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    frequent, totals, ambiguous = word_table(texts, min_count)
    own = [F.col("f").alias(c) for c in ("first", "head", "tail", "last")]
    level = stored(frequent.select("*", F.col("phrase").alias("last_word"), *own), "level1")
    heads, levels, counts = ranked(level, 1), [level], [level]
    lefts = heads
    for size in range(2, words + 1):
        bitmap = frequent_bitmap(counts[-1], size - 1)
        counts.append(phrase_counts(texts, size, min_count, lefts, heads, bitmap, ambiguous))
        levels.append(stored(extended(counts[-1], levels[-1], size), f"level{size}"))
        if size < words:
            lefts = ranked(counts[-1], size, heads.langs)
    kept = [outside(levels[k], counts[k + 1] if k + 1 < words else None, k + 1) for k in range(1, words)]
    kept = [c.select("lang", "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")) for c in kept]
    found = reduce(DataFrame.unionByName, kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a language may have most of the phrases: its best ones by bucket first
        buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = found.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        found = found.where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """The query in SQL: all phrases of up to four words by position, without ids, tiles or levels."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH pieces AS (
  SELECT COALESCE(lang, '{UNKNOWN}') AS lang,
         unnest(string_split_regex(translate(COALESCE(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces) WHERE len(w) > 0
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM counts WHERE k > 1 AND f >= {min_count}
), frequent AS MATERIALIZED (
  SELECT lang, phrase, f FROM counts WHERE f >= {min_count}
), divided AS MATERIALIZED (
  SELECT lang, phrase, k, f, cut, array_to_string(w[1 : cut], ' ') AS first_part, array_to_string(w[cut + 1 : k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), cuts AS (
  SELECT d.lang, d.phrase, d.k, d.f, d.cut, a.f AS l, b.f AS r, 2000000 * d.f // (a.f + b.f) AS score
  FROM divided d
  JOIN frequent a ON a.lang = d.lang AND a.phrase = d.first_part
  JOIN frequent b ON b.lang = d.lang AND b.phrase = d.rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), parts AS (
  SELECT DISTINCT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, f, k, w, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k)
), most AS (
  SELECT lang, phrase, max(f) AS f FROM parts GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.f IS NULL OR 100 * m.f < {INSIDE_PERCENT} * b.f
)
SELECT lang, rank, phrase, CAST(f AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (
  SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(phrase)) AS rank FROM kept
) JOIN totals USING (lang)
WHERE rank <= {top}
"""
