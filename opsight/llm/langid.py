"""Language identification by words first, character n-grams second.

A word that the model knows counts with its log frequency in each language. An unseen word falls back to its longest
character n-grams that are known at all, then to shorter ones. The sum over the words of the whole text decides; the
score is the winner's share after exponentiation.

The classifier is fitted on all labelled rows of at most `languages` languages: words are counted over whole texts,
n-grams over the distinct words. It keeps the `vocabulary` most frequent words and n-grams of each order and language,
so it is of bounded size whatever the number of rows, and is broadcast.

Null, empty or letterless texts: `und` with score 0. A table without a labelled row: every text with a letter is `und`.
Ties: the language first in order of name. Repeated rows: each row is answered. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsight.llm.common import released, stored, text_slices

UNKNOWN = "und"
VOCABULARY = 40_000
LANGUAGES = 200
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.3
MEMO_WORDS = 50_000
COUNTED = 200_000  # counts that a task holds before it sends them
_RUNS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if no character is a letter."""
    runs = _RUNS.findall(text.lower()) if text else []
    return runs if any(map(str.isalpha, runs)) or any(c.isalpha() for r in runs for c in r) else []


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between boundary marks."""
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def gram_key(order: int, gram: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{order}{gram}".encode())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of labelled texts; a word may come several times."""
    counts: dict[str, Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            columns = [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(words.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
        counts.clear()

    for batch in text_slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.setdefault(lang, Counter()).update(letters(text.as_py()))
        if sum(map(len, counts.values())) > COUNTED:
            yield from sent()
    yield from sent()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, order (0: words), gram, n of counted words; an n-gram may come several times."""
    counts: dict[tuple[str, int], dict[str, int]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, order), found in counts.items():
            columns = [
                pa.array([lang] * len(found), pa.string()), pa.array([order] * len(found), pa.int32()),
                pa.array(found, pa.string()), pa.array(found.values(), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "order", "gram", "n"])
        counts.clear()

    for batch in batches:
        for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for order in (0, *ORDERS):
                own = counts.setdefault((lang, order), {})
                for gram in grams(word, order) if order else (word,):
                    own[gram] = own.get(gram, 0) + n
        if sum(map(len, counts.values())) > COUNTED:
            yield from sent()
    yield from sent()


class Backoff:
    """Word and n-gram log frequencies for each language, filed under 64-bit hashes in sorted order."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        langs, orders, grams_, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
        self.langs = sorted(set(langs))
        at = {lang: i for i, lang in enumerate(self.langs)}
        keys = np.fromiter((gram_key(o, g) for o, g in zip(orders, grams_, strict=True)), np.uint64, len(rows))
        self.keys, place = np.unique(keys, return_inverse=True)
        table, order = np.zeros((len(self.keys), len(self.langs))), np.zeros(len(self.keys), np.int64)
        np.add.at(table, (place, np.array([at[lang] for lang in langs], np.int64)), np.array(counts, float))
        order[place] = np.array(orders, np.int64)
        for o in (0, *ORDERS):
            own = order == o
            table[own] = np.log((table[own] + SMOOTHING) / (table[own].sum(axis=0) + SMOOTHING * max(1, own.sum())))
        self.logs = table

    def places(self, order: int, found: list[str]) -> np.ndarray:
        """Where the table has these words or n-grams; -1 for unknown ones."""
        keys = np.fromiter((gram_key(order, g) for g in found), np.uint64, len(found))
        if not len(self.keys):
            return np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def vectors(self, words: list[str]) -> np.ndarray:
        """The log frequencies of words: their own, or the mean over their longest n-grams known."""
        out, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for order in (0, *ORDERS):
            parts = [[words[i]] if order == 0 else grams(words[i], order) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), np.array([len(p) for p in parts], np.int64))
            places = self.places(order, [g for p in parts for g in p])
            owner, places = owner[places >= 0], places[places >= 0]
            known, total = np.bincount(owner, minlength=len(left)), np.zeros((len(left), len(self.langs)))
            np.add.at(total, owner, self.logs[places])
            out[left] = total / np.maximum(known, 1)[:, None]
            left = left[known == 0]
        return out


class Scorer:
    """Whole texts against a model, with the vectors of words seen so far kept up to a number."""

    def __init__(self, model: Backoff):
        self.model, self.at = model, {}
        self.rows = np.zeros((0, len(model.langs)))

    def _look_up(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > MEMO_WORDS:  # start again rather than grow
            self.at.clear()
            self.rows, new = self.rows[:0], list(words)
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate((self.rows, self.model.vectors(new)))

    def __call__(self, texts: pa.Array) -> list[tuple[str, float]]:
        counts = [Counter(letters(text.as_py())) for text in texts]
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(counts)
        self._look_up(set().union(*counts))
        out = []
        for own in counts:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.array(list(own.values()), float) @ self.rows[[self.at[w] for w in own]]
            best = int(total.argmax())
            out.append((self.model.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(
    labelled: DataFrame, lang: str = "lang", text: str = "text", *, vocabulary: int = VOCABULARY, languages: int = LANGUAGES,
) -> Backoff:
    """The model of all rows with a language and a text."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return Backoff([])
    words = (
        rows.where(F.col("lang").isin([r["lang"] for r in sizes])).mapInArrow(_words, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    counts = (
        words.mapInArrow(_grams, "lang string, order int, gram string, n long")
        .groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    )
    with released(spark):
        counts = stored(counts, "grams")
        # the count of the last one kept, so that only these and their ties are ranked
        down = Window.partitionBy("lang", "order").orderBy(F.desc("n"))
        same = counts.groupBy("lang", "order", "n").agg(F.count("*").alias("same")).withColumn("upto", F.sum("same").over(down))
        least = same.where(F.col("upto") - F.col("same") < vocabulary).groupBy("lang", "order").agg(F.min("n").alias("least"))
        often = counts.join(F.broadcast(least), ["lang", "order"]).where("n >= least").drop("least")
        top = Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram")
        table = often.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= vocabulary).drop("rank").toArrow()
    return Backoff(list(zip(*[c.to_pylist() for c in table.columns], strict=True)))


def predict(docs: DataFrame, model: Backoff, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in text_slices(batches, 1):
            found = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Backoff, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a language with at least `min_score`; one pass, no shuffle."""
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in text_slices(batches, at):
            found = scorer(batch.column(at))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(kept, schema)
