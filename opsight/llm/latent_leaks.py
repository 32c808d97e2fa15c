"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 32 words, moved by 16, over whole documents. TF-IDF weights use document frequencies of hashed
words over all documents. Items are cut into the same windows, and each window is a query of its own. A distributed
randomised SVD gives the latent basis: it is fitted on all passages of all documents (each task adds up its products,
which are summed by a shuffle) together with the windows of the items, whose rows weigh more so that the basis
spans them; every passage of every document is then searched. A passage is a candidate of an item when its cosine with
one of the item's windows, inner product in the latent space over full norms, reaches `min_cosine`. Items of up to 17
words lie within one passage wherever they stand; for them the smaller of the two norms counts twice, which is the share
of the item in the passage, so that the other words of the passage do not hide them. Candidates are
checked by the longest common subsequence of words around the passage and by the item's answer (its last words).

A basis spans few windows, so there is one for each `block` of item windows, well below the rank however many items
there are; windows it still spans badly are added to it (`latent_scores`). Passages that cannot reach the cosine with
any window of a block are skipped by a sum over their words. About `PASS_WINDOWS` item windows share a pass over the
documents, so what is broadcast has a fixed bound (of whole items: one longer item is a pass of its own).

Null, empty and wordless texts and items match nothing. Ties: of several places for one item the best is reported, by
LCS, cosine, then position. Repeated rows are all answered. Extra columns are not read. Empty benchmark: no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import broadcasted, flat_words, mixed, separators, text_key, text_slices

SLOTS = 1 << 18
RANK = 256
STEP = 16
MIN_COSINE = 0.38
MIN_LCS = 0.6
SURE_LCS = 0.8
MIN_ANSWER = 0.5
ANSWER_WORDS = 8
ITEM_WEIGHT = 8.0
MIN_COVER = 0.9
BLOCK = RANK // 2
PASS_WINDOWS = 1024
SKETCH_SEED = 11
SIGNS = 4  # entries of a row of the random test matrix
STEPS_AT_ONCE = 2048
DENSE = 256  # of the used slots, the most frequent ones
ROWS_SENT = 64
SEPARATORS = separators(b" \t\n\x0b\x0c\r.,;:!?\"'()[]{}*#$%&|<>-")


def words_of(column: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text; punctuation separates words like white space."""
    hashes, counts = flat_words(column, SEPARATORS)
    return np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []


def words_in(texts: list[str]) -> list[np.ndarray]:
    return words_of(pa.array(texts, pa.string()))


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold a word of each slot, and the number of documents; SLOTS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in text_slices(batches, 0):
            for hashes in words_of(batch.column(0)):
                total[slots_of(hashes)] += 1  # a slot named twice in one step counts once
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["slot", "n"]
        )

    table = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = table["slot"].to_numpy(), table["n"].to_numpy()
    out = np.zeros(SLOTS, np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def _passages(hashes: np.ndarray) -> list[np.ndarray]:
    """Slots of the windows of two steps; a short rest is a window too."""
    slots = slots_of(hashes)
    return [slots[i : i + 2 * STEP] for i in range(0, max(1, len(slots) - STEP), STEP)] if len(slots) else []


def _rows(passages: list[np.ndarray], idf: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the unit TF-IDF rows, times their weights."""
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    key, count = np.unique(row * SLOTS + np.concatenate(passages), return_counts=True)
    row, slot = key // SLOTS, key % SLOTS
    value = count * idf[slot]
    norm = np.sqrt(np.bincount(row, value * value, len(passages)))
    return row, slot, value / np.maximum(norm, 1e-12)[row] * weights[row]


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by index, which is sorted."""
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    return index[first], np.add.reduceat(rows, first, axis=0)


def _sketch(slots: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the rows of the random test matrix: one sign in each of `SIGNS` ranges of columns."""
    edges = np.minimum(np.arange(SIGNS + 1) * rank // SIGNS, rank - 1)
    edges[-1] = rank
    grid = mixed(slots.astype(np.uint64)[:, None] * np.uint64(SIGNS) + np.arange(SIGNS, dtype=np.uint64) + np.uint64(SKETCH_SEED << 40))
    columns = edges[:-1] + ((grid >> np.uint64(8)) % np.maximum(np.diff(edges), 1).astype(np.uint64)).astype(np.int64)
    return columns, ((grid & np.uint64(1)).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(SIGNS))


def _sketched(row: np.ndarray, slot: np.ndarray, value: np.ndarray, rank: int) -> np.ndarray:
    """Rows times the random test matrix."""
    columns, signs = _sketch(slot, rank)
    size = (int(row[-1]) + 1) * rank
    return np.bincount((row[:, None] * rank + columns).ravel(), (signs * value[:, None]).ravel(), size).reshape(-1, rank)


def _products(found: tuple, used: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows A and their sketch Y: Y'Y, and A'Y for the used slots, which are all slots of A."""
    row, slot, value = found
    y = _sketched(row, slot, value, rank)
    cross = np.zeros((len(used), rank))
    order = np.argsort(slot, kind="stable")
    here, sums = _summed(np.searchsorted(used, slot[order]), y[row[order]] * value[order, None])
    cross[here] = sums
    return y.T @ y, cross


def in_steps(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts in steps: (slots by step, first step of each text, first and second step of each passage).

    Steps are filled up with the slot `SLOTS`, which is no word's. The last step is empty: the second one of a passage
    that has no other.
    """
    steps = -(-counts // STEP)
    begin = np.cumsum(steps) - steps
    total = int(steps.sum())
    slots = np.full((total + 1) * STEP, SLOTS, np.int64)
    slots[np.arange(len(hashes)) + np.repeat(begin * STEP - (np.cumsum(counts) - counts), counts)] = slots_of(hashes)
    last = np.zeros(total, bool)
    last[(begin + steps - 1)[steps > 0]] = True
    alone = np.zeros(total, bool)
    alone[begin[steps == 1]] = True
    first = np.flatnonzero(~last | alone)
    return slots.reshape(-1, STEP), begin, first, np.where(alone[first], total, first + 1)


def passage_norms(slots: np.ndarray, first: np.ndarray, second: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Norms of the TF-IDF rows of passages; `idf` ends with the zero of the slot that is no word's."""
    words = np.sort(np.hstack([slots[first], slots[second]]).astype(np.int32), axis=1)
    begins = np.ones(words.shape, bool)
    begins[:, 1:] = words[:, 1:] != words[:, :-1]
    at = np.flatnonzero(begins)
    value = np.diff(np.append(at, words.size)) * idf[words.ravel()[at]]
    return np.sqrt(np.bincount(at // words.shape[1], value * value, len(words)))


class Products:
    """Y'Y, and A'Y for the used slots, of the passages A of texts and their sketch Y, added up text by text.

    A row is a sum over the words of two steps, so each step is sketched once; and a word adds to the cross product the
    sketches of the passages that its step is in.
    """

    def __init__(self, used: np.ndarray, idf: np.ndarray, rank: int):
        self.idf, self.rank = np.append(idf, 0).astype(np.float32), rank
        self.used, self.order = used, np.argsort(idf[used], kind="stable")  # the most frequent ones first
        self.gram, self.total = np.zeros((rank, rank)), np.zeros((len(used), rank))
        self.n_dense = min(DENSE, len(used))
        self.place = np.full(SLOTS + 1, -1, np.int32)
        self.place[used[self.order]] = np.arange(len(used))
        self.columns, self.signs = _sketch(np.arange(SLOTS + 1), rank)
        self.columns, self.signs = self.columns.astype(np.int32), self.signs * self.idf[:, None]

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        slots, _, first, second = in_steps(hashes, counts)
        empty = len(slots) - 1
        self.part = np.zeros((len(self.used), self.rank), np.float32)
        for start in range(0, len(first), STEPS_AT_ONCE):
            a, b = first[start : start + STEPS_AT_ONCE], second[start : start + STEPS_AT_ONCE]
            low, high = int(a[0]), int(max(a[-1], b[b < empty].max(initial=0))) + 1
            part = np.vstack([slots[low:high], slots[empty:]])  # the steps of these passages, and the empty one
            self._add(part, a - low, np.where(b < empty, b - low, high - low))
        self.total += self.part

    def _add(self, slots: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        norm = passage_norms(slots, first, second, self.idf)
        scale = (1 / np.maximum(norm, 1e-12)).astype(np.float32)[:, None]
        at = (np.arange(len(slots), dtype=np.int32) * np.int32(self.rank))[:, None, None] + self.columns[slots]
        sums = np.bincount(at.ravel(), self.signs[slots].ravel(), len(slots) * self.rank).astype(np.float32).reshape(-1, self.rank)
        y = (sums[first] + sums[second]) * scale
        self.gram += y.T @ y
        y *= scale
        around = np.zeros_like(sums)
        around[first] += y
        around[second] += y  # the empty step has no words, whatever is added to it
        place = self.place[slots]
        step, _ = at_words = np.nonzero(place >= 0)
        place = place[at_words]
        often = place < self.n_dense  # words of most steps: as a matrix product
        held = np.bincount(place[often] * len(slots) + step[often], minlength=self.n_dense * len(slots))
        self.part[: self.n_dense] += held.reshape(-1, len(slots)).astype(np.float32) @ around
        place, step = place[~often], step[~often]
        if len(place):
            order = np.argsort(place, kind="stable")
            place, step = place[order], step[order]
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            count = np.diff(np.append(first, len(place)))
            for turn in range(int(count.max())):  # one occurrence of each word at a time
                at = first[count > turn] + turn
                self.part[place[at]] += around[step[at]]

    def cross(self) -> np.ndarray:
        """A'Y, in the order of the used slots."""
        cross = np.empty_like(self.total)
        cross[self.order] = self.total * self.idf[self.used[self.order], None]
        return cross


def document_products(docs: DataFrame, used: np.ndarray, idf: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """`Products` of all passages of all documents; tasks send blocks of rows, each summed up in one place."""
    spark = docs.sparkSession
    shared = broadcasted(spark.sparkContext, (used, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in text_slices(batches, 0):
            hashes, counts = flat_words(batch.column(0), SEPARATORS)
            if len(hashes):
                total = total or Products(*shared.value, rank)
                total.add(hashes, counts)
        rows = np.vstack([total.gram, total.cross()]).astype(np.float32) if total else np.empty((0, rank), np.float32)
        for at in range(0, len(rows), ROWS_SENT):
            block = rows[at : at + ROWS_SENT]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["at", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.float32)
                total[at] = total[at] + part if at in total else part.astype(float)
        for at, data in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([data.astype(np.float32).tobytes()], pa.binary())], names=["at", "data"]
            )

    # what each task sends has a fixed size, as the item windows of a pass are bounded
    parts = docs.select("text").mapInArrow(run, "at int, data binary")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = parts.repartition(width, "at").mapInArrow(added, "at int, data binary").toArrow()
    whole = np.zeros((rank + len(used), rank))
    for at, data in zip(table["at"].to_pylist(), table["data"].to_pylist(), strict=True):
        block = np.frombuffer(data, np.float32).reshape(-1, rank)
        whole[at : at + len(block)] = block
    return whole[:rank], whole[rank:]


def latent_scores(windows: list[np.ndarray], used: np.ndarray, gram: np.ndarray, cross: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, scores) of a block of item windows: what a word of each slot adds to the latent inner product with each.

    The basis is a randomised SVD of the documents' passages and of these windows: range finding, then the small factor.
    Windows that it spans badly add what is missing of them to it, so a copy keeps `MIN_COVER` of its cosine whatever
    the documents are.
    """
    rank = len(gram)
    row, slot, value = _rows(windows, idf, np.ones(len(windows)))
    slots = np.unique(slot)
    own_gram, own_cross = _products((row, slot, value * ITEM_WEIGHT), slots, rank)
    size, turn = np.linalg.eigh(gram + own_gram)
    good = size > max(size[-1], 1e-12) * 1e-9
    whiten = turn[:, good] / np.sqrt(size[good])  # Q = Y whiten has orthonormal columns
    small = (cross[np.searchsorted(used, slots)] + own_cross) @ whiten
    left, strength, _ = np.linalg.svd(small, full_matrices=False)  # small factor, used slots x rank
    basis = left[:, strength > strength[:1].max(initial=0) * 1e-9]
    queries = np.zeros((len(windows), len(slots)))
    queries[row, np.searchsorted(slots, slot)] = value
    inside = queries @ basis
    missing = (queries - inside @ basis.T)[(inside**2).sum(axis=1) < MIN_COVER * (queries**2).sum(axis=1)]
    if len(missing):
        more, strength, _ = np.linalg.svd(missing.T, full_matrices=False)
        basis = np.hstack([basis, more[:, strength > 1e-6]])
    return slots, (idf[slots, None] * (basis @ (queries @ basis).T)).astype(np.float32)


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit of a long number per word of the item."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        if hit := places.get(w):
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


class Searcher:
    """All passages of some texts against the windows of some items, one block of windows after the other."""

    def __init__(self, items, idf, blocks, min_cosine):
        self.min_cosine = min_cosine
        self.ids = [i for i, _ in items]
        self.items = words_in([t for _, t in items])
        self.lists = [item.tolist() for item in self.items]
        self.weight = np.append(idf * idf, 0).astype(np.float32)
        self.blocks = []
        for owners, floors, slots, scores in blocks:
            row = np.full(SLOTS + 1, len(slots), np.int32)
            row[slots] = np.arange(len(slots))
            scores = np.vstack([scores, np.zeros((1, scores.shape[1]), np.float32)])
            # no passage has a larger inner product with any window than the sum of its words' largest
            most, share = np.maximum(scores.max(axis=1), 0), np.maximum((scores / floors).max(axis=1), 0)
            self.blocks.append((owners, floors, row, scores, most, share if np.isfinite(floors).any() else None))

    def candidates(self, slots: np.ndarray, first: np.ndarray, second: np.ndarray) -> dict[tuple[int, int], float]:
        """Cosine by (first step of the passage, item)."""

        def sums(values: np.ndarray) -> np.ndarray:
            parts = values.sum(axis=1)
            return parts[first] + parts[second]

        norm = np.sqrt(sums(self.weight[slots]))
        out: dict[tuple[int, int], float] = {}
        least = self.min_cosine * (1 - 1e-5)
        for owners, floors, row, scores, most, share in self.blocks:
            found = row[slots]
            within = sums(most[found]) >= least * norm
            if share is not None:
                within |= sums(share[found]) >= least
            passages = np.flatnonzero(within & (norm > 0))
            for start in range(0, len(passages), 512):
                at = passages[start : start + 512]
                total = np.zeros((len(at), scores.shape[1]), np.float32)
                for step in (first[at], second[at]):
                    for k in range(STEP):
                        total += scores[found[step, k]]
                cosine = total / norm[at, None]
                hits = np.nonzero(total >= self.min_cosine * np.minimum(norm[at, None], floors))
                for i, k in zip(*(x.tolist() for x in hits), strict=True):
                    place = int(first[at[i]]), int(owners[k])
                    out[place] = max(out.get(place, 0.0), float(cosine[i, k]))
        return out

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item_id, cosine, lcs, answer, first word) of each item found in each text, at its best place."""
        if not len(hashes) or not self.items:
            return []
        slots, begin, first, second = in_steps(hashes, counts)
        starts = np.cumsum(counts) - counts
        best: dict[tuple[int, int], tuple] = {}
        for (step, k), cosine in self.candidates(slots, first, second).items():
            text = int(np.searchsorted(begin, step, side="right")) - 1  # wordless texts come before it in a tie
            whole = hashes[starts[text] : starts[text] + counts[text]]
            item, at = self.items[k], (step - int(begin[text])) * STEP
            around = whole[max(0, at - len(item)) : at + 2 * STEP + len(item)]
            there = set(around.tolist())
            if sum(w in there for w in self.lists[k]) < MIN_LCS * len(item):
                continue  # a subsequence has no words that the place does not have
            share = lcs(item, around) / len(item)
            if share < MIN_LCS:
                continue
            answer = item[-ANSWER_WORDS:]
            reply = lcs(answer, around) / len(answer)
            if share >= SURE_LCS or reply >= MIN_ANSWER:
                best[text, k] = max(best.get((text, k), (0.0,)), (share, min(cosine, 1.0), -at, reply))
        return [(text, self.ids[k], b[1], b[0], b[3], -b[2]) for (text, k), b in sorted(best.items())]


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", *, min_cosine: float = MIN_COSINE, rank: int = RANK, block: int = BLOCK,
) -> DataFrame:
    """doc_id, key, item_id, cosine, lcs, answer, first_word for every document and item found in it."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("key"), F.col(text).alias("text"))
    schema = "doc_id long, key string, item_id long, cosine double, lcs double, answer double, first_word long"
    spark = docs.sparkSession
    frequency, n_docs = document_frequencies(docs)
    idf = np.log((n_docs + 1) / (frequency + 1)).astype(np.float32)
    ordered = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    out, items, n_windows = None, [], 0

    def search(items: list[tuple[int, str]]) -> DataFrame:
        windows = [(k, p) for k, hashes in enumerate(words_in([t for _, t in items])) for p in _passages(hashes)]
        used = np.unique(np.concatenate([p for _, p in windows]))  # other slots add nothing to inner products
        gram, cross = document_products(docs, used, idf, rank)
        blocks = []
        for start in range(0, len(windows), block):
            owners, own = zip(*windows[start : start + block], strict=True)
            norms = [np.sqrt((np.unique(p, return_counts=True)[1] ** 2 * idf[np.unique(p)] ** 2).sum()) for p in own]
            floors = np.array([x if len(p) <= STEP + 1 and x > 0 else np.inf for p, x in zip(own, norms, strict=True)], np.float32)
            blocks.append((np.array(owners), floors, *latent_scores(list(own), used, gram, cross, idf)))
        shared = broadcasted(spark.sparkContext, (items, idf, blocks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value, min_cosine)
            for batch in text_slices(batches, 2):
                rows = searcher(*flat_words(batch.column(2), SEPARATORS))
                at = pa.array([r[0] for r in rows], pa.int64())
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array([r[c + 1] for r in rows], k) for c, k in enumerate(kinds)]],
                    names=["doc_id", "key", "item_id", "cosine", "lcs", "answer", "first_word"],
                )

        return docs.mapInArrow(run, schema)

    def add(found: DataFrame | None, items: list[tuple[int, str]]) -> DataFrame | None:
        usable = [item for item, found in zip(items, words_in([t for _, t in items]), strict=True) if len(found)]
        if not usable:
            return found
        part = search(usable)
        return part if found is None else found.unionByName(part)

    for row in ordered.toLocalIterator():  # the query set, some blocks at a time
        items.append((row["i"], row["t"]))
        n_windows += sum(len(_passages(hashes)) for hashes in words_in([row["t"]]))
        if n_windows >= PASS_WINDOWS:
            out, items, n_windows = add(out, items), [], 0
    out = add(out, items)
    return out if out is not None else spark.createDataFrame([], schema)
