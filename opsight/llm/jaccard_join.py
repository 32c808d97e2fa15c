"""N-gram Jaccard self-join: documents whose shingle sets are similar, and the groups that such links form.

Rare-first prefix filtering: shingles are ordered by document frequency (frequent ones, found by counting over all
documents, come last; the rest by hash), and two sets with a Jaccard similarity of `percent` share one of the first
n - ceil(percent * n / 100) + 1 of each. Only documents that meet on such a shingle are candidates; length, positional
and suffix filters thin them out, and each pair is verified once, with integers, on whole sets.

Groups of copies stay linear. Equal sets are one node. Shingles with the same nodes, as those of a passage that many
documents share, are one list. Of each list every node is first compared with a few pivots only; those links make
components. Then nodes outside the largest component of a long list meet one member of it, another one each turn (both
times those with the fewest rarer shingles before the list's own: an original links with more of its copies than they
do with each other), and
only pairs of components that are still different are enumerated after that, leaving out the largest component of each
list on one side. No link between different components is lost, because such a pair still meets in some list; a link
inside a component changes nothing.

Null or wordless texts have an empty set and are linked with nothing: their component is their own id. Fewer words than
a shingle: the whole sequence is one shingle. Ties and repeated rows: each row is answered, and equal texts are always
linked. Null ids are answered with the component's smallest id that is not null. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import (
    broadcasted, components, distinct, flat_words, in_slices, is_member, membership, shingle_hashes, stored, text_key, text_slices,
)

FREQUENT = 262_144
LOCAL_FREQUENT = 32_768
FLUSH = 2_000_000
PIVOTS = 4
TURNS = 3
CROWD = 8  # shorter lists are enumerated at once: at most so many pairs a row
BUCKETS = 128


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text of a column, sorted."""
    words, counts = flat_words(column)
    runs = shingle_hashes(words, size)
    out, at = [], 0
    for n in counts.tolist():
        out.append(distinct(runs[at : at + n - size + 1] if n >= size else shingle_hashes(words[at : at + n], size)))
        at += n
    return out


def node_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def prefix_of(hashes: np.ndarray, percent: int, frequent: tuple[np.ndarray, ...]) -> np.ndarray:
    """The rarest shingles of a set: as many as a similar set must share one of.

    The order is the same for all sets: unmarked shingles, then those in the bitmap of shared ones, then by frequency.
    """
    keep = len(hashes) - -(-percent * len(hashes) // 100) + 1
    known, often, bitmap, shared = frequent
    maybe = is_member(bitmap, hashes)
    if shared is not None:
        maybe |= is_member(shared, hashes)
    maybe = np.flatnonzero(maybe)
    if not len(maybe):
        return hashes[:keep]
    marked = hashes[maybe]
    count = np.zeros(len(marked), np.int64) if shared is None else is_member(shared, marked).astype(np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, marked), len(known) - 1)
        count = np.where(known[at] == marked, often[at], count)
    later = count > 0
    last = marked[later][np.lexsort((marked[later], count[later]))]
    return np.concatenate((np.delete(hashes, maybe[later]), last))[:keep]


def _arrow(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _per_text(docs: DataFrame, size: int, schema: str, emit: Callable) -> DataFrame:
    """Runs `emit(batch, sets)` over slices of documents; the last column of `docs` is the text."""
    last = len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, last):
            yield emit(batch, shingle_sets(batch.column(batch.num_columns - 1), size))

    return docs.mapInArrow(run, schema)


def members(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key, n, node, buckets of every row: the set's size, 128-bit digest (null for an empty set) and counts by
    part of the hash space; and, with a null key, shingle and n of what is frequent in the documents of a task.

    Each task counts its own documents in runs, and passes on shingles found three times or more in a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, n = {}, Counter(), 0
        kinds = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("node", pa.binary()), ("buckets", pa.list_(pa.int32())), ("shingle", pa.int64())])

        def flush() -> None:
            nonlocal held, n, total
            if held:
                values, counts = np.unique(np.concatenate(list(held.values())), return_counts=True)
                often = counts >= 3
                for value, count in zip(values[often].tolist(), counts[often].tolist(), strict=True):
                    total[value] += count
                if len(total) > 8 * LOCAL_FREQUENT:
                    total = Counter(dict(total.most_common(LOCAL_FREQUENT)))
            held, n = {}, 0

        for batch in text_slices(batches, 2):
            sets = shingle_sets(batch.column(2), size)
            held |= {node_of(s): s for s in sets if len(s)}  # copies count once
            n += sum(map(len, sets))
            if n > FLUSH:
                flush()
            columns = [
                pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BUCKETS).tolist() for s in sets], kinds[4].type),
                pa.nulls(len(sets), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], schema=kinds)
        flush()
        top = total.most_common(LOCAL_FREQUENT)
        values = np.array([t[0] for t in top], np.uint64).view(np.int64)
        empty = [pa.nulls(len(top), f.type) for f in kinds]
        yield pa.RecordBatch.from_arrays([*empty[:2], pa.array([t[1] for t in top], pa.int64()), *empty[3:5], pa.array(values)], schema=kinds)

    return docs.mapInArrow(run, "doc_id long, key string, n long, node binary, buckets array<int>, shingle long")


def frequent_shingles(counted: DataFrame) -> tuple:
    """The most frequent shingles, sorted by hash, their counts, and a bitmap; bounded, and only used to order prefixes."""
    counts = counted.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n"))
    table = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    values, often = table["shingle"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(values)
    bitmap = np.zeros(1 << 17, np.uint32)
    slot = values & np.uint64((1 << 22) - 1)
    np.bitwise_or.at(bitmap, slot >> np.uint64(5), np.uint32(1) << (slot & np.uint64(31)).astype(np.uint32))
    return values[order], often[order], bitmap, None


def prefixes(docs: DataFrame, size: int, percent: int, frequent, wanted=None) -> DataFrame:
    """shingle and half, or with `wanted` (a bitmap of shingles) shingle, node, half, n, pos: one row per prefix shingle."""
    context = docs.sparkSession.sparkContext
    shared = broadcasted(context, (frequent, wanted))

    def emit(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        order, bitmap = shared.value
        firsts = [prefix_of(s, percent, order) if len(s) else s for s in sets]
        nodes = [node_of(s) if len(s) else b"\0" * 16 for s in sets]
        lengths = np.array([len(f) for f in firsts])
        shingles = np.concatenate(firsts) if firsts else np.empty(0, np.uint64)
        halves = np.array([int.from_bytes(x[:8], "little", signed=True) for x in nodes], np.int64)
        if bitmap is None:
            return _arrow({"shingle": (shingles.view(np.int64), pa.int64()), "half": (np.repeat(halves, lengths), pa.int64())})
        row = np.repeat(np.arange(len(sets)), lengths)
        pos = np.arange(len(shingles)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hit = is_member(bitmap, shingles)
        sizes = np.array([len(s) for s in sets], np.int64)
        return _arrow({
            "shingle": (shingles[hit].view(np.int64), pa.int64()), "node": ([nodes[i] for i in row[hit]], pa.binary()),
            "half": (halves[row[hit]], pa.int64()), "n": (sizes[row[hit]], pa.int64()), "pos": (pos[hit], pa.int32()),
        })

    schema = "shingle long, half long" if wanted is None else "shingle long, node binary, half long, n long, pos int"
    return _per_text(docs.select("text"), size, schema, emit)


def shared_shingles(docs: DataFrame, size: int, percent: int, frequent: tuple) -> DataFrame:
    """The prefix shingles of two or more different sets."""
    ends = prefixes(docs, size, percent, frequent).groupBy("shingle").agg(F.min("half").alias("x"), F.max("half").alias("y"))
    return ends.where("x <> y").select("shingle")


def node_sets(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """node, hashes of the nodes in a bitmap (by the first half of their digest), one row for each."""
    shared = broadcasted(docs.sparkSession.sparkContext, wanted)

    def emit(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        nodes = [node_of(s) for s in full]
        halves = np.array([int.from_bytes(x[:8], "little") for x in nodes], np.uint64)
        found = {nodes[i]: full[i].tobytes() for i in np.flatnonzero(is_member(shared.value, halves))}
        return _arrow({"node": (list(found), pa.binary()), "hashes": (list(found.values()), pa.binary())})

    return _per_text(docs.select("text"), size, "node binary, hashes binary", emit).dropDuplicates(["node"])


def needed(percent: int, a: str = "na", b: str = "nb") -> Column:
    """The overlap that two sets of these sizes need: ceil(percent * (a + b) / (100 + percent))."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent) - 1e-9)


def promising(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that pass the length and suffix filters."""
    both = (
        pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("buckets").alias("ha")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("buckets").alias("hb")), "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    )
    # suffix filter: the overlap cannot exceed the sum over parts of the hash space of the smaller count
    bound = F.aggregate(F.zip_with("ha", "hb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return both.where(bound >= needed(percent)).select("a", "b")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int, label: str) -> DataFrame:
    """node, hashes of the given nodes (node, half), made again from their texts."""
    nodes = stored(nodes, f"{label}-ends")
    wanted = membership(nodes, "half")
    return stored(node_sets(docs, size, wanted).join(nodes, "node", "left_semi"), f"{label}-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs a, b of nodes whose whole sets are similar."""
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            a, b, left, right = (batch.column(n) for n in ("a", "b", "ha", "hb"))
            hit = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return stored(whole.select("a", "b", "ha", "hb").mapInArrow(run, "a binary, b binary"), label)


def ends_of(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sizes.select("node", "half"), "node")


def merged_lists(active: DataFrame) -> DataFrame:
    """list, node, half, n, pos: shingles that have the same nodes are one list, with each node's first place in any.

    A list's name is a hash of its nodes; lists that share a name by chance become one, which only adds candidates.
    """
    signs = [F.bit_xor(F.xxhash64(F.lit(seed), "node")) for seed in (1, 2)]
    names = active.groupBy("shingle").agg(F.xxhash64(F.count("*"), *signs).alias("list"))
    named = active.join(names, "shingle")
    return named.groupBy("list", "node").agg(F.first("half").alias("half"), F.first("n").alias("n"), F.min("pos").alias("pos"))


def with_roots(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists with more than one component: with root, the list's largest component, its number of nodes."""
    known = lists.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = known.groupBy("list", "root").agg(F.count("*").alias("k"))
    mains = per_root.groupBy("list").agg(
        F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots"), F.sum("k").alias("nodes")
    )
    return known.join(mains.where("roots > 1").drop("roots"), "list")


def central(turn: int, turns: int) -> Column:
    """A rank of a list's nodes by the rarer shingles before the list's own: an original has fewer than its changed copies.

    Another part of the nodes comes first each turn.
    """
    other = F.pmod(F.xxhash64("node"), F.lit(turns)) != turn
    return F.struct(other.alias("other"), F.col("pos"), F.col("node").alias("pivot"))


def bridge_pairs(crowded: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Every node outside the largest component of a list with one member of that component."""
    rows = with_roots(crowded, labels)
    picks = rows.where("root = main").groupBy("list").agg(F.min(central(turn, TURNS)).alias("pick"))
    met = rows.where("root <> main").select("list", "node").join(picks, "list").groupBy("node").agg(F.min("pick").alias("pick"))
    return met.select(F.least("node", "pick.pivot").alias("a"), F.greatest("node", "pick.pivot").alias("b"))


def joined_labels(labels: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(node, root) after links between components: the links are contracted to roots first."""
    roots = labels.withColumnRenamed("root", "r")
    ends = links.join(roots.withColumnsRenamed({"node": "a", "r": "ra"}), "a", "left").join(
        roots.withColumnsRenamed({"node": "b", "r": "rb"}), "b", "left"
    )
    ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = stored(components(ends, f"{label}-stars"), f"{label}-merged").withColumnsRenamed({"node": "first", "root": "last"})
    nodes = labels.unionByName(
        merged.join(labels.select(F.col("node").alias("first")), "first", "left_anti").select(F.col("first").alias("node"), F.col("first").alias("root"))
    )
    after = nodes.withColumnRenamed("root", "first").join(merged, "first", "left")
    return stored(after.select("node", F.coalesce("last", "first").alias("root")), f"{label}-labels")


def pivot_pairs(lists: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Every node with a few nodes of its lists, the same ones for all nodes that share a list."""
    ranks = [central(r, pivots) for r in range(pivots)]
    chosen = lists.groupBy("list").agg(*[F.min(x).alias(f"p{r}") for r, x in enumerate(ranks)])
    best = lists.select("list", "node").join(chosen, "list").groupBy("node").agg(
        *[F.min(f"p{r}").alias(f"p{r}") for r in range(pivots)]
    )
    both = best.select("node", F.explode(F.array_distinct(F.array(*[F.col(f"p{r}")["pivot"] for r in range(pivots)]))).alias("pivot"))
    both = both.where("node <> pivot")
    return both.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def cross_pairs(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of nodes in different components, after the length and positional filters."""
    # the smaller set of a similar pair meets the larger one in a still shorter prefix
    short = F.col("pos") < F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent) - 1e-9) + 1
    rows = with_roots(lists, labels).withColumn("short", short)
    left = rows.where("root <> main").select("list", *[F.col(c).alias(f"{c}_l") for c in ("node", "n", "pos", "root", "short")])
    right = rows.select("list", *[F.col(c).alias(f"{c}_r") for c in ("node", "n", "pos", "root", "short", "main")])
    # positional filter: at the first shingle that two sets share, what follows it bounds the overlap, and later ones
    # pass it only where the first does
    rest = F.least(F.col("n_l") - F.col("pos_l"), F.col("n_r") - F.col("pos_r"))
    met = left.join(right, "list").where(
        (F.col("root_l") != F.col("root_r"))
        & ((F.col("root_r") == F.col("main_r")) | (F.col("node_l") < F.col("node_r")))
        & (F.least("n_l", "n_r") * 100 >= F.greatest("n_l", "n_r") * percent)
        & ((F.col("short_l") & (F.col("n_l") <= F.col("n_r"))) | (F.col("short_r") & (F.col("n_r") <= F.col("n_l"))))
        & (rest >= needed(percent, "n_l", "n_r"))
    )
    return met.select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")).distinct()


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, key, n_shingles, component_id, root for every row.

    key is the text's digest, root the component's smallest set digest, null for an empty set.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("key"), F.col(text).alias("text"))
    counted = stored(members(docs, size), "members", "zstd")
    each = counted.where("key IS NOT NULL")
    frequent = frequent_shingles(counted)
    # twice: what the first prefixes find shared moves to the end of the order, so the second ones meet far less often
    frequent = (*frequent[:3], membership(shared_shingles(docs, size, percent, frequent), "shingle"))
    shared = stored(shared_shingles(docs, size, percent, frequent), "shared")
    active = prefixes(docs, size, percent, frequent, membership(shared, "shingle")).dropDuplicates(["shingle", "node"])
    lists = stored(merged_lists(stored(active.join(shared, "shingle", "left_semi"), "active", "zstd")), "lists", "zstd")
    halves = lists.select("node", "half").distinct()
    sizes = each.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    sizes = stored(sizes.join(halves, "node"), "sizes")
    # nodes of long lists keep their sets for the turns below
    long_lists = lists.groupBy("list").count().where(F.col("count") > CROWD).select("list")
    crowded = stored(lists.join(long_lists, "list", "left_semi"), "crowded", "zstd")
    pairs = stored(promising(pivot_pairs(lists), sizes, percent), "near-pairs")
    ends = ends_of(pairs, sizes).unionByName(crowded.select("node", "half")).distinct()
    sets = sets_of(docs, ends, size, "near")
    labels = stored(components(verified(pairs, sets, percent, "near"), "near-stars"), "labels")
    for turn in range(TURNS):
        pairs = stored(promising(bridge_pairs(crowded, labels, turn), sizes, percent), "bridge-pairs")
        links = verified(pairs, sets, percent, "bridges")
        if links.isEmpty():
            break
        labels = joined_labels(labels, links, "bridge")
    pairs = stored(promising(cross_pairs(lists, labels, percent), sizes, percent), "far-pairs")
    far = verified(pairs, sets_of(docs, ends_of(pairs, sizes), size, "far"), percent, "far")
    labels = joined_labels(labels, far, "far")
    rooted = each.join(labels, "node", "left").select("doc_id", "key", "n", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "root"
    )


def oracle(size: int, percent: int) -> str:
    """All pairs that share a shingle, and the closure of their links, in SQL."""
    run = " || ' ' || ".join(f"words[i + {k}]" for k in range(size))
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {size - 2}), lambda i: {run}) END) AS shingle FROM w
    ), n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (
      SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)
    ), links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    reach(start, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.start, links.y FROM reach JOIN links ON links.x = reach.node)
    SELECT n.doc_id, n.n AS n_shingles, min(reach.node) AS component_id
    FROM n JOIN reach ON reach.start = n.doc_id GROUP BY n.doc_id, n.n"""
