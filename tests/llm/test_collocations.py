"""Collocations against SQL and a plain count."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from opsight.llm import collocations as c
from opsight.llm.queries import LLM_ORACLES, LLM_QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, min_count, top):
    """The contract word by word, in dictionaries."""
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for mark in ".,;:!?\n\x0b\x0c\r":
            lowered = lowered.replace(mark, "\n")
        for piece in lowered.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= min_count}
    covered = {
        (lang, w[i : i + m])
        for (lang, w), f in frequent.items()
        for m in range(2, len(w))
        for i in range(len(w) - m + 1)
        if 100 * f >= 80 * counts[lang, w[i : i + m]]
    }
    found = {}
    for (lang, w), a in frequent.items():
        if (lang, w) not in covered:
            cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, totals[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1)
    )


def texts(seed, n=120):
    draw = random.Random(seed)
    words = ["a", "B", "c", "dé", "日本", "e\x00", "f-g", " ", "'x'"] + [f"w{i}" for i in range(30)]
    glue = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?", "; ", "\r\n"]
    rows = []
    for _ in range(n):
        made = "".join(draw.choices(words, weights=[9, 8, 7, 5, 4, 3, 3, 2, 2] + [1] * 30)[0] + draw.choice(glue) for _ in range(draw.randint(0, 60)))
        rows.append((made, draw.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("   ...", "de")] + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(t, l, 1, "x") for t, l in rows], "text string, lang string, f int, phrase string").repartition(6)


def result(df):
    return sorted(tuple(r[k] for k in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("min_count,top", [(2, 2000), (3, 7)])
def test_against_plain_counts(spark, min_count, top):
    rows = texts(min_count)
    assert result(c.collocations(frame(spark, rows), min_count=min_count, top=top)) == plain(rows, min_count, top)


def test_dense_tiles_and_small_portions(spark, monkeypatch):
    rows = texts(5, 300)
    expected = plain(rows, 4, 2000)
    monkeypatch.setattr(c, "TILE", 4)
    monkeypatch.setattr(c, "HEAD", 16)
    monkeypatch.setattr(c, "DENSE_SHARE", 8)
    monkeypatch.setattr(c, "PORTION_BYTES", 400)
    assert result(c.collocations(frame(spark, rows), min_count=4)) == expected


def test_words_with_a_shared_hash_get_other_ids(spark):
    """The same id in tasks and in the word table, whatever the case of the word."""
    portion = c.Portion(np.frombuffer("Été, W1 b w1".encode(), np.uint8), np.array([0, 14]), ["en"])
    plain_ids = c.words_of(portion, np.empty(0, np.uint64)).ids
    assert plain_ids[1] == plain_ids[3] and len(set(plain_ids.tolist())) == 3
    ids = c.words_of(portion, plain_ids[:2]).ids
    # A-Z only are folded, so the first word keeps its capital
    other = spark.sql("SELECT xxhash64('Été'), xxhash64('w1')").first()
    assert [v & c.MASK for v in other] == ids[:2].tolist() and ids[1] == ids[3] and ids[2] == plain_ids[2]


def test_tiles_count_all_pairs():
    rng = np.random.default_rng(1)
    left, right, lang = rng.integers(0, 1200, 400_000) // 3, rng.integers(0, 1200, 400_000) // 5, rng.integers(0, 2, 400_000)
    tiles = c.Tiles()
    rest = tiles.count(lang, left, right)
    total = sum(int(v.sum()) for v in tiles.held.values())
    assert tiles.held and total + int(rest.sum()) == 400_000
    seen = Counter(zip(lang[~rest].tolist(), left[~rest].tolist(), right[~rest].tolist()))
    for (code, top, side), cells in tiles.held.items():
        for cell in np.flatnonzero(cells)[:200]:
            assert cells[cell] == seen[code, top * c.TILE + cell // c.TILE, side * c.TILE + cell % c.TILE]


def test_long_text_is_cut_between_pieces():
    data = np.frombuffer(b"one two. three four five; " * 50 + b"x" * 90 + b" y", np.uint8)
    parts = list(c.cut_at_breaks(data, 40))
    assert b"".join(p.tobytes() for p in parts) == data.tobytes() and len(parts) > 20
    assert all(c.BREAK[p[-1]] for p in parts[:-1])


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_001, 9_000_000_000_000_000_002, 9_000_000_000_000_000_005)], "f long, l long, r long")
    f, l, r = df.first()
    assert df.select(c.score("f", "l", "r")).first()[0] == 2_000_000 * f // (l + r)


def test_nothing(spark):
    assert c.collocations(frame(spark, [(None, None)])).count() == 0
    assert c.collocations(frame(spark, []).limit(0)).count() == 0
    assert c.collocations(frame(spark, [("one. two, three", "en")] * 40)).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = sorted(tuple(r) for r in connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({LLM_ORACLES['op11_collocations']})").fetchall())
    assert result(LLM_QUERIES["op11_collocations"](spark, folder)) == expected and expected
