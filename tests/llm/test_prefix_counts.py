"""Prefix counts against the tokenizer library, prefix by prefix."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opsight.llm import prefix_counts as p
from opsight.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.001"
PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'l", "'v", "1", "23", "!", "?!", "é", "ß", "中", "՘", " ", "　",
    "\x1c", "\x85", "<|endoftext|>", "<|endof", "|>", "ing", "tion", "😀", "\r\n", "-----", "====", "xxxxx", "́", "'RE", "A",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(p.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    return p.counter(public_tokenizers.path(p.VOCABULARY))


def counts(library, text):
    return [len(e.ids) for e in library.encode_batch([text[:k] for k in range(1, len(text) + 1)], add_special_tokens=False)]


def test_every_prefix_of_odd_texts(library, own):
    draw = random.Random(1)
    for _ in range(1500):
        text = "".join(draw.choices(PARTS, k=draw.randint(1, 14)))
        assert np.cumsum(own.changes(text)).tolist() == counts(library, text), repr(text)


def test_every_prefix_of_prose(library, own, spark):
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(5).collect():
        text = row.text[:700]
        assert np.cumsum(own.changes(text)).tolist() == counts(library, text)


def test_all_characters(library, own):
    places = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3500 or c % 61 == 0 or 0x10000 <= c < 0x12000)]
    texts = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in places[i : i + 50]) for i in range(0, len(places), 50)]
    found = library.encode_batch(texts, add_special_tokens=False)
    assert [int(own.changes(t).sum()) for t in texts] == [len(f.ids) for f in found]


def test_long_units_and_portions(library, own, monkeypatch):
    for text in ("ab" * 3000, " " * 3000, " " * 3000 + "x", "=" * 3000, "中" * 2000, "x \n" * 1000 + "'re"):
        assert int(own.changes(text).sum()) == len(library.encode(text, add_special_tokens=False).ids)
    text = "one  two\n\nthree's ՘ <|endoftext|> four " * 40
    whole = own.changes(text)
    monkeypatch.setattr(p, "UNITS_AT_ONCE", 7)
    assert own.changes(text).tolist() == whole.tolist()


def test_memo_may_be_emptied(library, own, monkeypatch):
    monkeypatch.setattr(p, "MEMO_ENTRIES", 3)
    text = "many different words stand here and stand here again"
    assert np.cumsum(own.changes(text)).tolist() == counts(library, text)


def test_index_answers(spark, library):
    texts = ["one two three four", None, "", "a" * 5000, "  x  <|endoftext|>", "word " * 500, "same", "same"]
    rows = [(i if i != 6 else None, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, changes string")
    index = p.prefix_index(docs)
    exact = {i: counts(library, t) if t else [] for i, t, *_ in rows}
    for limit in (0, 1, 3, 100, 100_000):
        for r in p.answers(index, limit).collect():
            total = exact[r.doc_id][-1] if exact[r.doc_id] else 0
            within = [k + 1 for k, c in enumerate(exact[r.doc_id]) if c <= limit]
            assert (r.n_tokens, r.over_limit) == (total, total > limit)
            assert r.kept_chars == max(within, default=0)
            assert r.kept_tokens == (exact[r.doc_id][r.kept_chars - 1] if within else 0)
            assert r.n_bytes == len((texts[r.doc_id if r.doc_id is not None else 6] or "").encode())
    places = spark.createDataFrame([(i, k) for i in (0, 1, 3, 4, 5) for k in (0, 1, 4, 10_000)] + [(None, 1), (77, 1)], "doc_id long, chars int")
    for r in p.tokens_at(index, places).collect():
        seen = exact[r.doc_id][: r.chars]
        assert r.n_tokens == (seen[-1] if seen else 0)
    assert p.tokens_at(index, places).count() == 20
    assert p.answers(p.prefix_index(docs.limit(0))).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        p.counter(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    rows = LLM_QUERIES["op12_prefix_counts"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
        assert len(library.encode(texts[r.doc_id][: r.kept_chars], add_special_tokens=False).ids) == r.kept_tokens <= 1024
