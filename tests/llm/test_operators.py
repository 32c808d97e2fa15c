"""Operators against brute force, and their results for nulls, empty and long texts, ties, repeats, extra columns."""

import glob
import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opsight.llm import (
    chat, common, context_mixing, fertility, jaccard_join, langid, latent_leaks, packing, sentence_spans, surrogates, url_rules,
)
from opsight.llm.queries import LLM_ORACLES, LLM_QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
EXTRA = "score double, kept boolean, n long, token string, key string, root string, rank int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = "one two three four five six seven eight nine ten " * 4000
PASSAGE = "Every lamp along the quiet harbour went dark at once. Nobody had touched the old switch. " \
    "A cold wind came over the wall, and the boats began to knock. Someone laughed in the fog. " \
    "Then the bell rang twice, slowly, as it had done when the ferry sank. We all counted the strokes and waited."


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None), (2, "", "en"), (3, " \n ", "en"), (4, LONG, "en"), (5, "short text here", "en"),
        (5, "short text here", "en"), (None, "short text here", "en"), (6, "... 123 ---", "en"), (7, PASSAGE, "en"),
        (8, "Before it " + PASSAGE + " after it", "en"), (9, PASSAGE, None), (None, None, None),
    ]
    return spark.createDataFrame([(i, t, lang, "s", 0, *[None] * 7) for i, t, lang in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_sql_counterparts(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = LLM_QUERIES[name](spark, FOLDER)
    expected = duck.execute(LLM_ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(found.columns)
    left = sorted(tuple(str(r[c]) for c in names) for r in found.collect())
    assert left == sorted(tuple(map(str, r)) for r in expected.fetchall())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        url_rules.judge(pages, labels), surrogates.replace_all(none), langid.predict(none, langid.fit(none)),
        chat.collapse_and_render(turns), sentence_spans.deduplicated(none), context_mixing.scores(none, F.lit(True)),
        fertility.judged(fertility.features(none)), jaccard_join.linked(none), latent_leaks.leaks(none, items),
        packing.pack_documents(none),
    ):
        assert df.count() == 0


def test_url_edges(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?y"), (4, "http://example.net/fr/"), (5, "http://x.net"),
         (None, "http://w.example.com/de/1"), (7, "ftp://www.my.org/fr/"), (7, "ftp://www.my.org/fr/")],
        "page_id long, url string",
    )
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_rules.judge(pages, labels).collect())
    assert found == sorted([
        ("1", "", "", "None", "allow"), ("2", "", "", "None", "allow"), ("3", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("4", "example.net", "/fr/", "net/", "block"), ("5", "x.net", "", "None", "allow"),
        ("None", "w.example.com", "/de/1", "example.com/de/", "block"), ("7", "www.my.org", "/fr/", "org/fr/", "allow"),
        ("7", "www.my.org", "/fr/", "org/fr/", "allow"),
    ])


def test_mined_rules_block(spark):
    rows = [(i, f"http://shop{i}.com/casino/win/{i}" if i < 20 else f"http://shop{i}.com/news/{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 20), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    found = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {r.page_id for r in found if r.verdict == "block"} == set(range(20))


def test_surrogates_keep_type_and_identity(spark, odd):
    rows = [
        (1, "Write to Ann.Lee@mail.org or ann.lee@mail.org, call +1 (555) 010-9999 or +1 555 010 9999."),
        (2, "Card 4111 1111 1111 1111, host 10.0.0.7, password=abc123def456, Mrs. Jane Doe met Mr. Doe."), (3, None), (4, "clean"),
    ]
    out = {r.doc_id: r for r in surrogates.replace_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[3].text is None and out[4].text == "clean" and out[1]["__entities"] == 4
    a, b, c, d = [surrogates.find(out[1].text)[i] for i in range(4)]
    assert a[3] == b[3] and c[3] == d[3] and "ann.lee" not in out[1].text.lower() and "010" not in out[1].text
    kinds = {k: v for k, *_, v in surrogates.find(out[2].text)}
    assert set(kinds) == {"card", "ip", "secret", "name"} and surrogates.luhn(kinds["card"][:-1]) == kinds["card"][-1]
    assert surrogates.replace_all(odd).select(*odd.columns).count() == odd.count()
    table = surrogates.assigned(spark.createDataFrame([(i, f"u{i}@x.org 10.0.{i}.1") for i in range(200)], "doc_id long, text string"))
    assert table.select("kind", "made").distinct().count() == table.count() == 400
    few = surrogates.replace_all(spark.createDataFrame(rows, "doc_id long, text string"), few=-1)
    assert sorted(str(r.text) for r in few.collect()) == sorted(str(r.text) for r in out.values())


@pytest.mark.parametrize("text", ["(555) 123-4567", "555-123-4567", "0171 5557713", "+15551234567", "+1 (555) 123-4567"])
def test_telephone_forms(text):
    made, n = surrogates.replaced(f"call {text}, now", {}, "key")
    digits = [c for c in text if c.isdigit()]
    assert n == 1 and made != f"call {text}, now" and len(made) == len(f"call {text}, now")
    assert text[0] != "+" or made.startswith("call +1")
    assert [a.isdigit() for a in made] == [a.isdigit() for a in f"call {text}, now"] and len(digits) >= 10


def test_telephone_spellings_agree():
    found = surrogates.find("+15551234567 or +1 555 123 4567, +4917155577 or +49 171 55577, 2024-01-30, 4111 1111 1111 1111")
    assert [f[0] for f in found] == ["phone"] * 4 + ["card"]
    assert found[0][3] == found[1][3] and found[2][3] == found[3][3] and found[0][3] != found[2][3]
    national = surrogates.find("555-123-4567 or (555) 123-4567")
    assert national[0][3] == national[1][3]


def test_full_formats_are_permuted(spark):
    """Every number of a format, every one-letter address of a domain, and an address without a letter to change."""
    rows = [(k, f"call 0{k // 1000}-{k % 1000:03d}, then go") for k in range(10_000)]
    rows += [(20_000 + k, f"write to {c}@one.org now") for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(30_000, "and é@b.c too")]
    out = {r.doc_id: r.text for r in surrogates.replace_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    before, after = [x[1] for x in rows], [out[x[0]] for x in rows]
    assert len(set(after)) == len(rows) and not any(a == b for a, b in zip(before, after, strict=True))
    assert set(after[:10_000]) == set(before[:10_000])
    kinds = [surrogates.find(t)[0][0] for t in after]
    assert kinds == ["phone"] * 10_000 + ["email"] * 27


@pytest.mark.parametrize("text", ["12345678", "abc-12", "00", "7"])
def test_permutation_without_fixed_points(text):
    digits = [f"{k:0{len(text)}d}" for k in range(10 ** min(len(text), 4))] if text.isdigit() and len(text) < 5 else [text]
    made = [surrogates.permuted(d, "t", "key", whole=True) for d in digits]
    assert len(set(made)) == len(digits) and not any(a == b for a, b in zip(made, digits, strict=True))
    assert all(surrogates.format_of("ssn", a) == surrogates.format_of("ssn", b) for a, b in zip(made, digits, strict=True))


def test_dates_scripts_and_untitled_names():
    for text in ("born 05/2023 here", "from 01/1999 to 12/2004", "05-2023 and 07 2021"):
        assert surrogates.replaced(text, {}, "key") == (text, 0)
    made, n = surrogates.replaced("Dr. Ελένη Παπαδόπουλου rang", {}, "key")
    assert n == 1 and "Παπαδ" not in made and all("α" <= c.lower() <= "ω" for w in made.split()[1:3] for c in w)
    made, n = surrogates.replaced("John Smith, Mr. John Smith; then John Smithson and JOHN, John Smith", {}, "key")
    name = " ".join(made.split(";")[0].split()[-2:])
    assert n == 3 and made == f"{name}, Mr. {name}; then John Smithson and JOHN, {name}" and name != "John Smith"


def test_many_surnames_stay_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    made_up = ["".join(letters[(k // 26**p) % 26] for p in range(4)).capitalize() for k in range(25_000)]
    rows = [(k, f"{title} {w} came") for k, w in enumerate(made_up) for title in ("Mr", "Mrs")]
    found = surrogates.assigned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shown = {r.made.partition("|")[2] for r in found}
    assert len(found) == len(shown) == 50_000 and not shown & {w.lower() for w in made_up}


def test_language(docs, odd):
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    held = langid.predict(docs.where("doc_id % 4 = 2"), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    und = langid.predict(odd, model).where("lang_pred = 'und'")
    assert und.count() == 5 and und.agg(F.max("score")).first()[0] == 0
    assert langid.keep_identified(odd, model).columns == odd.columns
    assert langid.predict(odd, langid.Backoff([])).where("lang_pred <> 'und'").count() == 0


def test_language_model_is_fitted_on_all_rows(spark):
    """Against counts over every row of more rows than the earlier sample of about 4,000 a language held."""
    rare = ["".join("abcdefghij"[int(c)] for c in str(10_000 + k)) for k in range(9000)]
    rows = [(None if k % 3 else k, f"The {w} -- came, {w}x{k % 2}", "en") for k, w in enumerate(rare[:6000])]
    rows += [(k, f"und {w} \u00dcber", "de") for k, w in enumerate(rare[3000:])] + [(1, None, "en"), (2, "kein", None), (3, " 1 ", "fr")]
    counts = Counter()
    for _, text, lang in rows:
        for word in langid.letters(text) if lang else []:
            counts.update((lang, o, g) for o in (0, *langid.ORDERS) for g in (langid.grams(word, o) if o else [word]))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for vocabulary in (100_000, 700):  # all of them; cut among words that come equally often
        taken, kept = Counter(), []
        for (lang, order, gram), n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
            taken[lang, order] += 1
            if taken[lang, order] <= vocabulary:
                kept.append((lang, order, gram, n))
        expected, found = langid.Backoff(kept), langid.fit(frame, vocabulary=vocabulary)
        assert found.langs == expected.langs == ["de", "en"] and np.array_equal(found.keys, expected.keys)
        assert np.array_equal(found.logs, expected.logs)
    assert len(kept) < len(counts)


def test_chat_edges(spark):
    rows = [
        (1, 0, "u", "a"), (1, 1, "v", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "v", "b"), (3, 1, "v", "b"),
        (4, None, None, None), (None, 0, "u", "z"), (5, 0, "u", ""), (6, 0, "u", None),
    ]
    found = chat.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.n_copies) for r in found) == [
        ("1", 2, 2), ("4", 1, 1), ("5", 1, 1), ("6", 1, 1), ("None", 1, 1)]


def test_long_conversation_in_blocks(spark):
    rows = [(1, i, "u", f"t{i}") for i in range(1500)] + [(2, i, "u", f"t{i}") for i in range(1400)]
    found = chat.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found.select("conv_id").distinct().collect()[0][0] == 1 and found.count() == math.ceil(1500 / chat.PIECE_TURNS)


def test_repeated_passages_go(odd):
    out = {(r.doc_id, r.n_removed > 0): r.text for r in sentence_spans.deduplicated(odd).collect()}
    assert out[7, False] == PASSAGE and (4, True) in out and (5, False) in out
    assert "Nobody had touched" not in out[8, True] and out[8, True].startswith("Before") and out[8, True].endswith("after it")
    assert len(out[9, True]) < 40


def test_spans_against_all_runs(spark, texts):
    """Every run of every text in a dictionary; repeated rows, runs of a third of the rows and of two rows."""
    hot = "Every third text holds this line. It is long enough to be a run of its own here. Nothing else in it is of any use at all."
    rows = [(i, f"{t}\n{hot}" if i % 3 == 0 else t) for i, t in enumerate(list(texts.values())[:300])]
    pairs = [" ".join(f"w{(k * 31 + j * 17) % 9973}x{k}" for j in range(40)) for k in range(1200)]
    rows += [(1000 + k, f"{a} first. {p}") for k, p in enumerate(pairs) for a in ("one", "another")]
    rows += [(5, rows[5][1]), (None, hot), (None, None), (7000, ""), (7001, "\n \n")]
    keys = {r: ((r[0] is not None, r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()) for r in rows}
    held = {}
    for r in set(rows):
        _, sizes, hashes = sentence_spans.sentences((r[1] or "").encode())
        for run, first, last in zip(*(x.tolist() for x in sentence_spans.runs(sizes, hashes)), strict=True):
            held.setdefault(run, []).append((keys[r], first, last, r))
    spans = {}
    for found in held.values():
        for _, first, last, r in sorted(found, key=lambda x: x[:3])[1:]:
            spans.setdefault(r, []).append((first, last))
    expected = []
    for r in rows:
        raw, n, k = sentence_spans.without((r[1] or "").encode(), spans.get(r, []))
        expected.append((r[0], raw.decode() if k else r[1], n, k))
    got = sentence_spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert sum(k > 0 for *_, k in expected) > 1200


def test_context_mixing_base_and_bits(docs, texts, odd):
    train = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*(t or "").encode().lower().split(), b""])
    total, kinds = sum(train.values()), len(train)
    for r in LLM_QUERIES["op6_context_mixing"](docs.sparkSession, FOLDER).collect():
        found = [*texts[r.doc_id].encode().lower().split(), b""]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in found)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(found), sum(w in train for w in found), total)
        assert math.isclose(base, r.base_score, rel_tol=1e-9) and r.score < 0
    assert context_mixing.scores(odd, F.lit(True)).count() == odd.count()


def test_context_mixing_shares_events_of_prefixes():
    tokens = sorted({w.encode() for w in PASSAGE.lower().split()} | {b"", b"a", b"ab", b"abc", "äb".encode(), LONG.replace(" ", "").encode()})
    counts = np.arange(1, len(tokens) + 1)
    batch = pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(counts, pa.int64())], names=["token", "c"])
    table = np.zeros(2 * context_mixing.SLOTS)
    for _, share, slots in context_mixing._chunks(iter([batch])):
        for slot in slots:
            np.add.at(table, slot, share)
    apart = np.zeros_like(table)
    for token, c in zip(tokens, counts, strict=True):
        *_, slots = context_mixing.bit_events([token])
        # of a token alone each prefix is an event of its own
        assert all(len(slot) == 8 * (len(token) + 1) for slot in slots)
        for slot in slots:
            np.add.at(apart, slot, float(c))
    assert np.array_equal(table, apart)
    tables = context_mixing.predictions(table.astype(np.float32).reshape(-1, 2), 0)
    weights = context_mixing.first_weights(len(context_mixing.BITS) + 1)
    refined = np.tile(context_mixing.squash(np.linspace(-8, 8, context_mixing.BINS)), (context_mixing.GATES, 1))
    together = context_mixing.code_lengths(tokens, tables, weights, refined)
    single = [context_mixing.code_lengths([t], tables, weights, refined)[0] for t in tokens]
    assert np.allclose(together, single, rtol=1e-6)
    one_byte = context_mixing.code_lengths([bytes([b]) for b in range(256) if b != context_mixing.STOP], tables, weights, refined)
    assert (10**one_byte).sum() < 1


def test_fertility_base(docs, texts, odd):
    for r in fertility.judged(fertility.features(docs)).collect():
        found = texts[r.doc_id].encode().split()
        runs = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
        often = Counter(runs)
        hit = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(3)}
        lines = [x for x in texts[r.doc_id].encode().split(b"\n") if x.split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(found), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(found) < 50 or 100 * len(hit) > 50 * len(found)) and not (r.base_failed and r.kept)
    assert fertility.judged(fertility.features(odd)).count() == odd.count()


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_join_against_all_pairs(spark, texts, size, percent):
    words = PASSAGE.split()
    rows = [(i, t) for i, t in list(texts.items())[:60]]
    for k in range(40):  # near copies around the threshold
        own = list(words)
        for at in range(k % 5):
            own[(7 * k + 13 * at) % len(own)] = f"w{k}"
        rows.append((1000 + k, " ".join(own)))
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_edges(odd):
    found = Counter((r.doc_id, r.component_id) for r in jaccard_join.linked(odd).collect())
    assert found[1, 1] == found[2, 2] == found[4, 4] == 1 and found[5, 5] == 2 and found[None, 5] == 1
    assert found[9, 7] == found[7, 7] == 1 and found[None, None] == 1


def test_leaks_against_all_passages(spark, docs, texts, odd):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    truth = {(i, r.item_id) for i, t in texts.items() for r in items.collect() if r.text in t}
    found = {(r.doc_id, r.item_id) for r in latent_leaks.leaks(docs, items).collect()}
    assert len(truth & found) >= 0.9 * len(truth) and len(found) <= len(truth) + 1
    near = spark.createDataFrame([(1, PASSAGE.replace("Nobody", "Somebody").replace("fog", "mist")), (2, ""), (3, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in latent_leaks.leaks(odd, near, block=1).collect()} == {(7, 1), (8, 1), (9, 1)}


def excerpts(texts, n, sizes):
    """n excerpts of documents with the given numbers of words in turn, each with the document it stands in."""
    long = [(i, words) for i, t in sorted(texts.items()) if len(words := t.split()) >= max(sizes) + 50]
    out = []
    for k in range(n):
        i, words = long[k % len(long)]
        at = (k * 7919) % (len(words) - sizes[k % len(sizes)])
        out.append((k, i, " ".join(words[at : at + sizes[k % len(sizes)]])))
    return out


@pytest.mark.parametrize("n", [1000, 2048])
def test_leaks_of_many_items(spark, docs, texts, n):
    items = excerpts(texts, n, range(15, 60))
    found = latent_leaks.leaks(docs, spark.createDataFrame([(k, t) for k, _, t in items], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    assert sum((i, k) in found for k, i, _ in items) >= 0.9 * n


@pytest.mark.parametrize("size", [3, 5, 300, 1000])
def test_leaks_of_short_and_long_items(spark, docs, texts, size):
    words = (" ".join(t for t in texts.values())).split()
    pasted = [(k, " ".join(words[k * 997 : k * 997 + size])) for k in range(20)]
    odd_ones = [(k, " ".join([f"a{k}b{i}" for i in range(37)] + [t] + [f"c{k}d{i}" for i in range(40)])) for k, t in pasted]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in odd_ones], "doc_id long, text string"))
    found = latent_leaks.leaks(all_docs, spark.createDataFrame(pasted, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in found.where("doc_id >= 1000000").collect()}
    assert sum((10**6 + k, k) in found for k, _ in pasted) >= 18


def test_leaks_basis_is_fitted_on_all_passages(spark):
    """Against dense matrices over every passage of more documents than the earlier sample of 2,000 held."""
    rows = [(" ".join(f"v{(i * 31 + j * j) % 211}" for j in range(i % 70)),) for i in range(6000)] + [("",), (None,), (" ,. ",)]
    frame = spark.createDataFrame(rows, "text string")
    frequency, n_docs = latent_leaks.document_frequencies(frame)
    idf = np.log((n_docs + 1) / (frequency + 1)).astype(np.float32)
    passages = [p for t, in rows for h in latent_leaks.words_in([t]) for p in latent_leaks._passages(h)]
    row, slot, value = latent_leaks._rows(passages, idf, np.ones(len(passages)))
    words, at = np.unique(slot, return_inverse=True)
    used = words[::2]
    dense = np.zeros((len(passages), len(words)))
    dense[row, at] = value
    sketch = latent_leaks._sketched(np.arange(len(words)), words, np.ones(len(words)), 32)
    y = dense @ sketch
    gram, cross = latent_leaks.document_products(frame, used, idf, 32)
    assert len(rows) == n_docs and len(passages) > 10_000
    assert np.allclose(gram, y.T @ y, rtol=1e-3, atol=1e-2) and np.allclose(cross, dense[:, ::2].T @ y, rtol=1e-3, atol=1e-2)


def test_distinct_words_hash_as_before():
    values = np.array([5, 3, 5, 1, 3], np.uint64)
    assert common.distinct(values).tolist() == [1, 3, 5] and len(common.distinct(values[:0])) == 0


def test_packing_is_a_round_trip(docs, texts, odd):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack_documents(docs).collect()
    pieces, places = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts.items():
        ids = [*exact.encode(text, add_special_tokens=False).ids, packing.END_ID]
        for k, r in sorted(pieces[i].items()):
            part = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
            assert zlib.crc32(part) == r.ids_crc32
        assert sum(r.length for r in pieces[i].values()) == len(ids)
    for spots in places.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:])) and sum(spots[-1]) <= 1024
    assert len(places) <= math.ceil(sum(r.length for r in found) / 1024) * 1.02 + 1
    assert packing.pack_documents(odd).where("piece = 0").count() == odd.count()


def test_pipeline_stages(spark, docs, odd):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, rows, FOLDER), name)
        assert kept.columns == docs.columns and kept.count() <= rows.count()
        rows = kept
    assert jaccard_join.linked(rows).select("root").distinct().count() == rows.count()
    assert latent_leaks.leaks(rows, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, FOLDER).collect() if r.text == "short text here"} <= {5, None}
    assert corpus_pipeline.near_duplicates(spark, odd, FOLDER).where("text = 'short text here'").count() == 1
