"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from opsight.llm import whitening as w
from opsight.llm.queries import LLM_QUERIES

SCHEMA = "vec_id long, embedding array<double>, part string, component string, id int"


def frame(spark, vectors, parts=5):
    rows = [(i, v, "x", "y", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def numbers(vectors):
    return np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000


def checked(found, x, ids, components=32):
    """Every column of the result against numpy over whole numbers x."""
    n, d = x.shape
    centred = (n * x - x.sum(0)) / n
    levels, basis = np.linalg.eigh(centred.T @ centred / n)
    levels, basis = levels[::-1], basis[:, ::-1]
    k = min(components, int((levels > 1e-12 * levels.sum()).sum()))
    expected = centred @ basis[:, :k] / np.sqrt(levels[:k])
    rows = {(r.vec_id, r.component): r for r in found.collect()}
    assert set(rows) == {(i, c) for i in ids for c in range(1, k + 1)}
    got = np.array([[rows[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert np.allclose(got * np.sign((got * expected).sum(0)), expected, atol=1e-7)
    for row, i in enumerate(ids):
        assert rows[i, 1].n == n
        assert rows[i, 1].deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[row], x.sum(0)))
    share = [rows[ids[0], c].explained for c in range(1, k + 1)]
    assert np.allclose(share, levels[:k] / levels.sum(), rtol=1e-9)
    assert rows[ids[0], 1].identity_error < 1e-9


@pytest.mark.parametrize("kind", ["random", "repeated", "clustered"])
def test_rank_one_chain_equals_dense(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 17)) * 50
    if kind == "repeated":
        x = x[rng.integers(0, 4, 120)]
    if kind == "clustered":
        x = np.round(x / 100)
    levels, vectors = np.zeros(17), np.eye(17)
    for row in x:
        levels, vectors = w.rank_one(levels, vectors, row)
    assert np.allclose(vectors * levels @ vectors.T, x.T @ x, atol=1e-10 * np.abs(x.T @ x).max())
    assert np.allclose(vectors.T @ vectors, np.eye(17), atol=1e-12)
    assert np.allclose(levels, np.linalg.eigvalsh(x.T @ x), atol=1e-10 * np.abs(x.T @ x).max())


def test_merge_of_spectra():
    rng = np.random.default_rng(4)
    x = rng.integers(-900, 900, (700, 9)) + 1_000_000
    x[:300] += 500  # means differ
    parts = [w.Spectrum(9) for _ in range(3)]
    for part, rows in zip(parts, (x[:300], x[300:310], x[310:])):
        part.add(rows)
    parts[1].merge(parts[0])
    parts[1].merge(parts[2])
    centred = x - x.mean(0)
    assert parts[1].n == 700 and list(parts[1].sums) == list(x.sum(0))
    assert np.allclose(parts[1].vectors * parts[1].levels @ parts[1].vectors.T, centred.T @ centred, rtol=1e-9, atol=1e-3)


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(400, 40)) * np.linspace(0.1, 2, 40)).tolist()
    checked(w.whitened(frame(spark, vectors, 40)), numbers(vectors), list(range(400)))


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = rng.normal(size=(30, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0], [1.0] * 4]
    checked(w.whitened(frame(spark, good + bad)), numbers(good), list(range(30)))


def test_hot_vector_and_ties(spark):
    vectors = [[1.0, 2.0, 3.0]] * 200 + np.random.default_rng(7).normal(size=(300, 3)).tolist()
    checked(w.whitened(frame(spark, vectors)), numbers(vectors), list(range(500)))
    axes = [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]]  # equal eigenvalues: any basis
    rows = w.whitened(frame(spark, axes)).collect()
    assert len(rows) == 8 and max(r.identity_error for r in rows) < 1e-9


def test_without_variance(spark):
    assert w.whitened(frame(spark, [])).count() == 0
    assert w.whitened(frame(spark, [None, []])).count() == 0
    assert w.whitened(frame(spark, [[1.0, 2.0]])).count() == 0
    assert w.whitened(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    flat = [[float(i), 7.0] for i in range(6)]  # one constant dimension
    checked(w.whitened(frame(spark, flat)), numbers(flat), list(range(6)))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [0.0]), (None, [1.0]), (3, [2.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    rows = w.whitened(df).collect()
    assert sorted(str(r.vec_id) for r in rows) == ["3", "3", "None", "None"]


def test_numbers_beyond_64_bits(spark):
    big = [[2.0**40, 1.0], [-(2.0**40), 3.0], [5.0, 2.0**39]] * 10
    rows = w.whitened(frame(spark, big)).collect()
    assert len(rows) == 60 and all(r.deviation is None for r in rows) and rows[0].n == 30
    assert max(r.identity_error for r in rows) < 1e-6


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    checked(LLM_QUERIES["op13_whitening"](spark, folder), numbers([r.embedding for r in rows]), [r.vec_id for r in rows])
