"""Whitening against the eigenvectors of the covariance matrix."""
import math

import numpy as np
import pytest

from ledgerlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "old")
                                  for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def check(rows, vectors, most=16):
    """All columns against numpy, for vectors with an id each and no bad ones."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = int((np.sqrt(np.maximum(value, 0)) > 1e-7 * math.sqrt(value[0])).sum())
    k = min(k, most)
    want = (n * x - s) / n @ vector[:, :k] / np.sqrt(value[:k])
    got = np.full((len(x), k), np.nan)
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert abs(r["explained"] / (value[r["component"] - 1] / value.sum()) - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9
    assert len(rows) == len(x) * k
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 24)) * np.geomspace(3, 0.2, 24)
    vectors[100:250] = vectors[7]
    rows = whitening.whitened(frame(spark, vectors.tolist())).collect()
    assert list(rows[0].asDict()) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, vectors)


def test_far_from_the_origin_and_few_components(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 6)) * 2 + 30_000
    check(whitening.whitened(frame(spark, vectors.tolist()), 3).collect(), vectors, 3)


def test_columns_that_depend_on_others(spark):
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(size=(200, 5)) * 64) / 64
    vectors = np.column_stack([vectors, vectors[:, 0], np.full(200, 0.5), vectors[:, 1] + vectors[:, 2]])
    check(whitening.whitened(frame(spark, vectors.tolist())).collect(), vectors)


def test_fewer_vectors_than_entries(spark):
    vectors = np.random.default_rng(7).normal(size=(5, 12))
    check(whitening.whitened(frame(spark, vectors.tolist())).collect(), vectors)


def test_rows_without_a_result(spark):
    good = np.random.default_rng(8).normal(size=(30, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [math.nan] * 3, [math.inf, 0, 0]]
    ids = [*range(30), 50, 51, 52, 53, 54, None, 3]
    rows = whitening.whitened(frame(spark, [*good, *bad, good[0], good[1]], ids)).collect()
    assert len(rows) == 32 * 3
    assert {r["vec_id"] for r in rows} == {*range(30), None}
    first = {}
    for r in rows:
        if r["vec_id"] is not None and r["vec_id"] != 3:
            first[r["vec_id"], r["component"]] = r
    assert len(first) == 29 * 3
    assert sorted(r["whitened"] for r in rows if r["vec_id"] is None) == sorted(r["whitened"] for r in rows if r["vec_id"] == 0)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [None]])
def test_nothing_to_fit(spark, vectors):
    assert whitening.whitened(frame(spark, vectors)).count() == 0


def test_lengths_are_fitted_apart_and_large_entries_stay_exact(spark):
    rng = np.random.default_rng(9)
    two, three = rng.normal(size=(20, 2)), rng.normal(size=(20, 3))
    rows = whitening.whitened(frame(spark, two.tolist() + three.tolist())).collect()
    check([r for r in rows if r["vec_id"] < 20], two)
    check([type("R", (), {"__getitem__": lambda s, k, r=r: r["vec_id"] - 20 if k == "vec_id" else r[k]})() for r in rows if r["vec_id"] >= 20], three)
    far = whitening.whitened(frame(spark, [[1e38, 0.0], [-1e38, 1.0], [5.0, 2.0]])).collect()
    assert [r["deviation"] for r in sorted(far, key=lambda r: r["vec_id"])] == [None, None, *(r["deviation"] for r in far if r["vec_id"] == 2)]
    assert len(far) == 3        # the second direction has no share that doubles can tell
    near = [[2.0 ** 40, 1.0], [2.0 ** 40 + 2.0 ** 20, 3.0], [2.0 ** 40, 5.0]]
    x = [[int(64 * c) + 1_000_000 for c in v] for v in near]
    want = [sum((3 * x[i][j] - sum(r[j] for r in x)) ** 2 for j in range(2)) for i in range(3)]
    assert [next(r["deviation"] for r in whitening.whitened(frame(spark, near)).collect() if r["vec_id"] == i) for i in range(3)] == want
