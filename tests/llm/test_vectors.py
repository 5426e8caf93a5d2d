"""Vector searches against brute force."""
import math

import numpy as np
import pytest

from ledgerlens.llm import maxscore, vptree
from ledgerlens.llm.queries import VP_FACTOR

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors, queries, k, score):
    out = []
    for q in queries:
        got = sorted(((-score(vectors[q], v), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    vectors = {i: [float(x) for x in v] for i, v in enumerate(rng.normal(size=(900, 8)).astype(np.float32))}
    for i in range(300, 420):           # a large group of copies, and a zero vector
        vectors[i] = vectors[50]
    vectors[777] = [0.0] * 8
    rows = [(i, v, 0) for i, v in vectors.items()] + [(50, vectors[50], 1)]
    odd = [(1000, None, 0), (1050, [1.0] * 7 + [None], 0), (1100, [math.nan] * 8, 0), (1150, [math.inf] + [0.0] * 7, 0), (None, vectors[3], 0), (1200, [], 0)]
    return vectors, spark.createDataFrame(rows + odd, SCHEMA)


def test_maxscore_is_exact(spark, table):
    vectors, df = table
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    want = exact(whole, [i for i in whole if i % 50 == 0], 5, lambda a, b: sum(x * y for x, y in zip(a, b)))
    for rows in (100, 8192):
        got = maxscore.top_scores(df, df.filter("vec_id % 50 = 0"), 5, rows_per_shard=rows).collect()
        assert sorted(map(tuple, got)) == want


def test_maxscore_prunes():
    rng = np.random.default_rng(1)
    weights = np.floor(256 * rng.normal(size=(4000, 16)) * np.geomspace(1, 0.01, 16))
    index = maxscore.Postings(np.arange(4000), weights)
    for own, (at, score) in zip(range(8), index.best(weights[:8], np.arange(8), 5)):
        full = weights @ weights[own]
        full[own] = -np.inf
        order = np.lexsort((np.arange(4000), -full))[:5]
        assert (at == order).all() and (score == full[order]).all()


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))


def test_factor_one_is_exact(spark, table):
    vectors, df = table
    vectors = {i: v for i, v in vectors.items() if any(v)}
    want = exact(vectors, [i for i in vectors if i % 50 == 0], 5, cosine)
    got = sorted(map(tuple, vptree.neighbours(df, df.filter("vec_id % 50 = 0"), 5, 1.0, rows_per_shard=200, leaf=16).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_production_factor(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = df.toPandas()
    ids, v = rows.vec_id.to_numpy(), np.stack(list(rows.embedding)).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    hit = n = 0
    got = vptree.neighbours(df, df.filter("vec_id % 50 = 0"), 5, VP_FACTOR).toPandas()
    for q, part in got.groupby("query_id"):
        c = v @ v[ids == q][0]
        c[ids == q] = -2
        best = ids[np.argsort(-c)[:5]]
        hit, n = hit + len(set(best) & set(part.vec_id)), n + 5
    assert hit >= 0.9 * n


def test_no_rows(spark, table):
    _, df = table
    assert maxscore.top_scores(df.limit(0), df.filter("vec_id = 0"), 5).count() == 0
    assert vptree.neighbours(df, df.limit(0), 5, 1.0).count() == 0
    two = df.filter("vec_id in (0, 1)")
    assert [tuple(r)[:3] for r in vptree.neighbours(two, two.filter("vec_id = 0"), 5, 1.0).collect()] == [(0, 1, 1)]
