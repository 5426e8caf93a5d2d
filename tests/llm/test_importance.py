"""Importance resampling against a plain count, and the cutoff against a plain sort."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(rows, target, percent=25, least=20):
    made = [(i, *grams(t)) for i, t in rows]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in grams(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, n, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], math.inf if x[0] is None else x[0], x[3]))
    drawn = able[:percent * len(able) // 100]
    rest = out.copy()
    for x in drawn:
        rest.remove(x)
    return [(*x, r) for r, x in enumerate(drawn, 1)] + [(*x, None) for x in rest]


def texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgé日Z9") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["x" * 200, "y" * 70]
    made = [rng.choice([" ", "-", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(160)]
    return made + [None, "", "...", "word" * 30_000, "İ K ß ＡＢＣ a\x00b"], vocabulary


def key(rows):
    return sorted(rows, key=lambda x: tuple((v is None, v or 0) for v in x))


def test_against_a_plain_count(spark, documents):
    made, vocabulary = texts()
    rows = list(enumerate(made)) + [(3, made[3]), (3, made[4]), (None, made[5]), (None, None)] + [(200 + i, made[0] + " a" * 30) for i in range(100)]
    docs = documents(rows, more=["old"]).withColumnRenamed("x0", "rank")
    target = [" ".join(vocabulary[:20]), None, "", made[9]]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((25, 20), (100, 0), (0, 20)):
        got = importance.resampled(docs, df, percent, least)
        assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "n_features", "weight", "score", "rank"]
        got = [tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
        assert key(got) == key(plain(rows, target, percent, least))


def test_empty_tables(spark, documents):
    docs, none = documents(["a b c", None]), spark.createDataFrame([], "text string")
    assert importance.resampled(docs.limit(0), none).count() == 0
    got = importance.resampled(docs, none, 100, 0).collect()
    assert sorted(r["rank"] for r in got) == [1, 2]


@pytest.mark.parametrize("scores", [lambda i: i % 7, lambda i: 0, lambda i: -i * i, lambda i: 10 ** 12 if i % 3 else i])
def test_cutoff(spark, scores):
    rows = [(scores(i), i * 37 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "score long, id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k, margin in ((1, 1e-9), (250, 1e-6), (999, 2e-4), (1000, 1e-6)):
        got = importance.cutoff(df, "score", ["id"], k, 1000, margin)
        assert (got["score"], got["id"]) == order[k - 1]
    assert importance.cutoff(df, "score", ["id"], 0, 1000) is None


def test_positions_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as s")
    got = importance.positions(df, [df.s.desc(), df.id.asc()], "p").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 3), i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["p"])] == want and sorted(r["p"] for r in got) == list(range(1, 5001))


def test_checksums_of_words_and_pairs():
    from ledgerlens.llm.hashing import text_bytes
    import pyarrow as pa
    made, _ = texts()
    got, text, pair = importance.features(*text_bytes(pa.array(made)))
    for i, t in enumerate(made):
        assert Counter(got[np.concatenate([text, text[pair]]) == i].tolist()) == Counter(grams(t)[1])
