"""The model against a brute-force Katz model."""
import collections
import math
import re

import numpy as np
import pytest

from ledgerlens.llm import katz


def brute(rows, order):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]

    texts = [words(t) for _, t, _ in rows]
    train = [t for t, (_, _, held) in zip(texts, rows) if not held]
    total = sum(map(len, train))
    counts = [None] + [collections.Counter() for _ in range(order)]
    for t in train:
        p = ["<s>", *t]
        for i in range(1, len(p)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    counts[n][tuple(p[i - n + 1:i + 1])] += 1
    d = [None] + [katz.discounts(np.array([sum(v == r for v in counts[n].values()) for r in range(1, 7)])) for n in range(1, order + 1)]
    share = lambda n, c: d[n][c] * c if c <= katz.SMALL else c
    left = total - sum(share(1, c) for c in counts[1].values())
    spare = left < 1e-9
    followers = collections.defaultdict(list)
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            followers[g[:-1]].append((g[-1], c))
    known = {}

    def weight(h):
        if h not in known:
            n, all_ = len(h) + 1, sum(c for _, c in followers[h])
            taken = sum(c - share(n, c) for _, c in followers[h])
            bottom = all_ + (taken <= 1e-9)
            mass = (taken if taken > 1e-9 else 1) / bottom
            known[h] = bottom, mass / (1 - sum(prob(h[1:] + (w,)) for w, _ in followers[h]))
        return known[h]

    def prob(g):
        n = len(g)
        if n == 1:
            return share(1, counts[1][g]) / (total + spare) if counts[1][g] else (left + spare) / (total + spare)
        if g[:-1] not in followers:
            return prob(g[1:])
        bottom, back = weight(g[:-1])
        return share(n, counts[n][g]) / bottom if counts[n][g] else back * prob(g[1:])

    out = []
    for (doc, _, held), t in zip(rows, texts):
        p = ["<s>", *t]
        base = sum(math.log10((counts[1][(w,)] + 0.1) / (total + 0.1 * (len(counts[1]) + 1))) for w in t)
        score = sum(math.log10(prob(tuple(p[max(0, i - order + 1):i + 1]))) for i in range(1, len(p)))
        out.append((doc, held, len(t), sum((w,) in counts[1] for w in t), total, base, score))
    return out, prob, counts


ROWS = [(i, f"the A{i % 7} b{i * i % 5}\tThe c{i % 3} x{i} the a{i % 7}" * (1 + i % 3) if i % 11 else (None if i % 2 else " "), i % 10 == 0)
        for i in range(150)] + [(3, "twice " * 300, False), (3, "twice " * 300, False), (9, "never seen before", True)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 2000)
    want, _, _ = brute(ROWS, order)
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, held_out boolean, chunk string")
    got = sorted(map(tuple, katz.scores(docs, order).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in sorted(want)], rtol=1e-12, atol=1e-9)


def test_probabilities_add_up():
    _, prob, counts = brute(ROWS, 3)
    for h in [("the",), ("<s>",), ("the", "a1"), ("twice", "twice")]:
        assert abs(sum(prob((*h, w)) for (w,) in counts[1]) + prob((*h, "unseen")) - 1) < 1e-9


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", True), (None, None, True)], "doc_id long, text string, held_out boolean")
    got = katz.scores(docs).collect()
    assert len(got) == 2 and all(r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert katz.scores(docs.limit(0)).count() == 0


def test_discounts():
    n = np.array([100, 40, 20, 12, 8, 5])
    d = katz.discounts(n)
    assert d[0] == 1 and np.all((d[1:] > 0) & (d[1:] < 1))
    # Katz's condition: what is taken from the small counts is the number of singletons
    assert abs(((1 - d[1:]) * np.arange(1, 6) * n[:5]).sum() - n[0]) < 1e-9
    assert katz.discounts(np.zeros(6)).tolist()[1] == 0.5
