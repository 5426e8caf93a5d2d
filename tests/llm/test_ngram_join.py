"""The similarity join against a brute-force version."""
import random
import re

import numpy as np
import pytest

from ledgerlens.llm import ngram_join as N


def brute(rows, percent=75):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(x for x in (least.get(root(i)), doc) if x is not None) if doc is not None else least.get(root(i))
    return sorted(((d, len(s), least[root(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \t\n", "one", "One", "two words", "TWO  words\n", "a b c d", "É é", "x " * 3000]
    for n in (6, 40, 150, 400):        # groups of near copies, small and large, with a passage that all have
        seed = [word() for _ in range(n)]
        for _ in range(25):
            copy = list(seed)
            for _ in range(max(1, n // 60)):
                copy[rng.randrange(n)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(rng.randint(30, 90))] + passage) for _ in range(40)]
    texts += texts[12:16] + ["one"]
    rng.shuffle(texts)
    return [*enumerate(texts), (None, "one"), (3, "an id that comes twice with another text")]


def test_components_match_brute_force(spark, documents):
    rows = corpus()
    got = N.near_duplicates(documents(rows, more=("kept out",)).withColumnRenamed("x0", "node")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_long_lists_find_links_that_hubs_miss(spark, documents, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 1)        # all lists are long: only hub links come first
    rows = corpus()
    assert sorted(map(tuple, N.near_duplicates(documents(rows)).collect()), key=str) == brute(rows)


def brute_sets(rows):
    return [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) and d is not None
            else frozenset() for d, t in rows]


@pytest.mark.parametrize("block", [1024, 7])
def test_all_links_of_a_large_group(spark, documents, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = [(d, t) for d, t in corpus() if "É" not in (t or "")]
    sets = brute_sets(rows)
    link = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    got = N.link_counts(documents(rows)).collect()
    want = [(d, len(s) if d is not None else None, sum(link(s, t) for t in sets) - bool(s)) for (d, _), s in zip(rows, sets)]
    assert sorted(((r.doc_id, r.n_shingles if r.doc_id is not None else None, r.n_links) for r in got), key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)

    pairs, members = N.linked_pairs(documents(rows))
    pairs = [tuple(r) for r in pairs.collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    docs = {}
    for r in members.collect():
        docs.setdefault(r.node, set()).add(r.doc_id)
    named = lambda a, b: frozenset((frozenset(a), frozenset(b)))
    holders = {}
    for (d, _), s in zip(rows, sets):
        if s:
            holders.setdefault(s, set()).add(d)
    assert sorted(map(sorted, holders.values())) == sorted(map(sorted, docs.values()))
    different = list(holders)
    assert {named(docs[a], docs[b]) for a, b in pairs} == {named(holders[x], holders[y]) for i, x in enumerate(different) for y in different[:i] if link(x, y)}
    assert len(pairs) > 300


def test_empty_table(spark, documents):
    assert N.near_duplicates(documents([(1, "a")]).limit(0)).count() == 0


def test_signatures_meet_for_similar_sets():
    rng = np.random.default_rng(2)
    for often in (0.0, 0.5, 1.0):
        classes = (rng.random(N.SLOTS) < often).astype(np.uint8) * 3
        for _ in range(300):
            n = int(rng.integers(2, 500))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.unique(np.concatenate([a[:int(n * rng.uniform(0.75, 1))], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.2)), dtype=np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                assert len(np.intersect1d(N.signatures(a, classes, 75), N.signatures(b, classes, 75)))
                assert N.may_link(N.bit_map(a), len(a), N.bit_map(b), len(b), 75)
                (s, x, x2), (t, y, y2) = N.coarse_maps(N.bit_map(a)), N.coarse_maps(N.bit_map(b))
                x, y = (x if s <= t else x2), (y if t <= s else y2)
                only = np.bitwise_count(x & ~y).sum() // (N.COARSE // min(s, t))
                assert len(a) - only >= common


def test_almost_similar_texts_hand_over_no_pairs(spark, documents, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 1)
    made = []
    keep = N.cross_forest
    monkeypatch.setattr(N, "cross_forest", lambda *a: made.append(N.stored(keep(*a))) or made[-1])
    rng = random.Random(6)
    seed = [f"s{i}" for i in range(200)]
    texts = []
    for i in range(60):       # any two differ in 15 to 20 % of their shingles or more, so bit maps can hardly tell
        copy = list(seed)
        for k in rng.sample(range(0, 200, 5), 5):
            copy[k] = f"x{i}y{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = N.near_duplicates(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    sets = brute_sets(rows)
    apart = sum(50 <= 100 * len(x & y) / len(x | y) < 75 for i, x in enumerate(sets) for y in sets[:i])
    assert apart > 10 * len(rows)
    assert 0 < made[0].count() < len(rows)
