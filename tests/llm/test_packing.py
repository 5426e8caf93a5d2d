import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, hashing, packing
from ledgerlens.llm.queries import tokenizer_files


def test_pieces_and_places(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 128)
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|> and 日本語", "word " * 1023, "word " * 1024, "x y " * 5000]
    texts += [" ".join(rng.choice(("alpha", "beta", "gämma", "42")) for _ in range(rng.randint(1, 600))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no id"), (5, "the id of another")]
    got = packing.packed(documents(rows), *tokenizer_files()).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_files()[0])
    pieces = defaultdict(list)
    for r in got[got.doc_id.notna()].itertuples():
        pieces[int(r.doc_id)].append(r)
    for doc, text in rows[:len(texts)]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        if doc == 5:
            continue
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 1024
    sizes = got.length.to_numpy()
    plain = packing.fill(sizes, np.full(len(sizes), -1), np.argsort(-sizes), 1024).max() + 1     # best-fit decreasing over all
    assert got.sequence_id.nunique() <= plain + 4       # some is lost where small cells meet


def test_empty_table(spark, documents):
    assert packing.packed(documents([(1, "a")]).limit(0), *tokenizer_files()).count() == 0


def test_far_texts_are_found_in_little_memory():
    rng = random.Random(2)
    texts = ["", "é" * 9, "日", "", "ɿ", "ʀ", "x" * 3_000_000, *("".join(rng.choice("aé語") for _ in range(rng.randint(0, 3))) for _ in range(500)), "", "y" * 8_000_000, ""]
    data, starts = hashing.text_bytes(pa.array(texts))
    tracemalloc.start()
    far = packing.far_texts(data, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert far.tolist() == [any(ord(c) > 0x27F for c in t) for t in texts]
    assert peak < 2 * len(data)


def test_both_libraries_give_the_same_ids_up_to_u027f():
    path, ranks, pattern = tokenizer_files()
    exact = Tokenizer.from_file(path)
    quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    rng = random.Random(5)
    texts = [c * k + d for c in "abeoé -=*._1#" for k in (2, 3, 5, 8, 13, 33) for d in ("", "a", "e", " ")]
    texts += ["".join(chr(rng.randint(1, 0x27F)) for _ in range(rng.randint(2, 30))) for _ in range(4000)]
    texts += [a + chr(c) + b + chr(c) + chr(c) for c in range(1, 0x280) for a in "a \n" for b in " a1"]
    assert [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)] == [quick.encode_ordinary(t) for t in texts]


def test_genetic_steps_keep_packings_whole():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1024, 700)
    population = packing.start(sizes, 1024, rng)
    for _ in range(30):
        child = packing.mutated(sizes, packing.crossed(sizes, population[0], population[1], 1024, rng), 1024, rng)
        assert (child >= 0).all() and np.bincount(child, sizes).max() <= 1024
    best = packing.evolve(sizes, population, 1024, rng)[0]
    assert packing.fitness(sizes, best, 1024) >= max(packing.fitness(sizes, p, 1024) for p in population)
