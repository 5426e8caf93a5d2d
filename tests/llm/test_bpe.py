"""Encoding against the library, decoding as an exact round trip."""
import hashlib
import random
import time
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerlens.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def texts():
    rng = random.Random(3)
    out = [None, "", "a" * 900, "ab" * 700, "the" * 300 + "!" * 999, " " * 50, "\x1c\x1d a\x85b c", "日本語テキスト" * 30, "don't we'll I'VE",
           "１２３ ²½ Ⅷ", "\t\t\n a", "🙂👩‍👩‍👧 hi", "<|endoftext|> x", "\r\n \r\n"]
    out += ["".join(rng.choice("ab \n\t1!é 日thein") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    out += ["".join(chr(rng.randint(1, 0x2FFF)) for _ in range(80)) for _ in range(30)]
    out += ["".join(rng.choice("abcdeinthgrs") for _ in range(2000))]
    return out


def test_ids_and_bytes(spark, documents, monkeypatch):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    want = []
    for i, t in enumerate(texts()):
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    docs = documents(texts()).withColumn("n_tokens", F.lit("old"))
    got = bpe.encoded(docs, PATH, PATTERN)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want
    assert bpe.encoded(docs.limit(0), PATH, PATTERN).count() == 0


def encoder_of(ranks):
    return bpe.Encoder(([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])], zlib.compress(bpe.merge_table(ranks).tobytes())))


def test_windows_cover_a_word():
    for step in (96, 192):
        for n in (1, 2, 47, 48, 49, 96, 143, 144, 145, 240, 241, 1000):
            got = bpe.windows(n, step)
            assert got[0][0] == 0 and got[-1][1] == n
            assert all(b - c == step // 2 for (_, b), (c, _) in zip(got, got[1:]))


def test_long_words_are_the_librarys():
    """Random letters, other scripts, runs whose tokens are in step with the windows or not, tokens longer than an overlap."""
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, rng = encoder_of(ranks), random.Random(5)
    longest = max((t for t in ranks if t.decode("utf-8", "ignore").encode() == t), key=len).decode()
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (143, 144, 145, 146, 241, 3000)]
    words += ["".join(rng.choice("日本語がきくけこ한국어éüß") for _ in range(900)), "".join(rng.choice("=-*_#.~") for _ in range(3000))]
    words += [u * (2000 // len(u) + k) for u in ("a", "ab", "abc", "lol", "abcde", "hahahah", "=", "-=", "—", "─", "Ã", "ÃÂ", longest) for k in (0, 1)]
    encoder.learn(words)
    for w in words:
        assert encoder.ids[w] == " ".join(map(str, library._core_bpe.encode_single_piece(w.encode()))), w[:40]
        assert encoder.plain[w] == w.encode()


def test_a_word_of_many_bytes_takes_time_in_proportion():
    ranks = bpe.load_ranks(PATH)
    encoder, rng = encoder_of(ranks), random.Random(6)
    took = []
    for n in (30_000, 300_000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        t = time.time()
        encoder.learn([word])
        took.append(time.time() - t)
        assert encoder.plain[word] == word.encode()
    assert took[1] < 30 * took[0]


def test_order_is_spelt_out_when_rows_come_otherwise():
    ranks = bpe.load_ranks(PATH)
    encoder = encoder_of(ranks)
    words = [w.encode() for w in ("hello", " there", "straße", "xyzzyplugh")]
    assert list(encoder._encode(words)) == list(encoder._encode(words, bpe._LEFTMOST.replace("{window}", "ORDER BY w, p")))
    encoder.db.execute("CREATE TABLE _start2 AS SELECT * FROM (VALUES (0, 1, 5), (0, 0, 6)) v(w, p, id)")
    with pytest.raises(encoder.out_of_order):
        encoder.db.sql(bpe._LEFTMOST.replace("_start", "_start2").format(steps=5, window="")).fetchall()
