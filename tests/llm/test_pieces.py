"""Encoding and decoding against the library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerlens.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "     ", "\n", " a", "a ", "▁", "▁▁ ▁a▁", "a▁b c", "<s> </s> <unk> <0x41>", "日本語 テキスト", "\x00\x01 \x7f", "🙂👩‍👩‍👧 hi",
           "  a b　c", "é é", "word " * 500, "the" * 900, "ab" * 700, " " * 99 + "x" + " " * 40, "�"]
    out += ["".join(rng.choice("ab  \n\t1!é 日thein▁") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(30)]
    return out


def test_ids_and_texts(spark, documents):
    docs = documents([(7, t) for t in texts()] + [(None, "a null id")], more=["old"]).withColumnRenamed("x0", "ids")
    ids = pieces.encoded(docs, PATH)
    assert ids.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    want = [LIBRARY.encode(t or "") for t in [*texts(), "a null id"]]
    assert sorted(r["ids"] for r in ids.collect()) == sorted(want)
    back = pieces.decoded(ids, PATH)
    assert back.columns == ["doc_id", "lang", "source", "n_chars", "text"]
    assert sorted(r["text"] for r in back.collect()) == sorted(LIBRARY.decode(w) for w in want)
    assert pieces.encoded(docs.limit(0), PATH).count() == 0
    assert pieces.decoded(ids.limit(0), PATH).count() == 0


def test_any_ids_decode_as_the_library_does(spark):
    rng = random.Random(2)
    lists = [[rng.choice([rng.randint(0, 400), rng.randint(0, 31999), rng.randint(1, 2), 28705]) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, ids array<int>")
    assert [r["text"] for r in pieces.decoded(df, PATH).orderBy("id").collect()] == [LIBRARY.decode(x) for x in lists]
    odd = spark.createDataFrame([(0, None), (1, [None, 350]), (2, [-5, 99_999, 350])], "id long, ids array<int>")
    assert [r["text"] for r in pieces.decoded(odd, PATH).orderBy("id").collect()] == ["", LIBRARY.decode([350]), LIBRARY.decode([350])]


def test_long_chunks_and_both_ways_of_segmenting():
    rng = random.Random(1)
    table = pieces.Table(pieces.Model(PATH))
    long = "".join(rng.choice("abcdeinthgrs") for _ in range(300_000))
    assert table.encode([long.encode()])[0].tolist() == LIBRARY.encode(long)
    for _ in range(200):
        chunk = [ord(rng.choice("▁thein日🙂")) for _ in range(rng.randint(2, 40))]
        symbols = table.of_char[chunk]
        (_, got), = pieces.lockstep(symbols[None, :], table.merges)
        assert got[0].tolist() == pieces.queued(symbols.tolist(), table.merges).tolist()


def test_the_table_may_start_afresh(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_BYTES", 1000)
    table = pieces.Table(pieces.Model(PATH))
    for t in texts() * 2:
        ids, ends = table.encode([(t or "").encode()])
        assert ids.tolist() == LIBRARY.encode(t or "") and ends.tolist() == [0, len(ids)]


def test_other_models_are_refused(tmp_path):
    data = open(PATH, "rb").read()
    other = tmp_path / "m.model"
    other.write_bytes(data + bytes([0x12, 2, 0x18, 1]))      # a later trainer field: another kind of model
    with pytest.raises(ValueError):
        pieces.Model(str(other))


def test_query(spark):
    from ledgerlens.llm import queries
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = LIBRARY.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    got = queries.op11_sentencepiece_chunks(spark, folder)
    assert dict(got.dtypes)["n_tokens"] == "bigint"
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()} == want


def test_merge_table_finds_all_and_nothing_else():
    model = pieces.Model(PATH)
    keys, values = model.pairs()
    merges = pieces.Merges(keys, values)
    assert (merges(keys >> 23, keys & ((1 << 23) - 1)) == values).all()
    assert (merges(np.array([pieces.OTHER + 5, 0]), np.array([3, 0])) == pieces.NONE).all()
