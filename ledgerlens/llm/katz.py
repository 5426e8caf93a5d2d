"""Katz backoff language model: Good-Turing discounts and exactly normalised backoff weights.

Texts are hashed to words once and stored in chunks of bounded size, each with its own small vocabulary. For every order
the chunks send their distinct n-grams with training counts and the probability of the next lower order to buckets by
history; a bucket adds the counts up, and answers every chunk with the totals and with what a history's backoff weight
needs: its count, how many followers it has with each small count, and their lower-order mass. The answers are stored
as tables partitioned by bucket. Counts of counts come along with them, so the discounts are known before a weight is
formed. A chunk then evaluates its tokens recursively: a seen n-gram has its discounted share, any other the history's
weight times the probability of the next lower order.

A history that would fill more than a fraction of a bucket is dealt to several by its followers; its figures are sums,
and there are at most a few such histories per bucket, so they go through the driver.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import parts, release, stored
from .blobs import freeze, pieces, thaw
from .hashing import Powers, mix, slices, text_bytes, word_hashes

CHUNK = 12_000_000           # bytes of text in a chunk; one longer text is a chunk of its own
SMALL = 5                    # counts up to this are discounted
SHARE = 4                    # a history gets at most this fraction of a bucket's mean load
END = np.uint64(1)           # the token that ends a text
START = np.uint64(2)         # key of the history before a text
NONE = np.uint32(0xFFFFFFFF)  # no word: unseen in training, or before the text


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Factors for the counts 0 to ``SMALL`` (entry 0 is unused) from the numbers of n-grams seen 1, 2, ... times.

    The largest range of counts for which Good-Turing gives factors in (0, 1) is discounted; if there is none, a half
    is taken from each small count instead."""
    n = np.concatenate([[0], counts_of_counts]).astype(float)
    for k in range(SMALL, 0, -1):
        if np.all(n[1:k + 2] > 0):
            r = np.arange(1, k + 1)
            last = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[2:k + 2] / (r * n[1:k + 1]) - last) / (1 - last) if last < 1 else np.zeros(k)
            if np.all((d > 0) & (d < 1)):
                return np.concatenate([[1], d, np.ones(SMALL - k)])
    return np.concatenate([[1], 1 - 0.5 / np.arange(1, SMALL + 1)])


# ---- chunks ---------------------------------------------------------------------------------------------------------

def chunked(docs: DataFrame) -> DataFrame:
    """``(chunk, blob)`` from ``docs (doc_id, text, held_out)``: the word numbers of many texts and their vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, number, held, size = Powers(), TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            ids, none, out, counts, words = (np.concatenate(x) for x in zip(*held, strict=True))
            vocabulary, tokens, often = np.unique(words, return_inverse=True, return_counts=True)
            rank = np.argsort(-often, kind="stable")          # small numbers for frequent words
            vocabulary, tokens = vocabulary[rank], np.argsort(rank)[tokens]
            blob = freeze(doc_id=ids, no_id=none, held=out, length=counts.astype(np.uint32), vocabulary=vocabulary, tokens=tokens.astype(np.uint32))
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            ids, none = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            out = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            for a, b in slices(starts):
                if size and size + starts[b] - starts[a] > CHUNK:
                    yield flush()
                words, per_text = word_hashes(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], powers)
                words = np.insert(np.maximum(words, END + np.uint64(1)), np.cumsum(per_text), END)
                held.append((ids[a:b], none[a:b], out[a:b], per_text + 1, words))
                size += int(starts[b] - starts[a])
        if held:
            yield flush()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "chunk long, blob binary")


class Chunk:
    """The texts of a chunk with the answers to its questions so far."""

    def __init__(self, blob: bytes, answers: list[tuple[int, int, bytes]], buckets: int, facts: dict, order: int):
        self.__dict__.update(thaw(blob))
        self.buckets, self.facts = buckets, facts
        self.held = self.held.astype(bool)
        self.train = np.repeat(~self.held, self.length)
        self.first = np.concatenate([[0], np.cumsum(self.length[:-1], dtype=np.int64)])
        by_level: dict[int, dict[int, dict]] = {}
        for level, bucket, answer in answers:
            by_level.setdefault(level, {})[bucket] = thaw(answer)
        if by_level:
            self._words(by_level[1])
            self.grams, self.gram_key = self.tokens.astype(np.int64), self.word_id.astype(np.uint64)
            self.gram_seen, self.lower = self.word_id != NONE, self.word_p[self.tokens]
            for level in range(2, order + 1):
                self._level(level)
                if level in by_level:
                    self._answered(level, by_level[level])

    def word_buckets(self) -> tuple[np.ndarray, np.ndarray]:
        bucket = ((mix(self.vocabulary) >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        return np.argsort(bucket, kind="stable"), bucket

    def word_questions(self) -> Iterator[tuple[int, bytes]]:
        counts = np.bincount(self.tokens[self.train], minlength=len(self.vocabulary))
        order, bucket = self.word_buckets()
        for b, part in pieces(order, bucket):
            yield b, freeze(word=self.vocabulary[part], n=counts[part].astype(np.uint32))

    def _words(self, answers: dict[int, dict]) -> None:
        order, bucket = self.word_buckets()
        self.word_id, self.word_n = np.empty(len(order), np.uint32), np.empty(len(order), np.int64)
        for b, part in pieces(order, bucket):
            self.word_id[part], self.word_n[part] = answers[b]["id"], answers[b]["n"]
        f, n = self.facts[1], self.word_n
        self.word_p = np.where(n > 0, discounted(n, f["d"]) / f["tokens"], f["unseen"])

    def _level(self, level: int) -> None:
        """The distinct n-grams of this order: their history, last word and key, and where the texts have them."""
        # histories are the n-grams of the order before, one place to the left; at the start of a text there is none,
        # which for pairs is a history of its own
        width = int(self.grams.max(initial=-1)) + 1
        before = np.empty(len(self.grams), np.int64)
        before[1:] = self.grams[:-1]
        before[self.first] = width
        vocabulary = len(self.vocabulary)
        pair, self.grams = np.unique(before * vocabulary + self.tokens, return_inverse=True)
        self.pair_history, word = pair // vocabulary, pair % vocabulary
        keys = np.append(mix(self.gram_key + np.uint64(level << 40)), START)
        seen = np.append(self.gram_seen, level == 2)
        self.history_key, self.history_seen = keys, seen
        self.history_n = np.append(self.word_n, self.facts[1]["texts"]) if level == 2 else None
        self.pair_word = self.word_id[word]
        self.asked = seen[self.pair_history] & (self.pair_word != NONE)
        self.pair_lower = np.zeros(len(pair))
        self.pair_lower[self.grams] = self.lower
        if level == 2:      # few words differ in probability
            self.codes, code = np.unique(self.word_p, return_inverse=True)
            self.pair_code = code[word]
        else:
            self.codes, self.pair_code = np.unique(self.pair_lower, return_inverse=True)
        self.gram_key = mix(keys[self.pair_history] + self.pair_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _questions(self, level: int) -> tuple[np.ndarray, ...]:
        """Entries ``(history, word, position of the n-gram or -1)`` and their buckets; a history without a known
        follower here has an entry of its own, as its weight is needed all the same."""
        at = np.flatnonzero(self.asked)
        used = np.zeros(len(self.history_key), bool)
        used[self.pair_history] = True
        lonely = used & self.history_seen
        lonely[self.pair_history[at]] = False
        lonely = np.flatnonzero(lonely)
        history = np.concatenate([self.pair_history[at], lonely])
        word = np.concatenate([self.pair_word[at], np.full(len(lonely), NONE)])
        position = np.concatenate([at, np.full(len(lonely), -1)])
        salt = word.astype(np.uint64) % self.salts(level)[history]
        key = mix(self.history_key[history] + salt * np.uint64(0xD6E8FEB86659FD93))
        return history, word, position, ((key >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def salts(self, level: int) -> np.ndarray:
        if level > 2:       # a longer history is at most as frequent as its last word, and dealt by that word's rule
            return np.ones(len(self.history_key), np.uint64)
        return (1 + self.history_n // self.facts[1]["load"]).astype(np.uint64)

    def questions(self, level: int) -> Iterator[tuple[int, bytes]]:
        history, word, position, bucket = self._questions(level)
        counts = np.bincount(self.grams[self.train], minlength=len(self.pair_word))
        for b, part in pieces(np.argsort(bucket, kind="stable"), bucket):
            h, w, p = history[part], word[part], position[part]
            run = np.append(True, h[1:] != h[:-1])
            code, values = coded(np.where(p >= 0, self.pair_code[p], 0), self.codes)
            yield b, freeze(history=self.history_key[h[run]], run=np.diff(np.append(np.flatnonzero(run), len(h))).astype(np.uint32), word=w,
                            n=np.where(p >= 0, counts[p], 0).astype(np.uint32), code=code, lower=values)

    def _answered(self, level: int, answers: dict[int, dict]) -> None:
        """Probabilities of this order for every token, from the totals."""
        history, word, position, bucket = self._questions(level)
        n = np.zeros(len(self.pair_word), np.int64)
        total, mass = np.zeros(len(self.history_key)), np.zeros(len(self.history_key))
        small = np.zeros((SMALL, len(self.history_key)))
        for b, part in pieces(np.argsort(bucket, kind="stable"), bucket):
            got, h, p = answers[b], history[part], position[part]
            n[p[p >= 0]] = got["n"][p >= 0]
            h = h[np.append(True, h[1:] != h[:-1])]
            total[h], mass[h] = got["total"], got["mass"]
            small[:, h] = got["small"].reshape(SMALL, -1)
        facts = self.facts[level]
        if len(facts["hot_key"]):
            at = np.searchsorted(facts["hot_key"], self.history_key)
            at[at == len(facts["hot_key"])] = 0
            hot = np.flatnonzero(facts["hot_key"][at] == self.history_key)
            total[hot], mass[hot], small[:, hot] = facts["hot_total"][at[hot]], facts["hot_mass"][at[hot]], facts["hot_small"][:, at[hot]]
        d = facts["d"]
        taken = ((1 - d[1:]) * np.arange(1, SMALL + 1)) @ small       # counts taken from the seen followers
        bottom = total + (taken <= 1e-9)                              # nothing taken: one more count, left to the unseen
        left = np.where(taken <= 1e-9, 1, taken) / np.maximum(bottom, 1)
        weight = np.where(total > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
        h = self.pair_history
        p = np.where(n > 0, discounted(n, d) / np.maximum(bottom[h], 1), weight[h] * self.pair_lower)
        self.gram_seen = (n > 0) & self.asked
        self.lower = p[self.grams]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first) if len(self.first) else np.zeros(0)


def discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(n <= SMALL, d[np.minimum(n, SMALL)], 1.0) * n


def coded(code: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``code`` renumbered to the values it uses, and those."""
    used = np.zeros(len(values), bool)
    used[code] = True
    return (np.cumsum(used) - 1)[code].astype(np.uint32), values[used]


def over_chunks(frame: DataFrame, answers: DataFrame | None, work: Callable, schema: str, buckets: int, facts: dict,
                order: int) -> DataFrame:
    """Apply ``work(Chunk) -> record batches`` to every chunk, met by its answers; a task holds one chunk at a time."""
    if answers is None:
        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from work(number, Chunk(blob, [], buckets, facts, order))
        return frame.mapInArrow(alone, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, blob, got = None, None, []
        for batch in batches:
            for chunk, level, bucket, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if level == 0:
                    if blob is not None:
                        yield from work(number, Chunk(blob, got, buckets, facts, order))
                    number, blob, got = chunk, b, []
                else:
                    got.append((level, bucket, b))
        if blob is not None:
            yield from work(number, Chunk(blob, got, buckets, facts, order))

    both = frame.select("chunk", F.lit(0).alias("level"), F.lit(0).alias("bucket"), "blob").unionByName(answers)
    both = both.repartition(parts(frame.sparkSession), "chunk").sortWithinPartitions("chunk", "level", "bucket")
    return both.mapInArrow(run, schema)


# ---- buckets --------------------------------------------------------------------------------------------------------

_ANSWER = "chunk long, level int, bucket int, blob binary"


def answer_words(questions: DataFrame, buckets: int) -> DataFrame:
    """Totals and numbers of words for every chunk; rows of chunk -1 hold a bucket's figures."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        asked = [thaw(b) for b in table.column("blob").to_pylist()]
        words, at = np.unique(np.concatenate([a["word"] for a in asked]), return_inverse=True)
        total = np.bincount(at, np.concatenate([a["n"] for a in asked]), len(words)).astype(np.int64)
        number = np.empty(len(words), np.uint32)
        number[np.argsort(-total, kind="stable")] = np.arange(len(words), dtype=np.uint32) * np.uint32(buckets) + np.uint32(bucket)
        number[total == 0] = NONE
        rows, a = [(-1, freeze(tokens=np.array([total.sum()]), known=np.array([(total > 0).sum()]),
                               often=np.bincount(total[total <= SMALL + 1], minlength=SMALL + 2)[1:],
                               texts=total[words == END]))], 0
        for chunk, one in zip(table.column("chunk").to_pylist(), asked, strict=True):
            part = at[a:a + len(one["word"])]
            a += len(part)
            rows.append((chunk, freeze(id=number[part], n=total[part])))
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "level": pa.array([1] * len(rows), pa.int32()),
                         "bucket": pa.array([bucket] * len(rows), pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    return questions.groupBy("bucket").applyInArrow(run, _ANSWER)


def answer_grams(questions: DataFrame, level: int, hot: np.ndarray) -> DataFrame:
    """Totals of n-grams and figures of histories for every chunk; rows of chunk -1 hold a bucket's figures."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        asked = [thaw(b) for b in table.column("blob").to_pylist()]
        sizes = [len(a["word"]) for a in asked]
        history = np.concatenate([np.repeat(a["history"], a["run"]) for a in asked])
        word, n = (np.concatenate([a[c] for a in asked]) for c in ("word", "n"))
        lower = np.concatenate([a["lower"][a["code"]] for a in asked])
        order = np.lexsort((word, history))
        h, w = history[order], word[order]
        new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order].astype(np.int64), first)
        per_entry = np.empty(len(order), np.int64)
        per_entry[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        h, lower = h[first], lower[order][first]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        keys = h[start]
        sums = np.add.reduceat(total, start)
        mass = np.add.reduceat(np.where(total > 0, lower, 0.0), start)
        small = np.stack([np.add.reduceat((total == r).astype(np.int64), start) for r in range(1, SMALL + 1)])
        heavy = np.isin(keys, hot)
        rows, a = [(-1, freeze(often=np.bincount(total[total <= SMALL + 1], minlength=SMALL + 2)[1:], key=keys[heavy], total=sums[heavy],
                               mass=mass[heavy], small=small[:, heavy].ravel()))], 0
        for chunk, one, size in zip(table.column("chunk").to_pylist(), asked, sizes, strict=True):
            k = np.searchsorted(keys, one["history"])
            rows.append((chunk, freeze(n=per_entry[a:a + size].astype(np.uint32), total=sums[k].astype(np.uint32), mass=mass[k],
                                       small=small[:, k].astype(np.uint32).ravel())))
            a += size
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "level": pa.array([level] * len(rows), pa.int32()),
                         "bucket": pa.array([bucket] * len(rows), pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    return questions.groupBy("bucket").applyInArrow(run, _ANSWER)


# ---- the model ------------------------------------------------------------------------------------------------------

def scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for ``docs (doc_id, text, held_out)``.

    Every text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and followed by one end token; a null text
    is the end alone. Counts come from the texts that are not held out. ``score`` is the log10 probability under the
    model of the given order, ``base_score`` that of add-0.1 smoothed single tokens. Words never seen in training share
    one probability. Repeated rows are scored each on its own; an empty table gives none, and without training texts
    ``score`` is that of an unseen word for each token.
    """
    spark = docs.sparkSession
    buckets = parts(spark)
    chunks = stored(chunked(docs))
    facts: dict = {}

    def ask_words(number: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        for b, blob in chunk.word_questions():
            yield question(number, b, blob)

    asked = over_chunks(chunks, None, ask_words, "chunk long, bucket int, blob binary", buckets, facts, 1)
    answers = stored(answer_words(asked, buckets))
    told = [thaw(r["blob"]) for r in answers.filter("chunk = -1").select("blob").collect()]     # one row per bucket
    tokens, known = (sum(int(t[c][0]) for t in told) for c in ("tokens", "known"))
    often = np.sum([t["often"] for t in told] or [np.zeros(SMALL + 1)], axis=0)
    d = discounts(often)
    seen = tokens - float(((1 - d[1:]) * np.arange(1, SMALL + 1)) @ often[:SMALL])              # what discounting leaves
    spare = float(tokens == seen)                                                               # as for histories
    facts[1] = {"d": d, "tokens": max(tokens + spare, 1), "unseen": max(tokens - seen + spare, 1e-9 * (tokens == 0)) / max(tokens + spare, 1),
                "texts": sum(int(t["texts"].sum()) for t in told), "load": max(1, tokens // (SHARE * buckets))}
    if not tokens:
        facts[1]["unseen"] = 1.0
    tables = answers.filter("chunk >= 0")
    del asked
    release(spark)

    for level in range(2, order + 1):
        hot = _hot_keys(chunks, tables, buckets, facts, level)

        def ask_grams(number: int, chunk: Chunk, level: int = level) -> Iterator[pa.RecordBatch]:
            for b, blob in chunk.questions(level):
                yield question(number, b, blob)

        asked = over_chunks(chunks, tables, ask_grams, "chunk long, bucket int, blob binary", buckets, dict(facts), level)
        answers = stored(answer_grams(asked, level, hot))
        told = [thaw(r["blob"]) for r in answers.filter("chunk = -1").select("blob").collect()]  # counts, and at most SHARE heavy histories a bucket
        keys, at = np.unique(np.concatenate([t["key"] for t in told] or [np.empty(0, np.uint64)]), return_inverse=True)

        def add(name: str, told: list = told, keys: np.ndarray = keys, at: np.ndarray = at) -> np.ndarray:
            return np.bincount(at, np.concatenate([t[name] for t in told]), len(keys)) if len(keys) else np.zeros(0)

        small = [t["small"].reshape(SMALL, -1) for t in told]
        facts[level] = {"d": discounts(np.sum([t["often"] for t in told] or [np.zeros(SMALL + 1)], axis=0)), "hot_key": keys,
                        "hot_total": add("total"), "hot_mass": add("mass"),
                        "hot_small": np.stack([np.bincount(at, np.concatenate([s[r] for s in small]), len(keys)) for r in range(SMALL)])
                        if len(keys) else np.zeros((SMALL, 0))}
        tables = tables.unionByName(answers.filter("chunk >= 0"))
        del asked
        release(spark)

    def finish(number: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        n = chunk.word_n[chunk.tokens]
        base = np.log10((n + 0.1) / (tokens + 0.1 * (known + 1)))
        ids = chunk.doc_id
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=chunk.no_id.astype(bool)), pa.array(chunk.held), pa.array(chunk.length.astype(np.int64)), pa.array(chunk.sums((n > 0).astype(np.int64))),
             pa.array(np.full(len(ids), tokens)), pa.array(chunk.sums(base)), pa.array(chunk.sums(np.log10(chunk.lower)))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return over_chunks(chunks, tables, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                       "base_score double, score double", buckets, facts, order)


def question(number: int, bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())],
                                      ["chunk", "bucket", "blob"])


def _hot_keys(chunks: DataFrame, tables: DataFrame, buckets: int, facts: dict, level: int) -> np.ndarray:
    """Keys of the histories that are dealt to several buckets: at most ``SHARE`` times the number of buckets."""
    if level > 2:
        return np.empty(0, np.uint64)
    load = facts[1]["load"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                got = thaw(blob)
                yield pa.RecordBatch.from_arrays([pa.array(got["id"][got["n"] >= load].astype(np.int64))], ["id"])

    ids = tables.select("blob").mapInArrow(run, "id long").distinct().toPandas()["id"].to_numpy().astype(np.uint64)
    keys = mix(ids + np.uint64(2 << 40))
    if facts[1]["texts"] >= load:
        keys = np.append(keys, START)
    return np.sort(keys)
