"""Importance resampling towards a target distribution.

Hashed word and word-pair counts of all documents and of the target give every bucket a gain; a document's weight is the
floored mean gain of its features, gathered from one array. Gumbel noise makes the highest scores a sample without
replacement. Where the draw ends is found by a quantile sketch: its bracket is checked by exact counts of the rows outside
it, widened if they say so, and only the rows inside are sorted.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import offsets, parts, stored
from .hashing import LOWER, slices, text_bytes

BUCKETS = 10_000
SKETCH = 10_000       # accuracy of the quantile sketch
LONG = 64             # bytes from which a word's crc32 is taken by itself instead of column by column
INK = np.zeros(256, bool)
INK[48:58] = INK[97:123] = INK[128:] = True     # digits, a-z and all bytes of other characters
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, np.uint32(0xEDB88320) ^ (CRC >> np.uint32(1)), CRC >> np.uint32(1))
FLIP = np.uint32(0xFFFFFFFF)


def _carried(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, by_size: np.ndarray) -> np.ndarray:
    """Registers of the checksum after each word's bytes; ``by_size`` orders words from long to short."""
    start, size, s = start[by_size], size[by_size], state[by_size]
    long = int(np.searchsorted(-size, -LONG, "right"))
    for w in range(long):
        s[w] = np.uint32(zlib.crc32(data[start[w]:start[w] + size[w]], int(s[w] ^ FLIP))) ^ FLIP
    live = np.searchsorted(-size, -np.arange(LONG), "left")       # words with more than so many bytes
    for i in range(LONG):
        if live[i] <= long:
            break
        part = s[long:live[i]]
        s[long:live[i]] = CRC[(part ^ data[start[long:live[i]] + i]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(s)
    out[by_size] = s
    return out


def features(data: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and of all pairs of neighbouring words of texts laid end to end; for each word its text, for
    each pair the index of its first word."""
    data = LOWER[data]
    ink = INK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    begin = np.flatnonzero(begin)
    size = np.flatnonzero(last) + 1 - begin
    text = np.searchsorted(starts, begin, "right") - 1
    order = np.argsort(-size, kind="stable")
    state = _carried(np.full(len(begin), FLIP), data, begin, size, order)
    space = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
    pair = np.flatnonzero(text[1:] == text[:-1])
    led = np.full(len(begin), FLIP)
    led[pair + 1] = space[pair]
    both = _carried(led, data, begin, size, order)[pair + 1]
    return np.concatenate([state ^ FLIP, both ^ FLIP]).astype(np.int64) % buckets, text, pair


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; every task sends one row a bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, starts = text_bytes(batch.column(0))
            for a, b in slices(starts):
                got, _, _ = features(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], buckets)
                total += np.bincount(got, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():       # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share to the corpus's share, for each bucket."""
    k, s, t = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``n_words``, ``n_features`` and ``weight``, the floored mean gain of its features
    (0 without any). Columns with these names are replaced."""
    new = ["n_words", "n_features", "weight"]
    others = [c for c in docs.columns if c not in (text_col, *new)]
    frame = docs.select(*others, F.col(text_col).cast("string"))
    schema = docs.select(*others).schema
    for c in new:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(len(others)))
            n = len(starts) - 1
            words, total, number = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, b in slices(starts):
                got, text, pair = features(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], len(gain))
                owner = np.concatenate([text, text[pair]])
                words[a:b] = np.bincount(text, minlength=b - a)
                number[a:b] = np.bincount(owner, minlength=b - a)
                np.add.at(total[a:b], owner, gain[got])
            weight = total // np.maximum(number, 1)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(others))] + [pa.array(x) for x in (words, number, weight)],
                                             names=schema.names)

    return frame.mapInArrow(run, schema)


def noise(id_col: str, seed: int = 7) -> Column:
    """Thousandths of Gumbel noise from the id alone; a null id counts as the text ``null``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of each row, from 1, in ``order``, which leaves no ties.

    Ranges of the order are dealt to tasks by Spark's own sample of bounds, sorted there and written; a row's number is its
    place in the range plus the totals of the ranges before."""
    ranged = df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumns({"_range": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = offsets(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), "_range", "_n")
    return ranged.join(before.select("_range", "before"), "_range").withColumn(
        name, (F.col("before") + F.col("_place") + 1).cast("long")).drop("_range", "_place", "before")


def cutoff(rows: DataFrame, score: str, ties: list[str], k: int, n: int, margin: float = 2.0 / SKETCH) -> dict | None:
    """Score and ties of the ``k``-th of ``n`` rows by falling score, then rising ties; ``None`` if none is to be drawn.

    The sketch proposes a bracket of scores about the cutoff. It holds if fewer than ``k`` rows lie above it and at least ``k``
    rows do not lie below it, which two exact counts tell; otherwise its margin doubles, up to all rows. The rows of a valid
    bracket are sorted, and the one in place counts."""
    if k <= 0:
        return None
    at = 1.0 - k / n
    while True:
        ends = [max(0.0, at - margin), min(1.0, at + margin)]
        low, high = rows.agg(F.percentile_approx(score, ends, SKETCH).alias("q")).first()["q"]
        if margin >= 1:
            low, high = rows.agg(F.min(score), F.max(score)).first()
        above, inside = rows.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score).between(low, high))).first()
        if above < k <= above + inside:
            break
        margin *= 2
    order = [F.desc(score), *(F.asc_nulls_last(c) for c in ties)]
    bracket = positions(rows.filter(F.col(score).between(low, high)).select(score, *ties), order, "_position")
    return bracket.filter(F.col("_position") == k - above).first().asDict()


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, id_col: str = "doc_id",
              text_col: str = "text", seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs`` with its text replaced by ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the rows with at least ``least_words`` words, ``floor(percent * rows / 100)`` with the highest scores are drawn and
    ranked from 1, ties to the smaller id (null ids last); the rank of others is null. Rows that share an id are rows of their
    own, ordered by weight, then as they were first written. Null and empty texts have no features and weight 0. An
    empty target, or one without words, is a target without counts; an empty table gives no rows. Other columns stay;
    columns called like the new ones are replaced."""
    docs = docs.drop("n_words", "n_features", "weight", "score", "rank")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    rows = weighted(docs, gain, text_col).withColumn("score", F.col("weight") + noise(id_col, seed))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    able = rows.filter(F.col("n_words") >= least_words)
    n = able.count()
    ties = [id_col, "weight", "_row"]
    last = cutoff(able, "score", ties, percent * n // 100, n)
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("_row")
    drawn = F.col("score") > F.lit(last["score"])
    same = F.col("score") == F.lit(last["score"])
    for c in ties:
        end = F.lit(last[c])
        drawn |= same & (F.col(c).isNotNull() if last[c] is None else F.coalesce(F.col(c) < end, F.lit(False)))
        same &= F.col(c).eqNullSafe(end)
    drawn = (F.col("n_words") >= least_words) & (drawn | same)
    ranked = positions(rows.filter(drawn), [F.desc("score"), *(F.asc_nulls_last(c) for c in ties)], "rank")
    rest = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_row")
