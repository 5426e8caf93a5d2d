"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from the bytes of whole texts, many texts at once. The trees are grown level by level on
binned statistics of a bounded sample of labelled documents and kept as flat arrays, so a batch walks down all of them
with a few numpy steps. The sample is drawn by a hash of the id and small by its bound, so it is sent to the documents
rather than the texts to it.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import Powers, mix, prefix_hashes, slices, text_bytes, word_hashes

LABELLED = 20_000     # at most so many labelled documents are learnt from

# byte classes whose share of the text is a statistic
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\t\r", b".,;:'\"-()", b"!?",
            b"*$%&#@^~+=<>\\/_", b"|[]{}"]
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)     # the last class: all other bytes
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _i
STATISTICS = ["bytes", "words", *[f"share_{n}" for n in ("upper", "lower", "digit", "blank", "line", "stop", "shout", "symbol", "bar", "other")],
              "upper_accent", "word_length", "distinct_words", "top_word", "stutter", "lines", "line_length", "repeated_lines",
              "bare_lines", "marked_words", "pair_distinct", "longest_run"]


def statistics(column: pa.Array, powers: Powers) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; a null or empty text gives zeros."""
    data, starts = text_bytes(column)
    out = np.zeros((len(starts) - 1, len(STATISTICS)))
    for a, b in slices(starts):
        part, s = data[starts[a]:starts[b]], starts[a:b + 1] - starts[a]
        if len(part):
            out[a:b] = _statistics(part, s, powers)
    return out


def _statistics(data: np.ndarray, starts: np.ndarray, powers: Powers) -> np.ndarray:
    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[starts])

    size = np.diff(starts)
    some = np.maximum(size, 1)
    kind = _CLASS_OF[data]
    columns = [np.log1p(size), None] + [per_text(kind == c) / some for c in range(len(_CLASSES) + 1)]
    accent = np.zeros(len(data), bool)                 # two-byte capitals of Latin-1
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    columns.append(per_text(accent) / some)

    hashes, n = word_hashes(data, starts, powers)
    columns[1] = np.log1p(n)
    many = np.maximum(n, 1)
    columns.append(per_text((kind != 3) & (kind != 4)) / many)
    distinct, top, stutter, pairs, run = (np.zeros(len(n)) for _ in range(5))
    first = np.concatenate([[0], np.cumsum(n)])
    for i in np.flatnonzero(n):
        w = hashes[first[i]:first[i + 1]]
        order = np.sort(w)
        cuts = np.flatnonzero(order[1:] != order[:-1]) + 1
        counts = np.diff(np.concatenate([[0], cuts, [len(w)]]))
        distinct[i], top[i] = len(counts) / len(w), counts.max() / len(w)
        if len(w) > 1:
            same = w[1:] == w[:-1]
            stutter[i] = same.mean()
            p = np.sort(w[1:] * np.uint64(3) + w[:-1])
            pairs[i] = (1 + (p[1:] != p[:-1]).sum()) / len(p)
            stops = np.flatnonzero(~np.concatenate([[False], same, [False]]))
            run[i] = np.log1p(np.diff(stops).max() - 1)
    columns += [distinct, top, stutter]

    # lines: pieces between line feeds and ends of texts
    ends = np.zeros(len(data) + 1, bool)
    ends[np.flatnonzero(data == 10) + 1] = True
    ends[starts] = True
    at = np.flatnonzero(ends)
    p = prefix_hashes(data, powers)
    line = mix((p[at[1:]] - p[at[:-1]]) * powers.down[at[:-1]])
    text = np.searchsorted(starts, at[:-1], "right") - 1
    length = np.diff(at)
    lines = np.bincount(text, minlength=len(size))
    order = np.lexsort((line, text))
    again = np.zeros(len(line), bool)
    again[order[1:]] = (line[order][1:] == line[order][:-1]) & (text[order][1:] == text[order][:-1])
    columns += [np.log1p(lines), np.log1p(size / np.maximum(lines, 1)),
                np.bincount(text, np.where(again, length, 0), minlength=len(size)) / some]
    last = data[np.maximum(at[1:] - 2, at[:-1])]
    columns.append(np.bincount(text, _CLASS_OF[last] != 5, minlength=len(size)) / np.maximum(lines, 1))
    mark = np.zeros(len(data), bool)                   # a mark right before a blank
    mark[:-1] = np.isin(kind[:-1], (6, 7, 8)) & ((kind[1:] == 3) | (kind[1:] == 4))
    columns += [per_text(mark) / many, pairs, run]
    return np.stack(columns, axis=1)


@dataclass
class Forest:
    """Trees of one depth, flattened: node ``i`` has children ``2 i + 1`` and ``2 i + 2``; leaves are the last level."""
    prior: float
    depth: int
    feature: np.ndarray      # trees x inner nodes
    cut: np.ndarray          # trees x inner nodes: go right where the statistic is above it
    leaf: np.ndarray         # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            margin += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0,
         least: float = 5.0) -> Forest:
    """Boost logistic loss. Without rows, or with one label only, the smoothed share of the label is the score."""
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        margin = np.full(len(y), prior)
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(depth):
                base, width = 2 ** level - 1, 2 ** level
                local = at - base
                best = np.full(width, 1e-6)
                for f, e in enumerate(edges):
                    key = local * bins + binned[:, f]
                    gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                    hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                    gain[(hs < least / 4) | (ht - hs < least / 4)] = -1
                    gain = gain[:, :len(e)]
                    if not gain.shape[1]:
                        continue
                    b = gain.argmax(axis=1)
                    got = gain[np.arange(width), b]
                    for n in np.flatnonzero(got > best):
                        best[n], feature[t, base + n], cut[t, base + n] = got[n], f, e[b[n]]
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[t, at]] > cut[t, at])
            at -= inner
            leaf[t] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
            margin += leaf[t, at]
    return Forest(prior, depth, feature, cut, leaf)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Forest:
    """Learn ``quality`` from at most ``most`` labelled documents that are not held out, chosen by a hash of their id.

    Labels that are null or belong to no document are left out; of several labels of one document the smallest counts.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_label"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30))
    share = min(1.0, 1.1 * most / max(1, known.count()))
    chosen = known.filter(draw < int(share * (1 << 30))).orderBy(draw, "doc_id").limit(most)
    # at most ``most`` pairs of two numbers, so they may go to every executor
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            x = statistics(batch.column(0), powers)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([flat, batch.column(1)], ["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").toPandas()
    x = np.stack(list(got["x"])) if len(got) else np.zeros((0, len(STATISTICS)))
    order = np.lexsort(x.T) if len(x) else np.arange(0)        # the model must not depend on the order of arrival
    return grow(x[order], got["y"].to_numpy(float)[order])


def scored(docs: DataFrame, model: Forest, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``: how likely the text is good, 0 to 1. Null and empty texts get one too."""
    at = docs.columns.index(text_col)
    schema = docs.drop(score_col).schema.add(score_col, "double")
    kept = [i for i, c in enumerate(docs.columns) if c != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            score = model.score(statistics(batch.column(at), powers))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(score)],
                                             [*(batch.schema.names[i] for i in kept), score_col])

    return docs.mapInArrow(run, schema)
