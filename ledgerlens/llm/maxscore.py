"""Exact top-k by inner product with MaxScore over an inverted index.

A term is one signed dimension of the integer vectors: its posting list holds the rows whose weight there has that
sign. For a query only the lists whose sign agrees with the query's can raise a score, and each has a bound. Terms are
sorted by bound; the longest run of small ones whose bounds together cannot reach the current k-th best score is
non-essential. Essential postings are traversed, and for rows that can still compete the other terms are probed, the
largest bound first, dropping a row as soon as its bound falls below the k-th best.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import ROWS_PER_SHARD, search_shards, usable

SEEDS = 64      # rows of the strongest list that are scored first, for a threshold to start from
PROBED = 512    # rows probed between two updates of the threshold
TOGETHER = 128  # queries whose essential postings are traversed together


class Postings:
    """The posting lists of one shard, as columns of two matrices because the vectors are dense: ``up[:, t]`` is the
    list of the rows with a positive weight in dimension ``t``, ``down[:, t]`` that of the negative ones. Weights are
    integers held as doubles, exact below 2**53. Rows are in id order, so a smaller position is a smaller id."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.rows = ids, weights
        self.up, self.down = np.maximum(weights, 0), np.minimum(weights, 0)
        self.bound_up, self.bound_down = self.up.max(axis=0), -self.down.min(axis=0)
        order = np.argsort(weights, axis=0, kind="stable")
        self.strong_down, self.strong_up = order[:SEEDS].T, order[::-1][:SEEDS].T

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each term's list can add to a score."""
        return np.where(queries > 0, queries * self.bound_up, -queries * self.bound_down)

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and scores of its ``k`` best rows other than ``own``, ties to the smaller."""
        bounds = self.bounds(queries)
        order = np.argsort(bounds, axis=1, kind="stable")
        reach = np.cumsum(np.take_along_axis(bounds, order, 1), axis=1)
        tops, essential = [], np.ones(queries.shape, bool)
        for i, q in enumerate(queries):
            t = order[i, -1]
            strong = (self.strong_up if q[t] > 0 else self.strong_down)[t]
            top = Top(k, own[i])
            top.offer(strong, self.rows[strong] @ q)
            split = np.searchsorted(reach[i], top.threshold, "left")
            essential[i, order[i, :split]] = False
            tops.append(top)
        taken = np.where(essential, queries, 0)
        partial = np.maximum(taken, 0) @ self.up.T + np.minimum(taken, 0) @ self.down.T
        rest = np.where(essential, 0, bounds).sum(axis=1)
        for i, q in enumerate(queries):
            self.probe(q, essential[i], partial[i], rest[i], tops[i])
        return [(top.at, top.score) for top in tops]

    def probe(self, q: np.ndarray, essential: np.ndarray, partial: np.ndarray, rest: float, top: Top) -> None:
        """Complete the scores of the rows that may still enter ``top``.

        Left to add are the lists of the other sign, which never raise a score, and the non-essential terms."""
        alive = np.flatnonzero(partial + rest >= top.threshold)
        alive = alive[np.argsort(-partial[alive], kind="stable")]
        taken, others = np.where(essential, q, 0), np.where(essential, 0, q)
        for a in range(0, len(alive), PROBED):
            at = alive[a:a + PROBED]
            if partial[at[0]] + rest < top.threshold:
                break
            rows = self.rows[at]
            score = partial[at] + np.minimum(rows * taken, 0).sum(axis=1)
            stay = score + rest >= top.threshold
            at, score = at[stay], score[stay]
            if rest:
                score = score + rows[stay] @ others
                stay = score >= top.threshold
                at, score = at[stay], score[stay]
            top.offer(at, score)


class Top:
    """The best ``k`` rows so far and the score a row must reach to be among them."""

    def __init__(self, k: int, own: int):
        self.k, self.own, self.threshold = k, own, -np.inf
        self.at, self.score = np.empty(0, np.int64), np.empty(0)

    def offer(self, at: np.ndarray, score: np.ndarray) -> None:
        new = ~np.isin(at, self.at) & (at != self.own)
        at, score = np.concatenate([self.at, at[new]]), np.concatenate([self.score, score[new]])
        keep = np.lexsort((at, -score))[:self.k]
        self.at, self.score = at[keep], score[keep]
        if len(keep) == self.k:
            self.threshold = self.score[-1]


def top_scores(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
               scale: int = 256, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` largest integer inner products, itself left out.

    Components become ``floor(scale * x)``. Both frames have ``id_col`` and ``vec_col``; other columns are ignored.
    Rows without an id, or with a null vector or null or non-finite components, take no part; of rows sharing an id
    the one with the smallest vector counts. Fewer than ``k`` candidates: all of them. Ties go to the smaller id.
    """
    def whole(frame: DataFrame) -> DataFrame:
        return usable(frame, id_col, vec_col).withColumn(
            "vec", F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))

    def find(index: Postings, ids: np.ndarray, vecs: np.ndarray):
        at = np.searchsorted(index.ids, ids)
        own = np.where(index.ids[np.minimum(at, len(index.ids) - 1)] == ids, at, -1)
        found = []
        for a in range(0, len(ids), TOGETHER):
            found += index.best(vecs[a:a + TOGETHER], own[a:a + TOGETHER], k)
        q = np.repeat(np.arange(len(ids)), [len(f) for f, _ in found])
        return (q, index.ids[np.concatenate([f for f, _ in found])],
                np.concatenate([s for _, s in found]).astype(np.int64))

    return search_shards(whole(df), whole(queries), Postings, find, k, rows_per_shard, score="long")
