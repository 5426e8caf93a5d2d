"""Approximate nearest neighbours by cosine with vantage-point trees.

Unit vectors are compared by their straight distance, a metric that orders pairs as the cosine does. Each shard has a
tree: a node keeps a vantage point and the median distance to it, its children the nearer and the farther half. With
``t`` the k-th best distance so far, the child on the other side of the median is entered when
``|d - median| <= factor * t``; factor one is the triangle inequality itself and the search exact, smaller factors skip
children that would rarely help. Queries descend in batches. Copies of a vector are one point with a list of ids.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import ROWS_PER_SHARD, search_shards, usable

LEAF = 64
SPARE = 3       # points kept beyond k, so that rounding cannot decide about a tie


class Tree:
    def __init__(self, ids: np.ndarray, vecs: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids, *vecs.T[::-1]))
        ids, vecs = ids[order], vecs[order]
        new = np.ones(len(ids), bool)
        new[1:] = np.any(vecs[1:] != vecs[:-1], axis=1)
        self.ids, self.first = ids, np.append(np.flatnonzero(new), len(ids))   # the ids of point p: first[p] .. first[p + 1]
        self.raw = vecs[new]
        self.unit = self.raw / np.sqrt((self.raw ** 2).sum(1))[:, None]
        self.nodes = []
        rng = np.random.default_rng(7)
        # (points, parent, side); children are filled in when they are made
        todo = [(np.arange(len(self.unit)), None, 0)]
        while todo:
            points, parent, side = todo.pop()
            if parent is not None:
                self.nodes[parent][side] = len(self.nodes)
            if len(points) <= leaf:
                self.nodes.append([-1, 0.0, -1, -1, points])
                continue
            tried = rng.choice(points, min(5, len(points)), replace=False)
            seen = rng.choice(points, min(100, len(points)), replace=False)
            spread = self.distance(self.unit[tried] @ self.unit[seen].T).var(axis=1)
            vantage = tried[int(spread.argmax())]
            points = points[points != vantage]
            d = self.distance(self.unit[points] @ self.unit[vantage])
            half = np.argsort(d, kind="stable")
            middle = len(points) // 2
            self.nodes.append([int(vantage), float(d[half[middle]]), -1, -1, None])
            here = len(self.nodes) - 1
            todo += [(points[half[:middle]], here, 2), (points[half[middle:]], here, 3)]

    @staticmethod
    def distance(cosine: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * cosine, 0))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of up to ``k`` points per query (-1: none), and in ``self.seen`` the points compared."""
        best = np.full((len(queries), k), -1, np.int64)
        cos = np.full((len(queries), k), -np.inf)
        self.seen = 0
        slack = 1e-9

        def offer(qs: np.ndarray, points: np.ndarray, got: np.ndarray) -> None:
            self.seen += got.size
            better = np.flatnonzero((got >= cos[qs, k - 1:]).any(axis=1))
            if not len(better):
                return
            qs, got = qs[better], got[better]
            c = np.concatenate([cos[qs], got], axis=1)
            p = np.concatenate([best[qs], np.broadcast_to(points, got.shape)], axis=1)
            keep = np.argpartition(-c, k - 1, axis=1)[:, :k]
            keep = np.take_along_axis(keep, np.argsort(-np.take_along_axis(c, keep, 1), axis=1, kind="stable"), 1)
            cos[qs], best[qs] = np.take_along_axis(c, keep, 1), np.take_along_axis(p, keep, 1)

        # a frame is (node, queries) or, for the far side, (node, queries, gap to the median)
        todo = [(0, np.arange(len(queries)), None)]
        while todo:
            n, qs, gap = todo.pop()
            if gap is not None:
                near = gap <= factor * self.distance(np.maximum(cos[qs, k - 1], -1)) + slack
                qs = qs[near | (cos[qs, k - 1] == -np.inf)]
            if not len(qs):
                continue
            vantage, median, left, right, points = self.nodes[n]
            if points is not None:
                if len(points):
                    offer(qs, points, queries[qs] @ self.unit[points].T)
                continue
            c = queries[qs] @ self.unit[vantage]
            offer(qs, np.array([vantage]), c[:, None])
            d = self.distance(c)
            inside = d < median
            gap = np.abs(d - median)
            todo += [(left, qs[~inside], gap[~inside]), (right, qs[inside], gap[inside]),
                     (right, qs[~inside], None), (left, qs[inside], None)]
        return best, cos


def neighbours(df: DataFrame, queries: DataFrame, k: int, factor: float, id_col: str = "vec_id",
               vec_col: str = "embedding", rows_per_shard: int = ROWS_PER_SHARD, leaf: int = LEAF) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` near rows of every query by cosine, itself left out.

    Scores are the cosines of the original vectors in double precision. Every row is indexed. Rows without an id, zero
    vectors and vectors null or with null or non-finite components take no part; of rows sharing an id the one with
    the smallest vector counts. Ties go to the smaller id. Columns other than the two named are ignored.
    """
    def nonzero(frame: DataFrame) -> DataFrame:
        return usable(frame, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))

    def build(ids: np.ndarray, vecs: np.ndarray) -> Tree:
        return Tree(ids, vecs, leaf)

    def find(tree: Tree, ids: np.ndarray, vecs: np.ndarray):
        unit = vecs / np.sqrt((vecs ** 2).sum(1))[:, None]
        points, _ = tree.search(unit, k + 1 + SPARE, factor)
        q, p = np.nonzero(points >= 0)
        p = points[q, p]
        a, b = vecs[q], tree.raw[p]
        score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        # the smallest k + 1 ids of each point: one of them may be the query itself
        n = np.minimum(tree.first[p + 1] - tree.first[p], k + 1)
        row = np.repeat(np.arange(len(p)), n)
        item = tree.ids[np.repeat(tree.first[p], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        q, score = q[row], score[row]
        keep = item != ids[q]
        q, item, score = q[keep], item[keep], score[keep]
        order = np.lexsort((item, -score, q))
        q, item, score = q[order], item[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        return q[keep], item[keep], score[keep]

    return search_shards(nonzero(df), nonzero(queries), build, find, k, rows_per_shard)
