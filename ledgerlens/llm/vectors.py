"""Vectors dealt to shards, each met by the whole query set as a stream."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SHARD = 8192


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec array<double>)`` of the rows with an id and a vector without null or non-finite components."""
    vec = F.col(vec_col).cast("array<double>")
    broken = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~broken & (F.size("vec") > 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def first_of_each(ids: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per id in id order; of rows that share an id, the one with the smallest vector stays."""
    order = np.lexsort((*vecs.T[::-1], ids))
    ids, vecs = ids[order], vecs[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = ids[1:] != ids[:-1]
    return ids[keep], vecs[keep]


def search_shards(items: DataFrame, queries: DataFrame, build: Callable, find: Callable, k: int,
                  rows_per_shard: int = ROWS_PER_SHARD, score: str = "double") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of all shards for each query, ties to the smaller id.

    Items are dealt to shards by a hash of their id, and the stated query set is sent to every shard of its vector
    length. A task reads a shard's items first, builds ``build(ids, matrix)`` from them, then streams the queries in
    batches through ``find(index, ids, matrix) -> (query position, item ids, scores)``. It never holds more than one
    shard and one batch of queries. Vectors of different lengths are never compared. No queries or no items: no rows.
    """
    spark = items.sparkSession
    lengths = [(r["d"], max(1, math.ceil(r["n"] / rows_per_shard))) for r in
               items.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()]
    sizes = spark.createDataFrame(lengths, "d int, shards int")
    left = items.withColumn("d", F.size("vec")).join(sizes, "d").select(
        "d", F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "vec")
    queries = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    right = queries.withColumn("d", F.size("vec")).join(sizes, "d").select(
        "d", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "vec")
    total = max(1, sum(n for _, n in lengths))
    met = left.unionByName(right).repartition(total, "d", "shard").sortWithinPartitions("d", "shard", "kind")
    value = pa.int64() if score == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, index, ids, vecs = None, None, [], []
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero(np.any(at[1:] != at[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if b == a:
                    continue
                if (at[a, 0], at[a, 1]) != place:
                    place, index, ids, vecs = (at[a, 0], at[a, 1]), None, [], []
                rows, m = batch.column(3).to_numpy()[a:b], matrix(batch.column(4).slice(a, b - a))
                if at[a, 2] == 0:
                    ids.append(rows)
                    vecs.append(m)
                    continue
                if not ids:
                    continue
                if index is None:
                    index = build(*first_of_each(np.concatenate(ids), np.concatenate(vecs)))
                q, item, got = find(index, rows, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[q]), pa.array(item), pa.array(got, value)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    from ..operators.skew import top_k
    return top_k(found, ["query_id"], [F.desc("score"), "vec_id"], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
