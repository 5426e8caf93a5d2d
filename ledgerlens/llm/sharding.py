"""Proportional stratified interleaving into shards.

Rows are ranked within their stratum in a seeded random order. The fractional rank ``(2 * rank + 1) / (2 * n)``
spreads every stratum evenly over (0, 1); sorting by it interleaves the strata in proportion, and cutting the
sorted rows into equal runs gives every shard the mixture of the whole.

Neither ranking orders a stratum, or the table, in one task: ranks within a stratum are counted per hash prefix,
positions per interval of the fractional rank, and both are lifted by the counts of the buckets before. A stratum
holding a third of all rows is spread over as many buckets as the table is large.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import offsets, stored

ROWS_PER_BUCKET = 1024     # rows that one window orders, on average


def interleave(rows: DataFrame, key: str, stratum: str, shards: int, seed: str = "mix",
               ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within the shard); shard sizes differ by at most one row.

    ``key`` is hashed with the seed for the random order; rows with equal keys are ordered by ``ties``, and rows equal
    in those too are interchangeable. A null key or stratum is a value of its own. Columns of the input are kept, but for
    any named ``shard`` or ``slot``, which are replaced; an empty table gives an empty table. ``shards`` may exceed the number of rows: the rest stay empty.
    """
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    count = rows.count()
    digits = max(1, math.ceil(math.log(max(1, count / ROWS_PER_BUCKET), 16)))
    spans = max(1, count // ROWS_PER_BUCKET)
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    strat = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))
    # the row travels as one value, so that no column of it can clash with those made here
    marked = rows.select(F.struct(*cols).alias("row"), mark.alias("h"), strat.alias("s"), F.struct(key, *ties).alias("tie"))
    marked = marked.withColumn("b", F.conv(F.substring("h", 1, digits), 16, 10).cast("long"))

    # places in the stratum: counts per (stratum, hash prefix), summed over the smaller prefixes
    cube = marked.groupBy("s", "b").agg(F.count(F.lit(1)).alias("c"))
    ahead = W.partitionBy("s").orderBy("b")
    cube = cube.select("s", "b", (F.sum("c").over(ahead) - F.col("c")).alias("ahead"), F.sum("c").over(W.partitionBy("s")).alias("n"))
    here = W.partitionBy("s", "b").orderBy("h", "tie")
    ranked = marked.withColumn("r", F.row_number().over(here) - 1).join(cube, ["s", "b"])
    ranked = ranked.withColumn("f", (2 * (F.col("ahead") + F.col("r")) + 1) / (2 * F.col("n")))
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("f") * spans), F.lit(spans - 1)).cast("long"))
    ranked = stored(ranked.select("row", "h", "s", "tie", "f", "g"))

    # places in the whole: counts per interval of the fractional rank
    before = offsets(ranked.groupBy("g").agg(F.count(F.lit(1)).alias("c")), "g", "c").select("g", "before")
    order = W.partitionBy("g").orderBy("f", "s", "h", "tie")
    placed = ranked.withColumn("r", F.row_number().over(order) - 1).join(before, "g").withColumn("at", F.col("before") + F.col("r"))
    # shard k holds positions ceil(k * count / shards) to ceil((k + 1) * count / shards) - 1
    placed = placed.withColumn("k", F.expr(f"(at * {shards}) div {max(1, count)}"))
    first = F.expr(f"(k * {count} + {shards - 1}) div {shards}")
    return placed.select("row.*", F.col("k").cast("int").alias("shard"), (F.col("at") - first).cast("long").alias("slot"))
