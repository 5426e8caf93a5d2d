"""Skew-safe building blocks: running totals, band joins and window summaries.

One customer, card or device may hold a third of the ledger. A window partitioned by such a key would put all its rows
into one task, so every key is cut into time slices: each slice is windowed on its own and then lifted by the totals of
the slices before it, which come from a table aggregated per slice. All keys take this one path.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import DAY, HOUR
from ..session import stored

_MERGE = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, inside: Column, before: Column) -> Column:
    if kind in ("count", "sum"):
        return F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(inside, before)


def _aggregate(kind: str, value: Column) -> Column:
    return {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _marks(keys: list[str], us: str, slice_width: float) -> tuple[list[str], dict[str, Column]]:
    """Columns that tell a row's key and time slice. A null key is a key of its own; without nulls one exchange serves both
    the windows and the join."""
    ids = [f"_key{i}" for i in range(len(keys))]
    marks = {i: F.coalesce(F.col(k).cast("string"), F.lit("\0")) for i, k in zip(ids, keys, strict=True)}
    return ids, marks | {"_slice": F.floor(F.col(us) / F.lit(slice_width))}


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]],
                   slice_width: float = HOUR, source: DataFrame | None = None) -> DataFrame:
    """Add totals over the strictly earlier rows of the same key.

    ``source``: a stored table with the same rows, from which the totals per slice are taken. Steps that follow one
    another need it, as each would otherwise repeat all before it.

    ``order[0]`` must be a numeric time column; the rest break ties. ``totals`` maps a new column to
    ``(kind, value)`` with kind count, sum, max or min. Sums and counts are 0 on a key's first row,
    max and min are null there.
    """
    ids, marks = _marks(keys, order[0], slice_width)
    rows = df.withColumns(marks)
    part = [*ids, "_slice"]
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumns({n: _aggregate(k, v).over(w) for n, (k, v) in totals.items()})
    per_slice = (rows if source is None else source.withColumns(marks)).groupBy(*part).agg(*[_aggregate(k, v).alias(f"_p_{n}") for n, (k, v) in totals.items()])
    earlier = W.partitionBy(*ids).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = per_slice.select(*part, *[_MERGE[k](F.col(f"_p_{n}")).over(earlier).alias(f"_b_{n}") for n, (k, _) in totals.items()])
    lifted = inside.join(before, part, "left")
    return lifted.withColumns({n: _combine(k, F.col(n), F.col(f"_b_{n}")) for n, (k, _) in totals.items()}).select(*df.columns, *totals)


def trailing_totals(df: DataFrame, keys: list[str], row_id: str, us: str, spans: dict[str, tuple[int, Column]],
                    source: DataFrame | None = None) -> DataFrame:
    """Add the total of a value over the rows in ``(t - width, t]``, the row included.

    Each span is the cumulative total at the row less the cumulative total at ``t - width``, so the
    work per row does not depend on how many rows the span holds. The second total is looked up with
    a probe record at ``t - width``, because it may lie in another slice.
    """
    widths = sorted({w for w, _ in spans.values()})
    values = (df if source is None else source).select(*keys, row_id, us, *[v.alias(f"_v_{n}") for n, (_, v) in spans.items()])
    marks = values.withColumn("_w", F.explode(F.array(F.lit(0), *[F.lit(w) for w in widths])))
    marks = marks.withColumns({"_at": F.col(us) - F.col("_w"), "_kind": F.when(F.col("_w") == 0, 0).otherwise(1)})
    real = F.col("_kind") == 0
    run = running_totals(marks, keys, ["_at", "_kind", row_id],
                         {f"_c_{n}": ("sum", F.when(real, F.col(f"_v_{n}"))) for n in spans})
    at_row = {n: F.max(F.when(real, F.col(f"_c_{n}") + F.col(f"_v_{n}"))) for n in spans}
    at_start = {n: F.max(F.when(F.col("_w") == w, F.col(f"_c_{n}"))) for n, (w, _) in spans.items()}
    return df.join(run.groupBy(row_id).agg(*[(at_row[n] - at_start[n]).alias(n) for n in spans]), row_id)


def islands(df: DataFrame, keys: list[str], gap: int, row_id: str = "TransactionID", us: str = "us") -> DataFrame:
    """Number each key's chains of rows whose consecutive gaps are at most ``gap``.

    A slice's rows are chained in one pass. Whether its first row goes on with a chain, and how many chains there are before
    it, come from the first and last instants and the chains of the slices before.
    """
    ids, marks = _marks(keys, us, DAY)
    part = [*ids, "_slice"]
    w = W.partitionBy(*part).orderBy(us, row_id)
    rows = df.withColumns(marks).withColumn("_prev", F.lag(us).over(w))
    first = F.col("_prev").isNull() & F.col(us).isNotNull()
    new = F.when(first | (F.col(us) - F.col("_prev") <= gap), 0).otherwise(1)
    rows = rows.withColumn("_inside", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    earlier = W.partitionBy(*ids).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = rows.groupBy(*part).agg(F.min(us).alias("_from"), F.max(us).alias("_to"), F.max("_inside").alias("_n"))
    goes_on = F.col("_from").isNull() | (F.col("_from") - F.max("_to").over(earlier) <= gap)
    slices = slices.withColumn("_head", F.when(goes_on, 0).otherwise(1))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_head")).over(earlier), F.lit(0))
    lifted = rows.join(slices.select(*part, (before + F.col("_head")).alias("_base")), part, "left")
    return lifted.withColumn("island", F.col("_inside") + F.coalesce("_base", F.lit(0))).select(*df.columns, "island")


def band_join(probes: DataFrame, rows: DataFrame, keys: list[str], start: str, end: str, us: str = "us",
              width: int = DAY) -> DataFrame:
    """Rows of the probe's key with ``start <= us < end``.

    Both sides are cut into time buckets, so the join is an equi-join on (key, bucket): a heavy key is
    spread over its buckets and only buckets inside a probe's span are touched. Spark takes a table that was
    multiplied by ``explode`` for as small as before, so the join is told to shuffle and not to broadcast it.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    p = probes.filter(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(first, last))).hint("merge")
    r = rows.withColumn("_bucket", F.floor(F.col(us) / width))
    joined = p.join(r, keys + ["_bucket"])
    return joined.filter((F.col(us) >= F.col(start)) & (F.col(us) < F.col(end))).drop("_bucket")


def window_pieces(probes: DataFrame, rows: DataFrame, keys: list[str], start: str, end: str, dims: list[str],
                  measures: dict[str, Column], us: str = "us", width: int = DAY) -> DataFrame:
    """Pre-aggregated content of each probe's ``[start, end)`` span.

    Whole buckets come from a cube aggregated before the join (so a heavy key costs one row per bucket
    and dimension value, not one per ledger row); only the two edge buckets use single rows. Returns
    the probe columns, ``dims`` and the summed ``measures``; a span's totals are the sums over its
    pieces, its distinct values the distinct ``dims``.

    Cube and single rows share one exchange by key and bucket, which both joins use as it is. A probe is sent only to the
    buckets between the first and last in which its key has rows, however long its span is.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    rows = rows.select(*keys, F.floor(F.col(us) / width).alias("_bucket"), us, *dims, *[v.alias(n) for n, v in measures.items()])
    ids = [f"_key{i}" for i in range(len(keys))]
    held = rows.groupBy(*[F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)]).agg(
        F.min("_bucket").alias("_low"), F.max("_bucket").alias("_high"))
    rows = rows.filter(F.col(us).isNotNull()).repartition(*keys, "_bucket")
    # the time adds nothing; without it the cube's exchange would have other columns and be a second one
    cube = rows.groupBy(*keys, "_bucket", *dims).agg(*[F.sum(F.col(n) + 0 * F.col(us)).alias(n) for n in measures])
    p = probes.filter(F.col(start) < F.col(end)).withColumns({"_first": first, "_last": last})
    p = p.join(held, [F.col(k) == F.col(i) for k, i in zip(keys, ids, strict=True)]).drop(*ids)
    cols = [*probes.columns, *[d for d in dims if d not in probes.columns], *measures]
    low, high = F.greatest(F.col("_first") + 1, "_low"), F.least(F.col("_last") - 1, "_high")
    inner = (p.filter(low <= high).withColumn("_bucket", F.explode(F.sequence(low, high))).drop("_low", "_high").hint("merge")
             .join(cube, keys + ["_bucket"]).select(*cols))
    edges = (p.withColumn("_bucket", F.explode(F.array_distinct(F.array("_first", "_last")))).filter(F.col("_bucket").between(F.col("_low"), F.col("_high")))
             .drop("_low", "_high").hint("merge").join(rows, keys + ["_bucket"])
             .filter((F.col(us) >= F.col(start)) & (F.col(us) < F.col(end))).select(*cols))
    return inner.unionByName(edges)


def trailing_counts(probes: DataFrame, rows: DataFrame, keys: list[str], end: str, width: int, sums: dict[str, Column],
                    distinct: dict[str, Column], row_id: str = "TransactionID", us: str = "us") -> DataFrame:
    """Add to each probe, over the rows of its keys in ``[end - width, end)``: the ``sums``, and for each name in ``distinct``
    the number of different values that are not null.

    A value counts once, by the use whose previous use lies before the span. That use counts from its own time, or from
    ``width`` after the previous use if that is later, until ``width`` after itself: two events in time, whatever the probes
    are. Sums are two events a row as well, so every answer is a running total of events at the probe's instant, and the
    work does not depend on how many rows a span holds. ``keys`` are not null. A span without rows gives zeros.
    """
    names = [*sums, *distinct]
    span = F.lit(width)

    def steps(df: DataFrame, begin: Column, stop: Column, values: dict[str, Column]) -> DataFrame:
        both = F.explode(F.array(F.struct(begin.alias("at"), F.lit(1).alias("sign")), F.struct(stop.alias("at"), F.lit(-1).alias("sign"))))
        made = df.select(*keys, *[v.alias(f"_v_{n}") for n, v in values.items()], both.alias("_e"))
        return made.select(*keys, F.col("_e.at").alias("_at"), F.lit(1).alias("_kind"), *[(F.col(f"_v_{n}") * F.col("_e.sign")).alias(n) for n in values])

    line = probes.withColumns({"_at": F.col(end), "_kind": F.lit(0)})
    if sums:
        line = line.unionByName(steps(rows, F.col(us), F.col(us) + span, sums), allowMissingColumns=True)
    for name, value in distinct.items():
        uses = rows.select(*keys, value.alias("_value"), us, row_id).filter(F.col("_value").isNotNull())
        uses = running_totals(uses, [*keys, "_value"], [us, row_id], {"_last": ("max", F.col(us))}, slice_width=DAY)
        begin = F.greatest(F.col(us), F.coalesce(F.col("_last") + span, F.col(us)))
        uses = uses.filter(begin < F.col(us) + span)
        line = line.unionByName(steps(uses, begin, F.col(us) + span, {name: F.lit(1)}), allowMissingColumns=True)
    total = running_totals(line, keys, ["_at", "_kind"], {f"_t_{n}": ("sum", F.col(n)) for n in names}, slice_width=DAY)
    return total.filter(F.col("_kind") == 0).select(*probes.columns, *[F.col(f"_t_{n}").alias(n) for n in names])


def range_totals(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add the sums over all strictly earlier rows of the whole table in ``order``, which leaves no ties.

    Spark samples the order and deals even ranges of it; a range is summed in its task, and the totals of the ranges before
    it, of which there are as many as partitions, are added. The ranges are written once, so both steps see the same."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()])
    before = totals.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    out = ranged.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()}).join(before, "_range")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums])


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark trims each map-side partition to k before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
