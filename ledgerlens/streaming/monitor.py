"""The population monitor as a Structured Streaming job over ledger files.

Windowed counts keep bounded state behind a watermark. The exact detectors run in ``foreachBatch`` over a
bounded look-back of the stored ledger, with the same code as the batch monitor.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import flag
from ..operators import bursts
from ..params import DEFAULT, HOUR, Params

LEDGER = ("TransactionID string, us bigint, TransactionAmt double, ProductCD string, channel string, customer_id string, "
          "card_id string, device_profile_id string, id_15 string, id_23 string, p_txn double")


def ledger_stream(spark: SparkSession, folder: str, late: str = "1 hour", files_per_batch: int | None = None) -> DataFrame:
    """Parquet ledger files as they arrive; rows later than ``late`` behind the newest are dropped."""
    r = spark.readStream.schema(LEDGER)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)


def card_speed(rows: DataFrame, params: Params = DEFAULT, width: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Rows, small online rows and sub-cap rows per card and sliding window."""
    amount, online = F.col("TransactionAmt"), F.col("channel") == "online"
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "card_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(online & (amount < params.small_amount))).alias("n_small"),
        F.sum(flag(online & (amount >= params.band * params.cap) & (amount < params.cap))).alias("n_band")).select(
        F.unix_micros("w.start").alias("start_us"), "card_id", "n", "n_small", "n_band")


def device_days(rows: DataFrame) -> DataFrame:
    """Approximate customers and the new-and-proxied rows per device and day: constant state per device."""
    both = (F.col("id_15") == "New") & F.col("id_23").isNotNull()
    return rows.filter(F.col("device_profile_id").isNotNull()).groupBy(F.window("ts", "1 day").alias("w"), "device_profile_id").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("customer_id").alias("n_customers"), F.sum(flag(both)).alias("n_new_proxy")).select(
        F.unix_micros("w.start").alias("start_us"), "device_profile_id", "n", "n_customers", "n_new_proxy")


def member_episodes(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Chains of member rows per customer, closed once the gap has passed the watermark."""
    gap = f"{params.episode_gap_us // HOUR} hours"
    return rows.filter(F.col("p_txn") >= params.member_threshold).groupBy(F.session_window("ts", gap).alias("w"), "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("TransactionAmt")).alias("exposure"), F.min("us").alias("first_us"),
        F.max("us").alias("last_us")).select("customer_id", "n", "exposure", "first_us", "last_us")


def first_alerts(speed: DataFrame, params: Params = DEFAULT, width: str = "1 day") -> DataFrame:
    """One candidate alert per card and day: rows over the burst size, repeated ones dropped."""
    hits = speed.filter(F.col("n_small") >= params.burst_min)
    return hits.withColumn("day", F.date_trunc("day", F.timestamp_micros("start_us"))).select("card_id", "day").dropDuplicates()


def exact_bursts(spark: SparkSession, store: str, out: str, params: Params = DEFAULT):
    """``foreachBatch`` handler: append the batch to the store, re-run the exact detectors on the cards it
    touched over the look-back that can still change, and append their first hits.

    Writing a batch under its own number makes a replayed batch overwrite itself.
    """
    reach = params.burst_us + params.follow_us

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.drop("ts").write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        rows = spark.read.schema(LEDGER).parquet(f"{store}/epoch={epoch}")
        low = rows.agg(F.min("us")).first()[0]
        if low is None:
            return
        recent = spark.read.schema(LEDGER).parquet(f"{store}/*").filter(F.col("us") >= low - reach)
        touched = recent.join(rows.select("card_id").distinct(), "card_id", "left_semi")
        hits = bursts.card_testing(touched, ["card_id"], params).select(
            F.lit("card_testing").alias("type"), "card_id", "start_us", F.col("purchase").alias("seed_txn"))
        more = bursts.structuring(touched, ["card_id"], params).select(
            F.lit("structuring").alias("type"), "card_id", "start_us", F.col("start_id").alias("seed_txn"))
        hits.unionByName(more).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    return handle


def run_available(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; results are appended to parquet."""
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(sink)
    q.awaitTermination()
    return q


def run_batches(df: DataFrame, handler, checkpoint: str) -> StreamingQuery:
    q = df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
