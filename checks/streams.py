"""Streaming monitor: each query runs to completion on the ledger's files and returns what it appended.

A closing row two months later pushes the watermark past every real window, so all of them are emitted.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.params import DAY, TESTBED
from ledgerlens.session import new_folder
from ledgerlens.sources.testbed import START_US, Bank
from ledgerlens.streaming import monitor as S

from .prelude import DAY as D
from .prelude import HOUR as H
from .prelude import led
from .registry import query

COLS = ["TransactionID", "us", "TransactionAmt", "ProductCD", "channel", "customer_id", "card_id", "device_profile_id", "id_15", "id_23", "p_txn"]


def arrive(spark, sf):
    """The ledger as files in arrival order, then one far-off row that closes every window."""
    folder = new_folder(spark)
    led_ = Bank(spark, sf).ledger.select(*COLS)
    days = (F.col("us") - START_US) / DAY
    for part in (days < 8, (days >= 8) & (days < 16), (days >= 16) & (days < 24), days >= 24):       # one after the other, so the order is fixed
        led_.filter(part).write.mode("append").parquet(folder + "/in")
    last = led_.agg(F.max("us").alias("us")).select(
        F.lit("end").alias("TransactionID"), (F.col("us") + 60 * DAY).alias("us"), F.lit(50.0).alias("TransactionAmt"), F.lit("Z").alias("ProductCD"),
        F.lit("online").alias("channel"), F.lit("END").alias("customer_id"), F.lit("END").alias("card_id"), F.lit("END").alias("device_profile_id"),
        F.lit(None).cast("string").alias("id_15"), F.lit(None).cast("string").alias("id_23"), F.lit(1.0).alias("p_txn"))
    last.write.mode("append").parquet(folder + "/in")
    return folder


def appended(spark, sf, build):
    folder = arrive(spark, sf)
    # one batch in two steps: all files arrive together, so no row is late; the closing row moves the watermark
    rows = S.ledger_stream(spark, folder + "/in")
    S.run_available(build(rows), folder + "/out", folder + "/cp")
    return spark.read.parquet(folder + "/out")


@query("stream_card_speed", led(f"""
  SELECT start_us, card_id, count(*) AS n, count(*) FILTER (channel = 'online' AND TransactionAmt < 5) AS n_small,
    count(*) FILTER (channel = 'online' AND TransactionAmt >= 42.5 AND TransactionAmt < 50) AS n_band
  FROM (SELECT *, unnest(list_transform(range(0, 6), lambda i: (us // {10 * 60 * 1000000} - i) * {10 * 60 * 1000000})) AS start_us FROM ledger) GROUP BY ALL"""))
def stream_card_speed(spark, sf):
    return appended(spark, sf, lambda r: S.card_speed(r, TESTBED)).filter(F.col("card_id") != "END")


@query("stream_device_days")
def stream_device_days(spark, sf):
    """Customers are counted approximately, so only rows are compared."""
    return appended(spark, sf, S.device_days).filter(F.col("device_profile_id") != "END")


@query("stream_episodes", led(f"""
  SELECT customer_id, count(*) AS n, round(sum(abs(TransactionAmt)), 4) AS exposure, min(us) AS first_us, max(us) AS last_us FROM (
    SELECT *, sum(CASE WHEN gap <= {48 * H} THEN 0 ELSE 1 END) OVER (PARTITION BY customer_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, us - lag(us) OVER (PARTITION BY customer_id ORDER BY us) AS gap FROM ledger WHERE p_txn >= 0.15)) GROUP BY customer_id, island"""))
def stream_episodes(spark, sf):
    return appended(spark, sf, lambda r: S.member_episodes(r, TESTBED)).filter(F.col("customer_id") != "END").withColumn("exposure", F.round("exposure", 4))


@query("stream_exact_bursts")
def stream_exact_bursts(spark, sf):
    folder = arrive(spark, sf)
    rows = S.ledger_stream(spark, folder + "/in", files_per_batch=2)
    S.run_batches(rows, S.exact_bursts(spark, folder + "/store", folder + "/hits", TESTBED), folder + "/cp")
    return spark.read.parquet(folder + "/hits").select("type", "card_id", "start_us", "seed_txn").distinct()
