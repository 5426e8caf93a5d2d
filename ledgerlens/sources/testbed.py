"""A transaction ledger, closed cases and alerts derived from the ``events`` table.

The mapping is deterministic so that each operator can be checked by an independent SQL query.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import code_text, device_key, micros
from ..operators.skew import islands
from ..params import DAY, HOUR
from ..session import stored
from .ledger import number_cards

START_US = 1_704_067_200 * 1_000_000   # 2024-01-01, the first day of the events table


def pick(index, *values):
    """The value at position ``index`` of a short fixed list."""
    return F.get(F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]), index)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows: identity parts still separate, cards not numbered yet."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ev = ev.select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"), k.alias("k"))
    k, online = F.col("k"), F.col("event_type") != "purchase"
    return ev.select(
        F.col("event_id").cast("string").alias("TransactionID"),
        F.col("us"),
        F.floor((F.col("us") - START_US) / 1_000_000).alias("TransactionDT"),
        F.col("value").alias("TransactionAmt"),
        F.when(F.col("event_type") == "purchase", "W").when(F.col("event_type") == "click", "C")
         .when(F.col("event_type") == "view", "H").when(F.col("event_type") == "signup", "R")
         .otherwise("S").alias("ProductCD"),
        F.when(online, "online").otherwise("in_person").alias("channel"),
        F.concat(F.lit("C"), F.expr("lpad(cast(user_id as string), greatest(5, length(cast(user_id as string))), '0')")).alias("customer_id"),
        (k % 2).cast("string").alias("card2"),
        F.when(k % 5 == 0, " debit").otherwise("credit ").alias("card6"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("risk_score"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("p_txn"),
        F.when(k % 23 != 7, F.concat((k % 8 + 100).cast("string"), F.lit(".0"))).alias("addr1"),
        pick(k % 3, "87.0", "60.0", "87.0").alias("addr2"),
        (k % 9).cast("double").alias("dist1"),
        pick(k % 5, "gmail.com", "yahoo.com", "hotmail.com", None, "anonymous.com").alias("P_emaildomain"),
        pick(k % 7, None, None, None, "gmail.com", "yahoo.com", "icloud.com", "mail.com").alias("R_emaildomain"),
        (k % 4).cast("double").alias("C1"), (k % 6).cast("double").alias("C2"),
        F.when(k % 11 != 0, (k % 30).cast("double")).alias("D1"),
        pick(k % 3, "M0", "M1", "M2").alias("M4"), pick(k % 2, "T", "F").alias("M6"),
        F.when(online, F.when(F.col("event_type") == "signup", "New").otherwise("Found")).alias("id_15"),
        F.when(online & (k % 10 == 0), F.when(k % 20 == 0, "IP_PROXY:ANONYMOUS")
               .otherwise("IP_PROXY:TRANSPARENT")).alias("id_23"),
        F.when(online, F.when(k % 2 == 0, "desktop").otherwise("mobile")).alias("DeviceType"),
        F.when(online, pick(k % 7, "SM-G950U", "Windows", "MacOS", "iOS Device", "SM-J700M", "moto g", None))
         .alias("DeviceInfo"),
        F.when(online, pick(k % 4, "Android 8.0", "Windows 10", "iOS 11.2", None)).alias("id_30"),
        F.when(online, pick(k % 3, "chrome 62.0", "safari", None)).alias("id_31"),
        F.when(online, pick(k % 5, "2220x1080", " 1920x1080 ", "1334x750", None, " ")).alias("id_33"),
        k.alias("k"))


IDENTITY = ["DeviceInfo", "id_30", "id_31", "id_33"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_ledger(spark, sf_dir)
    raw = raw.withColumns({
        "addr1": F.nullif(code_text(F.col("addr1")), F.lit("")),
        "addr2": code_text(F.col("addr2")),
        "device_profile_id": device_key(*[F.col(c) for c in IDENTITY])}).drop(*IDENTITY)
    raw = raw.withColumn("has_device_record", F.col("device_profile_id").isNotNull())
    return number_cards(raw, ["card2", "card6"]).drop("card2", "card6")


def case_rows(led: DataFrame) -> DataFrame:
    """``error`` rows with the case they belong to: chains of one customer with gaps of at most 48 h."""
    return islands(led.filter(F.col("ProductCD") == "S"), ["customer_id"], 48 * HOUR)


def closed_cases(rows: DataFrame) -> DataFrame:
    """Case headers from ``case_rows``; the transactions stay in a table of their own."""
    g = rows.groupBy("customer_id", "island").agg(
        F.min(F.struct("us", "TransactionID", "card_id", "k")).alias("first"),
        F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n_txns"),
        F.round(F.sum(F.abs("TransactionAmt")), 2).alias("exposure_usd"),
        F.array_sort(F.collect_set("card_id")).alias("cards"))
    fraud = F.col("exposure_usd") >= 20
    pattern = F.when(fraud, pick(F.col("first.k") % 6, "card_testing", "card_not_present_fraud",
                                 "card_not_present_new_device", "out_of_region_use", "account_takeover",
                                 "undocumented")).otherwise("none")
    return g.select(
        F.concat(F.lit("CC-"), F.col("first.TransactionID")).alias("case_id"), "customer_id", "island",
        F.col("first.card_id").alias("card_id"),
        (F.col("last_us") + DAY).alias("opened_us"), (F.col("last_us") + 3 * DAY).alias("closed_us"),
        F.when(fraud, "confirmed_fraud").otherwise("cleared").alias("outcome"), pattern.alias("pattern"),
        F.col("first.TransactionID").alias("first_fraud_txn_id"), "n_txns", "exposure_usd",
        F.array_except("cards", F.array("first.card_id")).alias("connected_card_ids"),
        F.when(fraud, "BLOCK_CARD and CREATE_CASE").otherwise("CLOSE_NO_FRAUD").alias("actions_taken"),
        F.when(F.col("exposure_usd") > 50, "Yes").otherwise("No").alias("report_filed"),
        F.when(pattern == "undocumented", "several online purchases just under $500 within an hour")
         .when(fraud, "customer denied the purchases and the card was blocked")
         .otherwise("customer confirmed the transaction while travelling").alias("analyst_notes"))


def case_txns(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """``(case_id, TransactionID)`` membership table."""
    ids = closed.select("customer_id", "island", "case_id")
    return rows.join(ids, ["customer_id", "island"]).select("case_id", "TransactionID")


def alerts(led: DataFrame) -> DataFrame:
    """One alert per customer: the row whose id has the smallest md5."""
    cols = ["TransactionID", "us", "card_id", "risk_score", "k"]
    g = led.groupBy("customer_id").agg(F.min_by(F.struct(*cols), F.md5("TransactionID")).alias("r"))
    kind = pick(F.col("r.k") % 3, "risk_score", "customer_report", "analyst_request")
    return g.select(
        F.concat(F.lit("AL-"), F.col("r.TransactionID")).alias("case_id"), "customer_id",
        F.col("r.card_id").alias("card_id"), F.col("r.TransactionID").alias("flagged_txn_id"),
        F.col("r.us").alias("flag_us"), (F.col("r.us") + HOUR).alias("opened_us"),
        kind.alias("trigger_type"),
        F.concat(F.lit("Real-time model scored transaction "), F.col("r.TransactionID")).alias("trigger_text"),
        F.col("r.risk_score").alias("risk_score"))


class Bank:
    """The derived tables of one scale-factor folder, each written once and read from then on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def ledger(self) -> DataFrame:
        return stored(ledger(self.spark, self.sf_dir))

    @cached_property
    def case_rows(self) -> DataFrame:
        return stored(case_rows(self.ledger))

    @cached_property
    def closed(self) -> DataFrame:
        return stored(closed_cases(self.case_rows))

    @cached_property
    def case_txns(self) -> DataFrame:
        return stored(case_txns(self.case_rows, self.closed))

    @cached_property
    def alerts(self) -> DataFrame:
        return stored(alerts(self.ledger))
