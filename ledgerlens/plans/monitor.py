"""Population monitor: three sweeps over a date range, assembled into ordered alerts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import device_label
from ..operators.asof import population_window
from ..operators.bursts import card_testing, structuring
from ..operators.rings import ring_candidates
from ..params import DEFAULT, HOUR, Params

FIELDS = ["type", "element", "n_txns", "n_customers", "n_cards", "total", "score", "first_us", "last_us", "seed_txn"]


def ring_alerts(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return ring_candidates(rows, params).select(
        F.lit("device_ring").alias("type"), device_label(F.col("device_profile_id")).alias("element"), "n_txns",
        "n_customers", "n_cards", "first_us", "last_us", "seed_txn")


def structuring_alerts(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    hits = structuring(rows, ["card_id"], params)
    last = rows.select("card_id", F.col("us").alias("end_us"), "TransactionID", "TransactionAmt", "channel")
    band = last.filter((F.col("channel") == "online") & (F.col("TransactionAmt") < params.cap)
                       & (F.col("TransactionAmt") >= params.band * params.cap))
    seed = hits.join(band.select("card_id", "end_us", "TransactionID"), ["card_id", "end_us"]).groupBy(
        "card_id", "start_us", "end_us", "n", "total").agg(F.max("TransactionID").alias("seed_txn"))
    return seed.select(F.lit("structuring").alias("type"), F.col("card_id").alias("element"), F.col("n").alias("n_txns"),
                       F.lit(1).cast("bigint").alias("n_cards"), F.lit(1).cast("bigint").alias("n_customers"), "total", F.col("start_us").alias("first_us"),
                       F.col("end_us").alias("last_us"), "seed_txn")


def testing_alerts(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Best ``monitor_top`` card-testing hits by the score of their purchase."""
    hits = card_testing(rows, ["card_id"], params)
    scores = rows.select(F.col("TransactionID").alias("purchase"), F.col("p_txn").alias("score"))
    scored = hits.join(scores, "purchase").filter(F.col("score") >= params.monitor_min_score)
    top = scored.orderBy(F.desc("score"), "card_id").limit(params.monitor_top)
    return top.select(F.lit("card_testing").alias("type"), F.col("card_id").alias("element"),
                      (F.col("n_tests") + F.col("n_after")).alias("n_txns"), F.lit(1).cast("bigint").alias("n_cards"), F.lit(1).cast("bigint").alias("n_customers"),
                      F.round("score", 3).alias("score"), F.col("start_us").alias("first_us"), "last_us",
                      F.col("purchase").alias("seed_txn"))


def monitor_alerts(scored: DataFrame, start_us: int, end_us: int, params: Params = DEFAULT) -> DataFrame:
    """All alerts, ordered by ``as_of = last row + 1 h`` and numbered.

    Rows are ordered with a range sort and numbered by their place inside it plus the sizes of the
    ranges before, so numbering does not pull the alerts into a single task.
    """
    rows = population_window(scored, start_us, end_us)
    parts = [ring_alerts(rows, params), structuring_alerts(rows, params), testing_alerts(rows, params)]
    alerts = parts[0]
    for p in parts[1:]:
        alerts = alerts.unionByName(p, allowMissingColumns=True)
    alerts = alerts.withColumn("as_of", F.col("last_us") + HOUR)
    return number_rows(alerts, ["as_of", "type", "element"]).select(
        F.format_string("MON-%03d", "n_row").alias("alert_id"), *FIELDS, "as_of")


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``n_row`` (1, 2, ...) in global order.

    Rows are numbered inside each day of the first (time) column; the days before contribute their
    sizes, known from a table with one row per day.
    """
    d = df.withColumn("_d", F.floor(F.col(order[0]) / (24 * HOUR)))
    sizes = d.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    before = sizes.select("_d", F.sum("_n").over(W.partitionBy("_one").orderBy("_d").rowsBetween(
        W.unboundedPreceding, -1)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_d").orderBy(*order))
    return d.withColumn("_in", inside).join(before, "_d").withColumn(
        "n_row", F.col("_in") + F.coalesce(F.col("_before"), F.lit(0))).drop("_d", "_in", "_before")


def alerts_to_cases(alerts: DataFrame, scored: DataFrame) -> DataFrame:
    """Give each monitor alert the columns of an ordinary alert, taken from its seed row."""
    seed = scored.select(F.col("TransactionID").alias("seed_txn"), "customer_id", "card_id", "risk_score",
                         F.col("us").alias("flag_us"))
    text = (F.when(F.col("type") == "device_ring",
                   F.concat(F.lit("Monitor: device profile "), "element", F.lit(" used by "), "n_customers",
                            F.lit(" customers, new and behind a proxy on most rows.")))
            .when(F.col("type") == "structuring", F.concat(F.lit("Monitor: sub-limit online burst on "), "element", F.lit(".")))
            .otherwise(F.concat(F.lit("Monitor: small authorizations then a purchase on "), "element", F.lit("."))))
    return alerts.join(seed, "seed_txn").select(
        F.col("alert_id").alias("case_id"), "customer_id", "card_id", F.col("seed_txn").alias("flagged_txn_id"), "flag_us",
        F.col("as_of").alias("opened_us"),
        F.when(F.col("type") == "device_ring", "analyst_request").otherwise("risk_score").alias("trigger_type"),
        F.concat(text, F.lit(" Review transaction "), "seed_txn", F.lit(".")).alias("trigger_text"), "risk_score")
