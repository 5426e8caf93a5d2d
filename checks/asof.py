"""As-of bounded retrieval and look-ups."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import asof as A
from ledgerlens.params import DAY, TESTBED
from ledgerlens.sources.testbed import START_US, Bank

from .prelude import DAY as D
from .prelude import full, led, led_alerts
from .registry import query


@query("txn_context", led_alerts("SELECT case_id, l.TransactionID, TransactionAmt, device_profile_id, channel "
                                 "FROM alerts a JOIN ledger l ON l.TransactionID = a.flagged_txn_id"))
def txn_context(spark, sf):
    b = Bank(spark, sf)
    return A.txn_context(b.alerts, b.ledger).select("case_id", "TransactionID", "TransactionAmt", "device_profile_id", "channel")


@query("card_window", led_alerts(f"""
  SELECT case_id, TransactionID, l.us FROM alerts a JOIN ledger l USING (customer_id)
  WHERE l.us >= flag_us - {10 * D} AND l.us < opened_us"""))
def card_window(spark, sf):
    b = Bank(spark, sf)
    return A.card_window(A.lookback(b.alerts), b.ledger).select("case_id", "TransactionID", "us")


@query("cardholder_baseline", led_alerts(f"""
  SELECT case_id, count(l.us) AS n_txns, round(avg(TransactionAmt), 6) AS avg_amount, count(DISTINCT addr1) AS n_regions,
    count(DISTINCT device_profile_id) AS n_devices, count(DISTINCT ProductCD) AS n_products
  FROM alerts a LEFT JOIN ledger l ON l.customer_id = a.customer_id AND l.us >= flag_us - {120 * D} AND l.us < flag_us
  GROUP BY 1"""))
def cardholder_baseline(spark, sf):
    b = Bank(spark, sf)
    return A.baseline_summary(A.baseline(b.alerts), b.ledger).withColumn("avg_amount", F.round("avg_amount", 6))


@query("cardholder_baseline_rows", led_alerts(f"""
  SELECT case_id, TransactionID FROM alerts a JOIN ledger l USING (customer_id)
  WHERE l.us >= flag_us - {120 * D} AND l.us < flag_us"""))
def cardholder_baseline_rows(spark, sf):
    b = Bank(spark, sf)
    return A.card_window(A.baseline(b.alerts), b.ledger).select("case_id", "TransactionID")


def device_probes(b, back=30 * DAY):
    return A.txn_context(b.alerts, b.ledger).filter(F.col("device_profile_id").isNotNull()).join(
        b.alerts.select("case_id", "opened_us"), "case_id").select(
        "case_id", "device_profile_id", F.col("opened_us").alias("as_of"),
        (F.col("opened_us") - back).alias("start_us"), F.col("opened_us").alias("end_us"))


PROBES = f"""probes AS (SELECT a.case_id, l.device_profile_id, opened_us AS as_of, opened_us - {30 * D} AS start_us,
  opened_us AS end_us FROM alerts a JOIN ledger l ON l.TransactionID = a.flagged_txn_id WHERE l.device_profile_id IS NOT NULL)"""


@query("device_neighbors", led_alerts("""
  SELECT p.case_id, p.device_profile_id, count(*) AS n_txns, count(DISTINCT card_id) AS n_cards,
    count(DISTINCT customer_id) AS n_customers, count(*) FILTER (id_15 = 'New') AS n_new,
    count(*) FILTER (id_23 IS NOT NULL) AS n_proxy, count(*) FILTER (id_15 = 'New' AND id_23 IS NOT NULL) AS n_new_proxy,
    round(avg(p_txn), 6) AS mean_score
  FROM probes p JOIN ledger l USING (device_profile_id) WHERE l.us >= start_us AND l.us < end_us GROUP BY ALL""", PROBES))
def device_neighbors(spark, sf):
    b = Bank(spark, sf)
    return A.device_totals(device_probes(b), b.ledger, 30 * DAY).withColumn("mean_score", F.round("mean_score", 6))


@query("device_neighbor_rows", led_alerts("""
  SELECT p.case_id, TransactionID FROM probes p JOIN ledger l USING (device_profile_id)
  WHERE l.us >= start_us AND l.us < end_us""", PROBES))
def device_neighbor_rows(spark, sf):
    b = Bank(spark, sf)
    return A.device_neighbors(device_probes(b), b.ledger).select("case_id", "TransactionID")


@query("population_window", led(f"SELECT TransactionID FROM ledger WHERE us >= {START_US + 7 * D} AND us < {START_US + 9 * D}"))
def population_window(spark, sf):
    return A.population_window(Bank(spark, sf).ledger, START_US + 7 * DAY, START_US + 9 * DAY).select("TransactionID")


@query("prior_cases", full("""
  SELECT a.case_id AS alert_id, c.case_id, outcome FROM alerts a JOIN closed c USING (customer_id)
  WHERE closed_us < a.opened_us"""))
def prior_cases(spark, sf):
    b = Bank(spark, sf)
    return A.prior_cases(b.alerts, b.closed).select("alert_id", "case_id", "outcome")


@query("device_case_links", full(f"""
  SELECT DISTINCT p.case_id, p.device_profile_id, c.case_id AS closed_case FROM probes p
  JOIN ledger l USING (device_profile_id) JOIN case_txns m ON m.TransactionID = l.TransactionID
  JOIN closed c ON c.case_id = m.case_id
  WHERE outcome = 'confirmed_fraud' AND closed_us < as_of AND l.us >= as_of - {5 * D} AND l.us < as_of""", PROBES))
def device_case_links(spark, sf):
    b = Bank(spark, sf)
    return A.device_case_links(device_probes(b), b.closed, b.case_txns, b.ledger, lookback_us=5 * DAY)


@query("device_case_links_any_outcome", full("""
  SELECT DISTINCT p.case_id, p.device_profile_id, c.case_id AS closed_case FROM probes p
  JOIN ledger l USING (device_profile_id) JOIN case_txns m ON m.TransactionID = l.TransactionID
  JOIN closed c ON c.case_id = m.case_id WHERE closed_us < as_of""", PROBES))
def device_case_links_any(spark, sf):
    b = Bank(spark, sf)
    return A.device_case_links(device_probes(b), b.closed, b.case_txns, b.ledger, confirmed_only=False)


@query("population_structuring_sweep", led(f"""
  SELECT card_id, TransactionID, us, TransactionAmt FROM ledger WHERE channel = 'online' AND TransactionAmt >= 42.5
    AND TransactionAmt < 50 AND us >= {START_US} AND us < {START_US + 30 * D}"""))
def population_structuring_sweep(spark, sf):
    return A.structuring_sweep(Bank(spark, sf).ledger, START_US, START_US + 30 * DAY, TESTBED)


@query("population_structuring_counts", led(f"""
  SELECT card_id, count(*) AS n FROM ledger WHERE channel = 'online' AND TransactionAmt >= 42.5
    AND TransactionAmt < 50 AND us >= {START_US} AND us < {START_US + 30 * D} GROUP BY 1"""))
def population_structuring_counts(spark, sf):
    s = A.structuring_sweep(Bank(spark, sf).ledger, START_US, START_US + 30 * DAY, TESTBED)
    return s.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))


@query("card_transactions", led("""
  SELECT card_id, TransactionID, rank FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY us, TransactionID) AS rank
  FROM ledger) WHERE rank <= 10"""))
def card_transactions(spark, sf):
    led_ = Bank(spark, sf).ledger
    return A.card_transactions(led_, led_, 10).select("card_id", "TransactionID", F.col("rank").cast("bigint").alias("rank"))


@query("customer_transactions", led("""
  SELECT customer_id, TransactionID, rank FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY us DESC, TransactionID DESC) AS rank FROM ledger) WHERE rank <= 25"""))
def customer_transactions(spark, sf):
    led_ = Bank(spark, sf).ledger
    return A.customer_transactions(led_, led_, 25).select("customer_id", "TransactionID", F.col("rank").cast("bigint").alias("rank"))


@query("customer_cards", led("SELECT DISTINCT customer_id, card_id FROM ledger"))
def customer_cards(spark, sf):
    return A.customer_cards(Bank(spark, sf).ledger)


@query("device_cards", led("SELECT device_profile_id, card_id, count(*) AS n_txns FROM ledger "
                           "WHERE device_profile_id IS NOT NULL GROUP BY ALL"))
def device_cards(spark, sf):
    return A.cards_of(Bank(spark, sf).ledger, "device_profile_id")


@query("region_cards", led("SELECT addr1, card_id, count(*) AS n_txns FROM ledger WHERE addr1 IS NOT NULL GROUP BY ALL"))
def region_cards(spark, sf):
    return A.cards_of(Bank(spark, sf).ledger, "addr1")


def _shared(key, group):
    return led(f"""SELECT a.{group} AS set_id, l.{key}, count(DISTINCT l.card_id) AS card_count
      FROM (SELECT DISTINCT {group}, card_id FROM ledger WHERE {group} IS NOT NULL) a JOIN ledger l USING (card_id)
      WHERE l.{key} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT l.card_id) > 1""")


@query("shared_devices", _shared("device_profile_id", "DeviceType"))
def shared_devices(spark, sf):
    led_ = Bank(spark, sf).ledger
    sets = led_.filter(F.col("DeviceType").isNotNull()).select(F.col("DeviceType").alias("set_id"), "card_id")
    return A.shared_among(sets, led_, "device_profile_id")


@query("shared_regions", _shared("addr1", "customer_id"))
def shared_regions(spark, sf):
    led_ = Bank(spark, sf).ledger
    return A.shared_among(led_.select(F.col("customer_id").alias("set_id"), "card_id"), led_, "addr1")


@query("closed_cases_by_card", full("SELECT a.case_id AS alert_id, c.case_id FROM alerts a JOIN closed c USING (card_id)"))
def closed_by_card(spark, sf):
    b = Bank(spark, sf)
    return b.alerts.select(F.col("case_id").alias("alert_id"), "card_id").join(
        b.closed.select("case_id", "card_id"), "card_id").select("alert_id", "case_id")


@query("closed_cases_by_device", full("""
  SELECT DISTINCT device_profile_id, case_id, outcome, pattern FROM case_txns JOIN closed USING (case_id)
  JOIN ledger USING (TransactionID) WHERE device_profile_id IS NOT NULL"""))
def closed_by_device(spark, sf):
    b = Bank(spark, sf)
    return A.closed_by_device(b.closed, b.case_txns, b.ledger)


@query("similar_cases", full("""
  SELECT alert_id, case_id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY similarity DESC, case_id) AS rank FROM (
      SELECT a.case_id AS alert_id, c.case_id, round(0.3 * (a.customer_id = c.customer_id)::INT + 0.3 * (a.card_id = c.card_id)::INT
        + 0.2 * (c.pattern = 'card_testing')::INT, 6) AS similarity
      FROM alerts a JOIN closed c ON a.customer_id = c.customer_id OR a.card_id = c.card_id) WHERE similarity > 0.2)
  WHERE rank <= 10"""))
def similar_cases(spark, sf):
    b = Bank(spark, sf)
    return A.similar_cases(b.alerts.withColumn("pattern", F.lit("card_testing")), b.closed).select(
        "alert_id", "case_id", "similarity", F.col("rank").cast("bigint").alias("rank"))


@query("card_velocity", led(f"""
  SELECT card_id, latest_us, count(*) AS n, round(sum(TransactionAmt), 6) AS total, round(avg(TransactionAmt), 6) AS avg_amount
  FROM ledger JOIN (SELECT card_id, max(us) AS latest_us FROM ledger GROUP BY 1) USING (card_id)
  WHERE us >= latest_us - {D} GROUP BY ALL"""))
def card_velocity(spark, sf):
    return A.velocity(Bank(spark, sf).ledger).withColumns(
        {"total": F.round("total", 6), "avg_amount": F.round("avg_amount", 6)})


@query("earlier_investigations", led_alerts("""
  SELECT case_id, earlier_id, string_agg(why, '; ' ORDER BY rank) AS why FROM (
    SELECT a.case_id, m.case_id AS earlier_id, 1 AS rank, 'card ' || a.card_id AS why FROM alerts a JOIN alerts m USING (card_id)
    UNION ALL SELECT a.case_id, m.case_id, 2, 'device profile' FROM dev a JOIN dev m USING (device_profile_id)
    UNION ALL SELECT a.case_id, m.case_id, 3, 'same customer' FROM alerts a JOIN alerts m USING (customer_id))
  WHERE case_id <> earlier_id GROUP BY ALL""", """
  dev AS (SELECT a.case_id, l.device_profile_id FROM alerts a JOIN ledger l ON l.TransactionID = a.flagged_txn_id
    WHERE l.device_profile_id IS NOT NULL AND l.device_profile_id NOT LIKE '%UNK%'
    AND split_part(l.device_profile_id, '|', 1) NOT IN ('Windows', 'MacOS', 'iOS Device'))"""))
def earlier_investigations(spark, sf):
    b = Bank(spark, sf)
    d = F.col("device_profile_id")
    ctx = A.txn_context(b.alerts, b.ledger)
    dev = ctx.filter(C.is_specific_device(d) & ~d.contains("UNK")).select("case_id", d)
    cards = b.alerts.select("case_id", "customer_id", F.array("card_id").alias("cards"))
    memory = cards.join(dev, "case_id", "left").select("case_id", "customer_id", "cards", F.array_compact(F.array(d)).alias("devices"))
    return A.earlier_investigations(cards, dev, memory)
