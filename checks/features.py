"""Behaviour features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import asof as A
from ledgerlens.operators import features as X
from ledgerlens.params import DEFAULT
from ledgerlens.sources.testbed import Bank

from .prelude import DAY, HOUR, cases, full
from .registry import query

KEYED = """labels AS (SELECT TransactionID, min(closed_us) AS closed_us FROM case_txns JOIN closed USING (case_id)
    WHERE outcome = 'confirmed_fraud' GROUP BY 1)""", """
  keyed AS (SELECT *, card_id || '_' || coalesce(addr1, 'na') || '_' ||
      CAST(CAST(floor(TransactionDT / 86400) - coalesce(D1, -999) AS BIGINT) AS VARCHAR) AS uid FROM ledger)""", """
  kr AS (SELECT *, uid || '_' || coalesce(P_emaildomain, 'na') AS uid2, closed_us IS NOT NULL AS y
    FROM keyed LEFT JOIN labels USING (TransactionID))"""


def features_of(bank, **kw):
    if kw:
        return X.build_features(bank.ledger, bank.closed, bank.case_txns, **kw)
    if not hasattr(bank, "_features"):
        bank._features = X.build_features(bank.ledger, bank.closed, bank.case_txns)
    return bank._features


def _profile(k):
    return f"""SELECT TransactionID, row_number() OVER w - 1 AS n_prev,
      round(TransactionAmt / nullif(avg(TransactionAmt) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS amt_ratio,
      (us - lag(us) OVER w) / 1e6 AS dt_prev,
      (SELECT count(*) FROM kr f WHERE f.y AND f.{k} = kr.{k} AND f.closed_us < kr.us) AS known_fraud
    FROM kr WINDOW w AS (PARTITION BY {k} ORDER BY us, TransactionID)"""


def _profile_query(k):
    def run(spark, sf):
        f = features_of(Bank(spark, sf))
        return f.select("TransactionID", F.col(f"n_prev_{k}").alias("n_prev"), F.round(f"amt_ratio_{k}", 6).alias("amt_ratio"),
                        F.col(f"dt_prev_{k}").alias("dt_prev"), F.col(f"known_fraud_{k}").alias("known_fraud"))
    return run


for _k in ("uid", "uid2", "customer_id"):
    query(f"profile_features_{_k}", cases(_profile(_k), *KEYED))(_profile_query(_k))


@query("known_fraud_card", cases("""SELECT TransactionID, (SELECT count(*) FROM kr f WHERE f.y AND f.card_id = kr.card_id
  AND f.closed_us < kr.us) AS known FROM kr""", *KEYED))
def known_fraud_card(spark, sf):
    b = Bank(spark, sf)
    labels = X.label_table(b.closed, b.case_txns).join(b.ledger.select("TransactionID", "card_id"), "TransactionID")
    return A.known_before(b.ledger.select("TransactionID", "card_id", "us"), labels, "card_id", "known").select(
        "TransactionID", "known")


@query("velocity_features", cases(f"""
  SELECT TransactionID, count(*) OVER (w RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) - 1 AS vel1h,
    count(*) OVER (w RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW) - 1 AS vel24h,
    sum((TransactionAmt < 5 AND channel = 'online')::INT) OVER (w RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)::BIGINT AS small1h,
    CASE WHEN device_profile_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY device_profile_id ORDER BY us
      RANGE BETWEEN {7 * DAY - 1} PRECEDING AND CURRENT ROW) END AS dev_txn7d
  FROM ledger WINDOW w AS (PARTITION BY customer_id ORDER BY us)"""))
def velocity_features(spark, sf):
    return features_of(Bank(spark, sf)).select("TransactionID", "vel1h", "vel24h", "small1h", "dev_txn7d")


@query("novelty_features", cases("""
  SELECT TransactionID, """ + ", ".join(
    f"(row_number() OVER (PARTITION BY customer_id, coalesce({c}, 'NA') ORDER BY us, TransactionID) > 1)::INT AS seen_{c}"
    for c in X.SEEN) + """, (device_profile_id IS NOT NULL AND device_profile_id NOT LIKE '%UNK%')::INT AS dev_specific,
    round_even((TransactionAmt * 100) % 100, 0) AS cents, hour(make_timestamp(us)) AS hour, TRY_CAST(addr1 AS DOUBLE) AS addr1n,
    y::INT AS y, uid, uid2 FROM kr""", *KEYED))
def novelty_features(spark, sf):
    return features_of(Bank(spark, sf)).select("TransactionID", *[f"seen_{c}" for c in X.SEEN], "dev_specific", "cents",
                                               "hour", "addr1n", "y", "uid", "uid2")


@query("label_table", cases("""SELECT TransactionID, min(closed_us) AS closed_us FROM case_txns JOIN closed USING (case_id)
  WHERE outcome = 'confirmed_fraud' AND opened_us < 1705276800000000 GROUP BY 1"""))
def label_table(spark, sf):
    b = Bank(spark, sf)
    return X.label_table(b.closed, b.case_txns, opened_before=1_705_276_800_000_000).select("TransactionID", "closed_us")


def flagged(bank, f):
    """Alerts with the columns of their flagged row in ``f``."""
    return bank.alerts.select("case_id", "flagged_txn_id", "flag_us", "opened_us", "trigger_type", "trigger_text").join(
        f.drop("opened_us"), F.col("flagged_txn_id") == F.col("TransactionID"))


@query("recency_flags", full(f"""
  SELECT a.case_id, count(h.us) AS hist_n, count(*) FILTER (h.uid = f.uid) AS uid_hist_n,
    count(*) FILTER (h.us < flag_us - {14 * DAY}) AS old_n,
    coalesce(bool_or(h.addr1 = f.addr1), false)::INT AS seen_region,
    coalesce(bool_or(h.addr1 = f.addr1 AND h.uid = f.uid), false)::INT AS seen_uid_region,
    coalesce(bool_or(h.device_profile_id = f.device_profile_id AND h.us < flag_us - {14 * DAY}), false)::INT AS seen_dev,
    coalesce(bool_or(h.addr1 = f.addr1 AND h.card_id = f.card_id AND h.us < flag_us - {14 * DAY}), false)::INT AS seen_card_region,
    round(median(h.TransactionAmt) FILTER (h.uid = f.uid), 6) AS typical_amt
  FROM alerts a JOIN kr f ON f.TransactionID = a.flagged_txn_id
  LEFT JOIN kr h ON h.customer_id = a.customer_id AND h.us >= flag_us - {120 * DAY} AND h.us < flag_us
  GROUP BY a.case_id, f.uid""", *KEYED))
def recency_flags(spark, sf):
    b = Bank(spark, sf)
    keyed = X.with_cardholder_keys(b.ledger)
    return X.recency_flags(flagged(b, keyed), keyed, DEFAULT).withColumn("typical_amt", F.round("typical_amt", 6))
