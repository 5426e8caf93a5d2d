"""Episodes, burst detectors, rings and the monitor."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import asof as A
from ledgerlens.operators import bursts as B
from ledgerlens.operators import episodes as E
from ledgerlens.operators import features as X
from ledgerlens.operators import rings as R
from ledgerlens.params import DAY, TESTBED
from ledgerlens.plans import monitor as M
from ledgerlens.sources.testbed import START_US, Bank

from .asof import PROBES, device_probes
from .features import KEYED
from .prelude import DAY as D
from .prelude import HOUR as H
from .prelude import cases, full, led, led_alerts
from .registry import query

THRESHOLDS = (0.05, 0.1, 0.15, 0.2, 0.35)
EPISODES = f"""
  win AS (SELECT a.case_id, a.flagged_txn_id, th.threshold, l.TransactionID, l.us, l.TransactionAmt, l.p_txn
    FROM alerts a JOIN ledger l USING (customer_id) CROSS JOIN (SELECT unnest({list(THRESHOLDS)}) AS threshold) th
    WHERE l.us >= flag_us - {10 * D} AND l.us < opened_us AND (p_txn >= threshold OR TransactionID = flagged_txn_id))""", f"""
  gaps AS (SELECT *, us - lag(us) OVER (PARTITION BY case_id, threshold ORDER BY us, TransactionID) AS gap FROM win)""", f"""
  isl AS (SELECT *, sum(CASE WHEN gap <= {48 * H} THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, threshold
    ORDER BY us, TransactionID ROWS UNBOUNDED PRECEDING) AS island FROM gaps)""", """
  episodes AS (SELECT i.* FROM isl i JOIN isl f ON f.case_id = i.case_id AND f.threshold = i.threshold
    AND f.island = i.island AND f.TransactionID = f.flagged_txn_id)"""


@query("episode_rows", led_alerts("SELECT case_id, threshold::DOUBLE AS threshold, TransactionID FROM episodes", *EPISODES))
def episode_rows(spark, sf):
    b = Bank(spark, sf)
    return E.reconstruct(b.alerts, b.ledger, THRESHOLDS, TESTBED)


@query("episode_summary", led_alerts("""
  SELECT case_id, threshold::DOUBLE AS threshold, count(*) AS n, round(sum(abs(TransactionAmt)), 2) AS exposure,
    arg_min(TransactionID, us) AS first_id, min(us) AS first_us, max(us) AS last_us, max(p_txn) AS p_max,
    count(*) FILTER (p_txn >= 0.15) AS n_members FROM episodes GROUP BY ALL""", *EPISODES))
def episode_summary(spark, sf):
    b = Bank(spark, sf)
    return E.summarise(E.reconstruct(b.alerts, b.ledger, THRESHOLDS, TESTBED), b.ledger, TESTBED)


SMALL = "TransactionAmt < 5 AND channel = 'online'"
W = 168 * H
TESTING = f"""
  small AS (SELECT card_id, TransactionID, us FROM ledger WHERE {SMALL})""", f"""
  starts AS (SELECT s.card_id, s.us AS start_us, s.TransactionID AS start_id, count(*) AS n_tests, max(t.us) AS end_us
    FROM small s JOIN small t ON t.card_id = s.card_id AND t.us <= s.us + {W} AND (t.us, t.TransactionID) >= (s.us, s.TransactionID)
    GROUP BY ALL HAVING count(*) >= 3)""", f"""
  followed AS (SELECT s.*, l.us, l.TransactionID, l.TransactionAmt FROM starts s JOIN ledger l ON l.card_id = s.card_id
    AND l.us > s.end_us AND l.us <= s.end_us + {W} AND l.TransactionAmt >= 20)""", """
  first_start AS (SELECT card_id, min(start_us) AS start_us FROM followed GROUP BY 1)""", """
  testing AS (SELECT card_id, start_us, start_id, n_tests, end_us, arg_min(TransactionID, us) AS purchase,
      arg_min(TransactionAmt, us) AS purchase_amt, max(TransactionAmt) AS max_cleared, count(*) AS n_after, max(us) AS last_us
    FROM followed JOIN first_start USING (card_id, start_us) GROUP BY ALL)"""


@query("card_testing", led("SELECT * FROM testing", *TESTING))
def card_testing(spark, sf):
    return B.card_testing(Bank(spark, sf).ledger, ["card_id"], TESTBED)


@query("card_testing_rows", led(f"""
  SELECT t.card_id, s.TransactionID, 'test' AS role FROM testing t JOIN small s ON s.card_id = t.card_id
    AND (s.us, s.TransactionID) >= (t.start_us, t.start_id) AND s.us <= t.end_us
  UNION ALL SELECT t.card_id, l.TransactionID, CASE WHEN l.TransactionID = purchase THEN 'purchase' ELSE 'later' END
  FROM testing t JOIN ledger l ON l.card_id = t.card_id AND l.us > t.end_us AND l.us <= t.end_us + {W}
    AND l.TransactionAmt >= 20""", *TESTING))
def card_testing_rows(spark, sf):
    led_ = Bank(spark, sf).ledger
    return B.testing_rows(B.card_testing(led_, ["card_id"], TESTBED), led_, ["card_id"], TESTBED).select(
        "card_id", "TransactionID", "role")


BURSTS = """
  band AS (SELECT card_id, TransactionID, us, TransactionAmt AS amt FROM ledger WHERE channel = 'online'
    AND TransactionAmt >= 42.5 AND TransactionAmt < 50)""", f"""
  burst AS (SELECT s.card_id, s.us AS start_us, s.TransactionID AS start_id, max(t.us) AS end_us, count(*) AS n,
      round(sum(t.amt), 2) AS total, list_sort(list(t.amt)) AS amts
    FROM band s JOIN band t ON t.card_id = s.card_id AND t.us <= s.us + {W} AND (t.us, t.TransactionID) >= (s.us, s.TransactionID)
    GROUP BY ALL HAVING count(*) >= 3)""", """
  accepted AS (SELECT *, amts[1] AS low, amts[-1] AS high, round((end_us - start_us) / 60e6, 1) AS span_min FROM burst
    WHERE amts[-1] - amts[1] >= 0.5 AND NOT list_bool_or(list_transform(range(2, len(amts) + 1), lambda i: amts[i] - amts[i - 1] < 0.10)))""", """
  structuring AS (SELECT card_id, start_us, start_id, end_us, n, total, low, high, span_min FROM accepted
    QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY start_us, start_id) = 1)"""


@query("structuring_burst", led("SELECT * FROM structuring", *BURSTS))
def structuring_burst(spark, sf):
    return B.structuring(Bank(spark, sf).ledger, ["card_id"], TESTBED)


@query("structuring_rows", led(f"""
  SELECT s.card_id, b.TransactionID FROM structuring s JOIN band b ON b.card_id = s.card_id AND b.us <= s.end_us
    AND (b.us, b.TransactionID) >= (s.start_us, s.start_id)""", *BURSTS))
def structuring_rows(spark, sf):
    led_ = Bank(spark, sf).ledger
    return B.structuring_rows(B.structuring(led_, ["card_id"], TESTBED), led_, ["card_id"], TESTBED).select(
        "card_id", "TransactionID")


@query("recurring_charge", cases(f"""
  SELECT case_id, n_prior, n_monthly FROM (
    SELECT case_id, count(*) - 1 AS n_prior, count(*) FILTER (floor(gap / {D}) BETWEEN 1 AND 8) AS n_monthly FROM (
      SELECT case_id, us - lag(us) OVER (PARTITION BY case_id ORDER BY us) AS gap FROM (
        SELECT f.TransactionID AS case_id, h.us FROM keyed f JOIN keyed h ON h.customer_id = f.customer_id
          AND h.ProductCD = f.ProductCD AND h.us >= f.us - {120 * D} AND h.us < f.us
          AND abs(h.TransactionAmt - f.TransactionAmt) <= 0.25 * f.TransactionAmt
        UNION ALL SELECT TransactionID, us FROM keyed)) GROUP BY 1)
  WHERE n_prior >= 2 AND n_monthly >= 2""", *KEYED))
def recurring_charge(spark, sf):
    """Every ledger row as a disputed charge, with the customer standing in for the cardholder key."""
    rows = Bank(spark, sf).ledger.withColumn("uid", F.col("customer_id"))
    probes = rows.select(F.col("TransactionID").alias("case_id"), "uid", "ProductCD", "TransactionAmt",
                         F.col("us").alias("flag_us"), (F.col("us") - 120 * DAY).alias("start_us"), F.col("us").alias("end_us"))
    return B.recurring(probes, rows, TESTBED)


@query("ring_candidates", led("""
  SELECT device_profile_id, count(DISTINCT customer_id) AS n_customers, count(DISTINCT card_id) AS n_cards, count(*) AS n_txns,
    count(*) FILTER (id_15 = 'New' AND id_23 IS NOT NULL) AS n_new_proxy, min(us) AS first_us, max(us) AS last_us,
    arg_max(TransactionID, us) AS seed_txn
  FROM ledger WHERE device_profile_id IS NOT NULL GROUP BY 1
  HAVING n_customers >= 3 AND n_new_proxy / n_txns >= 0.25"""))
def ring_candidates(spark, sf):
    return R.ring_candidates(Bank(spark, sf).ledger, TESTBED)


@query("ring_candidates_top", led("""
  SELECT device_profile_id, count(DISTINCT customer_id) AS n_customers FROM ledger WHERE device_profile_id IS NOT NULL
  GROUP BY 1 HAVING n_customers >= 3 AND count(*) FILTER (id_15 = 'New' AND id_23 IS NOT NULL) * 4 >= count(*)
  ORDER BY n_customers DESC, device_profile_id LIMIT 3"""))
def ring_candidates_top(spark, sf):
    return R.ring_candidates(Bank(spark, sf).ledger, TESTBED).orderBy(F.desc("n_customers"), "device_profile_id").limit(
        3).select("device_profile_id", "n_customers")


RINGS = """
  nb AS (SELECT p.case_id, p.device_profile_id, as_of, l.* EXCLUDE (device_profile_id) FROM probes p
    JOIN ledger l USING (device_profile_id) WHERE l.us >= start_us AND l.us < end_us)""", """
  rings AS (SELECT case_id, device_profile_id, as_of, count(*) AS n_txns, count(DISTINCT customer_id) AS n_customers,
      count(DISTINCT card_id) AS n_cards, count(*) FILTER (id_15 = 'New') AS n_new, count(id_23) AS n_proxy,
      count(*) FILTER (id_15 = 'New' AND id_23 IS NOT NULL) AS n_new_proxy, avg(p_txn) AS mean_score, max(id_23) AS proxy
    FROM nb GROUP BY ALL
    HAVING n_customers >= 3 AND (n_new_proxy / n_txns >= 0.25 OR (mean_score >= 0.09
      AND split_part(device_profile_id, '|', 1) NOT IN ('UNK', 'Windows', 'MacOS', 'iOS Device', 'Trident/7.0')
      AND split_part(device_profile_id, '|', 2) <> 'UNK' AND split_part(device_profile_id, '|', 4) <> 'UNK')))"""


@query("device_rings", led_alerts("""
  SELECT case_id, device_profile_id, n_txns, n_customers, n_cards, n_new_proxy, round(mean_score, 6) AS mean_score,
    concat_ws(', ', CASE WHEN n_new / n_txns >= 0.25 THEN 'marked New for every account' END,
      CASE WHEN n_proxy > 0 AND n_proxy >= 0.25 * n_txns THEN 'behind a proxy (' || lower(replace(proxy, 'IP_PROXY:', '')) || ')' END) AS anomaly
  FROM rings""", PROBES, *RINGS))
def device_rings(spark, sf):
    b = Bank(spark, sf)
    return R.device_rings(device_probes(b), b.ledger, TESTBED).select(
        "case_id", "device_profile_id", "n_txns", "n_customers", "n_cards", "n_new_proxy",
        F.round("mean_score", 6).alias("mean_score"), "anomaly")


@query("device_ring_members", led_alerts("SELECT DISTINCT case_id, customer_id, card_id FROM nb SEMI JOIN rings USING (case_id)",
                                         PROBES, *RINGS))
def device_ring_members(spark, sf):
    b = Bank(spark, sf)
    p = device_probes(b)
    rings = R.device_rings(p, b.ledger, TESTBED).join(p.select("case_id", "as_of"), "case_id")
    return R.ring_members(rings, b.ledger, TESTBED)


@query("structuring_ring", led_alerts(f"""
  SELECT DISTINCT case_id, card_id FROM ring_hits r
  WHERE EXISTS (SELECT 1 FROM ring_hits o JOIN alerts a ON a.case_id = o.case_id WHERE o.case_id = r.case_id AND o.card_id <> a.card_id)""",
  *BURSTS[:1], f"""
  scoped AS (SELECT a.case_id, b.* FROM alerts a JOIN band b ON b.us >= opened_us - {30 * D} AND b.us < opened_us)""", f"""
  ring_hits AS (SELECT case_id, card_id FROM (SELECT s.case_id, s.card_id, s.us, s.TransactionID, list_sort(list(t.amt)) AS amts
    FROM scoped s JOIN scoped t ON t.case_id = s.case_id AND t.card_id = s.card_id AND t.us <= s.us + {W}
      AND (t.us, t.TransactionID) >= (s.us, s.TransactionID) GROUP BY ALL HAVING count(*) >= 3)
    WHERE amts[-1] - amts[1] >= 0.5 AND NOT list_bool_or(list_transform(range(2, len(amts) + 1), lambda i: amts[i] - amts[i - 1] < 0.10)))"""))
def structuring_ring(spark, sf):
    b = Bank(spark, sf)
    a = b.alerts.select("case_id", F.col("card_id").alias("own_card"), F.col("opened_us").alias("as_of"))
    return R.structuring_ring(a, b.ledger, TESTBED)


@query("structuring_precedents", cases("""
  SELECT case_id, rank FROM (SELECT case_id, row_number() OVER (ORDER BY closed_us, case_id) AS rank FROM closed
    WHERE pattern = 'undocumented' AND contains(analyst_notes, 'just under $500')) WHERE rank <= 4"""))
def structuring_precedents(spark, sf):
    p = R.structuring_precedents(Bank(spark, sf).closed)
    return p.select(F.posexplode("precedents")).select(F.col("col.case_id").alias("case_id"),
                                                       (F.col("pos") + 1).cast("bigint").alias("rank"))


SPAN = f"us >= {START_US} AND us < {START_US + 30 * D}"
MONITOR = f"""
  found AS (
    SELECT 'device_ring' AS type, replace(device_profile_id, '|', ' | ') AS element, count(*) AS n_txns,
      count(DISTINCT customer_id) AS n_customers, count(DISTINCT card_id) AS n_cards, NULL::DOUBLE AS total, NULL::DOUBLE AS score,
      min(us) AS first_us, max(us) AS last_us, arg_max(TransactionID, us) AS seed_txn
    FROM ledger WHERE device_profile_id IS NOT NULL GROUP BY device_profile_id
    HAVING count(DISTINCT customer_id) >= 3 AND count(*) FILTER (id_15 = 'New' AND id_23 IS NOT NULL) / count(*) >= 0.25
    UNION ALL
    SELECT 'structuring', s.card_id, n, 1, 1, total, NULL, start_us, end_us, b.TransactionID
    FROM structuring s JOIN band b ON b.card_id = s.card_id AND b.us = s.end_us
    UNION ALL
    SELECT 'card_testing', card_id, n_tests + n_after, 1, 1, NULL, round(p, 3), start_us, last_us, purchase FROM (
      SELECT t.*, l.p_txn AS p FROM testing t JOIN ledger l ON l.TransactionID = t.purchase WHERE l.p_txn >= 0.05
      ORDER BY l.p_txn DESC, t.card_id LIMIT 10))"""


@query("monitor_alerts", led(f"""
  SELECT 'MON-' || lpad(CAST(row_number() OVER (ORDER BY last_us, type, element) AS VARCHAR), 3, '0') AS alert_id, *,
    last_us + {H} AS as_of FROM found""", *TESTING, *BURSTS, MONITOR))
def monitor_alerts(spark, sf):
    return M.monitor_alerts(Bank(spark, sf).ledger, START_US, START_US + 30 * DAY, TESTBED)


@query("monitor_seed_alerts", led(f"""
  SELECT customer_id, card_id, seed_txn AS flagged_txn_id, last_us + {H} AS opened_us,
    CASE WHEN type = 'device_ring' THEN 'analyst_request' ELSE 'risk_score' END AS trigger_type
  FROM found JOIN ledger ON TransactionID = seed_txn""", *TESTING, *BURSTS, MONITOR))
def monitor_seed_alerts(spark, sf):
    led_ = Bank(spark, sf).ledger
    a = M.monitor_alerts(led_, START_US, START_US + 30 * DAY, TESTBED)
    return M.alerts_to_cases(a, led_).select("customer_id", "card_id", "flagged_txn_id", "opened_us", "trigger_type")
