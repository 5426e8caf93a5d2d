"""SQL statement of the derived ledger, written independently of the Spark code, for DuckDB."""
from __future__ import annotations

HOUR = 3_600_000_000
DAY = 24 * HOUR

LEDGER = f"""
base AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, epoch_us(ts) AS us,
         event_type <> 'purchase' AS online FROM events),
parts AS (
  SELECT CAST(event_id AS VARCHAR) AS TransactionID, us,
    CAST(floor((us - 1704067200000000) / 1000000) AS BIGINT) AS TransactionDT, value AS TransactionAmt,
    CASE event_type WHEN 'purchase' THEN 'W' WHEN 'click' THEN 'C' WHEN 'view' THEN 'H'
                    WHEN 'signup' THEN 'R' ELSE 'S' END AS ProductCD,
    CASE WHEN online THEN 'online' ELSE 'in_person' END AS channel,
    'C' || lpad(CAST(user_id AS VARCHAR), greatest(5, length(CAST(user_id AS VARCHAR)))::INT, '0') AS customer_id,
    CAST(k % 2 AS VARCHAR) AS card2, CASE WHEN k % 5 = 0 THEN 'debit' ELSE 'credit' END AS card6,
    least(1.0, value / 100) AS risk_score, least(1.0, value / 100) AS p_txn,
    CASE WHEN k % 23 <> 7 THEN CAST(k % 8 + 100 AS VARCHAR) END AS addr1,
    ['87', '60', '87'][k % 3 + 1] AS addr2, CAST(k % 9 AS DOUBLE) AS dist1,
    ['gmail.com', 'yahoo.com', 'hotmail.com', NULL, 'anonymous.com'][k % 5 + 1] AS P_emaildomain,
    [NULL, NULL, NULL, 'gmail.com', 'yahoo.com', 'icloud.com', 'mail.com'][k % 7 + 1] AS R_emaildomain,
    CAST(k % 4 AS DOUBLE) AS C1, CAST(k % 6 AS DOUBLE) AS C2,
    CASE WHEN k % 11 <> 0 THEN CAST(k % 30 AS DOUBLE) END AS D1,
    ['M0', 'M1', 'M2'][k % 3 + 1] AS M4, ['T', 'F'][k % 2 + 1] AS M6,
    CASE WHEN online THEN CASE WHEN event_type = 'signup' THEN 'New' ELSE 'Found' END END AS id_15,
    CASE WHEN online AND k % 10 = 0 THEN
      CASE WHEN k % 20 = 0 THEN 'IP_PROXY:ANONYMOUS' ELSE 'IP_PROXY:TRANSPARENT' END END AS id_23,
    CASE WHEN online THEN CASE WHEN k % 2 = 0 THEN 'desktop' ELSE 'mobile' END END AS DeviceType,
    CASE WHEN online AND NOT (k % 7 = 6 AND k % 4 = 3 AND k % 3 = 2 AND k % 5 >= 3) THEN
      ['SM-G950U', 'Windows', 'MacOS', 'iOS Device', 'SM-J700M', 'moto g', 'UNK'][k % 7 + 1] || '|' ||
      ['Android 8.0', 'Windows 10', 'iOS 11.2', 'UNK'][k % 4 + 1] || '|' ||
      ['chrome 62.0', 'safari', 'UNK'][k % 3 + 1] || '|' ||
      ['2220x1080', '1920x1080', '1334x750', 'UNK', 'UNK'][k % 5 + 1] END AS device_profile_id,
    k FROM base),
tuples AS (
  SELECT customer_id, card2, card6,
    customer_id || '-K' || row_number() OVER (PARTITION BY customer_id ORDER BY card2, card6) AS card_id
  FROM (SELECT DISTINCT customer_id, card2, card6 FROM parts)),
ledger AS (
  SELECT parts.* EXCLUDE (card2, card6), card_id, device_profile_id IS NOT NULL AS has_device_record
  FROM parts JOIN tuples USING (customer_id, card2, card6))"""

CASES = LEDGER + f""",
err AS (
  SELECT *, us - lag(us) OVER (PARTITION BY customer_id ORDER BY us, TransactionID) AS gap
  FROM ledger WHERE ProductCD = 'S'),
case_rows AS (
  SELECT * EXCLUDE gap, sum(CASE WHEN gap <= {48 * HOUR} THEN 0 ELSE 1 END)
    OVER (PARTITION BY customer_id ORDER BY us, TransactionID ROWS UNBOUNDED PRECEDING) AS island FROM err),
closed_raw AS (
  SELECT customer_id, island, arg_min(TransactionID, us) AS first_id, arg_min(card_id, us) AS card_id,
    arg_min(k, us) AS k, max(us) AS last_us, count(*) AS n_txns,
    round(sum(abs(TransactionAmt)), 2) AS exposure_usd, list_sort(list_distinct(list(card_id))) AS cards
  FROM case_rows GROUP BY ALL),
closed AS (
  SELECT 'CC-' || first_id AS case_id, customer_id, island, card_id, last_us + {DAY} AS opened_us,
    last_us + {3 * DAY} AS closed_us,
    CASE WHEN exposure_usd >= 20 THEN 'confirmed_fraud' ELSE 'cleared' END AS outcome,
    CASE WHEN exposure_usd >= 20 THEN ['card_testing', 'card_not_present_fraud', 'card_not_present_new_device',
      'out_of_region_use', 'account_takeover', 'undocumented'][k % 6 + 1] ELSE 'none' END AS pattern,
    first_id AS first_fraud_txn_id, n_txns, exposure_usd,
    list_filter(cards, lambda c: c <> card_id) AS connected_card_ids,
    CASE WHEN exposure_usd >= 20 THEN 'BLOCK_CARD and CREATE_CASE' ELSE 'CLOSE_NO_FRAUD' END AS actions_taken,
    CASE WHEN exposure_usd > 50 THEN 'Yes' ELSE 'No' END AS report_filed,
    CASE WHEN exposure_usd >= 20 AND k % 6 = 5 THEN 'several online purchases just under $500 within an hour'
         WHEN exposure_usd >= 20 THEN 'customer denied the purchases and the card was blocked'
         ELSE 'customer confirmed the transaction while travelling' END AS analyst_notes
  FROM closed_raw),
case_txns AS (
  SELECT case_id, TransactionID FROM case_rows JOIN closed USING (customer_id, island))"""

ALERTS = f""",
alert_pick AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY md5(TransactionID)) AS rn FROM ledger),
alerts AS (
  SELECT 'AL-' || TransactionID AS case_id, customer_id, card_id, TransactionID AS flagged_txn_id, us AS flag_us,
    us + {HOUR} AS opened_us, ['risk_score', 'customer_report', 'analyst_request'][k % 3 + 1] AS trigger_type,
    'Real-time model scored transaction ' || TransactionID AS trigger_text, risk_score
  FROM alert_pick WHERE rn = 1)"""


def led(sql: str, *ctes: str) -> str:
    return _assemble(LEDGER, sql, ctes)


def led_alerts(sql: str, *ctes: str) -> str:
    return _assemble(LEDGER + ALERTS, sql, ctes)


def cases(sql: str, *ctes: str) -> str:
    return _assemble(CASES, sql, ctes)


def full(sql: str, *ctes: str) -> str:
    return _assemble(CASES + ALERTS, sql, ctes)


def _assemble(prelude: str, sql: str, ctes: tuple) -> str:
    return "WITH RECURSIVE " + ",\n".join([prelude.strip(), *[c.strip() for c in ctes]]) + "\n" + sql.strip()
