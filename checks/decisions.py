"""Policy tables and the probability chain over case states derived from every ledger row."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import assess as S
from ledgerlens.operators import policy as P
from ledgerlens.operators import policy_v1 as V1
from ledgerlens.params import DEFAULT
from ledgerlens.sources.testbed import Bank, pick

from .prelude import led
from .registry import query


def states(spark, sf):
    """One case state per ledger row; its fields cycle through every combination of branches."""
    led_ = Bank(spark, sf).ledger
    b, k, amount = F.col("TransactionDT"), F.col("k"), F.col("TransactionAmt")
    part = lambda d, m: (F.floor(b / d) % m).cast("int")
    return led_.select(
        "TransactionID", F.col("TransactionID").alias("case_id"), amount.alias("flagged_amount"), "p_txn", "risk_score", "k",
        ((b % 100) / 100).alias("p"), pick(part(100, 3), "fraud", "legitimate", "uncertain").alias("verdict"),
        F.round(amount * (k % 9) * 20, 2).alias("exposure"),
        pick(part(300, 4), "none", "card_testing", "card_not_present_fraud", "undocumented").alias("pattern"),
        (k % 4).alias("n_signals"), pick(part(1200, 3), "risk_score", "customer_report", "analyst_request").alias("trigger"),
        pick(part(3600, 4), None, "denied", "confirmed", "no_reply").alias("response"),
        (part(7, 2) == 0).alias("evidence_requested"),
        F.when(part(7, 2) == 0, pick(part(5, 2), "step_up_auth", "customer_validation")).otherwise("").alias("request_type"),
        F.when(part(11, 3) == 0, "device profile X").otherwise("").alias("shared_origin"), (k % 3).alias("connected_cards"),
        (part(13, 2) == 0).alias("cross_customer"), (amount * 5).alias("card_testing_cleared_max"),
        (part(17, 4) == 0).alias("recurring_match"), (part(19, 3) == 0).alias("conflicting"))


STATES = """
  states AS (SELECT TransactionID, TransactionAmt AS flagged_amount, p_txn, risk_score, k, (b % 100) / 100 AS p,
    ['fraud', 'legitimate', 'uncertain'][b // 100 % 3 + 1] AS verdict, round(TransactionAmt * (k % 9) * 20, 2) AS exposure,
    ['none', 'card_testing', 'card_not_present_fraud', 'undocumented'][b // 300 % 4 + 1] AS pattern, k % 4 AS n_signals,
    ['risk_score', 'customer_report', 'analyst_request'][b // 1200 % 3 + 1] AS trigger,
    [NULL, 'denied', 'confirmed', 'no_reply'][b // 3600 % 4 + 1] AS response, b // 7 % 2 = 0 AS requested,
    CASE WHEN b // 7 % 2 = 0 THEN ['step_up_auth', 'customer_validation'][b // 5 % 2 + 1] ELSE '' END AS rtype,
    b // 11 % 3 = 0 AS shared, k % 3 AS connected, b // 13 % 2 = 0 AS crossed, TransactionAmt * 5 AS cleared,
    b // 17 % 4 = 0 AS recurring, b // 19 % 3 = 0 AS conflicting
  FROM (SELECT *, TransactionDT AS b FROM ledger))"""

POLICY = """
  f AS (SELECT *, coalesce(response = 'confirmed', false) AS yes, coalesce(response = 'denied', false) AS deny,
    coalesce(response = 'no_reply', false) AS mute, verdict = 'fraud' OR (p >= 0.7 AND verdict <> 'legitimate') AS strong,
    pattern = 'card_testing' AS ct, recurring AND trigger = 'customer_report' AND response IS NULL AS r7,
    response IS NULL AND NOT recurring AS blank FROM states)""", """
  g AS (SELECT *, blank AND n_signals <= 1 AND p < 0.7 AND p >= 0.15 AS b1 FROM f)""", """
  h AS (SELECT *, blank AND NOT b1 AND verdict = 'fraud' AND p >= 0.7 AND NOT ct AS b2,
    strong AND NOT yes AND verdict <> 'legitimate' AND (exposure > 1000 OR (shared AND connected > 0) OR crossed) AS sar FROM g)""", """
  i AS (SELECT *, blank AND NOT b1 AND NOT b2 AND verdict <> 'legitimate' AND p > 0.15 AND p < 0.85 AND NOT ct AS b3 FROM h)""", """
  j AS (SELECT *, r7 OR b1 OR b3 OR (blank AND requested AND rtype = 'customer_validation') AS a_verify,
    (ct AND NOT yes) OR (blank AND requested AND rtype = 'step_up_auth') AS a_step FROM i)""", """
  acts AS (SELECT *, (mute OR (ct AND NOT yes)) AND NOT r7 AND NOT b1 AS a_decline,
    (deny OR (ct AND NOT yes AND cleared > 100) OR b2) AND NOT r7 AND NOT b1 AS a_block,
    (yes AND (requested OR trigger = 'customer_report')) OR (NOT yes AND (deny OR mute OR ct OR r7 OR b2 OR p >= 0.3 OR requested
      OR a_verify OR a_step OR trigger = 'customer_report' OR sar OR (shared AND connected > 0 AND strong)
      OR (pattern = 'undocumented' AND crossed AND strong))) AS a_case,
    shared AND connected > 0 AND strong AND NOT yes AS a_monitor_others,
    (mute AND exposure > 500) OR (pattern = 'undocumented' AND crossed AND strong AND NOT yes)
      OR (verdict = 'uncertain' AND (exposure > 500 OR conflicting) AND NOT yes) AS a_escalate,
    (yes AND recurring) OR r7 AS a_warn FROM j)""", """
  none_ AS (SELECT *, NOT (a_decline OR a_block OR a_step OR a_verify OR mute OR a_case OR sar OR a_monitor_others OR a_escalate
    OR a_warn OR yes) AS nothing, verdict = 'legitimate' AND p <= 0.15 AS calm FROM acts)""", """
  decided AS (SELECT *, concat_ws('|', CASE WHEN a_decline THEN 'DECLINE_TRANSACTION:L1' END,
    CASE WHEN a_block THEN 'BLOCK_CARD:' || CASE WHEN exposure <= 2500 THEN 'L1' ELSE 'L2' END END,
    CASE WHEN a_step THEN 'STEP_UP_AUTH:auto' END, CASE WHEN a_verify THEN 'VERIFY_WITH_CUSTOMER:auto' END,
    CASE WHEN mute OR (nothing AND NOT calm) THEN 'MONITOR_CARD:auto' END, CASE WHEN a_case THEN 'CREATE_CASE:auto' END,
    CASE WHEN sar THEN 'FILE_REPORT:L2' END, CASE WHEN a_monitor_others THEN 'MONITOR_CONNECTED_CARDS:auto' END,
    CASE WHEN a_escalate THEN 'ESCALATE_TO_ANALYST:auto' END, CASE WHEN a_warn THEN 'WARN_CUSTOMER:auto' END,
    CASE WHEN nothing AND calm THEN 'ALLOW_TRANSACTION:auto' END,
    CASE WHEN yes OR (nothing AND calm) THEN 'CLOSE_NO_FRAUD:auto' END) AS actions,
    CASE WHEN a_escalate THEN 'escalated' WHEN verdict = 'fraud' THEN 'closed_fraud' WHEN verdict = 'legitimate'
      THEN 'closed_legitimate' ELSE 'open' END AS status FROM none_)"""


def flat(actions):
    return F.array_join(F.transform(actions, lambda a: F.concat_ws(":", a["action"], a["route"])), "|")


@query("policy_decisions", led("SELECT TransactionID, actions, sar AS file_sar, status FROM decided", STATES, *POLICY))
def policy_decisions(spark, sf):
    d = P.decide(states(spark, sf))
    return d.select("TransactionID", flat(F.col("actions")).alias("actions"), "file_sar",
                    S.status(F.col("verdict"), F.col("actions")).alias("status"))


@query("policy_sar_reason", led("""
  SELECT TransactionID, CASE WHEN sar THEN '3a' || CASE WHEN deny THEN '/R2' ELSE '' END || CASE WHEN shared AND connected > 0 THEN '/R6' ELSE '' END
      || CASE WHEN pattern = 'undocumented' AND crossed THEN '/R9' ELSE '' END || ': fraud ' ||
      CASE WHEN verdict = 'fraud' THEN 'confirmed' ELSE 'strongly suspected' END || ' and ' || concat_ws('; ',
      CASE WHEN exposure > 1000 THEN 'exposure $' || format('{:,.2f}', exposure) || ' exceeds $1,000' END,
      CASE WHEN shared AND connected > 0 THEN 'activity connects to a shared device profile X' END,
      CASE WHEN crossed THEN 'activity connects to another customer''s fraud' END,
      CASE WHEN pattern = 'undocumented' AND crossed THEN 'coordinated undocumented pattern (R9)' END)
    WHEN verdict = 'legitimate' OR yes THEN '3a: no report — the activity was assessed as legitimate'
    WHEN NOT strong THEN '3a: no report — fraud is neither confirmed nor strongly suspected (p=' || printf('%.2f', p) || ')'
    ELSE '3a: no report — exposure $' || format('{:,.2f}', exposure) || ' is at most $1,000 and there is no shared device, region cluster, other customer''s fraud, or coordinated pattern; case only' END AS sar_reason
  FROM decided""", STATES, *POLICY))
def policy_sar_reason(spark, sf):
    return P.decide(states(spark, sf)).select("TransactionID", "sar_reason")


@query("approval_routes", led("""
  SELECT TransactionID, CASE WHEN exposure <= 2500 THEN 'L1' ELSE 'L2' END AS block_route, 'L2' AS report_route,
    'auto' AS case_route, 'L1' AS decline_route FROM states""", STATES))
def approval_routes(spark, sf):
    e = F.col("exposure")
    return states(spark, sf).select(
        "TransactionID", *[P.route(F.lit(a), e).alias(n) for a, n in (
            ("BLOCK_CARD", "block_route"), ("FILE_REPORT", "report_route"), ("CREATE_CASE", "case_route"),
            ("DECLINE_TRANSACTION", "decline_route"))])


def v1_states(spark, sf):
    return states(spark, sf).withColumns({
        "cleared_large": F.col("flagged_amount") >= 20, "n_device_neighbors": (F.col("shared_origin") != "").cast("int"),
        "n_connected": F.col("connected_cards"), "recurring": F.col("recurring_match"),
        "n_graph_evidence": F.col("k") % 5, "n_evidence": F.col("k") % 4, "steps": F.col("k") % 10,
        "flagged_amount": F.col("exposure") / 2})


V1_SQL = """
  u AS (SELECT *, coalesce(response = 'confirmed', false) AS yes, coalesce(response = 'denied', false) AS deny,
    exposure / 2 AS amt, flagged_amount >= 20 AS large FROM states)""", """
  v AS (SELECT *, list_filter([
      CASE WHEN p < 0.7 THEN CASE WHEN trigger = 'customer_report' OR p >= 0.3 THEN 'VERIFY_WITH_CUSTOMER:auto' ELSE 'MONITOR_CARD:auto' END
           WHEN pattern = 'card_testing' THEN CASE WHEN large THEN 'BLOCK_CARD:L1' ELSE 'DECLINE_TRANSACTION:L1' END
           WHEN p >= 0.85 THEN CASE WHEN amt > 2500 THEN 'BLOCK_CARD:L2' ELSE 'BLOCK_CARD:L1' END ELSE 'VERIFY_WITH_CUSTOMER:auto' END,
      CASE WHEN p >= 0.7 AND pattern = 'card_testing' AND NOT large THEN 'STEP_UP_AUTH:auto' END,
      CASE WHEN p >= 0.7 OR (p >= 0.3 AND trigger <> 'customer_report') THEN 'CREATE_CASE:auto' END,
      CASE WHEN verdict = 'uncertain' AND amt > 500 THEN 'ESCALATE_TO_ANALYST:auto' END], lambda x: x IS NOT NULL) AS ini FROM u)""", """
  w AS (SELECT *, CASE WHEN exposure > 2500 THEN 'BLOCK_CARD:L2' ELSE 'BLOCK_CARD:L1' END AS blk,
    trigger = 'customer_report' AND p < 0.3 AND recurring AS r7 FROM v)""", """
  x AS (SELECT *, CASE
      WHEN r7 THEN ['CREATE_CASE:auto', 'VERIFY_WITH_CUSTOMER:auto', 'WARN_CUSTOMER:auto']
      WHEN yes THEN ['CLOSE_NO_FRAUD:auto']
      WHEN deny THEN [blk, 'CREATE_CASE:auto', CASE WHEN exposure > 1000 OR shared OR connected > 0 THEN 'FILE_REPORT:L2' END,
        CASE WHEN shared THEN 'MONITOR_CONNECTED_CARDS:auto' END]
      WHEN p >= 0.85 THEN [blk, 'CREATE_CASE:auto', CASE WHEN exposure > 1000 OR shared THEN 'FILE_REPORT:L2' END,
        CASE WHEN shared THEN 'MONITOR_CONNECTED_CARDS:auto' END]
      WHEN p >= 0.7 THEN ['VERIFY_WITH_CUSTOMER:auto', 'CREATE_CASE:auto', CASE WHEN exposure > 500 THEN 'ESCALATE_TO_ANALYST:auto' END]
      WHEN p >= 0.15 THEN ini ELSE ['CLOSE_NO_FRAUD:auto'] END AS mid FROM w)""", """
  y AS (SELECT *, list_filter(mid || CASE WHEN pattern = 'undocumented' THEN [
      CASE WHEN NOT list_contains(mid, 'CREATE_CASE:auto') THEN 'CREATE_CASE:auto' END,
      CASE WHEN exposure > 1000 AND NOT list_contains(mid, 'FILE_REPORT:L2') THEN 'FILE_REPORT:L2' END,
      CASE WHEN NOT list_contains(mid, 'ESCALATE_TO_ANALYST:auto') THEN 'ESCALATE_TO_ANALYST:auto' END] ELSE [] END, lambda q: q IS NOT NULL) AS fin,
    CASE WHEN r7 OR yes THEN 'legitimate' WHEN deny THEN 'fraud' WHEN p >= 0.85 THEN 'fraud' WHEN p < 0.15 THEN 'legitimate' ELSE verdict END AS after_,
    CASE WHEN yes THEN greatest(0, p - 0.5) WHEN deny THEN least(1, p + 0.2) ELSE p END AS p_after FROM x)"""


@query("policy_v1_actions", led("""
  SELECT TransactionID, array_to_string(ini, '|') AS initial, array_to_string(fin, '|') AS final, after_ AS verdict_after,
    round(p_after, 6) AS p_after FROM y""", STATES, *V1_SQL))
def policy_v1_actions(spark, sf):
    d = V1.final_actions(V1.initial_actions(v1_states(spark, sf)))
    return d.select("TransactionID", flat(F.col("initial")).alias("initial"), flat(F.col("final")).alias("final"),
                    "verdict_after", F.round("p_after", 6).alias("p_after"))


@query("policy_v1_report_status", led("""
  SELECT TransactionID, after_ = 'fraud' AND (exposure > 1000 OR shared OR connected > 0 OR pattern = 'undocumented') AS sar_file,
    CASE WHEN after_ <> 'fraud' THEN 'Verdict is not fraud' WHEN pattern = 'undocumented' THEN 'Undocumented coordinated pattern'
      WHEN connected > 0 THEN 'Connected to another card''s fraud' WHEN shared THEN 'Shared device profile linking multiple cards'
      WHEN exposure > 1000 THEN 'Exposure exceeds $1,000 threshold'
      ELSE 'No SAR triggers met: exposure below threshold and no shared connections' END AS sar_reason,
    CASE WHEN p >= 0.85 AND k % 5 >= 2 THEN 'high' WHEN p <= 0.15 AND k % 4 >= 2 THEN 'low' WHEN deny THEN 'denied'
      WHEN yes THEN 'confirmed' WHEN k % 10 >= 8 THEN 'steps' ELSE '' END AS stop,
    CASE after_ WHEN 'fraud' THEN 'closed_fraud' WHEN 'legitimate' THEN 'closed_legitimate'
      ELSE CASE WHEN p_after >= 0.5 THEN 'escalated' ELSE 'open' END END AS status FROM y""", STATES, *V1_SQL))
def policy_v1_report_status(spark, sf):
    d = V1.final_actions(V1.initial_actions(v1_states(spark, sf)))
    return V1.stop_and_status(V1.report_decision(d)).select("TransactionID", "sar_file", "sar_reason", "stop", "status")


NAME = "list_transform({}, lambda a: split_part(a, ':', 1))"


@query("policy_v1_changes", led(f"""
  SELECT TransactionID, CASE WHEN t = '' THEN 'nothing' ELSE t END AS what_changed FROM (
    SELECT TransactionID, concat_ws('; ', CASE WHEN len(a) > 0 THEN 'Added: ' || array_to_string(a, ', ') END,
      CASE WHEN len(r) > 0 THEN 'Removed: ' || array_to_string(r, ', ') END) AS t FROM (
      SELECT TransactionID, list_sort(list_filter({NAME.format('fin')}, lambda z: NOT list_contains({NAME.format('ini')}, z))) AS a,
        list_sort(list_filter({NAME.format('ini')}, lambda z: NOT list_contains({NAME.format('fin')}, z))) AS r FROM y))""", STATES, *V1_SQL))
def policy_v1_changes(spark, sf):
    return V1.final_actions(V1.initial_actions(v1_states(spark, sf))).select("TransactionID", "what_changed")


@query("bounded_reassessment", led("""
  SELECT TransactionID, round(q, 6) AS p_new, CASE WHEN verdict = 'fraud' AND q < 0.5 THEN 'uncertain'
    WHEN verdict = 'legitimate' AND q > 0.6 THEN 'uncertain' ELSE verdict END AS verdict_new
  FROM (SELECT *, least(least(1.0, p + 0.15), greatest(greatest(0.0, p - 0.15), risk_score)) AS q FROM states)""", STATES))
def bounded_reassessment(spark, sf):
    s = states(spark, sf).withColumn("q", S.bounded_move(F.col("p"), F.col("risk_score")))
    return s.select("TransactionID", F.round("q", 6).alias("p_new"), S.guarded_verdict(F.col("verdict"), F.col("q")).alias("verdict_new"))


def chain_states(spark, sf):
    s = states(spark, sf)
    return s.select(
        "TransactionID", "case_id", "p_txn", "risk_score", "trigger", "pattern", "k", "flagged_amount", (F.col("k") % 4).alias("n_members"),
        F.least(F.lit(1.0), F.col("p_txn") * 1.5).alias("p_max"), (F.col("k") % 5 == 0).cast("int").alias("known_uid"),
        (F.col("k") % 7 == 0).alias("f_structuring"), (F.col("k") % 11 == 0).alias("f_device_ring"),
        (F.col("pattern") == "card_testing").alias("f_card_testing"), F.col("recurring_match").alias("f_recurring"),
        (F.col("k") % 13 == 0).alias("f_earlier"), F.when(F.col("k") % 3 == 0, "New").otherwise("Found").alias("id_15"),
        F.when(F.col("k") % 17 == 0, "IP_PROXY:ANONYMOUS").alias("id_23"), (F.col("k") % 2).alias("seen_region"),
        F.lit(0).alias("seen_dev"), (F.col("k") % 3 % 2).alias("seen_card_region"), F.when(F.col("k") % 5 != 1, "101").alias("addr1"),
        (F.col("k") % 6).alias("old_n"))


def _step(name, src, cond, ratio):
    z = f"ln(least(greatest({src}, 1e-6), 1 - 1e-6) / (1 - least(greatest({src}, 1e-6), 1 - 1e-6)))"
    return f"{name} AS MATERIALIZED (SELECT *, CASE WHEN {cond} THEN least(greatest(1 / (1 + exp(-({z} + ln({ratio})))), 0.02), 0.98) ELSE {src} END AS {name}_p FROM "


LG = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"
CHAIN = f"""
  c0 AS (SELECT *, least(1.0, p_txn * 1.5) AS p_max, k % 4 AS n_members FROM states)""", f"""
  c1 AS (SELECT *, 1 / (1 + exp(-(0.2381 * {LG.format('p_txn')} + 0.0106 * {LG.format('p_max')} + 1.1608 * ln(1 + n_members)
    + 1.9369 * (k % 5 = 0)::INT))) AS raw FROM c0)""", f"""
  c2 AS (SELECT *, least(greatest(1 / (1 + exp(-({LG.format('raw')} - ln(0.905 / 0.095)))), 0.02), 0.98) AS p_model FROM c1)""", \
    _step("s1", "p_model", "k % 7 = 0", 10.0) + "c2)", _step("s2", "s1_p", "k % 11 = 0", 10.0) + "s1)", \
    _step("s3", "s2_p", "pattern = 'card_testing'", 5.0) + "s2)", _step("s4", "s3_p", "recurring", 0.2) + "s3)", \
    _step("s5", "s4_p", "k % 13 = 0", 3.0) + "s4)", _step("s6", "s5_p", "trigger = 'customer_report'", 2.0) + "s5)", """
  sg AS (SELECT *, (k % 7 = 0)::INT + (k % 11 = 0)::INT + (pattern = 'card_testing')::INT + (k % 13 = 0)::INT AS n_struct FROM s6)""", """
  sn AS (SELECT *, n_struct + (p_txn >= 0.5)::INT + (n_members >= 2)::INT + (k % 5 = 0)::INT
      + ((k % 3 = 0 OR k % 17 = 0) AND (p_txn >= 0.2 OR n_struct > 0))::INT
      + (k % 3 % 2 = 0 AND k % 5 <> 1 AND k % 6 > 0 AND p_txn >= 0.2)::INT + (trigger = 'customer_report')::INT AS n_signals_,
    (p_txn < 0.05)::INT + (k % 2 = 1)::INT + (n_members <= 1 AND n_struct = 0)::INT AS n_benign FROM sg)""", """
  st AS (SELECT *, (s6_p >= 0.85 AND n_signals_ >= 2) OR (s6_p <= 0.15 AND n_benign >= 2) AS stop_now,
    CASE WHEN s6_p >= 0.7 AND n_signals_ >= 2 THEN 'fraud' WHEN s6_p <= 0.15 THEN 'legitimate' ELSE 'uncertain' END AS verdict0,
    (trigger = 'customer_report' AND p_txn < 0.05 AND n_struct = 0) OR (risk_score >= 0.85 AND p_txn < 0.05) AS conflict FROM sn)""", """
  rp AS (SELECT *, CASE WHEN stop_now THEN NULL WHEN s5_p >= 0.6 THEN 'denied'
    WHEN s5_p < CASE WHEN trigger = 'customer_report' THEN 0.2 ELSE 0.4 END THEN 'confirmed' ELSE 'no_reply' END AS reply FROM st)""", \
    _step("r1", "s6_p", "reply IS NOT NULL", "CASE reply WHEN 'denied' THEN 2.5 WHEN 'confirmed' THEN 0.25 ELSE 1.0 END") + "rp)", """
  fv AS MATERIALIZED (SELECT *, CASE WHEN reply = 'denied' THEN 'fraud' WHEN reply = 'confirmed' THEN 'legitimate' WHEN reply = 'no_reply' THEN 'uncertain'
    WHEN recurring THEN 'uncertain' WHEN r1_p >= 0.85 THEN 'fraud' WHEN r1_p <= 0.15 THEN 'legitimate' ELSE 'uncertain' END AS verdict_ FROM r1)"""


@query("probability_chain", led("""SELECT TransactionID, round(p_model, 6) AS p_model, round(s5_p, 6) AS p_evidence,
  round(s6_p, 6) AS p FROM s6""", STATES, *CHAIN))
def probability_chain(spark, sf):
    return S.probability_chain(chain_states(spark, sf)).select(
        "TransactionID", *[F.round(c, 6).alias(c) for c in ("p_model", "p_evidence", "p")])


@query("signals_and_verdicts", led("""SELECT TransactionID, n_signals_ AS n_signals, n_benign, verdict0, stop_now, conflict AS conflicting,
  reply AS response, round(r1_p, 6) AS p1, verdict_ AS verdict, CASE WHEN trigger = 'customer_report' AND reply IS NULL
  AND verdict_ = 'fraud' THEN 'denied' ELSE reply END AS policy_response FROM fv""", STATES, *CHAIN))
def signals_and_verdicts(spark, sf):
    c = S.initial_verdict(S.signals(S.probability_chain(chain_states(spark, sf))))
    c = S.final_verdict(S.with_reply(c))
    return c.select("TransactionID", "n_signals", F.size("benign").alias("n_benign"), "verdict0", "stop_now", "conflicting",
                    "response", F.round("p1", 6).alias("p1"), "verdict", "policy_response")


@query("pattern_name", led("""
  SELECT TransactionID, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'undocumented' WHEN pattern = 'card_testing' THEN 'card_testing'
    ELSE arg_max(name, (v, -ord)) END AS pattern
  FROM (SELECT s.TransactionID, s.k, s.pattern, s.n_online, s.n_rows, s.new_online, m.name, m.ord, (s.k * m.mul % 97) / 97.0 AS v
    FROM (SELECT *, k % 3 AS n_online, 2 AS n_rows, k % 3 > 0 AND k % 5 = 0 AS new_online FROM states) s,
      (VALUES ('account_takeover', 1, 13), ('card_not_present_fraud', 2, 29), ('card_not_present_new_device', 3, 31),
        ('card_testing', 4, 89), ('out_of_region_use', 5, 7)) m(name, ord, mul)
    WHERE name <> 'card_testing' AND NOT (n_online = 0 AND name LIKE 'card_not%') AND NOT (n_online > 0 AND new_online AND name = 'card_not_present_fraud')
      AND NOT (n_online > 0 AND NOT new_online AND name = 'card_not_present_new_device') AND NOT (n_online = n_rows AND name = 'out_of_region_use'))
  GROUP BY TransactionID, k, pattern""", STATES))
def pattern_name(spark, sf):
    k = F.col("k")
    prob = lambda m: (k * m % 97) / 97.0
    s = states(spark, sf).select(
        "TransactionID", (k % 7 == 0).alias("f_structuring"), (k % 11 == 0).alias("f_device_ring"),
        (F.col("pattern") == "card_testing").alias("f_card_testing"), (k % 3).alias("n_online"), F.lit(2).alias("n_rows"),
        ((k % 3 > 0) & (k % 5 == 0)).cast("int").alias("any_new_online"),
        F.create_map(F.lit("account_takeover"), prob(13), F.lit("card_not_present_fraud"), prob(29),
                     F.lit("card_not_present_new_device"), prob(31), F.lit("card_testing"), prob(89),
                     F.lit("out_of_region_use"), prob(7)).alias("pattern_p"))
    return S.pattern_name(s).select("TransactionID", "pattern")
