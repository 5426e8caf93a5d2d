"""Evaluation metrics, replay and run summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import features as FT
from ledgerlens.operators import metrics as M
from ledgerlens.params import DAY as DAY_US
from ledgerlens.params import TESTBED
from ledgerlens.sources.testbed import START_US, Bank, table

from .decisions import CHAIN, STATES, chain_states
from .features import KEYED
from .prelude import DAY, HOUR, cases, led
from .registry import query

SCORED = """scored AS (SELECT p_txn AS score, (l.TransactionID IN (SELECT TransactionID FROM labels))::INT AS y FROM ledger l)"""
LAB = KEYED[0]


def scored(bank):
    lab = FT.label_table(bank.closed, bank.case_txns).select("TransactionID", F.lit(1).alias("y"))
    return bank.ledger.select("TransactionID", F.col("p_txn").alias("score")).join(lab, "TransactionID", "left").select(
        "score", F.coalesce("y", F.lit(0)).alias("y"))


RANKING = """SELECT n, n_pos, round((ranks - n_pos * (n_pos + 1) / 2) / (n_pos * (n - n_pos)), 6) AS roc_auc, round(ap / n_pos, 6) AS avg_precision,
    round(brier, 6) AS brier FROM (SELECT count(*) AS n, sum(y)::BIGINT AS n_pos, sum(y * rk) AS ranks, sum(y * prec) AS ap, avg((score - y) ** 2) AS brier FROM (
      SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk,
        sum(y) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) / count(*) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS prec FROM scored))"""


@query("ranking_metrics", cases(RANKING, LAB, SCORED))
def ranking_metrics(spark, sf):
    return M.ranking(scored(Bank(spark, sf))).withColumns({c: F.round(c, 6) for c in ("roc_auc", "avg_precision", "brier")})


@query("ranking_metrics_documents", """WITH scored AS (SELECT least(1.0, d.n_chars / 4000) AS score, l.quality AS y FROM documents d JOIN labels l USING (doc_id))
  """ + RANKING)
def ranking_metrics_documents(spark, sf):
    s = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("score"), F.col("quality").alias("y"))
    return M.ranking(s).withColumns({c: F.round(c, 6) for c in ("roc_auc", "avg_precision", "brier")})


CONFUSION = """conf AS (SELECT threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp,
    count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn,
    round(count(*) FILTER ((score >= threshold) = (y = 1)) / count(*), 4) AS accuracy
  FROM scored CROSS JOIN (SELECT (5 * i) / 100.0 AS threshold FROM range(1, 20) t(i)) GROUP BY 1)"""


@query("confusion_by_threshold", cases("SELECT * REPLACE (threshold::DOUBLE AS threshold) FROM conf", LAB, SCORED, CONFUSION))
def confusion_by_threshold(spark, sf):
    return M.confusion(scored(Bank(spark, sf)))


@query("best_threshold", cases("SELECT threshold::DOUBLE AS threshold, accuracy FROM conf ORDER BY accuracy DESC, threshold LIMIT 1", LAB, SCORED, CONFUSION))
def best_threshold(spark, sf):
    return M.best_threshold(scored(Bank(spark, sf)))


@query("score_separation", cases("SELECT y, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd FROM scored GROUP BY 1", LAB, SCORED))
def score_separation(spark, sf):
    return M.separation(scored(Bank(spark, sf))).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


REPLAY = """
  cr AS (SELECT m.case_id, c.customer_id, c.opened_us, c.outcome, c.pattern, c.exposure_usd, c.report_filed, l.TransactionID, l.us, l.p_txn, l.risk_score
    FROM case_txns m JOIN closed c USING (case_id) JOIN ledger l ON l.TransactionID = m.TransactionID)""", """
  ra AS (SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN outcome = 'confirmed_fraud'
    THEN md5(case_id || TransactionID) ELSE '' END, us, TransactionID) = 1)""", f"""
  rw AS (SELECT a.case_id, a.TransactionID AS flagged, th.threshold, l.TransactionID, l.us, l.TransactionAmt, l.p_txn
    FROM ra a JOIN ledger l USING (customer_id) CROSS JOIN (SELECT unnest([0.2, 0.3, 0.35, 0.4, 0.5, 0.6]) AS threshold) th
    WHERE l.us >= a.us - {10 * DAY} AND l.us < a.opened_us AND (l.p_txn >= threshold OR l.TransactionID = a.TransactionID))""", f"""
  ri AS (SELECT *, sum(CASE WHEN gap <= {48 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, threshold ORDER BY us, TransactionID ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT *, us - lag(us) OVER (PARTITION BY case_id, threshold ORDER BY us, TransactionID) AS gap FROM rw))""", """
  rep AS (SELECT i.* FROM ri i JOIN ri f ON f.case_id = i.case_id AND f.threshold = i.threshold AND f.island = i.island AND f.TransactionID = f.flagged)""", """
  rr AS (SELECT e.case_id, threshold::DOUBLE AS threshold, count(*) AS n, round(sum(abs(TransactionAmt)), 2) AS exposure, max(e.p_txn) AS p_max,
      count(*) FILTER (e.p_txn >= 0.15) AS n_members, count(t.TransactionID) / (count(*) + max(nt.n) - count(t.TransactionID)) AS jaccard
    FROM rep e LEFT JOIN case_txns t ON t.case_id = e.case_id AND t.TransactionID = e.TransactionID
    JOIN (SELECT case_id, count(*) AS n FROM case_txns GROUP BY 1) nt ON nt.case_id = e.case_id GROUP BY ALL)""".replace(
    "t.TransactionID = e.TransactionID", "t.TransactionID = e.TransactionID"), """
  replayed AS (SELECT rr.*, a.pattern, a.exposure_usd AS true_exposure, (a.outcome = 'confirmed_fraud')::INT AS y, a.report_filed, a.p_txn AS p_flag,
    a.TransactionID AS flagged_txn_id FROM rr JOIN ra a USING (case_id))"""


def replayed(b):
    return M.replay(b.closed, b.case_txns, b.ledger, TESTBED)


@query("replay_cases", cases("SELECT case_id, threshold, n, exposure, p_max, n_members, round(jaccard, 6) AS jaccard, pattern, true_exposure, y FROM replayed", *REPLAY))
def replay_cases(spark, sf):
    return replayed(Bank(spark, sf)).select("case_id", "threshold", "n", "exposure", "p_max", "n_members",
                                            F.round("jaccard", 6).alias("jaccard"), "pattern", "true_exposure", "y")


@query("replay_quality", cases("""SELECT threshold, count(*) AS n, round(avg(jaccard), 4) AS mean_jaccard, round(avg((jaccard = 1)::INT), 4) AS exact_match,
  round(avg((abs(exposure - true_exposure) <= 0.1 * true_exposure)::INT), 4) AS exposure_within_10pct FROM replayed WHERE y = 1 GROUP BY 1""", *REPLAY))
def replay_quality(spark, sf):
    return M.replay_quality(replayed(Bank(spark, sf)))


PRED = "CASE WHEN n >= 2 THEN 'account_takeover' ELSE 'card_not_present_fraud' END"
LG = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"
BACK = f"""
  bt0 AS (SELECT *, {PRED} AS pred_pattern, 1 / (1 + exp(-(0.2381 * {LG.format('p_flag')} + 0.0106 * {LG.format('p_max')} + 1.1608 * ln(1 + n_members)))) AS raw
    FROM replayed WHERE threshold = 0.2)""", f"""
  bt AS (SELECT *, least(greatest(1 / (1 + exp(-({LG.format('raw')} + 2.5 - ln(0.905 / 0.095)))), 0.02), 0.98) AS p FROM bt0)""", """
  bv AS (SELECT *, CASE WHEN p >= 0.7 THEN 'fraud' WHEN p <= 0.3 THEN 'legitimate' ELSE 'uncertain' END AS verdict, p >= 0.6 AS blocked,
    exposure > 60 AS sar, report_filed = 'Yes' AS true_sar, p BETWEEN 0.15 AND 0.85 AS asked FROM bt)""", """
  bw AS (SELECT *, CASE WHEN y = 1 THEN 0.5 / (SELECT avg(y) FROM bv) ELSE 0.5 / (1 - (SELECT avg(y) FROM bv)) END AS w,
    (verdict = 'fraud' AND y = 1) OR (verdict = 'legitimate' AND y = 0) AS ok FROM bv)"""


def backtest_cases(b):
    r = replayed(b).filter(F.col("threshold") == 0.2)
    flag_p = M.replay_alerts(b.closed, b.case_txns, b.ledger).select("case_id", F.col("risk_score").alias("p_flag"))
    r = r.join(flag_p, "case_id")
    raw = C.sigmoid(F.lit(0.2381) * C.logit(F.col("p_flag")) + F.lit(0.0106) * C.logit(F.col("p_max")) + F.lit(1.1608) * F.log1p("n_members"))
    p = C.clip(C.sigmoid(C.logit(raw) + 2.5 - C.logit(F.lit(0.905))), 0.02, 0.98)
    r = r.withColumn("p", p).withColumn("pred_pattern", F.when(F.col("n") >= 2, "account_takeover").otherwise("card_not_present_fraud"))
    c = F.col("p")
    return r.withColumns({"verdict": F.when(c >= 0.7, "fraud").when(c <= 0.3, "legitimate").otherwise("uncertain"), "blocked": c >= 0.6,
                          "sar": F.col("exposure") > 60, "true_sar": F.col("report_filed") == "Yes", "asked": c.between(0.15, 0.85)})


@query("backtest_figures", cases("""
  SELECT count(*) AS n_cases, sum(y)::BIGINT AS n_confirmed, sum(1 - y)::BIGINT AS n_cleared, round(sum(w * (p - y) ** 2) / sum(w), 4) AS brier_balanced,
    round(sum(w * ok::INT) / sum(w), 4) AS accuracy_uncertain_wrong,
    round(sum(w * ok::INT) FILTER (verdict <> 'uncertain') / sum(w) FILTER (verdict <> 'uncertain'), 4) AS accuracy_decided,
    round(avg((verdict = 'uncertain')::INT), 4) AS uncertain_rate, round(avg((verdict = 'fraud')::INT) FILTER (y = 1), 4) AS fraud_recall,
    round(avg((verdict = 'legitimate')::INT) FILTER (y = 0), 4) AS legit_recall,
    round(avg(jaccard) FILTER (y = 1 AND verdict <> 'legitimate'), 4) AS mean_jaccard,
    round(avg((jaccard = 1)::INT) FILTER (y = 1 AND verdict <> 'legitimate'), 4) AS exact_match,
    round(avg((abs(exposure - true_exposure) <= 0.1 * true_exposure)::INT) FILTER (y = 1 AND verdict <> 'legitimate'), 4) AS exposure_within_10pct,
    round(avg((pred_pattern = pattern)::INT) FILTER (y = 1 AND verdict = 'fraud'), 4) AS pattern_accuracy,
    round(avg(blocked::INT) FILTER (y = 0), 4) AS block_rate_cleared, round(avg(blocked::INT) FILTER (y = 1), 4) AS block_rate_confirmed,
    round(avg((sar = true_sar)::INT) FILTER (y = 1), 4) AS sar_agreement, round(avg(asked::INT), 4) AS request_rate,
    round((SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) FROM
      (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM (SELECT y, round(p, 9) AS p FROM bw))), 4) AS roc_auc
  FROM bw""", *REPLAY, *BACK))
def backtest_figures(spark, sf):
    return M.backtest(backtest_cases(Bank(spark, sf)).withColumn("p", F.round("p", 9)))


@query("balanced_scores", cases("""SELECT count(*) AS n, round(sum(w * ((p >= 0.5) = (y = 1))::INT) / sum(w), 6) AS accuracy_balanced,
  round(sum(w * (p - y) ** 2) / sum(w), 6) AS brier_balanced, round(avg((p - y) ** 2), 6) AS brier FROM bw""", *REPLAY, *BACK))
def balanced_scores(spark, sf):
    return M.balanced_scores(backtest_cases(Bank(spark, sf))).withColumns(
        {c: F.round(c, 6) for c in ("accuracy_balanced", "brier_balanced", "brier")})


@query("pattern_accuracy", cases("SELECT pattern, count(*) AS n, round(avg((pred_pattern = pattern)::INT), 3) AS accuracy FROM bw WHERE y = 1 GROUP BY 1",
                                 *REPLAY, *BACK))
def pattern_accuracy(spark, sf):
    return M.grouped_accuracy(backtest_cases(Bank(spark, sf)).filter(F.col("y") == 1))


@query("pattern_anchors", cases("""SELECT pattern, count(*) AS n, round(avg((outcome = 'confirmed_fraud')::INT), 4) AS p_confirmed_fraud,
  round((sum((outcome = 'confirmed_fraud')::INT) + 1) / (count(*) + 2), 4) AS proposed_anchor, round(avg(least(1, exposure_usd / 100)), 4) AS mean_score
  FROM closed GROUP BY 1"""))
def pattern_anchors(spark, sf):
    return M.pattern_anchors(Bank(spark, sf).closed.withColumn("score", F.least(F.lit(1.0), F.col("exposure_usd") / 100)))


@query("case_sample", cases("""SELECT case_id, outcome FROM closed WHERE outcome = 'cleared' UNION ALL
  (SELECT case_id, outcome FROM closed WHERE outcome = 'confirmed_fraud' ORDER BY md5(case_id), case_id LIMIT 100)"""))
def case_sample(spark, sf):
    return M.case_sample(Bank(spark, sf).closed, 100).select("case_id", "outcome")


@query("time_split_arms", cases(f"""SELECT count(*) FILTER (us < {START_US + 15 * DAY}) AS n_train, count(*) FILTER (us >= {START_US + 15 * DAY}
    AND us < {START_US + 25 * DAY}) AS n_valid, count(*) FILTER (us < {START_US + 15 * DAY} AND TransactionID IN (SELECT TransactionID FROM case_txns
    JOIN closed USING (case_id) WHERE outcome = 'confirmed_fraud' AND opened_us < {START_US + 15 * DAY})) AS n_train_pos,
    count(*) FILTER (us >= {START_US + 15 * DAY} AND us < {START_US + 25 * DAY} AND TransactionID IN (SELECT TransactionID FROM labels)) AS n_valid_pos FROM ledger""", LAB))
def time_split_arms(spark, sf):
    from ledgerlens.operators.learn import split_counts
    b = Bank(spark, sf)
    return split_counts(b.ledger, b.closed, b.case_txns, START_US + 15 * DAY_US, START_US + 25 * DAY_US)


@query("run_summary", led("""SELECT count(*) AS n_cases, count(*) FILTER (verdict_ = 'fraud') AS n_fraud, count(*) FILTER (verdict_ = 'legitimate') AS n_legitimate,
  count(*) FILTER (verdict_ = 'uncertain') AS n_uncertain, round(avg((verdict_ = 'fraud')::INT), 3) AS fraud_share, round(avg((verdict_ = 'uncertain')::INT), 3) AS uncertain_share,
  count(*) FILTER (flagged_amount > 20) AS sars_filed, round(min(r1_p), 3) AS prob_min, round(max(r1_p), 3) AS prob_max, round(avg(r1_p), 3) AS prob_mean,
  sum(k % 9)::BIGINT AS tool_calls, sum(k % 4)::BIGINT AS tokens FROM fv""", STATES, *CHAIN))
def run_summary(spark, sf):
    from ledgerlens.operators import assess as S
    c = S.final_verdict(S.with_reply(S.initial_verdict(S.signals(S.probability_chain(chain_states(spark, sf))))))
    a = c.select("verdict", F.col("p1").alias("p"), (F.col("flagged_amount") > 20).alias("sar"),
                 (F.col("k") % 9).alias("tool_calls"), (F.col("k") % 4).alias("tokens"))
    return M.run_summary(a)


@query("suspect_counters", led("""SELECT TransactionID AS case_id, k AS tokens FROM ledger WHERE k = 0 OR k = (SELECT k FROM ledger GROUP BY k HAVING count(*) >= 2
  ORDER BY count(*) DESC, k LIMIT 1)"""))
def suspect_counters(spark, sf):
    return M.suspect_counters(Bank(spark, sf).ledger.select(F.col("TransactionID").alias("case_id"), F.col("k").alias("tokens")))
