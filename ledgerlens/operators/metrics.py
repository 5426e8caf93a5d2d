"""Evaluation: ranking metrics, thresholds, calibration tables, replay and backtest figures."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..params import DEFAULT, Params
from ..session import checkpointed, stored
from .episodes import reconstruct, set_agreement, summarise
from .skew import range_totals

THRESHOLDS = [round(i * 0.05, 2) for i in range(1, 20)]


def ranking(scored: DataFrame) -> DataFrame:
    """ROC-AUC (tied scores share their mean rank), average precision and Brier score. ``score, y``.

    Rows are counted per distinct score first, so ties never lie on two sides of a range; the counts below each score then come
    from even ranges of scores, however the scores are spread. One ascending pass serves both directions."""
    per_score = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos"))
    below = range_totals(per_score, ["score"], {"n_below": F.col("n"), "pos_below": F.col("pos")})
    error = (F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))
    whole = scored.agg(F.count(F.lit(1)).alias("n_all"), F.sum("y").cast("long").alias("n1"), F.avg(error).alias("brier"))
    g = below.crossJoin(whole)      # one row
    tp, seen = F.col("n1") - F.col("pos_below"), F.col("n_all") - F.col("n_below")
    sums = g.agg(F.sum(F.col("pos") * (F.col("n_below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum(F.col("pos") * tp / seen).alias("ap_sum"))
    n1, n0 = F.col("n1"), F.col("n_all") - F.col("n1")
    return sums.crossJoin(whole).select(
        F.col("n_all").alias("n"), n1.alias("n_pos"), ((F.col("ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("roc_auc"),
        (F.col("ap_sum") / n1).alias("avg_precision"), "brier")


def confusion(scored: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Confusion counts per threshold. Rows are first counted per interval between thresholds."""
    place = sum((flag(F.col("score") >= t) for t in thresholds[1:]), flag(F.col("score") >= thresholds[0]))
    g = scored.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    t = F.posexplode(F.array(*[F.lit(x) for x in thresholds])).alias("i", "threshold")
    j = g.select("place", "n", "pos", t)
    above = F.col("place") > F.col("i")
    part = lambda cond, v: F.sum(F.when(cond, v).otherwise(0))
    neg = F.col("n") - F.col("pos")
    c = j.groupBy("threshold").agg(part(above, F.col("pos")).alias("tp"), part(above, neg).alias("fp"),
                                   part(~above, F.col("pos")).alias("fn"), part(~above, neg).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / total, 4))


def best_threshold(scored: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    c = confusion(scored, thresholds)
    best = F.min(F.struct((-F.col("accuracy")).alias("a"), "threshold")).alias("b")
    return c.agg(best).select(F.col("b.threshold").alias("threshold"), (-F.col("b.a")).alias("accuracy"))


def pattern_anchors(cases: DataFrame) -> DataFrame:
    """Share of confirmed fraud per pattern, with the add-one estimate and the mean score."""
    k = F.sum(flag(F.col("outcome") == "confirmed_fraud"))
    n = F.count(F.lit(1))
    return cases.groupBy("pattern").agg(
        n.alias("n"), F.round(k / n, 4).alias("p_confirmed_fraud"), F.round((k + 1) / (n + 2), 4).alias("proposed_anchor"),
        F.round(F.avg("score"), 4).alias("mean_score"))


def separation(scored: DataFrame) -> DataFrame:
    return scored.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))


def balanced(cases: DataFrame) -> DataFrame:
    """Add ``w``: class weights that give each class half of the total."""
    tot = cases.agg(F.avg("y").alias("_rate"))
    j = cases.crossJoin(tot)      # one row
    return j.withColumn("w", F.when(F.col("y") == 1, 0.5 / F.col("_rate")).otherwise(0.5 / (1 - F.col("_rate")))).drop("_rate")


def balanced_scores(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Balanced accuracy at one half and balanced Brier score. ``p, y``."""
    b = balanced(checkpointed(cases))
    right = flag((F.col("p") >= 0.5) == (F.col("y") == 1))
    err = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    return b.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * right) / F.sum("w")).alias("accuracy_balanced"),
                 (F.sum(F.col("w") * err) / F.sum("w")).alias("brier_balanced"), F.avg(err).alias("brier"))


def grouped_accuracy(cases: DataFrame) -> DataFrame:
    return cases.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"),
                                        F.round(F.avg(flag(F.col("pred_pattern") == F.col("pattern")).cast("double")), 3).alias("accuracy"))


def replay_alerts(closed: DataFrame, members: DataFrame, ledger: DataFrame) -> DataFrame:
    """Turn closed cases back into alerts. A confirmed case is flagged at the row whose id hashes lowest
    with the case id, a cleared one at its first row; the alert opens when the case was opened."""
    rows = members.join(ledger.select("TransactionID", "us", "card_id", "risk_score"), "TransactionID")
    pick = rows.join(closed.select("case_id", "outcome", "customer_id", "opened_us"), "case_id")
    order = F.struct(F.when(F.col("outcome") == "confirmed_fraud", F.md5(F.concat("case_id", "TransactionID"))).otherwise(""),
                     "us", "TransactionID")
    g = pick.groupBy("case_id", "customer_id", "opened_us").agg(
        F.min_by(F.struct("TransactionID", "us", "card_id", "risk_score"), order).alias("r"))
    return g.select("case_id", "customer_id", "opened_us", F.col("r.TransactionID").alias("flagged_txn_id"),
                    F.col("r.us").alias("flag_us"), F.col("r.card_id").alias("card_id"), F.col("r.risk_score").alias("risk_score"))


def replay(closed: DataFrame, members: DataFrame, scored: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Rebuild every closed case's episode at each threshold and compare it with the true rows."""
    alerts = stored(replay_alerts(closed, members, scored))
    eps = stored(reconstruct(alerts, scored, params.thresholds, params))
    found = summarise(eps, scored, params)
    agree = set_agreement(eps, members, ["case_id", "threshold"]).select("case_id", "threshold", "jaccard")
    truth = closed.select("case_id", "pattern", F.col("exposure_usd").alias("true_exposure"),
                          flag(F.col("outcome") == "confirmed_fraud").alias("y"), "report_filed")
    return found.join(agree, ["case_id", "threshold"]).join(truth, "case_id")


def replay_quality(replayed: DataFrame) -> DataFrame:
    """Per threshold, over confirmed cases: mean Jaccard, exact matches, exposure within a tenth."""
    fr = replayed.filter(F.col("y") == 1)
    near = F.abs(F.col("exposure") - F.col("true_exposure")) <= 0.1 * F.col("true_exposure")
    return fr.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("jaccard"), 4).alias("mean_jaccard"),
        F.round(F.avg(flag(F.col("jaccard") == 1).cast("double")), 4).alias("exact_match"),
        F.round(F.avg(flag(near).cast("double")), 4).alias("exposure_within_10pct"))


def case_sample(closed: DataFrame, n: int) -> DataFrame:
    """All cleared cases and the ``n`` confirmed ones with the lowest hash."""
    cleared = closed.filter(F.col("outcome") == "cleared")
    fraud = closed.filter(F.col("outcome") == "confirmed_fraud").orderBy(F.md5("case_id"), "case_id").limit(n)
    return cleared.unionByName(fraud)


def backtest(cases: DataFrame) -> DataFrame:
    """End-to-end figures in one row.

    ``cases``: ``y, p, verdict, pattern, pred_pattern, jaccard, exposure, true_exposure, blocked, sar,
    true_sar, asked``. The ranking figure is joined from ``ranking``.
    """
    c = F.col
    cases = checkpointed(cases)      # one short row per case, read by several aggregates
    b = balanced(cases)
    y1, y0 = c("y") == 1, c("y") == 0
    right = ((c("verdict") == "fraud") & y1) | ((c("verdict") == "legitimate") & y0)
    decided = c("verdict") != "uncertain"
    found = y1 & (c("verdict") != "legitimate")
    called = y1 & (c("verdict") == "fraud")
    rate = lambda cond, within: F.round(F.avg(F.when(within, flag(cond).cast("double"))), 4)
    near = F.abs(c("exposure") - c("true_exposure")) <= 0.1 * c("true_exposure")
    err = (c("p") - c("y")) * (c("p") - c("y"))
    one = b.agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("y").alias("n_confirmed"), F.sum(1 - c("y")).alias("n_cleared"),
        F.round(F.sum(c("w") * err) / F.sum("w"), 4).alias("brier_balanced"),
        F.round(F.sum(c("w") * flag(right)) / F.sum("w"), 4).alias("accuracy_uncertain_wrong"),
        F.round(F.sum(F.when(decided, c("w") * flag(right))) / F.sum(F.when(decided, c("w"))), 4).alias("accuracy_decided"),
        rate(~decided, F.lit(True)).alias("uncertain_rate"), rate(c("verdict") == "fraud", y1).alias("fraud_recall"),
        rate(c("verdict") == "legitimate", y0).alias("legit_recall"),
        F.round(F.avg(F.when(found, c("jaccard"))), 4).alias("mean_jaccard"), rate(c("jaccard") == 1, found).alias("exact_match"),
        rate(near, found).alias("exposure_within_10pct"), rate(c("pred_pattern") == c("pattern"), called).alias("pattern_accuracy"),
        rate(c("blocked"), y0).alias("block_rate_cleared"), rate(c("blocked"), y1).alias("block_rate_confirmed"),
        rate(c("sar") == c("true_sar"), y1).alias("sar_agreement"), rate(c("asked"), F.lit(True)).alias("request_rate"))
    auc = ranking(cases.select(c("p").alias("score"), "y")).select(F.round("roc_auc", 4).alias("roc_auc"))
    return one.crossJoin(auc)


def run_summary(answers: DataFrame) -> DataFrame:
    """Totals over a run's case rows: ``verdict, p, sar, tokens, tool_calls, latency_s``."""
    tally = lambda v: F.count_if(F.col("verdict") == v)
    n = F.count(F.lit(1))
    return answers.agg(
        n.alias("n_cases"), tally("fraud").alias("n_fraud"), tally("legitimate").alias("n_legitimate"),
        tally("uncertain").alias("n_uncertain"), F.round(tally("fraud") / n, 3).alias("fraud_share"),
        F.round(tally("uncertain") / n, 3).alias("uncertain_share"), F.count_if(F.col("sar")).alias("sars_filed"),
        F.round(F.min("p"), 3).alias("prob_min"), F.round(F.max("p"), 3).alias("prob_max"), F.round(F.avg("p"), 3).alias("prob_mean"),
        F.sum("tool_calls").alias("tool_calls"), F.sum("tokens").alias("tokens"))


def suspect_counters(answers: DataFrame) -> DataFrame:
    """Cases whose counter is zero or equals the value most often repeated (the smallest on a tie)."""
    g = answers.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    frozen = g.agg(F.min_by("tokens", F.struct(-F.col("n"), "tokens")).alias("frozen"))
    j = answers.crossJoin(frozen)      # one row, null when no counter repeats
    return j.filter((F.col("tokens") == 0) | (F.col("tokens") == F.col("frozen"))).select("case_id", "tokens")
