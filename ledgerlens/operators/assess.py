"""From findings to a verdict: probability chain, signals, verdicts, reply, affected set and status."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bayes, calibrated, flag, logit, sigmoid
from ..params import DEFAULT, Params
from .policy import takes


def _log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def _shift(z: Column, hit: Column, ratio: float, params: Params) -> Column:
    """One likelihood-ratio update in log-odds: add, then clip. ``z`` occurs once, so chains stay small."""
    moved = z + F.when(hit, F.lit(math.log(ratio))).otherwise(F.lit(0.0))
    return F.greatest(F.least(moved, F.lit(_log_odds(params.p_ceil))), F.lit(_log_odds(params.p_floor)))


def probability_chain(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Calibrated case probability, then one clipped update per finding, in a fixed order.

    Expects ``p_txn, p_max, n_members, known_uid`` and the findings ``f_structuring, f_device_ring,
    f_card_testing, f_recurring, f_earlier`` (booleans) and ``trigger``.
    """
    c = cases.withColumn("p_model", calibrated(F.col("p_txn"), F.col("p_max"), F.col("n_members"), F.col("known_uid"), params))
    steps = [("f_structuring", "structuring"), ("f_device_ring", "device_ring"), ("f_card_testing", "card_testing"),
             ("f_recurring", "recurring"), ("f_earlier", "earlier_case")]
    z = logit(F.col("p_model"))
    for column, name in steps:
        z = _shift(z, F.col(column), params.lr[name], params)
    c = c.withColumn("z_evidence", z)
    report = F.col("trigger") == "customer_report"
    return c.withColumns({"p_evidence": sigmoid(F.col("z_evidence")),
                          "p": sigmoid(_shift(F.col("z_evidence"), report, params.lr["customer_report"], params))}).drop("z_evidence")


def signals(cases: DataFrame) -> DataFrame:
    """Independent fraud signals and benign signals."""
    c = F.col
    structural = F.array_compact(F.array(
        F.when(c("f_structuring"), "structuring"), F.when(c("f_device_ring"), "device_ring"),
        F.when(c("f_card_testing"), "card_testing"), F.when(c("f_earlier"), "agent_memory")))
    cases = cases.withColumn("structural", structural)
    found = F.size("structural") > 0
    odd_device = F.coalesce(c("id_15") == "New", F.lit(False)) | c("id_23").isNotNull()
    new_region = (c("seen_card_region") == 0) & c("addr1").isNotNull() & (c("old_n") > 0) & (c("p_txn") >= 0.2)
    fraud = F.array_compact(F.array(
        F.when(c("p_txn") >= 0.5, "model"), F.when(c("n_members") >= 2, "episode"), F.when(c("known_uid") > 0, "history"),
        F.when(odd_device & ((c("p_txn") >= 0.2) | found), "device"), F.when(new_region, "region")))
    fraud = F.concat(fraud, c("structural"), F.when(c("trigger") == "customer_report", F.array(F.lit("customer_report")))
                     .otherwise(F.array().cast("array<string>")))
    benign = F.array_compact(F.array(
        F.when(c("p_txn") < 0.05, "model"),
        F.when((c("seen_region") == 1) | (c("seen_dev") == 1), "familiar region/device"),
        F.when((c("n_members") <= 1) & ~found, "isolated")))
    return cases.withColumns({"signals": fraud, "benign": benign, "n_signals": F.size(fraud)})


def initial_verdict(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Conflict, first verdict, stopping rule and the request it leads to."""
    c = F.col
    quiet = F.size("structural") == 0
    conflict = (((c("trigger") == "customer_report") & (c("p_txn") < 0.05) & quiet)
                | ((c("risk_score") >= 0.85) & (c("p_txn") < 0.05)))
    verdict = (F.when((c("p") >= params.p_verify_below) & (c("n_signals") >= 2), "fraud")
               .when(c("p") <= params.stop_low, "legitimate").otherwise("uncertain"))
    stop = (((c("p") >= params.stop_high) & (c("n_signals") >= 2))
            | ((c("p") <= params.stop_low) & (F.size("benign") >= 2)))
    request = F.when(stop, "").when(c("pattern") == "card_testing", "step_up_auth").otherwise("customer_validation")
    return cases.withColumns({"conflicting": F.coalesce(conflict, F.lit(False)), "verdict0": verdict, "stop_now": stop,
                              "request_type": request, "evidence_requested": ~stop})


def with_reply(cases: DataFrame, replies: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """The customer's reply: taken from ``replies (case_id, reply)``, else from the evidence-only rule.

    A reply only exists where evidence was requested. ``p1`` is the probability after it.
    """
    if replies is None:
        cases = cases.withColumn("reply", F.lit(None).cast("string"))
    else:
        cases = cases.join(replies.select("case_id", "reply"), "case_id", "left")
    below = F.when(F.col("trigger") == "customer_report", params.confirm_below_report).otherwise(params.confirm_below)
    assumed = (F.when(F.col("p_evidence") >= params.deny_at, "denied")
               .when(F.col("p_evidence") < below, "confirmed").otherwise("no_reply"))
    response = F.when(F.col("evidence_requested"), F.coalesce("reply", assumed))
    ratio = (F.when(F.col("response") == "denied", params.lr["denied"])
             .when(F.col("response") == "confirmed", params.lr["confirmed"]).otherwise(params.lr["no_reply"]))
    cases = cases.withColumn("response", response).drop("reply")
    return cases.withColumn("p1", F.when(F.col("response").isNotNull(), bayes(F.col("p"), ratio, params)).otherwise(F.col("p")))


def final_verdict(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    r, p1 = F.col("response"), F.col("p1")
    alone = F.when(p1 >= params.stop_high, "fraud").when(p1 <= params.stop_low, "legitimate").otherwise("uncertain")
    verdict = (F.when(r == "denied", "fraud").when(r == "confirmed", "legitimate").when(r == "no_reply", "uncertain")
               .when(F.col("f_recurring"), "uncertain").otherwise(alone))
    report = (F.col("trigger") == "customer_report") & r.isNull() & (F.col("verdict") == "fraud")
    return cases.withColumn("verdict", verdict).withColumn(
        "policy_response", F.when(report, "denied").otherwise(r))


def status(verdict: Column, actions: Column) -> Column:
    return (F.when(takes(actions, "ESCALATE_TO_ANALYST"), "escalated").when(verdict == "fraud", "closed_fraud")
            .when(verdict == "legitimate", "closed_legitimate").otherwise("open"))


def bounded_move(anchor: Column, proposed: Column, limit: float = 0.15) -> Column:
    """A reassessment may move the probability by at most ``limit`` from its anchor."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(anchor - limit, F.least(anchor + limit, proposed))))


def guarded_verdict(proposed: Column, p: Column, params: Params = DEFAULT) -> Column:
    """Keep a proposed verdict only where the probability can support it."""
    return (F.when((proposed == "fraud") & (p < 0.5), "uncertain")
            .when((proposed == "legitimate") & (p > 0.6), "uncertain").otherwise(proposed))


def pattern_name(cases: DataFrame, probabilities: str = "pattern_p") -> DataFrame:
    """Name the pattern: structural findings first, else the likeliest class definitions allow.

    ``pattern_p``: map of class to probability; ``n_rows, n_online, any_new_online`` describe the episode.
    """
    c = F.col
    none_online, all_online = c("n_online") == 0, c("n_online") == c("n_rows")
    barred = F.concat(
        F.array(F.lit("card_testing"), F.lit("undocumented"), F.lit("none")),
        F.when(none_online, F.array(F.lit("card_not_present_fraud"), F.lit("card_not_present_new_device")))
        .when(c("any_new_online") == 1, F.array(F.lit("card_not_present_fraud")))
        .otherwise(F.array(F.lit("card_not_present_new_device"))),
        F.when(all_online, F.array(F.lit("out_of_region_use"))).otherwise(F.array().cast("array<string>")))
    allowed = F.map_filter(c(probabilities), lambda k, v: ~F.array_contains(barred, k))
    entries = F.transform(F.map_entries(allowed), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    best = F.array_min(entries)["k"]
    name = (F.when(c("f_structuring") | c("f_device_ring"), "undocumented").when(c("f_card_testing"), "card_testing")
            .otherwise(F.coalesce(best, F.lit("none"))))
    return cases.withColumn("pattern", name)


def gates(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Which scans apply to a case, from cheap predicates on its flagged row and window counts."""
    c = F.col
    online = c("channel") == "online"
    in_band = online & (c("TransactionAmt") >= params.band * params.cap) & (c("TransactionAmt") < params.cap)
    return cases.withColumns({
        "g_structuring": flag(in_band | (c("n_band") >= 3)),
        "g_device": flag((c("trigger") == "analyst_request")
                         | (c("device_profile_id").isNotNull() & ((c("dev_hardware") == 1) | c("id_23").isNotNull()))),
        "g_testing": flag(c("n_small") >= 3),
        "g_recurring": flag(c("trigger") == "customer_report")})
