"""The earlier policy generation: initial and final action lists, report, stop rule and status.

Input columns: ``p, pattern, trigger, verdict, flagged_amount, exposure, cleared_large, response,
n_device_neighbors, n_connected, recurring, n_graph_evidence, n_evidence, steps``. The state a final
decision leaves behind is reported in ``verdict_after`` and ``p_after`` instead of being overwritten.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .policy import action_names, changes, route

Step = tuple[str, Column, str]


def _list(steps: list[Step], exposure: Column, params: Params) -> Column:
    """Actions whose condition holds, in table order."""
    entries = [F.when(cond, F.struct(F.lit(a).alias("action"), route(F.lit(a), exposure, params).alias("route"),
                                     F.lit(why).alias("reason"))) for a, cond, why in steps]
    return F.array_compact(F.array(*entries))


def _append_missing(actions: Column, extra: Column) -> Column:
    names = action_names(actions)
    return F.concat(actions, F.filter(extra, lambda a: ~F.array_contains(names, a["action"])))


def initial_actions(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    p, amount = F.col("p"), F.coalesce("flagged_amount", F.lit(0.0))
    weak = p < params.p_verify_below
    report = F.col("trigger") == "customer_report"
    testing = ~weak & (F.col("pattern") == "card_testing")
    high = ~weak & ~testing & (p >= params.stop_high)
    middle = ~weak & ~testing & ~high
    asks = weak & ~report & (p >= params.p_open_case)
    steps = [
        ("VERIFY_WITH_CUSTOMER", weak & report, "R1: customer report, verify before any block"),
        ("VERIFY_WITH_CUSTOMER", asks | middle, "R1: verify before blocking"),
        ("MONITOR_CARD", weak & ~report & ~asks, "R1: low probability, monitor"),
        ("BLOCK_CARD", testing & F.col("cleared_large"), "R5: a purchase over $100 has cleared"),
        ("DECLINE_TRANSACTION", testing & ~F.col("cleared_large"), "R5: testing sequence"),
        ("STEP_UP_AUTH", testing & ~F.col("cleared_large"), "R5: authenticate before further activity"),
        ("BLOCK_CARD", high, "R2: high-confidence fraud"),
        ("CREATE_CASE", asks | testing | high | middle, "3a: the evidence warrants a case"),
        ("ESCALATE_TO_ANALYST", (F.col("verdict") == "uncertain") & (amount > params.escalate_exposure),
         "R8: uncertain verdict with exposure over $500")]
    # a block after card testing always takes the first approval line, whatever the amount
    limited = F.when(testing, F.lit(0.0)).otherwise(amount)
    return cases.withColumn("initial", _list(steps, limited, params))


def final_actions(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Needs ``initial``. Adds ``final``, ``verdict_after``, ``p_after`` and ``what_changed``."""
    c = F.col
    p, exposure = c("p"), c("exposure")
    confirmed = c("response").eqNullSafe(F.lit("confirmed"))
    denied = c("response").eqNullSafe(F.lit("denied"))
    alone = ~confirmed & ~denied
    high = alone & (p >= params.stop_high)
    middle = alone & ~high & (p >= params.p_verify_below)
    keep = alone & ~high & ~middle & (p >= params.stop_low)
    low = alone & (p < params.stop_low)
    shared = c("n_device_neighbors") > 0
    costly = exposure > params.sar_exposure
    steps = [
        ("CLOSE_NO_FRAUD", confirmed | low, "R3: legitimate"),
        ("VERIFY_WITH_CUSTOMER", middle, "R1: verify before blocking"),
        ("BLOCK_CARD", denied | high, "R2: fraud denied by the customer or held with high confidence"),
        ("CREATE_CASE", denied | high | middle, "R2: case required"),
        ("FILE_REPORT", (denied & (costly | shared | (c("n_connected") > 0))) | (high & (costly | shared)),
         "R2: exposure over $1,000 or shared connections"),
        ("MONITOR_CONNECTED_CARDS", (denied | high) & shared, "R6: shared device profile"),
        ("ESCALATE_TO_ANALYST", middle & (exposure > params.escalate_exposure), "R8: medium confidence with exposure")]
    base = F.when(keep, c("initial")).otherwise(_list(steps, exposure, params))
    recurs = (c("trigger") == "customer_report") & (p < params.p_open_case) & c("recurring")
    disputed = _list([("CREATE_CASE", F.lit(True), "R7: disputed charge matches a recurring pattern"),
                      ("VERIFY_WITH_CUSTOMER", F.lit(True), "R7: verify with the customer"),
                      ("WARN_CUSTOMER", F.lit(True), "R7: recurring charges")], exposure, params)
    final = F.when(recurs, disputed).otherwise(base)
    odd = c("pattern") == "undocumented"
    extra = _list([("CREATE_CASE", odd, "R9: undocumented pattern requires a case"),
                   ("FILE_REPORT", odd & costly, "R9: coordinated pattern requires a report"),
                   ("ESCALATE_TO_ANALYST", odd, "R9: analyst review")], exposure, params)
    out = cases.withColumn("_base", final).withColumn("final", _append_missing(c("_base"), extra)).drop("_base")
    after = (F.when(recurs | confirmed | low, "legitimate").when(denied | high, "fraud").otherwise(c("verdict")))
    moved = (F.when(confirmed, F.greatest(F.lit(0.0), p - 0.5)).when(denied, F.least(F.lit(1.0), p + 0.2)).otherwise(p))
    return out.withColumns({"verdict_after": after, "p_after": moved, "what_changed": changes(c("initial"), c("final"))})


def report_decision(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``sar_file`` and ``sar_reason`` from ``verdict_after``; the last ground that holds names the reason."""
    c = F.col
    fraud = c("verdict_after") == "fraud"
    ground = (F.when(c("pattern") == "undocumented", "Undocumented coordinated pattern")
              .when(c("n_connected") > 0, "Connected to another card's fraud")
              .when(c("n_device_neighbors") > 0, "Shared device profile linking multiple cards")
              .when(c("exposure") > params.sar_exposure, "Exposure exceeds $1,000 threshold"))
    reason = (F.when(~fraud, "Verdict is not fraud").when(ground.isNotNull(), ground)
              .otherwise("No SAR triggers met: exposure below threshold and no shared connections"))
    return cases.withColumns({"sar_file": fraud & ground.isNotNull(), "sar_reason": reason})


def stop_and_status(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    c = F.col
    stop = (F.when((c("p") >= params.stop_high) & (c("n_graph_evidence") >= 2), "high")
            .when((c("p") <= params.stop_low) & (c("n_evidence") >= 2), "low")
            .when(c("response") == "denied", "denied").when(c("response") == "confirmed", "confirmed")
            .when(c("steps") >= 8, "steps").otherwise(""))
    status = (F.when(c("verdict_after") == "fraud", "closed_fraud").when(c("verdict_after") == "legitimate", "closed_legitimate")
              .when(c("p_after") >= 0.5, "escalated").otherwise("open"))
    return cases.withColumns({"stop": stop, "status": status})
