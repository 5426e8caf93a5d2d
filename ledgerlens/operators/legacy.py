"""The earlier generation of detectors: per-card rules over a card's recent rows.

"Recent" is the true last ``n`` rows; ``take="first"`` uses the earliest ones instead, which is what the
earlier generation actually read. Results are one row per alert or card.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, flag
from .skew import running_totals, top_k

# Base weight per pattern and the boost of each kind of evidence.
WEIGHTS = {"card_testing": 0.85, "card_not_present_fraud": 0.65, "card_not_present_new_device": 0.75,
           "out_of_region_use": 0.70, "account_takeover": 0.80, "undocumented": 0.60}
BOOSTS = {"e_small_online": 0.15, "e_denied": 0.20, "e_confirmed": -0.30, "e_new_device": 0.10, "e_shared_device": 0.10,
          "e_out_of_region": 0.10, "e_high_velocity": 0.05, "e_closed_case": 0.05, "e_proxy": 0.05,
          "e_recurring": -0.15, "e_normal": -0.10}


def recent(ledger: DataFrame, n: int, take: str = "last") -> DataFrame:
    last = take == "last"
    order = [F.desc("us"), F.desc("TransactionID")] if last else [F.asc("us"), F.asc("TransactionID")]
    return top_k(ledger, ["card_id"], order, n)


def card_testing_any_time(ledger: DataFrame, any_small: bool) -> DataFrame:
    """Cards whose first row of at least $50 after small online rows follows two or more of them.

    ``any_small``: the search stops at the first large row after *any* small row; otherwise at the first
    one after at least two.
    """
    small = (F.col("channel") == "online") & (F.col("TransactionAmt") < 5)
    rows = ledger.select("card_id", "us", "TransactionID", "TransactionAmt", flag(small).alias("small"))
    run = running_totals(rows, ["card_id"], ["us", "TransactionID"],
                         {"before": ("sum", F.col("small")), "paid": ("sum", F.col("TransactionAmt") * F.col("small"))})
    stop = (F.col("small") == 0) & (F.col("TransactionAmt") >= 50) & (F.col("before") >= (1 if any_small else 2))
    first = run.filter(stop).groupBy("card_id").agg(
        F.min(F.struct("us", "TransactionID", "TransactionAmt", "before", "paid")).alias("h"))
    sizes = ledger.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))
    return first.join(sizes.filter(F.col("n") >= 3), "card_id").filter(F.col("h.before") >= 2).select(
        "card_id", F.col("h.before").alias("n_small"), F.round("h.paid", 2).alias("small_total"),
        F.col("h.TransactionID").alias("large_txn"), F.col("h.TransactionAmt").alias("large_amount"))


def card_profile(alerts: DataFrame, ledger: DataFrame, n: int = 30, take: str = "last") -> DataFrame:
    """What the rules read about each alert's card: at most ``n`` rows per card go into it."""
    rows = recent(ledger.join(alerts.select("card_id").distinct(), "card_id", "left_semi"), n, take)
    size = rows.groupBy("card_id").agg(F.max("rank").alias("n_rows"))
    rows = rows.join(size, "card_id").withColumn(
        "place", F.when(F.lit(take == "last"), F.col("rank")).otherwise(F.col("n_rows") - F.col("rank") + 1))
    online = F.col("channel") == "online"
    small = online & (F.col("TransactionAmt") < 5)
    near = lambda k: F.col("place") <= k  # noqa: E731 - the k rows nearest to the end of the list
    return rows.groupBy("card_id", "n_rows").agg(
        F.avg("TransactionAmt").alias("avg_amount"), F.sum(flag(online)).alias("n_online"),
        F.countDistinct(F.when(near(10), F.col("channel"))).alias("channels10"),
        F.countDistinct("R_emaildomain").alias("n_recipients"), F.sum(flag(small & near(5))).alias("small5"),
        F.max(F.when(near(5), F.col("TransactionAmt"))).alias("max5"))


def rule_flags(alerts: DataFrame, profile: DataFrame) -> DataFrame:
    """Each rule as a boolean. ``alerts`` carries the flagged row's ``channel, TransactionAmt`` and the
    evidence flags ``testing_hit, new_device, proxy, new_region, device_cards``."""
    c = F.col
    a = alerts.join(profile, "card_id", "left")
    online, person = c("channel") == "online", c("channel") == "in_person"
    odd = (c("new_device") == 1) | (c("proxy") == 1)
    out = {"r_testing": c("testing_hit") == 1,
           "r_cnp": online & (c("TransactionAmt") > 3 * c("avg_amount")) & (c("TransactionAmt") > 100) & (c("n_online") >= 2),
           "r_new_device": online & odd, "r_region": person & (c("new_region") == 1),
           "r_takeover": (c("n_rows") >= 5) & (c("channels10") > 1) & odd,
           "r_undocumented": (c("device_cards") >= 3) | (c("n_recipients") >= 3)}
    return a.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in out.items()})


def first_pattern(flags: DataFrame) -> DataFrame:
    order = [("r_testing", "card_testing"), ("r_cnp", "card_not_present_fraud"), ("r_new_device", "card_not_present_new_device"),
             ("r_region", "out_of_region_use"), ("r_takeover", "account_takeover"), ("r_undocumented", "undocumented")]
    name = F.lit("none")
    for rule, pattern in reversed(order):
        name = F.when(F.col(rule), pattern).otherwise(name)
    return flags.withColumn("pattern", name)


def scorecard(pattern: Column, evidence: dict[str, Column], trigger: Column, risk: Column, n_precedents: Column) -> Column:
    """Weighted evidence in [0, 1]. ``evidence``: count of claims per kind; no claim at all gives 0.5."""
    base = F.lit(0.0)
    for name, w in WEIGHTS.items():
        base = F.when(pattern == name, F.lit(w)).otherwise(base)
    total, any_claim = base, F.lit(0)
    for kind, n in evidence.items():
        total = total + F.lit(BOOSTS[kind]) * n
        any_claim = any_claim + n
    total = (total + F.when(trigger == "customer_report", 0.15).otherwise(0.0) + F.when(risk > 0.8, 0.05).otherwise(0.0)
             + F.lit(0.10) * F.least(n_precedents, F.lit(3)))
    return F.when(any_claim == 0, 0.5).otherwise(clip(total, 0.0, 1.0))


def out_of_region(ledger: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes (card_id, region)``: rows in the region, rows in other regions, and whether both occur."""
    j = probes.select("card_id", "region").distinct().join(ledger.select("card_id", "addr1"), "card_id")
    here = F.col("addr1") == F.col("region")
    g = j.groupBy("card_id", "region").agg(F.sum(flag(here)).alias("n_in_region"), F.sum(flag(~here)).alias("n_elsewhere"))
    return g.withColumn("detected", (F.col("n_in_region") > 0) & (F.col("n_elsewhere") > 0))


def new_device(ledger: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes (card_id, device_profile_id)``: a device is new when the card used it at most once."""
    use = ledger.groupBy("card_id", "device_profile_id").agg(F.count(F.lit(1)).alias("n"))
    j = probes.select("card_id", "device_profile_id").distinct().join(use, ["card_id", "device_profile_id"], "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("card_id", "device_profile_id", (n <= 1).alias("detected"), F.greatest(n - 1, F.lit(0)).alias("prior_uses"))


def context_signals(alerts: DataFrame, ledger: DataFrame, n: int = 30) -> DataFrame:
    """Flagged amount against the card's recent average, same-day runs and small rows among the last five.

    In time order, neighbours on the same day number the rows less the distinct days.
    """
    rows = recent(ledger.join(alerts.select("card_id").distinct(), "card_id", "left_semi"), n)
    five = F.col("rank") <= 5
    g = rows.groupBy("card_id").agg(
        F.avg("TransactionAmt").alias("avg_amount"), F.sum(flag(five)).alias("n5"),
        F.countDistinct(F.when(five, F.floor(F.col("us") / 86_400_000_000))).alias("days5"),
        F.sum(flag(five & (F.col("TransactionAmt") < 5))).alias("small5"))
    j = alerts.select("case_id", "card_id", "TransactionAmt").join(g, "card_id")
    enough = F.col("n5") >= 3
    return j.select("case_id", (F.col("TransactionAmt") > 3 * F.col("avg_amount")).alias("high_amount"),
                    (F.col("TransactionAmt") < 0.5 * F.col("avg_amount")).alias("low_amount"),
                    (enough & (F.col("n5") - F.col("days5") >= 2)).alias("same_day_burst"),
                    F.when(enough, F.col("small5")).otherwise(0).alias("n_small"))


def same_price(alerts: DataFrame, ledger: DataFrame, within: float = 1.0) -> DataFrame:
    """Alerts whose card has another row with the same e-mail domain and nearly the same amount.

    Amounts are cut into steps of ``within``; a near amount lies in the same or an adjacent step, so the
    match is an equi-join on (card, domain, step).
    """
    a = alerts.select("case_id", "card_id", "flagged_txn_id", "P_emaildomain", F.col("TransactionAmt").alias("f_amt"))
    step = F.floor(F.col("f_amt") / within)
    a = a.withColumn("step", F.explode(F.array(step - 1, step, step + 1))).withColumn("mail", F.coalesce("P_emaildomain", F.lit("")))
    r = ledger.select("card_id", "TransactionID", "TransactionAmt", F.coalesce("P_emaildomain", F.lit("")).alias("mail"),
                      F.floor(F.col("TransactionAmt") / within).alias("step"))
    hit = a.join(r, ["card_id", "mail", "step"]).filter(
        (F.abs(F.col("TransactionAmt") - F.col("f_amt")) < within) & (F.col("TransactionID") != F.col("flagged_txn_id")))
    return hit.select("case_id").distinct()
