"""Retrieval bounded by ``as_of``. Every query answers a whole set of alerts at once.

Alerts carry ``case_id``, ``customer_id`` and the bounds in microseconds; a single call is the
one-row case.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..params import DEFAULT, HOUR, Params
from .skew import band_join, running_totals, top_k, trailing_counts, window_pieces


def txn_context(alerts: DataFrame, ledger: DataFrame) -> DataFrame:
    """The flagged row of each alert with its device."""
    a = alerts.select("case_id", F.col("flagged_txn_id").alias("TransactionID"))
    return a.join(ledger, "TransactionID")


def card_window(alerts: DataFrame, ledger: DataFrame, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Rows on any of the customer's cards in ``[start, end)``."""
    return band_join(alerts.select("case_id", "customer_id", start, end), ledger, ["customer_id"], start, end)


def lookback(alerts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Add the look-back span ``[flagged - lookback, opened)``."""
    return alerts.withColumns({"start_us": F.col("flag_us") - params.lookback_us, "end_us": F.col("opened_us")})


def baseline(alerts: DataFrame, as_of: str = "flag_us", params: Params = DEFAULT) -> DataFrame:
    return alerts.withColumns({"start_us": F.col(as_of) - params.baseline_us, "end_us": F.col(as_of)})


def baseline_summary(alerts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Count, mean amount and distinct regions, devices and products per alert's span."""
    probes = alerts.select("case_id", "customer_id", "start_us", "end_us")
    amount = F.col("TransactionAmt")
    pieces = window_pieces(probes, ledger, ["customer_id"], "start_us", "end_us",
                           ["addr1", "device_profile_id", "ProductCD"],
                           {"n": F.lit(1), "total": amount, "n_amount": F.when(amount.isNotNull(), 1).otherwise(0)})
    g = pieces.groupBy("case_id").agg(
        F.sum("n").alias("n_txns"), (F.sum("total") / F.sum("n_amount")).alias("avg_amount"),
        F.countDistinct("addr1").alias("n_regions"), F.countDistinct("device_profile_id").alias("n_devices"),
        F.countDistinct("ProductCD").alias("n_products"))
    empty = {"n_txns": 0, "n_regions": 0, "n_devices": 0, "n_products": 0}
    return alerts.select("case_id").join(g, "case_id", "left").fillna(empty)


def device_totals(probes: DataFrame, ledger: DataFrame, width_us: int) -> DataFrame:
    """Per (case, device) in the ``width_us`` before ``end_us``: rows, distinct cards and customers, rows marked new or behind a
    proxy, mean score. Probes without rows there are left out."""
    new, proxy = F.col("id_15") == "New", F.col("id_23").isNotNull()
    sums = {"n_txns": F.lit(1), "n_new": flag(new), "n_proxy": flag(proxy), "n_new_proxy": flag(new & proxy),
            "_score": F.coalesce("p_txn", F.lit(0.0)), "_scored": flag(F.col("p_txn").isNotNull())}
    found = trailing_counts(probes.select("case_id", "device_profile_id", "end_us"), ledger.filter(F.col("device_profile_id").isNotNull()),
                            ["device_profile_id"], "end_us", width_us, sums, {"n_cards": F.col("card_id"), "n_customers": F.col("customer_id")})
    mean = F.when(F.col("_scored") > 0, F.col("_score") / F.col("_scored"))
    return found.filter(F.col("n_txns") > 0).withColumn("mean_score", mean).drop("end_us", "_score", "_scored")


def device_neighbors(probes: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows themselves: same device in ``[start, end)``."""
    rows = ledger.filter(F.col("device_profile_id").isNotNull())
    keep = probes.select("case_id", "device_profile_id", "start_us", "end_us")
    return band_join(keep, rows, ["device_profile_id"], "start_us", "end_us")


def population_window(ledger: DataFrame, start_us: int, end_us: int) -> DataFrame:
    return ledger.filter((F.col("us") >= start_us) & (F.col("us") < end_us))


def prior_cases(alerts: DataFrame, closed: DataFrame) -> DataFrame:
    """Closed cases of the same customer, closed strictly before the alert was opened."""
    a = alerts.select(F.col("case_id").alias("alert_id"), "customer_id", F.col("opened_us").alias("as_of"))
    return a.join(closed, "customer_id").filter(F.col("closed_us") < F.col("as_of"))


def device_case_links(probes: DataFrame, closed: DataFrame, members: DataFrame, ledger: DataFrame,
                      confirmed_only: bool = True, lookback_us: int | None = None) -> DataFrame:
    """Closed cases whose transactions used the probe's device.

    ``probes``: ``case_id, device_profile_id, as_of``. With ``lookback_us`` the device use must lie in
    ``[as_of - lookback, as_of)``; the case must be closed before ``as_of`` either way. The case side is
    reduced to one row per (device, case) with its first and last use before it meets the probes.
    """
    c = closed.filter(F.col("outcome") == "confirmed_fraud") if confirmed_only else closed
    rows = ledger.filter(F.col("device_profile_id").isNotNull()).select("TransactionID", "device_profile_id", "us")
    used = members.join(c.select("case_id", "closed_us"), "case_id").join(rows, "TransactionID").withColumnRenamed("case_id", "closed_case")
    if lookback_us is None:
        # one row per side and device, so a pair comes about once; the pairs are never shuffled
        uses = used.groupBy("device_profile_id", "closed_case").agg(F.min("closed_us").alias("closed_us"))
        asked = probes.groupBy("case_id", "device_profile_id").agg(F.max("as_of").alias("as_of"))
        j = asked.join(uses, "device_profile_id").filter(F.col("closed_us") < F.col("as_of"))
        return j.select("case_id", "device_profile_id", "closed_case")
    uses = (used.withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
            .groupBy("device_profile_id", "closed_case", "closed_us", "day")
            .agg(F.min("us").alias("first_use"), F.max("us").alias("last_use")))
    j = probes.select("case_id", "device_profile_id", "as_of").join(uses, "device_profile_id")
    # day rows straddling the lower bound are cut by their last use, those straddling as_of by the first
    j = j.filter((F.col("closed_us") < F.col("as_of")) & (F.col("last_use") >= F.col("as_of") - lookback_us) & (F.col("first_use") < F.col("as_of")))
    return j.select("case_id", "device_profile_id", "closed_case").distinct()


def structuring_sweep(ledger: DataFrame, start_us: int, end_us: int, params: Params = DEFAULT) -> DataFrame:
    """Online rows just under the cap inside the span, per card; the ids are the matching rows."""
    return in_band(population_window(ledger, start_us, end_us), params).select(
        "card_id", "TransactionID", "us", "TransactionAmt")


def in_band(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    amount = F.col("TransactionAmt")
    return rows.filter((F.col("channel") == "online") & (amount < params.cap) & (amount >= params.band * params.cap))


def known_before(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """As-of backward count, strict: confirmed rows of ``key`` whose case closed before ``us``.

    Rows and closings are merged into one time line; a closing at the row's own instant sorts after it.
    ``labels``: ``key, closed_us``.
    """
    line = rows.withColumn("_kind", F.lit(0)).unionByName(
        labels.filter(F.col(key).isNotNull()).select(key, F.col("closed_us").alias("us"), F.lit(1).alias("_kind")),
        allowMissingColumns=True)
    line = running_totals(line, [key], ["us", "_kind"], {name: ("sum", F.col("_kind"))})
    return line.filter(F.col("_kind") == 0).drop("_kind")


# ---- card, customer, device and region look-ups over a set of probes -------------------------------

def card_transactions(cards: DataFrame, ledger: DataFrame, limit: int = 100, last: bool = False) -> DataFrame:
    """First (or last) ``limit`` rows of each card in time order."""
    order = ([F.desc("us"), F.desc("TransactionID")] if last else [F.asc("us"), F.asc("TransactionID")])
    return top_k(ledger.join(cards.select("card_id").distinct(), "card_id", "left_semi"), ["card_id"], order, limit)


def customer_transactions(customers: DataFrame, ledger: DataFrame, limit: int = 500) -> DataFrame:
    """Last ``limit`` rows of each customer."""
    rows = ledger.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    return top_k(rows, ["customer_id"], [F.desc("us"), F.desc("TransactionID")], limit)


def customer_cards(ledger: DataFrame) -> DataFrame:
    return ledger.select("customer_id", "card_id").distinct()


def cards_of(ledger: DataFrame, key: str) -> DataFrame:
    """Cards seen with each device (``device_profile_id``) or region (``addr1``)."""
    return ledger.filter(F.col(key).isNotNull()).groupBy(key, "card_id").agg(F.count(F.lit(1)).alias("n_txns"))


def shared_among(card_sets: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` used by more than one card of the same set (``set_id, card_id``)."""
    use = ledger.filter(F.col(key).isNotNull()).select("card_id", key).distinct()
    g = card_sets.select("set_id", "card_id").distinct().join(use, "card_id")
    g = g.groupBy("set_id", key).agg(F.count(F.lit(1)).alias("card_count"))
    return g.filter(F.col("card_count") > 1)


def closed_by_device(closed: DataFrame, members: DataFrame, ledger: DataFrame) -> DataFrame:
    dev = ledger.filter(F.col("device_profile_id").isNotNull()).select("TransactionID", "device_profile_id")
    ids = members.join(dev, "TransactionID").select("device_profile_id", "case_id").distinct()
    return ids.join(closed.select("case_id", "outcome", "pattern"), "case_id")


def similar_cases(alerts: DataFrame, closed: DataFrame, params_pattern: str = "pattern", k: int = 10) -> DataFrame:
    """Additive overlap: customer .3, card .3, pattern .2; above .2; the ten best.

    Pattern alone scores .2 and never passes, so only pairs sharing a customer or card can qualify and
    two equi-joins find them all.
    """
    a = alerts.select(F.col("case_id").alias("alert_id"), F.col("customer_id").alias("a_customer"),
                      F.col("card_id").alias("a_card"), F.col(params_pattern).alias("a_pattern"))
    c = closed.select("case_id", "customer_id", "card_id", "pattern")
    pairs = a.join(c, F.col("a_customer") == F.col("customer_id")).unionByName(
        a.join(c, (F.col("a_card") == F.col("card_id")) & (F.col("a_customer") != F.col("customer_id"))))
    score = (0.3 * flag(F.col("a_customer") == F.col("customer_id")) + 0.3 * flag(F.col("a_card") == F.col("card_id"))
             + 0.2 * flag((F.col("a_pattern") != "") & (F.col("a_pattern") == F.col("pattern"))))
    scored = pairs.withColumn("similarity", F.round(score, 6)).filter(F.col("similarity") > 0.2)
    return top_k(scored, ["alert_id"], [F.desc("similarity"), F.asc("case_id")], k)


def velocity(ledger: DataFrame, hours: int = 24) -> DataFrame:
    """Per card: rows in the ``hours`` up to and including its latest row.

    The latest instant is an aggregate joined back, so no card's rows meet in one task.
    """
    latest = ledger.groupBy("card_id").agg(F.max("us").alias("latest_us"))
    rows = ledger.join(latest, "card_id").filter(F.col("us") >= F.col("latest_us") - hours * HOUR)
    return rows.groupBy("card_id", "latest_us").agg(
        F.count(F.lit(1)).alias("n"), F.sum("TransactionAmt").alias("total"), F.avg("TransactionAmt").alias("avg_amount"))


def earlier_investigations(alerts: DataFrame, devices: DataFrame, memory: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Earlier cases sharing a card, a specific device or the customer, with the reason text.

    ``alerts``: ``case_id, customer_id, cards``; ``devices``: ``case_id, device_profile_id`` (specific
    ones only); ``memory``: ``case_id, customer_id, cards, devices, verdict, pattern, opened_us``.
    """
    m = memory.select(F.col("case_id").alias("earlier_id"), F.col("customer_id").alias("earlier_customer"),
                      "cards", "devices")
    by_card = (alerts.select("case_id", F.explode("cards").alias("card_id"))
               .join(m.select("earlier_id", F.explode("cards").alias("card_id")), "card_id")
               .groupBy("case_id", "earlier_id").agg(F.slice(F.array_sort(F.collect_set("card_id")), 1, params.shown_shared).alias("shared"))
               .select("case_id", "earlier_id", F.lit(1).alias("rank"),
                       F.concat(F.lit("card "), F.array_join("shared", ", ")).alias("why")))
    by_device = (devices.join(m.select("earlier_id", F.explode("devices").alias("device_profile_id")), "device_profile_id")
                 .select("case_id", "earlier_id", F.lit(2).alias("rank"), F.lit("device profile").alias("why")).distinct())
    by_customer = (alerts.select("case_id", F.col("customer_id").alias("earlier_customer"))
                   .join(m.select("earlier_id", "earlier_customer"), "earlier_customer")
                   .select("case_id", "earlier_id", F.lit(3).alias("rank"), F.lit("same customer").alias("why")))
    links = by_card.unionByName(by_device).unionByName(by_customer).filter(F.col("case_id") != F.col("earlier_id"))
    # at most three reasons exist per pair, so the list is bounded
    why = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "why"))), lambda x: x["why"]), "; ")
    return links.groupBy("case_id", "earlier_id").agg(why.alias("why"))
