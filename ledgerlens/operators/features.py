"""Causal behaviour features.

Histories are running totals per key over time slices, so no customer, card or device is ordered in one
task. Case closings travel in the same time line, which turns the strict as-of counts into running sums.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..params import DAY, HOUR
from ..session import released, stored
from .skew import running_totals, trailing_totals

CUSTOMER = "customer_id"
PROFILE_KEYS = ["uid", "uid2", CUSTOMER]
LABEL_KEYS = ["uid", "uid2", "card_id", CUSTOMER]
SEEN = ["ProductCD", "device_profile_id", "addr1", "P_emaildomain"]
SPEEDS = {"vel1h": HOUR, "vel24h": 24 * HOUR, "small1h": HOUR}

# The model's columns.
CATEGORICAL = ["ProductCD", "channel", "P_emaildomain", "R_emaildomain", "id_15", "id_23", "id_34", "DeviceType",
               "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9", "addr2"]
NUMERIC = (["TransactionAmt", "risk_score", "dist1", "dist2"] + [f"C{i}" for i in range(1, 15)]
           + [f"D{i}" for i in range(1, 16)] + ["cents", "hour", "addr1n"])
DERIVED_PREFIXES = ("known_fraud", "n_prev", "amt_ratio", "dt_prev", "vel", "small1h", "seen_", "dev_")


def label_table(closed: DataFrame, members: DataFrame, opened_before: int | None = None) -> DataFrame:
    """One row per labelled transaction: its earliest confirmed case."""
    f = closed.filter(F.col("outcome") == "confirmed_fraud")
    if opened_before is not None:
        f = f.filter(F.col("opened_us") < opened_before)
    j = members.join(f.select("case_id", "closed_us", "pattern"), "case_id")
    best = j.groupBy("TransactionID").agg(F.min(F.struct("closed_us", "case_id", "pattern")).alias("l"))
    return best.select("TransactionID", F.col("l.closed_us").alias("closed_us"), F.col("l.case_id").alias("label_case"),
                       F.col("l.pattern").alias("label_pattern"))


def with_cardholder_keys(ledger: DataFrame) -> DataFrame:
    """``uid``: card, region and account-open day; ``uid2`` adds the e-mail domain."""
    day = F.floor(F.col("TransactionDT") / 86400)
    opened = (day - F.coalesce(F.col("D1"), F.lit(-999.0))).cast("long").cast("string")
    uid = F.concat_ws("_", "card_id", F.coalesce("addr1", F.lit("na")), opened)
    return ledger.withColumns({"day": day, "uid": uid,
                               "uid2": F.concat_ws("_", uid, F.coalesce("P_emaildomain", F.lit("na")))})


def row_features(rows: DataFrame) -> DataFrame:
    dev = F.col("device_profile_id")
    amount = F.col("TransactionAmt")
    return rows.withColumns({
        "small_online": flag((amount < 5) & (F.col("channel") == "online")),
        "dev_specific": flag(dev.isNotNull() & ~dev.contains("UNK")),
        "cents": F.bround(F.pmod(amount * 100, F.lit(100.0))),
        "hour": F.hour(F.timestamp_micros("us")),
        "addr1n": F.col("addr1").try_cast("double")})


def device_use(rows: DataFrame) -> DataFrame:
    """``dev_txn7d``: uses of the device in ``(t - 7 d, t]``. Rows without a device skip the shuffle. ``rows`` is read twice."""
    known = F.col("device_profile_id").isNotNull()
    some, none = rows.filter(known), rows.filter(~known)
    some = trailing_totals(some, ["device_profile_id"], "TransactionID", "us",
                           {"dev_txn7d": (7 * DAY, F.lit(1))})
    return some.unionByName(none.withColumn("dev_txn7d", F.lit(0).cast("long")))


def _time_line(rows: DataFrame) -> DataFrame:
    closings = rows.filter(F.col("y") == 1).select(
        CUSTOMER, "card_id", "uid", "uid2", F.col("closed_us").alias("us"), F.lit(1).alias("_kind"))
    return rows.withColumn("_kind", F.lit(0)).unionByName(closings, allowMissingColumns=True)


ORDER = ["us", "_kind", "TransactionID"]


def _histories(rows: DataFrame) -> DataFrame:
    """The histories of ``rows``, which hold what these read and no more: every step moves them once."""
    real = F.col("_kind") == 0
    values = {f"_v_{c}": F.coalesce(F.col(c), F.lit("NA")) for c in SEEN}
    line = stored(_time_line(rows).withColumns(values))
    out = line
    for k in LABEL_KEYS:
        totals = {f"known_fraud_{k}": ("sum", F.col("_kind"))}
        if k in PROFILE_KEYS:
            totals |= {f"n_prev_{k}": ("count", F.when(real, 1)),
                       f"_sum_{k}": ("sum", F.when(real, F.col("TransactionAmt"))),
                       f"_last_{k}": ("max", F.when(real, F.col("us")))}
        out = running_totals(out, [k], ORDER, totals, source=line)
    out = released(out)
    for c in SEEN:
        out = running_totals(out, [CUSTOMER, f"_v_{c}"], ORDER, {f"seen_{c}": ("count", F.when(real, 1))}, source=line)
        out = out.withColumn(f"seen_{c}", (F.col(f"seen_{c}") > 0).cast("int"))
    out = released(out)
    spans = {n: (w, F.col("small_online") if n == "small1h" else F.lit(1)) for n, w in SPEEDS.items()}
    out = trailing_totals(out.filter(real), [CUSTOMER], "TransactionID", "us", spans, source=line.filter(real))
    return out.drop(*values)


def build_features(ledger: DataFrame, closed: DataFrame, members: DataFrame, opened_before: int | None = None) -> DataFrame:
    labels = label_table(closed, members, opened_before)
    rows = with_cardholder_keys(ledger).join(labels, "TransactionID", "left")
    rows = row_features(rows.withColumn("y", F.col("closed_us").isNotNull().cast("int")))
    # histories run on the columns they read; the whole rows are moved once, to get theirs by the number they were stored with
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    asked = rows.select(*dict.fromkeys(["_row", "TransactionID", "us", "y", "closed_us", *LABEL_KEYS, "TransactionAmt", "small_online", *SEEN]))
    out = _histories(device_use(asked))
    out = rows.join(out.select("_row", *[c for c in out.columns if c not in rows.columns]), "_row").drop("_row")
    final = {}
    for k in PROFILE_KEYS:
        mean = F.nullif(F.col(f"_sum_{k}") / F.nullif(F.col(f"n_prev_{k}"), F.lit(0)), F.lit(0.0))
        final[f"amt_ratio_{k}"] = F.col("TransactionAmt") / mean
        final[f"dt_prev_{k}"] = (F.col("us") - F.col(f"_last_{k}")) / 1e6
    final["vel1h"], final["vel24h"] = F.col("vel1h") - 1, F.col("vel24h") - 1
    return out.withColumns(final).drop("_kind", *[f"_{n}_{k}" for k in PROFILE_KEYS for n in ("sum", "last")])


def model_columns(features: DataFrame) -> tuple[list[str], list[str]]:
    """Categorical and numeric model columns present in ``features``."""
    have = features.columns
    derived = [c for c in have if c.startswith(DERIVED_PREFIXES)]
    return [c for c in CATEGORICAL if c in have], [c for c in NUMERIC if c in have] + derived


def recency_flags(alerts: DataFrame, features: DataFrame, params) -> DataFrame:
    """What each flagged row looks like against the customer's baseline.

    ``alerts`` joined with its flagged row: ``case_id, customer_id, flag_us, addr1, device_profile_id,
    card_id, uid``. Baseline rows come pre-aggregated per day, so the flags cost one row per day and
    value; only the median needs single amounts, and only of the flagged cardholder.
    """
    from .asof import baseline
    from .skew import band_join, window_pieces
    probes = baseline(alerts, params=params).select(
        "case_id", CUSTOMER, "start_us", "end_us", "flag_us", F.col("addr1").alias("f_addr1"),
        F.col("device_profile_id").alias("f_dev"), F.col("card_id").alias("f_card"), F.col("uid").alias("f_uid"))
    dims = ["addr1", "device_profile_id", "card_id", "uid"]
    # a row is "old" when it lies before flag - 14 d; spans are cut there so no piece straddles the limit
    cut = F.least(F.greatest(F.col("flag_us") - params.established_us, F.col("start_us")), F.col("end_us"))
    old = probes.withColumns({"end_us": cut, "old": F.lit(1)})
    new = probes.withColumns({"start_us": cut, "old": F.lit(0)})
    pieces = window_pieces(old.unionByName(new), features, [CUSTOMER], "start_us", "end_us", dims, {"n": F.lit(1)})
    region, device = F.col("addr1") == F.col("f_addr1"), F.col("device_profile_id") == F.col("f_dev")
    own, holder, is_old = F.col("card_id") == F.col("f_card"), F.col("uid") == F.col("f_uid"), F.col("old") == 1
    hit = lambda c: F.max(flag(c))
    g = pieces.groupBy("case_id").agg(
        F.sum("n").alias("hist_n"), F.sum(F.when(holder, F.col("n")).otherwise(0)).alias("uid_hist_n"),
        F.sum(F.when(is_old, F.col("n")).otherwise(0)).alias("old_n"),
        hit(region).alias("seen_region"), hit(region & holder).alias("seen_uid_region"),
        hit(device & is_old).alias("seen_dev"), hit(region & own & is_old).alias("seen_card_region"))
    amounts = band_join(probes.select("case_id", F.col("f_uid").alias("uid"), "start_us", "end_us"),
                        features.select("uid", "us", "TransactionAmt"), ["uid"], "start_us", "end_us")
    typical = amounts.groupBy("case_id").agg(F.median("TransactionAmt").alias("typical_amt"))
    flags = ["hist_n", "uid_hist_n", "old_n", "seen_region", "seen_uid_region", "seen_dev", "seen_card_region"]
    return (alerts.select("case_id").join(g, "case_id", "left").join(typical, "case_id", "left")
            .fillna({c: 0 for c in flags}))
