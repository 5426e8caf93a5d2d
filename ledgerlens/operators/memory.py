"""Case memory: episode features, the case index and graph-linked precedents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import flag, share
from ..params import DAY, DEFAULT, Params
from ..session import checkpointed, stored
from .skew import running_totals, window_pieces

# The episode features, in order.
FEATURES = ["n", "log_n", "frac_online", "frac_w", "mixed_channel", "frac_new_dev", "any_new_dev", "frac_found_dev",
            "any_proxy", "frac_has_device", "n_small_online", "frac_small", "max_amt", "mean_amt", "n_regions",
            "frac_region_unseen", "frac_uid_region_unseen", "frac_dev_unseen", "span_h", "n_products", "frac_m4_m2",
            "frac_m6_f", "n_emails", "hist_n"]


def episode_features(episodes: DataFrame, rows: DataFrame, history_us: int = DEFAULT.history_us,
                     bounds: DataFrame | None = None) -> DataFrame:
    """The behavioural vector of each case.

    ``episodes``: ``case_id`` and the ledger columns of its rows (with ``uid``). History is the customer's
    rows in the ``history_us`` before the episode, or the spans of ``bounds (case_id, hist_from, hist_to)``.
    Novelty compares the episode's distinct values with the values of a pre-aggregated history.
    """
    c = F.col
    online, small = c("channel") == "online", (c("TransactionAmt") < 5) & (c("channel") == "online")
    new = c("id_15") == "New"
    base = episodes.groupBy("case_id", "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.log1p(F.count(F.lit(1))).alias("log_n"), share(online).alias("frac_online"),
        share(c("ProductCD") == "W").alias("frac_w"),
        (F.max(flag(online)) * F.max(flag(~online))).alias("mixed_channel"), share(new).alias("frac_new_dev"),
        F.max(flag(new)).alias("any_new_dev"), share(c("id_15") == "Found").alias("frac_found_dev"),
        F.max(flag(c("id_23").isNotNull())).alias("any_proxy"), share(c("device_profile_id").isNotNull()).alias("frac_has_device"),
        F.sum(flag(small)).alias("n_small_online"), share(small).alias("frac_small"), F.max("TransactionAmt").alias("max_amt"),
        F.avg("TransactionAmt").alias("mean_amt"), F.countDistinct("addr1").alias("n_regions"),
        ((F.max("us") - F.min("us")) / 3600e6).alias("span_h"), F.countDistinct("ProductCD").alias("n_products"),
        share(c("M4") == "M2").alias("frac_m4_m2"), share(c("M6") == "F").alias("frac_m6_f"),
        F.countDistinct("P_emaildomain").alias("n_emails"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.max("p_txn").alias("p_flag"))
    probes = base.select("case_id", "customer_id", (c("first_us") - history_us).alias("start_us"), c("first_us").alias("end_us"))
    if bounds is not None:
        probes = base.select("case_id", "customer_id", "first_us").join(bounds, "case_id").select(
            "case_id", "customer_id", c("hist_from").alias("start_us"), F.least("hist_to", "first_us").alias("end_us"))
    past = window_pieces(probes, rows, ["customer_id"], "start_us", "end_us", ["addr1", "device_profile_id", "uid"],
                         {"n_past": F.lit(1)})
    own = episodes.select("case_id", "uid").distinct().withColumn("own_uid", F.lit(1))
    past = past.join(own, ["case_id", "uid"], "left").select(
        "case_id", "addr1", "device_profile_id", F.coalesce("own_uid", F.lit(0)).alias("own_uid"), "n_past", F.lit(0).alias("n_now"))
    both = past.unionByName(episodes.select("case_id", "addr1", "device_profile_id", F.lit(0).alias("own_uid"),
                                            F.lit(0).alias("n_past"), F.lit(1).alias("n_now")))
    region = both.filter(c("addr1").isNotNull()).groupBy("case_id", "addr1").agg(
        F.sum("n_now").alias("now"), F.sum("n_past").alias("seen"), F.sum(c("n_past") * c("own_uid")).alias("seen_own"))
    region = region.groupBy("case_id").agg(F.sum(F.when(c("seen") == 0, c("now"))).alias("r_new"),
                                           F.sum(F.when(c("seen_own") == 0, c("now"))).alias("u_new"))
    device = both.filter(c("device_profile_id").isNotNull()).groupBy("case_id", "device_profile_id").agg(
        F.sum("n_now").alias("now"), F.sum("n_past").alias("seen"))
    device = device.groupBy("case_id").agg(F.sum(F.when(c("seen") == 0, c("now"))).alias("d_new"))
    hist = past.groupBy("case_id").agg(F.sum("n_past").alias("hist_n"))
    out = base.join(region, "case_id", "left").join(device, "case_id", "left").join(hist, "case_id", "left")
    part = lambda x: F.coalesce(c(x), F.lit(0)) / c("n")
    return out.withColumns({"frac_region_unseen": part("r_new"), "frac_uid_region_unseen": part("u_new"),
                            "frac_dev_unseen": part("d_new"), "hist_n": F.coalesce("hist_n", F.lit(0))}).select(
        "case_id", "customer_id", "first_us", "last_us", "p_flag", *[c(f).cast("double").alias(f) for f in FEATURES])


def case_episodes(members: DataFrame, rows: DataFrame) -> DataFrame:
    return members.join(rows, "TransactionID")


def case_index(closed: DataFrame, members: DataFrame, rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per closed case: its features and what retrieval filters on."""
    f = episode_features(case_episodes(members, rows), rows, params.history_us)
    return f.join(closed.select("case_id", "outcome", "pattern", "opened_us", "closed_us", "card_id"), "case_id")


def case_keys(episodes: DataFrame) -> DataFrame:
    """``(case_id, kind, value)``: cardholder keys and devices of each case's rows."""
    pairs = episodes.select("case_id", F.explode(F.array(
        F.struct(F.lit("uid").alias("kind"), F.col("uid").alias("value")),
        F.struct(F.lit("device").alias("kind"), F.col("device_profile_id").alias("value")))).alias("p"))
    return pairs.select("case_id", "p.kind", "p.value").filter(F.col("value").isNotNull()).distinct()


def moments(index: DataFrame, features: list[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation per feature (deviation 0 counts as 1): a fixed-size driver value."""
    row = index.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features}


def standardise(df: DataFrame, stats: dict, features: list[str] = FEATURES, limit: float = 5.0) -> DataFrame:
    """Add ``v``: the standardised feature vector, each entry clipped to ``±limit``."""
    z = [F.greatest(F.lit(-limit), F.least(F.lit(limit), (F.col(f) - F.lit(stats[f][0])) / F.lit(stats[f][1]))) for f in features]
    return df.withColumn("v", F.array(*z))


BLOCKS = 8      # tasks that the cases on a device are dealt to

# How a link is named (first match wins) and in which order links are listed.
LINKS = [("same cardholder (uid)", 1, 0), ("same card", 2, 2), ("same device profile", 3, 1), ("same customer", 4, 3)]


def graph_links(alerts: DataFrame, uids: DataFrame, cards: DataFrame, devices: DataFrame, index: DataFrame,
                keys: DataFrame, most: int | None = None) -> DataFrame:
    """Closed cases reachable from each alert over the cardholder, card, device or customer.

    ``alerts``: ``case_id, customer_id, as_of``; ``uids``/``cards``/``devices``: long tables per alert.
    Four equi-joins find the pairs; the label is the first that matches, the rank orders the list. Pairs that come too late
    are left out at once. Pairs over a device, of which there are most, are never shuffled (``device_pairs``).

    With ``most`` an alert gets the links to its first ``most`` cases of each outcome, in the order of rank and case. A busy
    device then brings only its first cases (``first_on_device``), so there are no rows of all pairs that share one.
    """
    c = index.select(F.col("case_id").alias("closed_case"), "customer_id", "card_id", "closed_us", "outcome", "pattern")
    closed = c.groupBy("closed_case").agg(F.min("closed_us").alias("since"), F.collect_list(F.struct("closed_us", "outcome", "pattern")).alias("closed"))
    asked = alerts.groupBy("case_id").agg(F.max("as_of").alias("until"), F.collect_list("as_of").alias("as_of"))
    k = keys.withColumnRenamed("case_id", "closed_case")
    sides = [
        (uids, k.filter(F.col("kind") == "uid").select("closed_case", F.col("value").alias("uid")), "uid"),
        (cards, c.select("closed_case", "card_id"), "card_id"),
        (devices, k.filter(F.col("kind") == "device").select("closed_case", F.col("value").alias("device_profile_id")), "device_profile_id"),
        (alerts, c.select("closed_case", "customer_id"), "customer_id")]
    if most is None:
        near = None
        for (mine, theirs, key), (_, first, _) in zip(sides, LINKS):
            if key != "device_profile_id":
                p = mine.select("case_id", key).distinct().join(asked.select("case_id", "until"), "case_id").join(
                    theirs.distinct().join(closed.select("closed_case", "since"), "closed_case"), key)
                p = p.filter(F.col("since") < F.col("until")).select("case_id", "closed_case", F.lit(first).alias("first"))
                near = p if near is None else near.unionByName(p)
        near = stored(near.groupBy("case_id", "closed_case").agg(F.min("first").alias("first")))
        mine, theirs = stored(devices.select("case_id", "device_profile_id").filter(F.col("device_profile_id").isNotNull()).distinct()), stored(sides[2][1].distinct())
        both = near.filter("first = 4").join(mine, "case_id").join(theirs, ["closed_case", "device_profile_id"], "left_semi")
        both = both.select("case_id", "closed_case", F.lit(3).alias("_device")).distinct()
        best = near.join(both, ["case_id", "closed_case"], "left").withColumn("first", F.coalesce("_device", "first")).join(asked, "case_id").join(closed, "closed_case")
        cols = ["case_id", "closed_case", "first", "as_of", "closed"]
        far = device_pairs(mine.join(asked, "case_id"), theirs.join(closed, "closed_case"), near)
        return _listed(best.select(*cols).unionByName(far.withColumn("first", F.lit(3)).select(*cols)))
    pairs = None
    for (mine, theirs, key), (_, first, _) in zip(sides, LINKS):
        mine, theirs = mine.select("case_id", key).distinct().join(asked, "case_id"), theirs.distinct().join(closed, "closed_case")
        if key == "device_profile_id":
            pairs, theirs = checkpointed(pairs), theirs.filter(F.col(key).isNotNull())
            p = first_on_device(mine, theirs, pairs.filter("first = 2").join(pairs.filter("first = 1"), ["case_id", "closed_case"], "left_anti"), most)
        else:
            p = mine.join(theirs, key).filter(F.col("since") < F.col("until"))
        p = p.select("case_id", "closed_case", F.lit(first).alias("first"), "as_of", "closed")
        pairs = p if pairs is None else pairs.unionByName(p)
    best = pairs.groupBy("case_id", "closed_case").agg(F.min("first").alias("first"), F.first("as_of").alias("as_of"), F.first("closed").alias("closed"))
    found = _listed(best)
    place = F.dense_rank().over(W.partitionBy("case_id", "outcome").orderBy("link_rank", "closed_case"))
    return found.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def _listed(best: DataFrame) -> DataFrame:
    """``(case_id, closed_case, first, as_of, closed)`` with label and rank, a row for each case closed before ``as_of``."""
    label, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, first, order in LINKS:
        label = F.when(F.col("first") == first, name).otherwise(label)
        rank = F.when(F.col("first") == first, order).otherwise(rank)
    j = best.withColumn("c", F.explode("closed")).withColumn("as_of", F.explode("as_of"))
    return j.filter(F.col("c.closed_us") < F.col("as_of")).select(
        "case_id", "closed_case", "c.outcome", "c.pattern", label.alias("link"), rank.alias("link_rank"))


def device_pairs(asked: DataFrame, uses: DataFrame, known: DataFrame) -> DataFrame:
    """``asked (case_id, device_profile_id, until, ..)`` with the cases of ``uses (closed_case, device_profile_id, since, ..)`` on the
    same device that were closed before ``until``, without the pairs ``known (case_id, closed_case)``.

    Both sides bring all their devices and an alert what is known of it, so a pair is made at the first device the two share
    and nowhere else, and no pair has to meet another one. The cases on a device are dealt to ``BLOCKS`` tasks, and the number of
    tasks is set: Spark would put the small sides of so large a join into few.
    """
    key, parts = "device_profile_id", int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    skip = known.groupBy("case_id").agg(F.collect_list("closed_case").alias("_known"))
    mine = asked.join(asked.groupBy("case_id").agg(F.collect_set(key).alias("_mine")), "case_id").join(skip, "case_id", "left")
    theirs = uses.join(uses.groupBy("closed_case").agg(F.collect_set(key).alias("_theirs")), "closed_case")
    once = (F.size("_mine") == 1) | (F.size("_theirs") == 1) | (F.array_min(F.array_intersect("_mine", "_theirs")) == F.col(key))
    new = F.col("_known").isNull() | ~F.array_contains("_known", F.col("closed_case"))
    mine = mine.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    theirs = theirs.withColumn("_block", F.pmod(F.xxhash64("closed_case"), F.lit(BLOCKS)).cast("int"))
    mine, theirs = (df.repartition(parts, key, "_block") for df in (mine, theirs))
    return mine.join(theirs, [key, "_block"]).filter((F.col("since") < F.col("until")) & once & new).drop("_mine", "_theirs", "_known", "_block")


def first_on_device(asked: DataFrame, uses: DataFrame, demoted: DataFrame, most: int) -> DataFrame:
    """``asked (case_id, device_profile_id, until, as_of)`` with the first ``most`` cases, by id, of each outcome that used the
    device and were closed before ``until``; all of them where one of the first is in ``demoted (case_id, closed_case)``, pairs
    that a link listed further behind names.

    Closings and alerts share a device's time line. A closing keeps the smaller of its id and the smallest so far and hands the
    larger one on; the smallest of what was handed on is the second. So every place is one running minimum, whatever the
    number of alerts and cases on a device.
    """
    key = "device_profile_id"
    each = uses.withColumn("c", F.explode("closed")).groupBy(key, "closed_case", F.col("c.outcome").alias("outcome")).agg(F.min("c.closed_us").alias("us"))
    each = each.filter(F.col("us").isNotNull())
    outcomes = each.select("outcome").distinct()
    line = each.select(key, "outcome", "us", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("case_id"), F.col("closed_case").alias("id")).unionByName(
        asked.select(key, "case_id", F.col("until").alias("us"), F.lit(0).alias("kind"), F.lit(None).cast(each.schema["closed_case"].dataType).alias("id")).crossJoin(outcomes))
    line, places = stored(line), [f"_m{i}" for i in range(most)]
    for place in places:
        line = stored(running_totals(line, [key, "outcome"], ["us", "kind", "id"], {place: ("min", F.col("id"))}, slice_width=DAY).withColumn(
            "id", F.when(F.col("id").isNotNull() & F.col(place).isNotNull(), F.greatest("id", place))))
    heads = line.filter(F.col("kind") == 0).select("case_id", key, "outcome", F.array_compact(F.array(*places)).alias("head"))
    first = checkpointed(heads.select("case_id", key, "outcome", (F.size("head") == most).alias("more"), F.explode("head").alias("closed_case")))
    again = first.filter("more").join(demoted, ["case_id", "closed_case"], "left_semi").select("case_id", key).distinct()
    every = asked.join(again, ["case_id", key], "left_semi").join(uses, key).filter(F.col("since") < F.col("until"))
    cols = ["case_id", key, "until", "as_of", "closed_case", "since", "closed"]
    few = first.select("case_id", key, "closed_case").distinct().join(asked, ["case_id", key]).join(uses, [key, "closed_case"])
    return few.select(*cols).unionByName(every.select(*cols))
