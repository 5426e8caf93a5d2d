"""Investigate a set of alerts: context, findings, probability, verdict, policy and answer document.

The alerts are handled as one table from end to end. Only the effect of earlier verdicts on later alerts
is sequential: the cheap case-level steps are repeated for the alerts whose earlier fraud cases changed,
until nothing changes. Case-level tables (one short row per alert) are written between stages, so a lost
executor costs a stage and plans stay small. The cards of a ring, which may be many, stay rows of their own until all
verdicts have settled.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import device_label, flag, is_specific_device, money
from ..operators import asof, assess, bursts, episodes, memory, policy, rings, similarity
from ..operators.features import recency_flags
from ..operators.skew import range_totals, top_k
from ..params import DEFAULT, Params
from ..session import checkpointed, stored

# Pattern names in prose.
PATTERN_TEXT = {"card_testing": "card testing", "card_not_present_fraud": "card-not-present fraud",
                "card_not_present_new_device": "card-not-present fraud from a new device", "out_of_region_use": "out-of-region use",
                "account_takeover": "account takeover", "undocumented": "an undocumented coordinated pattern", "none": "no fraud pattern"}


@dataclass
class Inputs:
    """``scored``: the feature table with ``p_txn``; ``index``: the case index with its keys."""
    alerts: DataFrame
    scored: DataFrame
    closed: DataFrame
    members: DataFrame
    index: DataFrame
    keys: DataFrame
    pattern_p: object = None      # callable: episode features -> (case_id, pattern_p)
    replies: DataFrame | None = None
    params: Params = DEFAULT


def _flagged(x: Inputs) -> DataFrame:
    """One row per alert with its flagged row and recency flags."""
    a = x.alerts.select("case_id", "flagged_txn_id", "opened_us", F.col("trigger_type").alias("trigger"), "trigger_text")
    cols = ["TransactionID", "us", "TransactionAmt", "ProductCD", "channel", "customer_id", "card_id", "uid", "addr1",
            "device_profile_id", "id_15", "id_23", "risk_score", "p_txn", "known_fraud_uid"]
    f = a.join(x.scored.select(*cols), F.col("flagged_txn_id") == F.col("TransactionID")).drop("TransactionID")
    f = stored(f.withColumnRenamed("us", "flag_us").withColumnRenamed("known_fraud_uid", "known_uid"))
    return stored(f.join(recency_flags(f, x.scored, x.params), "case_id"))


def findings(x: Inputs, f: DataFrame) -> dict[str, DataFrame]:
    """Window, detectors and episode of every alert. Detectors run set-wise; gates pick the alerts."""
    p = x.params
    cols = ["TransactionID", "us", "TransactionAmt", "ProductCD", "channel", "card_id", "uid", "addr1", "device_profile_id",
            "id_15", "id_23", "p_txn", "P_emaildomain", "M4", "M6"]
    win = asof.card_window(asof.lookback(f, p), x.scored.select("customer_id", *cols)).drop("start_us", "end_us")
    win = stored(win)
    amount, online = F.col("TransactionAmt"), F.col("channel") == "online"
    band = online & (amount >= p.band * p.cap) & (amount < p.cap)
    sizes = win.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_win"), F.sum(flag(band)).alias("n_band"),
                                       F.sum(flag(online & (amount < p.small_amount))).alias("n_small"),
                                       F.count_if(F.col("p_txn") >= p.member_threshold).alias("n_hi"))
    f = f.join(sizes, "case_id", "left").fillna(0, ["n_win", "n_band", "n_small", "n_hi"])
    f = f.withColumn("dev_hardware", flag(is_specific_device(F.col("device_profile_id"))))
    f = stored(assess.gates(f, p))
    on = lambda g: f.filter(F.col(g) == 1).select("case_id")
    scoped = lambda g: win.join(on(g), "case_id", "left_semi")
    first = lambda d: d.groupBy("case_id").agg(F.min(F.struct("card_id", *[c for c in d.columns if c not in ("case_id", "card_id")])).alias("b")
                                               ).select("case_id", "b.*")
    st = stored(first(bursts.structuring(scoped("g_structuring"), ["case_id", "card_id"], p)))
    st_rows = bursts.structuring_rows(st, win, ["case_id", "card_id"], p).select("case_id", "TransactionID")
    own = st.select("case_id", F.col("card_id").alias("own_card")).join(f.select("case_id", F.col("opened_us").alias("as_of")), "case_id")
    st_ring = stored(rings.structuring_ring(own, x.scored, p))
    ct = stored(first(bursts.card_testing(scoped("g_testing"), ["case_id", "card_id"], p)))
    ct_rows = bursts.testing_rows(ct, win, ["case_id", "card_id"], p).select("case_id", "TransactionID", "role")
    rec = bursts.recurring(asof.baseline(f, params=p).join(on("g_recurring"), "case_id", "left_semi"), x.scored, p)
    devices = (win.filter((F.col("p_txn") >= p.member_threshold) & F.col("device_profile_id").isNotNull())
               .select("case_id", "device_profile_id")
               .unionByName(f.filter(F.col("device_profile_id").isNotNull()).select("case_id", "device_profile_id")).distinct())
    devices = stored(devices)
    probes = devices.join(on("g_device"), "case_id", "left_semi").join(f.select("case_id", F.col("opened_us").alias("as_of")), "case_id")
    ring = rings.best_ring(rings.device_rings(probes, x.scored, p))
    ring = stored(ring.join(f.select("case_id", F.col("opened_us").alias("as_of")), "case_id"))
    ring_cards = stored(rings.ring_members(ring, x.scored, p))
    ring_rows = (win.join(ring.select("case_id", "device_profile_id"), ["case_id", "device_profile_id"]).join(
        ring.select("case_id", (F.col("as_of") - p.ring_us).alias("_from")), "case_id").filter(F.col("us") >= F.col("_from"))
        .select("case_id", "TransactionID"))
    precedents = stored(rings.ring_precedents(ring, x.closed, x.members, x.scored, p))
    base = episodes.reconstruct(f.select("case_id", "customer_id", "flagged_txn_id", "flag_us", "opened_us"), x.scored,
                                (p.member_threshold,), p).select("case_id", "TransactionID")
    base, st_rows, ct_rows = stored(base), stored(st_rows), stored(ct_rows)
    flagged_ids = f.select("case_id", F.col("flagged_txn_id").alias("TransactionID"))
    in_burst = st_rows.join(flagged_ids, ["case_id", "TransactionID"]).select("case_id")
    ep = base.join(in_burst, "case_id", "left_anti").unionByName(st_rows.join(in_burst, "case_id", "left_semi"))
    ep = ep.unionByName(ring_rows).unionByName(ct_rows.select("case_id", "TransactionID")).distinct()
    keep = ct_rows.filter(F.col("role").isin("test", "purchase")).select("case_id", "TransactionID").unionByName(flagged_ids).distinct()
    ep = stored(ep.join(win, ["case_id", "TransactionID"]))
    tested = ep.join(ct.select("case_id"), "case_id", "left_semi")
    strong = tested.filter(F.col("p_txn") >= p.member_threshold)
    weak = tested.filter(F.col("p_txn") < p.member_threshold).join(keep, ["case_id", "TransactionID"], "left_semi")
    ep = ep.join(ct.select("case_id"), "case_id", "left_anti").unionByName(strong).unionByName(weak)
    ep = stored(ep.select("case_id", "customer_id", *cols))
    return {"f": f, "win": win, "structuring": st, "structuring_cards": st_ring, "testing": ct, "recurring": stored(rec),
            "ring": ring, "ring_cards": ring_cards, "ring_rows": ring_rows, "ring_precedents": precedents, "devices": devices, "episode": ep}


def case_table(x: Inputs, d: dict[str, DataFrame]) -> DataFrame:
    """One row per alert with everything the decision steps read."""
    p, f, ep = x.params, d["f"], d["episode"]
    online = F.col("channel") == "online"
    g = ep.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p_txn") >= p.member_threshold).alias("n_members"), F.max("p_txn").alias("p_max"),
        F.round(F.sum(F.abs("TransactionAmt")), 2).alias("exposure0"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.min_by("TransactionID", F.struct("us", "TransactionID")).alias("first_id"), F.count_if(online).alias("n_online"),
        F.max(flag(online & (F.col("id_15") == "New"))).alias("any_new_online"),
        F.array_sort(F.collect_set("card_id")).alias("own_cards"), F.array_sort(F.collect_set("ProductCD")).alias("products"),
        F.array_sort(F.collect_set("addr1")).alias("regions"), F.array_sort(F.collect_set("device_profile_id")).alias("ep_devices"))
    mark = lambda df, name: df.select("case_id", F.lit(True).alias(name)).distinct()
    flagged_in_ring = d["ring_rows"].join(f.select("case_id", F.col("flagged_txn_id").alias("TransactionID")), ["case_id", "TransactionID"])
    c = f.join(g, "case_id")
    sr = d["structuring_cards"].groupBy("case_id").agg(F.count(F.lit(1)).alias("sr_cards"))
    st = d["structuring"].select("case_id", F.col("card_id").alias("st_card"), F.col("n").alias("st_n"), F.col("total").alias("st_total"),
                                 F.col("span_min").alias("st_span"), F.col("low").alias("st_low"), F.col("high").alias("st_high"))
    ct = d["testing"].select("case_id", F.col("card_id").alias("ct_card"), "n_tests", "purchase_amt", "max_cleared")
    ring = d["ring"].select("case_id", F.col("device_profile_id").alias("ring_device"), F.col("n_customers").alias("ring_customers"),
                            F.col("n_cards").alias("ring_n_cards"), F.col("anomaly").alias("ring_anomaly"))
    rec = d["recurring"].select("case_id", F.col("n_prior").alias("n_recurring"))
    for part in (sr, st, ct, ring, rec, mark(flagged_in_ring, "_in_ring")):
        c = c.join(part, "case_id", "left")
    # cards the ring adds to the alert's own: the device ring when there is one, else the structuring ring
    ring_cards = d["ring_cards"].select("case_id", "card_id").unionByName(
        d["structuring_cards"].join(d["ring"].select("case_id"), "case_id", "left_anti")).distinct()
    extra = ring_cards.join(ep.select("case_id", "card_id").distinct(), ["case_id", "card_id"], "left_anti")
    d["added_cards"] = extra = stored(extra)
    c = c.join(extra.groupBy("case_id").agg(F.count(F.lit(1)).cast("int").alias("n_added")), "case_id", "left")
    return stored(c.withColumns({
        "f_structuring": F.col("st_n").isNotNull() & F.col("sr_cards").isNotNull(), "f_device_ring": F.coalesce("_in_ring", F.lit(False)),
        "f_card_testing": F.col("n_tests").isNotNull(), "f_recurring": F.col("n_recurring").isNotNull(),
        "n_added": F.coalesce("n_added", F.lit(0))}).drop("_in_ring"))


def precedents(x: Inputs, d: dict[str, DataFrame], c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked precedent candidates per case, and the pattern probabilities of its episode.

    ``(case_id, closed_case, source, place, outcome)`` with source 1 graph link, 2 ring, 3 nearest,
    4 nearest cleared, 5 cleared graph link.
    """
    bounds = c.select("case_id", (F.col("flag_us") - x.params.baseline_us).alias("hist_from"), F.col("flag_us").alias("hist_to"))
    feats = stored(memory.episode_features(d["episode"], x.scored, bounds=bounds))
    a = c.select("case_id", "customer_id", F.col("opened_us").alias("as_of"))
    links = memory.graph_links(a, d["episode"].select("case_id", "uid").distinct(), d["episode"].select("case_id", "card_id").distinct(),
                               d["devices"], x.index, x.keys, most=3)
    found = stored(links)
    links = top_k(found, ["case_id"], ["link_rank", "closed_case"], 3, "place")
    # for a legitimate verdict the first cleared ones of all links count, wherever they stand
    links_cleared = top_k(found.filter(F.col("outcome") == "cleared"), ["case_id"], ["link_rank", "closed_case"], 2, "place")
    # cases of the device ring come first, then those of the structuring ring's shape; four in all
    ringed = top_k(ring_cases(x, d, a), ["case_id"], ["kind", "since", "closed_case"], 4, "place").join(
        x.closed.select(F.col("case_id").alias("closed_case"), "outcome"), "closed_case")
    stats = memory.moments(x.index)
    q = memory.standardise(feats, stats).select(F.col("case_id").alias("query_id"), "v").join(a.select(F.col("case_id").alias("query_id"), "as_of"), "query_id")
    pts = memory.standardise(x.index, stats).select(F.col("case_id").alias("point_id"), "v", F.col("closed_us").alias("since"), "outcome")
    out = None
    for source, (k, pool) in {3: (5, pts), 4: (3, pts.filter(F.col("outcome") == "cleared"))}.items():
        near = similarity.nearest(q, pool.drop("outcome"), k).select(F.col("query_id").alias("case_id"), F.col("point_id").alias("closed_case"),
                                                                     F.lit(source).alias("source"), F.col("rank").alias("place"), "distance")
        out = near if out is None else out.unionByName(near)
    out = out.join(x.index.select(F.col("case_id").alias("closed_case"), "outcome"), "closed_case")
    listed = (links.select("case_id", "closed_case", F.lit(1).alias("source"), "place", F.lit(0.0).alias("distance"), "outcome")
              .unionByName(links_cleared.select("case_id", "closed_case", F.lit(5).alias("source"), "place", F.lit(0.0).alias("distance"), "outcome"))
              .unionByName(ringed.select("case_id", "closed_case", F.lit(2).alias("source"), "place", F.lit(0.0).alias("distance"), "outcome"))
              .unionByName(out.select("case_id", "closed_case", "source", "place", "distance", "outcome")))
    probs = x.pattern_p(feats) if x.pattern_p is not None else rule_probabilities(feats)
    return stored(listed), stored(probs)


def ring_cases(x: Inputs, d: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """``(case_id, closed_case, kind, since)``: closed cases on the ring's device (kind 0), and those of the structuring
    shape closed before the alert was opened (kind 1), for alerts with such a ring."""
    device = d["ring_precedents"].select("case_id", "closed_case", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("since"))
    shape = rings.structuring_precedents(x.closed).select(F.explode("precedents").alias("e")).select(
        F.col("e.case_id").alias("closed_case"), F.lit(1).alias("kind"), F.col("e.closed_us").alias("since"))
    hit = d["structuring_cards"].select("case_id").distinct().join(asked.select("case_id", "as_of"), "case_id")
    # at most four cases of the shape, so this stays four rows an alert
    shape = hit.crossJoin(shape).filter(F.col("since") < F.col("as_of")).select("case_id", "closed_case", "kind", "since")
    return device.unionByName(shape).groupBy("case_id", "closed_case").agg(F.min("kind").alias("kind"), F.min("since").alias("since"))


def rule_probabilities(feats: DataFrame) -> DataFrame:
    """Stand-in class probabilities from episode shares, used where no pattern model is given."""
    c = F.col
    weight = {"card_not_present_fraud": c("frac_online") * (1 - c("frac_new_dev")) + 0.1,
              "card_not_present_new_device": c("frac_online") * c("frac_new_dev") + 0.1,
              "out_of_region_use": (1 - c("frac_online")) * c("frac_uid_region_unseen") + 0.1,
              "account_takeover": c("mixed_channel") + 0.05}
    total = sum(weight.values(), F.lit(0.0))
    return feats.select("case_id", F.create_map(*[y for k, w in weight.items() for y in (F.lit(k), w / total)]).alias("pattern_p"))


def decide_level(c: DataFrame, x: Inputs) -> DataFrame:
    """Case-level steps for alerts whose earlier cases are final: needs ``f_earlier`` and ``earlier_other``."""
    p = x.params
    c = assess.pattern_name(assess.signals(assess.probability_chain(c, p)))
    c = checkpointed(assess.with_reply(assess.initial_verdict(c, p), x.replies, p))
    c = checkpointed(assess.final_verdict(c, p))
    legit = F.col("verdict") == "legitimate"
    structural = F.size("structural") > 0
    shared = F.when(F.col("f_device_ring"), F.concat(F.lit("device profile "), device_label(F.col("ring_device")))).otherwise("")
    c = c.withColumns({"connected_cards": F.when(structural, F.col("n_added")).otherwise(0), "shared_origin": shared})
    c = c.withColumn("cross_customer", (F.col("connected_cards") > 0) | F.col("earlier_other"))
    state = { "recurring_match": F.col("f_recurring"),
             "card_testing_cleared_max": F.coalesce("max_cleared", F.lit(0.0))}
    c = checkpointed(c.withColumns(state))
    before = c.select("case_id", "p", F.col("verdict0").alias("verdict"), F.col("exposure0").alias("exposure"), "pattern", "n_signals", "trigger",
                      F.lit(None).cast("string").alias("response"), "evidence_requested", "request_type", "shared_origin", "connected_cards",
                      "cross_customer", "card_testing_cleared_max", "recurring_match", "conflicting")
    after = c.select("case_id", F.col("p1").alias("p"), "verdict", F.when(legit, 0.0).otherwise(F.col("exposure0")).alias("exposure"),
                     F.when(legit, "none").otherwise(F.col("pattern")).alias("pattern"), "n_signals", "trigger",
                     F.col("policy_response").alias("response"), "evidence_requested", F.lit("").alias("request_type"),
                     F.when(legit, "").otherwise(F.col("shared_origin")).alias("shared_origin"),
                     F.when(legit, 0).otherwise(F.col("connected_cards")).alias("connected_cards"), (~legit & F.col("cross_customer")).alias("cross_customer"),
                     "card_testing_cleared_max", "recurring_match", (F.col("conflicting") & (F.col("verdict") == "uncertain")).alias("conflicting"))
    d0 = checkpointed(policy.decide(before, p).select("case_id", F.col("actions").alias("initial")))
    d1 = checkpointed(policy.decide(after, p).select("case_id", F.col("actions").alias("final"), "file_sar", "sar_reason", "exposure",
                                                           F.col("pattern").alias("pattern1"), F.col("shared_origin").alias("shared1")))
    c = c.drop("exposure").join(d0, "case_id").join(d1, "case_id")
    return checkpointed(c.withColumns({
        "initial": F.when(F.col("evidence_requested"), F.col("initial")).otherwise(F.col("final")),
        "status": assess.status(F.col("verdict"), F.col("final")),
        "memory_cards": F.when(legit, F.array("card_id")).otherwise(F.col("own_cards"))}))


def with_ring_cards(c: DataFrame, added: DataFrame) -> DataFrame:
    """Settled cases with the lists of the cards a ring adds, ``added (case_id, card_id)``, to those of a structural finding."""
    none, legit = F.array().cast("array<string>"), F.col("verdict") == "legitimate"
    c = c.join(added.groupBy("case_id").agg(F.array_sort(F.collect_list("card_id")).alias("ring_cards")), "case_id", "left")
    c = c.withColumn("ring_cards", F.when(F.size("structural") > 0, F.coalesce("ring_cards", none)).otherwise(none))
    others = F.array_union(F.array_except("own_cards", F.array("card_id")), F.col("ring_cards"))
    return c.withColumns({"connected_card_ids": F.when(legit, none).otherwise(F.array_sort(others)),
                          "memory_cards": F.when(legit, F.array("card_id")).otherwise(F.array_sort(F.array_union("own_cards", others)))})


def fraud_traces(decided: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """The cards, devices and customer that every alert judged fraud leaves: ``case_id, customer_id, opened_us, place, k (kind, v)``.
    ``added (case_id, card_id)``: cards that alerts with a structural finding leave besides those of ``memory_cards``."""
    none = F.array().cast("array<string>")
    left = F.explode(F.concat(
        F.transform("memory_cards", lambda x: F.struct(F.lit("card").alias("kind"), x.alias("v"))),
        F.transform(F.coalesce("all_devices", none), lambda x: F.struct(F.lit("device").alias("kind"), x.alias("v"))),
        F.array(F.struct(F.lit("customer").alias("kind"), F.col("customer_id").alias("v")))))
    fraud = decided.filter(F.col("verdict") == "fraud")
    cols = ["case_id", "customer_id", "opened_us", "place"]
    traces = fraud.select(*cols, left.alias("k"))
    if added is None:
        return traces
    found = fraud.filter(F.size("structural") > 0).select(*cols).join(added, "case_id")
    return traces.unionByName(found.select(*cols, F.struct(F.lit("card").alias("kind"), F.col("card_id").alias("v")).alias("k")))


def earlier_links(decided: DataFrame, keys: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """All pairs ``(case_id, earlier_id)`` of an alert and an earlier one judged fraud that share a value; one row each."""
    t = fraud_traces(decided, added).select("k.kind", "k.v", F.struct("opened_us", "case_id").alias("e"))
    ask = keys.join(decided.select("case_id", "opened_us"), "case_id")
    hit = ask.join(t, ["kind", "v"]).filter(F.col("e") < F.struct("opened_us", "case_id"))
    return hit.select("case_id", F.col("e.case_id").alias("earlier_id")).distinct()


def earlier_fraud(decided: DataFrame, keys: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Which alerts share a card, specific device or customer with an earlier alert judged fraud.

    Per shared value only the earliest fraud cases of two different customers are kept: they decide both
    whether an earlier case exists and whether one belongs to somebody else, so a value shared by many
    alerts never multiplies them in the rounds. ``keys``: ``case_id, kind, v`` of each alert; ``place`` of a decided
    case: its number in the order of ``opened_us`` and ``case_id``.
    """
    # the place is a number, so the smallest of many rows is found without sorting them
    marks = fraud_traces(decided, added).groupBy("k.kind", "k.v", "customer_id").agg(F.min("place").alias("e"))
    two = top_k(marks.select("kind", "v", F.col("customer_id").alias("ec"), "e"), ["kind", "v"], ["e"], 2)
    ask = keys.join(decided.select("case_id", "customer_id", "place"), "case_id")
    hit = ask.join(two, ["kind", "v"]).filter(F.col("e") < F.col("place"))
    hit = hit.join(decided.select(F.col("place").alias("e"), F.col("case_id").alias("earlier_id")), "e")
    return hit.groupBy("case_id").agg(F.max(flag(F.col("ec") != F.col("customer_id"))).alias("other"),
                                      F.array_sort(F.collect_set("earlier_id")).alias("earlier"))


def run_rounds(x: Inputs, c: DataFrame, d: dict[str, DataFrame]) -> DataFrame:
    """Decide all alerts, then redo those whose earlier fraud cases changed, until none does.

    Links only point back in time, so the rounds settle on exactly what handling the alerts one after
    the other gives; their number is the depth to which verdicts actually influence each other. The rounds look at
    two earlier cases per value; ``earlier`` and its size ``n_earlier`` are made of all once the verdicts have settled.
    """
    none = F.array().cast("array<string>")
    specific = d["devices"].filter(is_specific_device(F.col("device_profile_id")))
    keys = (c.select("case_id", F.lit("card").alias("kind"), F.explode(F.array_union("own_cards", F.array("card_id"))).alias("v"))
            .unionByName(specific.select("case_id", F.lit("device").alias("kind"), F.col("device_profile_id").alias("v")))
            .unionByName(c.select("case_id", F.lit("customer").alias("kind"), F.col("customer_id").alias("v"))))
    keys = stored(keys.distinct())
    # cards that no alert asks for lead nowhere
    added = d.get("added_cards")
    if added is not None:
        added = stored(added.join(keys.filter("kind = 'card'").select(F.col("v").alias("card_id")).distinct(), "card_id", "left_semi"))
    dev_list = d["devices"].groupBy("case_id").agg(F.array_sort(F.collect_set("device_profile_id")).alias("all_devices"))
    at = range_totals(c.select("opened_us", "case_id").distinct(), ["opened_us", "case_id"], {"place": F.lit(1)})
    at = stored(at.withColumnRenamed("opened_us", "_opened"))
    c = c.join(dev_list, "case_id", "left").join(at, "case_id").filter(F.col("_opened").eqNullSafe(F.col("opened_us"))).drop("_opened")
    c = checkpointed(c)
    start = {"f_earlier": F.lit(False), "earlier_other": F.lit(False), "earlier": none}
    done = decide_level(c.withColumns(start), x)
    while True:
        links = done.select("case_id", F.col("earlier").alias("_had")).join(earlier_fraud(done, keys, added), "case_id", "left")
        stale = checkpointed(links.withColumn("earlier", F.coalesce("earlier", none)).filter(F.col("earlier") != F.col("_had")))
        if stale.isEmpty():
            break
        again = c.join(stale.select("case_id", "earlier", (F.size("earlier") > 0).alias("f_earlier"),
                                    (F.coalesce("other", F.lit(0)) == 1).alias("earlier_other")), "case_id")
        redone = decide_level(again, x)
        done = checkpointed(done.join(stale.select("case_id"), "case_id", "left_anti").unionByName(redone))
    listed = stored(earlier_links(done, keys, added)).groupBy("case_id").agg(
        F.array_sort(F.collect_list("earlier_id")).alias("earlier"), F.count(F.lit(1)).alias("n_earlier"))
    listed = done.drop("earlier", "place").join(listed, "case_id", "left")
    return listed.withColumns({"earlier": F.coalesce("earlier", none), "n_earlier": F.coalesce("n_earlier", F.lit(0))})


def choose_precedents(c: DataFrame, listed: DataFrame) -> DataFrame:
    """Links and ring cases first; neighbours of the outcome concluded fill the list up to six.

    A legitimate verdict starts from the first two cleared links instead."""
    j = listed.join(c.select("case_id", "verdict"), "case_id")
    legit, cleared = F.col("verdict") == "legitimate", F.col("outcome") == "cleared"
    source = F.col("source")
    order = (F.when(legit, F.when(source == 5, 1).when(source == 4, 3).when((source == 3) & cleared, 4))
             .otherwise(F.when(source == 1, 1).when(source == 2, 2).when((source == 3) & (F.col("outcome") == "confirmed_fraud"), 3)))
    best = j.withColumn("o", order).filter(F.col("o").isNotNull()).groupBy("case_id", "closed_case").agg(F.min(F.struct("o", "place")).alias("o"))
    # links and ring cases are at most seven, and all stay
    kept = top_k(best, ["case_id"], ["o", "closed_case"], 7).filter((F.col("rank") <= 6) | (F.col("o.o") <= 2))
    return kept.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "closed_case"))), lambda s: s["closed_case"])
                                       .alias("similar_prior_cases"))


def investigate(x: Inputs) -> DataFrame:
    """Decided cases, one row per alert, with the columns ``answers`` renders."""
    f = _flagged(x)
    d = findings(x, f)
    c = case_table(x, d)
    listed, probs = precedents(x, d, c)
    c = stored(c.join(probs, "case_id", "left"))
    done = with_ring_cards(run_rounds(x, c, d), d["added_cards"])
    prior = choose_precedents(done, listed)
    near = listed.filter(F.col("source") == 3).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_near"), F.count_if(F.col("outcome") == "confirmed_fraud").alias("n_near_fraud"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "closed_case"))), lambda s: s["closed_case"]).alias("near_ids"))
    ids = d["episode"].groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "TransactionID"))),
                                                          lambda s: s["TransactionID"]).alias("episode_ids"))
    done = done.join(prior, "case_id", "left").join(near, "case_id", "left").join(ids, "case_id", "left")
    none = F.array().cast("array<string>")
    # lists of many cards and cases: cut as they are, without columns of their own
    return checkpointed(done.withColumns({"similar_prior_cases": F.coalesce("similar_prior_cases", none), "near_ids": F.coalesce("near_ids", none)}))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def evidence(c, params: Params = DEFAULT) -> Column:
    """Evidence claims as structs; a claim whose condition fails is left out."""
    none = F.array().cast("array<string>")
    item = lambda claim, ref, ids, source="graph": F.struct(claim.alias("claim"), F.lit(source).alias("source"), ref.alias("ref"), ids.alias("entity_ids"))
    two = lambda v: F.format_string("%.2f", v)
    at = F.date_format(C.from_micros(c("flag_us")), "yyyy-MM-dd HH:mm")
    where = F.when(c("addr1").isNotNull(), _say(" in billing region ", c("addr1"))).otherwise("")
    entries = [
        item(_say("Flagged ", money(c("TransactionAmt")), " ", F.replace(c("channel"), F.lit("_"), F.lit("-")), " purchase (product ", c("ProductCD"), ")", where,
                  " on ", at, "; bank risk score ", two(c("risk_score")), ", our transaction model ", two(c("p_txn"))),
             _say("query:txn_context(txn_id=", c("flagged_txn_id"), ")"), F.array("flagged_txn_id", "card_id")),
        item(_say("Customer has ", c("hist_n").cast("string"), " transactions in the prior 120 days; ",
                  F.when(c("addr1").isNull(), "no billing region on the flagged transaction").otherwise(
                      _say("billing region ", F.coalesce("addr1", F.lit("")), F.when(c("seen_region") == 1, " is familiar").otherwise(" is new"), " for the customer"))),
             _say("query:cardholder_baseline(customer_id=", c("customer_id"), ", days=120)"), F.array("customer_id")),
        F.when(c("known_uid") > 0, item(_say("This cardholder key already has ", c("known_uid").cast("string"), " transaction(s) in confirmed closed fraud cases"),
                                        _say("query:prior_cases(customer_id=", c("customer_id"), ")"), F.array("customer_id"))),
        item(F.when(c("n_rows") > 1, _say(c("n_rows").cast("string"), " transaction(s) ", C.span_text(c("first_us"), c("last_us")), " on card(s) ",
                                          F.array_join("own_cards", ", "), " form one episode (gaps <= 48 h); ", c("n_members").cast("string"), " of them score as members"))
             .otherwise("No other transaction on the customer's cards in the window scores as likely fraud; the flagged transaction is isolated"),
             _say("query:card_window(customer_id=", c("customer_id"), ", days=10)"), c("episode_ids")),
        F.when(c("st_n").isNotNull(), item(_say(c("st_n").cast("string"), " online purchases within ", F.format_string("%.0f", "st_span"), " minutes, each between ",
                                                money(c("st_low")), " and ", money(c("st_high"))), _say("query:structuring_scan(card_id=", c("st_card"), ")"), F.array("st_card"))),
        F.when(c("sr_cards").isNotNull(), item(_say("The same burst appears on ", c("sr_cards").cast("string"), " cards in the prior 30 days"),
                                               F.lit("query:population_structuring_sweep(days=30)"), F.slice("ring_cards", 1, params.shown_sweep_cards))),
        F.when(c("ring_device").isNotNull(), item(_say("Device profile ", device_label(c("ring_device")), " (", c("ring_anomaly"), ") was used on ",
                                                       c("ring_n_cards").cast("string"), " cards of ", c("ring_customers").cast("string"), " customers in the prior 30 days"),
                                                  F.lit("query:device_neighbors(days=30)"), F.slice("ring_cards", 1, params.shown_ring_cards))),
        F.when(c("n_tests").isNotNull(), item(_say(c("n_tests").cast("string"), " small online authorizations close together on ", c("ct_card"), ", then ", money(c("purchase_amt"))),
                                              _say("query:card_testing_scan(card_id=", c("ct_card"), ")"), F.array("ct_card"))),
        F.when(c("n_recurring").isNotNull(), item(_say(c("n_recurring").cast("string"), " earlier monthly charges of the same product and amount by this cardholder"),
                                                  F.lit("query:recurring_check"), F.array("card_id"))),
        F.when(c("n_near") > 0, item(_say("Behavioural nearest neighbours among closed cases: ", c("n_near_fraud").cast("string"), " of ", c("n_near").cast("string"), " confirmed fraud"),
                                     F.lit("query:similar_cases(k=5, vector=episode_behaviour)"), c("near_ids"))),
        F.when(F.size("earlier") > 0, item(_say("Earlier investigation(s) ", F.array_join("earlier", ", "), " share a card, device or customer"),
                                           F.lit("query:agent_case_links"), c("earlier"))),
        F.when(c("trigger") == "customer_report", item(_say("Customer reported the charge as not made by them: ", c("trigger_text")), F.lit("case_pack:trigger_text"),
                                                       F.array("customer_id"), "customer")),
        item(F.lit("Policy rules applied: see next_best_actions reasons"), F.lit("fraud-policy"), none, "document")]
    return F.array_compact(F.array(*entries))


def answers(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The nested answer document per case."""
    c = F.col
    none = F.array().cast("array<string>")
    legit = c("verdict") == "legitimate"
    two = lambda v: F.format_string("%.2f", v)
    prose = F.create_map(*[F.lit(v) for kv in PATTERN_TEXT.items() for v in kv])
    reply_text = F.concat(F.lit("Assumed reply: "), F.replace(c("response"), F.lit("_"), F.lit(" ")))
    aff = F.when(legit, none).otherwise(c("episode_ids"))
    span = C.span_text(c("first_us"), c("last_us"))
    described = (F.when(c("f_structuring"), _say("Threshold structuring: ", F.coalesce(c("st_n"), F.lit(0)).cast("string"), " online purchases just under the limit, totalling ",
                                                 money(F.coalesce("st_total", F.lit(0.0))), ". The same burst shape appears on other customers' cards. It was found by a population sweep."))
                 .otherwise(_say("Shared-device ring: one device profile (", device_label(c("ring_device")), ") used on ", F.coalesce(c("ring_n_cards"), F.lit(0)).cast("string"),
                                 " cards. No single cardholder's behaviour explains it. It was found by expanding from the flagged device.")))
    summary = F.when(legit, F.concat_ws(" ", _say(money(c("TransactionAmt")), " transaction ", c("flagged_txn_id"), " on ", c("card_id"),
                                                  " assessed as legitimate (probability ", two(c("p1")), ")."),
                                        F.when(c("response") == "confirmed", "The cardholder's confirmation settles it."))).otherwise(
        F.concat_ws(" ", _say(F.initcap(F.element_at(prose, c("pattern1"))), ": ", c("n_rows").cast("string"), " transaction(s) ", span, " on ",
                              F.array_join("own_cards", ", "), " totalling ", money(c("exposure")), " (probability ", two(c("p1")), ")."),
                    F.when(F.size("signals") > 0, _say("Evidence: ", F.array_join("signals", ", "), ".")),
                    F.when(c("response") == "denied", "The customer's denial settles the verdict.")
                    .when(c("response") == "no_reply", "No reply was assumed, so the card is monitored."),
                    F.when(F.size("connected_card_ids") > 0, _say(F.size("connected_card_ids").cast("string"), " connected card(s) identified."))))
    day = lambda us: F.date_format(C.from_micros(us), "yyyy-MM-dd")
    narrative = F.concat_ws(" ", _say("Between ", day(c("first_us")), " and ", day(c("last_us")), ", ", c("n_rows").cast("string"), " transaction(s) totalling ",
                                      money(c("exposure")), " were made on card(s) ", F.array_join("own_cards", ", "), " belonging to customer ", c("customer_id"), "."),
                            _say("The activity comprised ", C.channel_mix(c("n_online"), c("n_rows") - c("n_online")), " transaction(s) under product code(s) ",
                                 F.array_join("products", ", "), ", in ", C.region_text(c("regions")), "."),
                            F.when(F.size("ep_devices") > 0, _say("Online transactions came from device profile(s) ", F.array_join(F.transform(F.slice("ep_devices", 1, params.shown_devices), device_label), "; "), ".")),
                            F.when(c("response").isNotNull(), _say(reply_text, ".")), _say("The pattern is named ", F.element_at(prose, c("pattern1")), "."),
                            _say("The assessed probability is ", F.format_string("%.0f", c("p1") * 100), " percent."),
                            _say("Total suspicious amount: ", money(c("exposure")), "."), _say("Actions recommended: ", F.array_join(policy.action_names(c("final")), ", "), "."))
    devs = F.when(~legit & c("f_device_ring"), F.array(device_label(c("ring_device")))).otherwise(none)
    filed = c("file_sar")
    sar = F.struct(filed.alias("file"), c("sar_reason").alias("reason"), F.when(filed, narrative).otherwise("").alias("narrative"),
                   F.when(filed, F.concat(F.array_sort(F.array_union(F.array_union(F.array("customer_id"), c("own_cards")), c("connected_card_ids"))), devs)).otherwise(none).alias("subjects"),
                   F.when(filed, c("exposure")).otherwise(0.0).alias("total_amount_usd"),
                   F.when(filed, F.array(day(c("first_us")), day(c("last_us")))).otherwise(none).alias("activity_dates"))
    request = F.struct(c("request_type").alias("type"), F.lit(8).alias("asked_after_step"), reply_text.alias("assumed_response"))
    asked = c("evidence_requested")
    stop = (F.when(asked & c("response").isin("denied", "confirmed"), _say("The reply (", c("response"), ") settles the question; probability ", two(c("p")), " -> ", two(c("p1")), "."))
            .when(asked, _say("Customer unreachable; probability stays ", two(c("p1")), "."))
            .when(c("p1") >= params.stop_high, _say("Probability ", two(c("p1")), " >= 0.85 on ", c("n_signals").cast("string"), " independent signals; stopping rule met."))
            .otherwise(_say("Probability ", two(c("p1")), " <= 0.15 on independent evidence (", F.array_join("benign", ", "), "); stopping rule met.")))
    case = F.struct(
        c("status"), c("verdict"), F.round("p1", 2).alias("fraud_probability"), c("pattern1").alias("pattern"),
        F.when(c("pattern1") == "undocumented", described).otherwise("").alias("pattern_description"), aff.alias("affected_txn_ids"),
        F.when(legit, "").otherwise(c("first_id")).alias("first_suspicious_txn_id"), c("connected_card_ids"), devs.alias("connected_device_profiles"),
        c("exposure").alias("exposure_usd"), evidence(c, params).alias("evidence"), c("similar_prior_cases"), summary.alias("summary"),
        F.lit(False).alias("written_to_graph"), F.lit("").alias("graph_case_id"))
    return cases.select(
        "case_id", case.alias("case"), F.when(asked, F.array(request)).otherwise(F.array().cast("array<struct<type:string,asked_after_step:int,assumed_response:string>>")).alias("evidence_requests"),
        F.struct(c("initial"), c("final"), F.when(asked, policy.changes(c("initial"), c("final"))).otherwise("nothing").alias("what_changed")).alias("next_best_actions"),
        sar.alias("sar"), stop.alias("stop_reason"), F.lit(0).alias("tool_calls"), F.lit(0).alias("tokens"), F.lit(0.0).alias("latency_s"))


def memory_records(cases: DataFrame) -> DataFrame:
    """The record each decided case leaves for later investigations."""
    legit = F.col("verdict") == "legitimate"
    none = F.array().cast("array<string>")
    return cases.select("case_id", F.concat(F.lit("CASE-"), "case_id").alias("graph_case_id"), "customer_id", F.col("memory_cards").alias("cards"),
                        F.when(legit, none).otherwise(F.coalesce("all_devices", none)).alias("devices"), "verdict", F.col("pattern1").alias("pattern"),
                        F.when(legit, none).otherwise(F.col("episode_ids")).alias("txn_ids"), "opened_us", F.round("p1", 4).alias("p"), "exposure")


def write_answers(docs: DataFrame, out: str) -> None:
    """One JSON document per line, one folder per case."""
    docs.withColumn("_case", F.col("case_id")).write.mode("overwrite").partitionBy("_case").json(out)


def case_list(docs: DataFrame) -> DataFrame:
    """The nine-column list a case browser shows."""
    return docs.select("case_id", F.col("case.verdict").alias("verdict"), F.col("case.fraud_probability").alias("p"), F.col("case.status").alias("status"),
                       F.col("case.pattern").alias("pattern"), F.col("case.exposure_usd").alias("exposure"), F.size("case.affected_txn_ids").alias("n_affected"),
                       F.col("sar.file").alias("sar"), F.coalesce(F.get("evidence_requests", F.lit(0))["type"], F.lit("")).alias("request"))
