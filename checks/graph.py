"""Graph tables and walks, and the earlier generation's detectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import asof as A
from ledgerlens.operators import graph as G
from ledgerlens.operators import legacy as L
from ledgerlens.sources.testbed import Bank

from .prelude import DAY, cases, full, led, led_alerts
from .registry import query

RID = "CASE WHEN coalesce(TRY_CAST(addr1 AS DOUBLE), 0) <> 0 THEN CAST(CAST(addr1 AS DOUBLE) AS BIGINT)::VARCHAR ELSE 'UNKNOWN' END"
DEVID = "'D' || upper(substr(md5(device_profile_id), 1, 6))"
VERTEX_SQL = {
    "Customer": "SELECT customer_id, count(DISTINCT card_id) AS num_cards, min(us) AS first_seen, max(us) AS last_seen FROM ledger GROUP BY 1",
    "Card": """SELECT card_id, customer_id, min(us) AS first_seen, max(us) AS last_seen, count(*) AS num_transactions,
      round(sum(TransactionAmt), 6) AS total_amount FROM ledger GROUP BY ALL""",
    "Transaction": """SELECT TransactionID, customer_id, card_id, TransactionAmt AS amount, us, channel, risk_score, ProductCD, addr1, addr2,
      P_emaildomain, R_emaildomain FROM ledger""",
    "DeviceProfile": f"""SELECT {DEVID} AS device_id, device_profile_id, split_part(device_profile_id, '|', 1) AS device_info,
      split_part(device_profile_id, '|', 2) AS os, split_part(device_profile_id, '|', 3) AS browser, split_part(device_profile_id, '|', 4) AS screen,
      count(DISTINCT card_id) AS num_cards_seen, min(us) AS first_seen, max(us) AS last_seen FROM ledger WHERE device_profile_id IS NOT NULL GROUP BY device_profile_id""",
    "EmailDomain": """SELECT domain, count(DISTINCT customer_id) AS num_customers, CASE WHEN count(DISTINCT kind) > 1 THEN 'both' ELSE max(kind) END AS domain_type
      FROM (SELECT customer_id, P_emaildomain AS domain, 'purchaser' AS kind FROM ledger UNION ALL SELECT customer_id, R_emaildomain, 'recipient' FROM ledger)
      WHERE domain IS NOT NULL GROUP BY 1""",
    "BillingRegion": f"SELECT {RID} AS region_id, count(DISTINCT customer_id) AS num_customers, max(addr2)::DOUBLE AS country_code FROM ledger GROUP BY 1",
    "ClosedCase": "SELECT case_id, customer_id, card_id, opened_us, closed_us, outcome, pattern, exposure_usd, n_txns, analyst_notes FROM closed",
}
EDGE_SQL = {
    "OWNS": "SELECT customer_id AS src, card_id AS dst, min(us) AS since FROM ledger GROUP BY ALL",
    "MADE": "SELECT card_id AS src, TransactionID AS dst FROM ledger",
    "FROM_DEVICE": """SELECT TransactionID AS src, device_profile_id AS dst, id_15 = 'New' AS is_new_device, id_23 AS proxy_type FROM ledger
      WHERE device_profile_id IS NOT NULL""",
    "PURCHASER_EMAIL": "SELECT TransactionID AS src, P_emaildomain AS dst FROM ledger WHERE P_emaildomain IS NOT NULL",
    "RECIPIENT_EMAIL": "SELECT TransactionID AS src, R_emaildomain AS dst FROM ledger WHERE R_emaildomain IS NOT NULL",
    "BILLED_IN": f"SELECT TransactionID AS src, {RID} AS dst FROM ledger",
    "NEXT_TXN": """SELECT src, dst, delta_seconds FROM (SELECT lag(TransactionID) OVER w AS src, TransactionID AS dst,
      (us - lag(us) OVER w) / 1e6 AS delta_seconds FROM ledger WINDOW w AS (PARTITION BY card_id ORDER BY us, TransactionID)) WHERE src IS NOT NULL""",
    "INVOLVES_TXN": "SELECT case_id AS src, TransactionID AS dst FROM case_txns",
    "ON_CARD": "SELECT case_id AS src, card_id AS dst FROM closed",
    "CONNECTED_CARD": "SELECT case_id AS src, unnest(connected_card_ids) AS dst FROM closed",
    "SHARES_DEVICE": """SELECT card_id AS src, device_profile_id AS dst, min(us) AS first_seen, max(us) AS last_seen FROM ledger
      WHERE device_profile_id IS NOT NULL GROUP BY ALL""",
    "SAME_REGION": f"SELECT card_id AS src, {RID} AS dst, count(*) AS txn_count FROM ledger GROUP BY ALL",
}


def _vertex(name):
    def run(spark, sf):
        b = Bank(spark, sf)
        v = G.vertices(b.ledger, b.closed)[name]
        return v.withColumn("total_amount", F.round("total_amount", 6)) if name == "Card" else v
    return run


def _edge(name):
    def run(spark, sf):
        b = Bank(spark, sf)
        return G.edges(b.ledger, b.closed, b.case_txns)[name]
    return run


for _n, _s in VERTEX_SQL.items():
    query(f"vertex_{_n.lower()}", cases(_s))(_vertex(_n))
for _n, _s in EDGE_SQL.items():
    query(f"edge_{_n.lower()}", cases(_s))(_edge(_n))


@query("graph_counts", cases(" UNION ALL ".join(
    [f"SELECT 'vertices_{n}' AS name, count(*) AS n FROM ({s})" for n, s in VERTEX_SQL.items()]
    + [f"SELECT 'edges_{n}', count(*) FROM ({s})" for n, s in EDGE_SQL.items()])))
def graph_counts(spark, sf):
    b = Bank(spark, sf)
    return G.counts(G.vertices(b.ledger, b.closed), "vertices").unionByName(
        G.counts(G.edges(b.ledger, b.closed, b.case_txns), "edges"))


CASE_FAN = {
    "case_on_card": "SELECT case_id AS src, card_id AS dst FROM alerts",
    "case_involves_txn": "SELECT case_id AS src, flagged_txn_id AS dst FROM alerts",
    "case_involves_device": """SELECT case_id AS src, device_profile_id AS dst FROM alerts JOIN ledger ON TransactionID = flagged_txn_id
      WHERE device_profile_id IS NOT NULL""",
    "case_connected_card": "SELECT DISTINCT case_id AS src, l.card_id AS dst FROM alerts a JOIN ledger l USING (customer_id) WHERE l.card_id <> a.card_id",
    "case_similar_to": """SELECT a.case_id AS src, c.case_id AS dst, 0.6 AS similarity_score FROM alerts a JOIN closed c
      ON c.customer_id = a.customer_id AND c.card_id = a.card_id""",
}


def _case_edge(name):
    def run(spark, sf):
        b = Bank(spark, sf)
        f = b.alerts.join(b.ledger.select(F.col("TransactionID").alias("flagged_txn_id"), "device_profile_id"), "flagged_txn_id")
        own = b.ledger.select("customer_id", F.col("card_id").alias("other")).distinct()
        other = f.join(own, "customer_id").filter(F.col("other") != F.col("card_id")).groupBy("case_id").agg(
            F.collect_list("other").alias("connected_cards"))
        similar = f.select("case_id", "customer_id", "card_id").join(
            b.closed.select(F.col("case_id").alias("c"), "customer_id", "card_id"), ["customer_id", "card_id"]).groupBy("case_id").agg(
            F.collect_list(F.struct(F.col("c").alias("case_id"), F.lit(0.6).alias("score"))).alias("similar"))
        rec = f.select("case_id", "card_id", F.array("flagged_txn_id").alias("txn_ids"),
                       F.array_compact(F.array("device_profile_id")).alias("devices"))
        rec = rec.join(other, "case_id", "left").join(similar, "case_id", "left")
        return G.case_edges(rec)[name.upper()]
    return run


for _n, _s in CASE_FAN.items():
    query(f"edge_{_n}", full(_s))(_case_edge(_n))


@query("edge_linked_customer", led("""
  SELECT src, dst, link_type, link_value FROM (SELECT lag(customer_id) OVER (PARTITION BY link_type, link_value ORDER BY customer_id) AS src,
    customer_id AS dst, link_type, link_value FROM (SELECT DISTINCT customer_id, 'device' AS link_type, device_profile_id AS link_value FROM ledger
      UNION SELECT DISTINCT customer_id, 'email', R_emaildomain FROM ledger) WHERE link_value IS NOT NULL) WHERE src IS NOT NULL"""))
def edge_linked_customer(spark, sf):
    return G.linked_customers(Bank(spark, sf).ledger, {"device": "device_profile_id", "email": "R_emaildomain"})


@query("graph_neighbors", led_alerts("SELECT device_profile_id AS id, TransactionID AS neighbor FROM ledger JOIN (SELECT DISTINCT device_profile_id "
                                     "FROM ledger JOIN alerts ON TransactionID = flagged_txn_id) USING (device_profile_id)"))
def graph_neighbors(spark, sf):
    b = Bank(spark, sf)
    e = G.edges(b.ledger, b.closed, b.case_txns)["FROM_DEVICE"]
    flagged = b.alerts.select(F.col("flagged_txn_id").alias("src"))
    return G.neighbors(e, e.join(flagged, "src", "left_semi").select(F.col("dst").alias("id")), reverse=True).select("id", "neighbor")


ROUNDS = 3
PR = """
  e AS (SELECT DISTINCT card_id AS src, device_profile_id AS dst FROM ledger WHERE device_profile_id IS NOT NULL)""", """
  b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)""", """
  dg AS (SELECT src AS id, count(*) AS deg, 1.0::DOUBLE AS pr FROM b GROUP BY 1)""", """
  r1 AS (SELECT b.dst AS id, 0.15 + 0.85 * sum(pr / deg) AS pr FROM b JOIN dg ON dg.id = b.src GROUP BY 1)""", """
  r2 AS (SELECT b.dst AS id, 0.15 + 0.85 * sum(r1.pr / deg) AS pr FROM b JOIN r1 ON r1.id = b.src JOIN dg ON dg.id = b.src GROUP BY 1)""", """
  r3 AS (SELECT b.dst AS id, 0.15 + 0.85 * sum(r2.pr / deg) AS pr FROM b JOIN r2 ON r2.id = b.src JOIN dg ON dg.id = b.src GROUP BY 1)"""


@query("graph_pagerank", led("SELECT id, round(pr, 6) AS pr FROM r3", *PR))
def graph_pagerank(spark, sf):
    d = Bank(spark, sf).ledger.filter(F.col("device_profile_id").isNotNull())
    e = d.select(F.col("card_id").alias("src"), F.col("device_profile_id").alias("dst"))
    return G.pagerank(e, iterations=ROUNDS, cut_every=2).withColumn("pr", F.round("pr", 6))


@query("graph_components", led("""
  SELECT id, min(root) AS component FROM reach GROUP BY id""", """
  e AS (SELECT DISTINCT customer_id AS src, device_profile_id AS dst FROM ledger WHERE id_15 = 'New' AND id_23 IS NOT NULL
    AND device_profile_id IS NOT NULL)""", """
  b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)""", """
  reach AS (SELECT src AS id, src AS root FROM b UNION SELECT b.dst, reach.root FROM reach JOIN b ON b.src = reach.id)"""))
def graph_components(spark, sf):
    """Components of customers and devices over new, proxied use."""
    d = Bank(spark, sf).ledger.filter((F.col("id_15") == "New") & F.col("id_23").isNotNull() & F.col("device_profile_id").isNotNull())
    return G.components(d.select(F.col("customer_id").alias("src"), F.col("device_profile_id").alias("dst")))


@query("card_activity", led("SELECT card_id, count(*) AS n_txns, count(DISTINCT device_profile_id) AS n_devices FROM ledger GROUP BY 1"))
def card_activity(spark, sf):
    b = Bank(spark, sf)
    e = G.edges(b.ledger, b.closed, b.case_txns)
    made = e["MADE"].groupBy(F.col("src").alias("card_id")).agg(F.count(F.lit(1)).alias("n_txns"))
    dev = e["SHARES_DEVICE"].groupBy(F.col("src").alias("card_id")).agg(F.count(F.lit(1)).alias("n_devices"))
    return made.join(dev, "card_id", "left").fillna({"n_devices": 0})


# ---- earlier generation ------------------------------------------------------------------------------

SM = "(channel = 'online' AND TransactionAmt < 5)"


def _any_time_sql(least):
    return led("""SELECT card_id, before AS n_small, round(paid, 2) AS small_total, TransactionID AS large_txn, TransactionAmt AS large_amount
      FROM hits WHERE rn = 1 AND before >= 2""", f"""
      run AS (SELECT *, coalesce(sum({SM}::INT) OVER w, 0)::BIGINT AS before, coalesce(sum(CASE WHEN {SM} THEN TransactionAmt END) OVER w, 0) AS paid,
        count(*) OVER (PARTITION BY card_id) AS n FROM ledger
        WINDOW w AS (PARTITION BY card_id ORDER BY us, TransactionID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", f"""
      hits AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY us, TransactionID) AS rn FROM run WHERE NOT {SM}
        AND TransactionAmt >= 50 AND before >= {least} AND n >= 3)""")


@query("legacy_card_testing_graph", _any_time_sql(1))
def legacy_card_testing_graph(spark, sf):
    return L.card_testing_any_time(Bank(spark, sf).ledger, any_small=True)


@query("legacy_card_testing", _any_time_sql(2))
def legacy_card_testing(spark, sf):
    return L.card_testing_any_time(Bank(spark, sf).ledger, any_small=False)


@query("legacy_out_of_region", led_alerts("""
  SELECT f.card_id, f.region, count(*) FILTER (l.addr1 = f.region) AS n_in_region, count(*) FILTER (l.addr1 <> f.region) AS n_elsewhere,
    n_in_region > 0 AND n_elsewhere > 0 AS detected
  FROM (SELECT DISTINCT l.card_id, l.addr1 AS region FROM alerts a JOIN ledger l ON l.TransactionID = flagged_txn_id WHERE addr1 IS NOT NULL) f
  JOIN ledger l USING (card_id) GROUP BY ALL"""))
def legacy_out_of_region(spark, sf):
    b = Bank(spark, sf)
    f = A.txn_context(b.alerts, b.ledger).filter(F.col("addr1").isNotNull())
    return L.out_of_region(b.ledger, f.select("card_id", F.col("addr1").alias("region")))


@query("legacy_new_device", led("""SELECT card_id, device_profile_id, count(*) <= 1 AS detected, count(*) - 1 AS prior_uses FROM ledger
  WHERE device_profile_id IS NOT NULL GROUP BY ALL"""))
def legacy_new_device(spark, sf):
    d = Bank(spark, sf).ledger.filter(F.col("device_profile_id").isNotNull())
    return L.new_device(d, d.select("card_id", "device_profile_id"))


RULES = """
  fl AS (SELECT a.case_id, l.* FROM alerts a JOIN ledger l ON l.TransactionID = a.flagged_txn_id)""", """
  rec AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY us DESC, TransactionID DESC) AS rn FROM ledger QUALIFY rn <= 30)""", """
  prof AS (SELECT card_id, count(*) AS n_rows, avg(TransactionAmt) AS avg_amount, count(*) FILTER (channel = 'online') AS n_online,
    count(DISTINCT channel) FILTER (rn <= 10) AS channels10, count(DISTINCT R_emaildomain) AS n_recipients FROM rec GROUP BY 1)""", """
  dc AS (SELECT device_profile_id, count(DISTINCT card_id) AS device_cards FROM ledger WHERE device_profile_id IS NOT NULL GROUP BY 1)""", f"""
  runl AS (SELECT *, coalesce(sum({SM}::INT) OVER (PARTITION BY card_id ORDER BY us, TransactionID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    count(*) OVER (PARTITION BY card_id) AS n FROM ledger)""".replace("{SM}", SM), f"""
  tst AS (SELECT DISTINCT card_id, 1 AS hit FROM runl WHERE NOT {SM} AND TransactionAmt >= 50 AND before >= 2 AND n >= 3)""", """
  rules AS (SELECT case_id, card_id, TransactionID, TransactionAmt, risk_score, id_15, id_23, coalesce(hit, 0) = 1 AS r1,
    channel = 'online' AND TransactionAmt > 3 * avg_amount AND TransactionAmt > 100 AND n_online >= 2 AS r2,
    channel = 'online' AND (coalesce(id_15 = 'New', false) OR id_23 IS NOT NULL) AS r3, channel = 'in_person' AND coalesce(addr1 = '103', false) AS r4,
    n_rows >= 5 AND channels10 > 1 AND (coalesce(id_15 = 'New', false) OR id_23 IS NOT NULL) AS r5,
    coalesce(device_cards, 0) >= 400 OR n_recipients >= 3 AS r6
    FROM fl LEFT JOIN prof USING (card_id) LEFT JOIN dc USING (device_profile_id) LEFT JOIN tst USING (card_id))""", """
  named AS (SELECT *, CASE WHEN r1 THEN 'card_testing' WHEN r2 THEN 'card_not_present_fraud' WHEN r3 THEN 'card_not_present_new_device'
    WHEN r4 THEN 'out_of_region_use' WHEN r5 THEN 'account_takeover' WHEN r6 THEN 'undocumented' ELSE 'none' END AS pattern FROM rules)"""


def rules_of(b):
    f = A.txn_context(b.alerts, b.ledger)
    hit = L.card_testing_any_time(b.ledger, any_small=False).select("card_id", F.lit(1).alias("testing_hit"))
    dc = A.cards_of(b.ledger, "device_profile_id").groupBy("device_profile_id").agg((F.count(F.lit(1)) - 397).alias("device_cards"))
    f = f.join(hit, "card_id", "left").join(dc, "device_profile_id", "left").withColumns({
        "new_device": C.flag(F.col("id_15") == "New"), "proxy": C.flag(F.col("id_23").isNotNull()),
        "new_region": C.flag(F.col("addr1") == "103")})
    return L.first_pattern(L.rule_flags(f, L.card_profile(b.alerts, b.ledger)))


@query("legacy_rules", led_alerts("SELECT case_id, r1, r2, r3, r4, r5, r6, pattern FROM named", *RULES))
def legacy_rules(spark, sf):
    names = ["r_testing", "r_cnp", "r_new_device", "r_region", "r_takeover", "r_undocumented"]
    return rules_of(Bank(spark, sf)).select("case_id", *[F.col(n).alias(f"r{i + 1}") for i, n in enumerate(names)], "pattern")


@query("legacy_scorecard", led_alerts("""
  SELECT case_id, pattern, round(CASE WHEN n = 0 THEN 0.5 ELSE greatest(0, least(1, base + 0.10 * nd + 0.05 * px + 0.15 * (TransactionAmt < 5)::INT
      + CASE WHEN risk_score > 0.8 THEN 0.05 ELSE 0 END)) END, 6) AS score
  FROM (SELECT *, coalesce(id_15 = 'New', false)::INT AS nd, (id_23 IS NOT NULL)::INT AS px, nd + px + (TransactionAmt < 5)::INT AS n,
    CASE pattern WHEN 'card_testing' THEN 0.85 WHEN 'card_not_present_fraud' THEN 0.65 WHEN 'card_not_present_new_device' THEN 0.75
      WHEN 'out_of_region_use' THEN 0.70 WHEN 'account_takeover' THEN 0.80 WHEN 'undocumented' THEN 0.60 ELSE 0 END AS base FROM named)""", *RULES))
def legacy_scorecard(spark, sf):
    r = rules_of(Bank(spark, sf))
    ev = {"e_new_device": F.col("new_device"), "e_proxy": F.col("proxy"), "e_small_online": C.flag(F.col("TransactionAmt") < 5)}
    s = L.scorecard(F.col("pattern"), ev, F.lit("risk_score"), F.col("risk_score"), F.lit(0))
    return r.select("case_id", "pattern", F.round(s, 6).alias("score"))


@query("context_signals", led_alerts(f"""
  SELECT case_id, TransactionAmt > 3 * avg_amount AS high_amount, TransactionAmt < 0.5 * avg_amount AS low_amount,
    n5 >= 3 AND n5 - days5 >= 2 AS same_day_burst, CASE WHEN n5 >= 3 THEN small5 ELSE 0 END AS n_small
  FROM fl JOIN (SELECT card_id, avg(TransactionAmt) AS avg_amount, count(*) FILTER (rn <= 5) AS n5, count(DISTINCT us // {DAY}) FILTER (rn <= 5) AS days5,
    count(*) FILTER (rn <= 5 AND TransactionAmt < 5) AS small5 FROM rec GROUP BY 1) USING (card_id)""", *RULES[:2]))
def context_signals(spark, sf):
    b = Bank(spark, sf)
    return L.context_signals(A.txn_context(b.alerts, b.ledger), b.ledger)


@query("legacy_same_price", led_alerts("""
  SELECT DISTINCT a.case_id FROM alerts a JOIN ledger f ON f.TransactionID = a.flagged_txn_id JOIN ledger l ON l.card_id = f.card_id
  WHERE l.P_emaildomain IS NOT DISTINCT FROM f.P_emaildomain AND abs(l.TransactionAmt - f.TransactionAmt) < 1 AND l.TransactionID <> f.TransactionID"""))
def legacy_same_price(spark, sf):
    b = Bank(spark, sf)
    f = b.alerts.join(b.ledger.select(F.col("TransactionID").alias("flagged_txn_id"), "P_emaildomain", "TransactionAmt"), "flagged_txn_id")
    return L.same_price(f, b.ledger)
