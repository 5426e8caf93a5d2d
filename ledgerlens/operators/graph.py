"""The property graph as one table per vertex and edge type, and walks over it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import device_digest, region_id
from ..session import checkpointed
from .skew import running_totals

FIRST, LAST = F.min, F.max


def vertices(ledger: DataFrame, closed: DataFrame, cases: DataFrame | None = None) -> dict[str, DataFrame]:
    """Vertex tables. ``cases``: investigation records, when there are any."""
    dev = ledger.filter(F.col("device_profile_id").isNotNull())
    part = F.split("device_profile_id", r"\|")
    mails = ledger.select("customer_id", F.explode(F.array(
        F.struct(F.lit("purchaser").alias("kind"), F.col("P_emaildomain").alias("domain")),
        F.struct(F.lit("recipient").alias("kind"), F.col("R_emaildomain").alias("domain")))).alias("m"))
    mails = mails.select("customer_id", "m.kind", "m.domain").filter(F.col("domain").isNotNull()).distinct()
    # distinct counts are taken over already distinct pairs, so a popular value is combined map-side
    cards = ledger.groupBy("customer_id", "card_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    regions = ledger.select("customer_id", region_id(F.col("addr1")).alias("region_id"), "addr2").groupBy(
        "region_id", "customer_id").agg(F.max("addr2").alias("addr2"))
    out = {
        "Customer": cards.groupBy("customer_id").agg(F.count(F.lit(1)).alias("num_cards"), F.min("a").alias("first_seen"),
                                                     F.max("b").alias("last_seen")),
        "Card": ledger.groupBy("card_id", "customer_id").agg(
            F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.count(F.lit(1)).alias("num_transactions"),
            F.sum("TransactionAmt").alias("total_amount")),
        "Transaction": ledger.select("TransactionID", "customer_id", "card_id", F.col("TransactionAmt").alias("amount"), "us",
                                     "channel", "risk_score", "ProductCD", "addr1", "addr2", "P_emaildomain", "R_emaildomain"),
        "DeviceProfile": dev.groupBy("device_profile_id", "card_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
        .groupBy("device_profile_id").agg(F.count(F.lit(1)).alias("num_cards_seen"), F.min("a").alias("first_seen"),
                                          F.max("b").alias("last_seen"))
        .select(device_digest(F.col("device_profile_id")).alias("device_id"), "device_profile_id",
                F.get(part, F.lit(0)).alias("device_info"), F.get(part, F.lit(1)).alias("os"), F.get(part, F.lit(2)).alias("browser"),
                F.get(part, F.lit(3)).alias("screen"), "num_cards_seen", "first_seen", "last_seen"),
        "EmailDomain": mails.groupBy("domain", "customer_id").agg(F.max("kind").alias("kind"), F.min("kind").alias("kind0"))
        .groupBy("domain").agg(F.count(F.lit(1)).alias("num_customers"),
                               F.when(F.min("kind0") == F.max("kind"), F.max("kind")).otherwise("both").alias("domain_type")),
        "BillingRegion": regions.groupBy("region_id").agg(F.count(F.lit(1)).alias("num_customers"),
                                                          F.max("addr2").try_cast("double").alias("country_code")),
        "ClosedCase": closed.select("case_id", "customer_id", "card_id", "opened_us", "closed_us", "outcome", "pattern",
                                    "exposure_usd", "n_txns", "analyst_notes")}
    if cases is not None:
        out["InvestigationCase"] = cases
    return out


def next_txn(ledger: DataFrame) -> DataFrame:
    """Consecutive rows of a card with the seconds between them."""
    rows = ledger.select("card_id", "TransactionID", "us")
    prev = running_totals(rows, ["card_id"], ["us", "TransactionID"],
                          {"prev": ("max", F.struct("us", "TransactionID"))})
    return prev.filter(F.col("prev").isNotNull()).select(
        F.col("prev.TransactionID").alias("src"), F.col("TransactionID").alias("dst"),
        ((F.col("us") - F.col("prev.us")) / 1e6).alias("delta_seconds"))


def edges(ledger: DataFrame, closed: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Edge tables ``src, dst`` plus attributes."""
    def pair(df: DataFrame, src, dst, *rest) -> DataFrame:
        return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *rest)
    dev = ledger.filter(F.col("device_profile_id").isNotNull())
    region = ledger.withColumn("region_id", region_id(F.col("addr1")))
    span = [F.min("us").alias("first_seen"), F.max("us").alias("last_seen")]
    return {
        "OWNS": pair(ledger.groupBy("customer_id", "card_id").agg(F.min("us").alias("since")), "customer_id", "card_id", "since"),
        "MADE": pair(ledger, "card_id", "TransactionID"),
        "FROM_DEVICE": pair(dev, "TransactionID", "device_profile_id",
                            F.coalesce(F.col("id_15") == "New", F.lit(False)).alias("is_new_device"), F.col("id_23").alias("proxy_type")),
        "PURCHASER_EMAIL": pair(ledger.filter(F.col("P_emaildomain").isNotNull()), "TransactionID", "P_emaildomain"),
        "RECIPIENT_EMAIL": pair(ledger.filter(F.col("R_emaildomain").isNotNull()), "TransactionID", "R_emaildomain"),
        "BILLED_IN": pair(region, "TransactionID", "region_id"),
        "NEXT_TXN": next_txn(ledger),
        "INVOLVES_TXN": pair(members, "case_id", "TransactionID"),
        "ON_CARD": pair(closed, "case_id", "card_id"),
        "CONNECTED_CARD": closed.select(F.col("case_id").alias("src"), F.explode("connected_card_ids").alias("dst")),
        "SHARES_DEVICE": pair(dev.groupBy("card_id", "device_profile_id").agg(*span), "card_id", "device_profile_id",
                              "first_seen", "last_seen"),
        "SAME_REGION": pair(region.groupBy("card_id", "region_id").agg(F.count(F.lit(1)).alias("txn_count")), "card_id",
                            "region_id", "txn_count")}


def case_edges(cases: DataFrame) -> dict[str, DataFrame]:
    """Edges of investigation records: ``case_id, card_id, txn_ids, connected_cards, devices, similar``.

    ``similar``: array of ``struct<case_id, score>``.
    """
    def fan(column: str) -> DataFrame:
        return cases.select(F.col("case_id").alias("src"), F.explode(column).alias("dst"))
    return {"CASE_ON_CARD": cases.select(F.col("case_id").alias("src"), F.col("card_id").alias("dst")),
            "CASE_INVOLVES_TXN": fan("txn_ids"), "CASE_CONNECTED_CARD": fan("connected_cards"),
            "CASE_INVOLVES_DEVICE": fan("devices"),
            "CASE_SIMILAR_TO": cases.select(F.col("case_id").alias("src"), F.explode("similar").alias("s")).select(
                "src", F.col("s.case_id").alias("dst"), F.col("s.score").alias("similarity_score"))}


def linked_customers(ledger: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Customers sharing a value, as a chain per value: each one is linked to the next in id order.

    A chain carries the same connectivity as all pairs with one edge per member, so a value shared by
    millions of customers stays linear. ``keys`` maps a link type to its column.
    """
    kinds = F.array(*[F.struct(F.lit(t).alias("link_type"), F.col(c).cast("string").alias("link_value")) for t, c in keys.items()])
    use = ledger.select("customer_id", F.explode(kinds).alias("k")).select("customer_id", "k.link_type", "k.link_value")
    use = use.filter(F.col("link_value").isNotNull()).distinct()
    # order by a numeric place of the id: slices of a hot value are ranges of that place
    use = use.withColumn("_place", F.regexp_extract("customer_id", r"(\d+)", 1).cast("bigint"))
    prev = running_totals(use, ["link_type", "link_value"], ["_place", "customer_id"],
                          {"_prev": ("max", F.struct("_place", "customer_id"))}, slice_width=100_000)
    return prev.filter(F.col("_prev").isNotNull()).select(F.col("_prev.customer_id").alias("src"),
                                                          F.col("customer_id").alias("dst"), "link_type", "link_value")


def neighbors(edge: DataFrame, start: DataFrame, reverse: bool = False) -> DataFrame:
    """Neighbours of ``start (id)`` over one edge type; ``reverse`` walks from dst to src."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edge.join(start.select(F.col("id").alias(a)).distinct(), a, "left_semi").select(
        F.col(a).alias("id"), F.col(b).alias("neighbor"), *[c for c in edge.columns if c not in ("src", "dst")])


def counts(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """``(name, n)`` per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(f"{kind}_{name}").alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def pagerank(edge: DataFrame, iterations: int = 10, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """PageRank on an undirected weightless graph ``(src, dst)`` for a fixed number of rounds.

    A round is one join on the source and one aggregate on the target. The aggregate combines map-side,
    so a busy device receives one partial sum per task. Lineage is cut through reliable storage.
    """
    both = edge.select("src", "dst").distinct()
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = checkpointed(both.join(degree, "src"))
    rank = degree.select(F.col("src").alias("id"), F.lit(1.0).alias("pr"))
    for i in range(iterations):
        sent = links.join(rank, links.src == rank.id).select(F.col("dst").alias("id"), (F.col("pr") / F.col("deg")).alias("x"))
        rank = sent.groupBy("id").agg((F.lit(1 - damping) + F.lit(damping) * F.sum("x")).alias("pr"))
        if (i + 1) % cut_every == 0 and i + 1 < iterations:
            rank = checkpointed(rank)
    return rank


def components(edge: DataFrame) -> DataFrame:
    """Connected components ``(id, component)`` of an undirected graph, labelled by the smallest id.

    Alternates linking every node's larger neighbours to its smallest one and every node to the smallest
    of its smaller neighbours. The number of rounds grows with the logarithm of the path length.
    """
    e = edge.select("src", "dst").filter(F.col("src") != F.col("dst"))
    isolated = edge.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    e = checkpointed(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("u", "v", "m")
        e = small.select(F.col("u"), F.col("m").alias("v")).unionByName(
            small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = checkpointed(e)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return isolated.join(e.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select(
        "id", F.coalesce("m", "id").alias("component"))
