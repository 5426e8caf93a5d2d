"""Steps whose work must not grow faster than the input and the rows they return."""
import random

import numpy as np
from pyspark.sql import functions as F

from helpers import DEVICE, hours, ledger, row
from ledgerlens.functions import text as X
from ledgerlens.operators import asof, bursts, memory, rings, similarity, skew
from ledgerlens.params import DAY, TESTBED

T0 = 1_700_000_000_000_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_multiplied_probes_are_not_broadcast(spark):
    """120 rows an alert were taken for one and sent to the driver."""
    rows = ledger(spark, [row(i, T0 + hours(i), 10.0) for i in range(5)])
    probes = spark.createDataFrame([("A", "C00001", T0 - 120 * DAY, T0 + DAY)], "case_id string, customer_id string, start_us bigint, end_us bigint")
    band = skew.band_join(probes, rows, ["customer_id"], "start_us", "end_us")
    pieces = skew.window_pieces(probes, rows, ["customer_id"], "start_us", "end_us", ["addr1"], {"n": F.lit(1)})
    assert "Broadcast" not in plan(band) and "Broadcast" not in plan(pieces)
    assert band.count() == 5 and pieces.agg(F.sum("n")).first()[0] == 5


def test_recurring_goes_to_few_buckets(spark, monkeypatch):
    """every charge went to each of 120 days."""
    seen = {}
    join = bursts.band_join
    monkeypatch.setattr(bursts, "band_join", lambda *a, **k: seen.update(k) or join(*a, **k))
    rows = ledger(spark, [row(i, T0 + 4 * DAY * i, 100.0 + i) for i in range(6)]).withColumn("uid", F.col("customer_id"))
    probes = rows.select(F.col("TransactionID").alias("case_id"), "uid", "ProductCD", "TransactionAmt", F.col("us").alias("flag_us"),
                         (F.col("us") - 120 * DAY).alias("start_us"), F.col("us").alias("end_us"))
    got = {tuple(r) for r in bursts.recurring(probes, rows, TESTBED).collect()}
    assert got == {(str(i), i, i) for i in range(2, 6)}
    assert 120 * DAY / seen.get("width", DAY) <= 4


def brute_ring(rows, alerts, p):
    out = set()
    for case, own, as_of in alerts:
        cards = set()
        for card in {r[0] for r in rows}:
            mine = sorted(r[1:] for r in rows if r[0] == card and as_of - p.ring_us <= r[1] < as_of)
            for i, s in enumerate(mine):
                a = sorted(r[2] for r in mine[i:] if r[0] <= s[0] + p.burst_us)
                if len(a) >= p.burst_min and a[-1] - a[0] >= p.min_spread and min(y - x for x, y in zip(a, a[1:])) >= p.min_step:
                    cards.add(card)
        if cards - {own}:
            out |= {(case, c) for c in cards}
    return out


def test_structuring_ring_by_spans(spark):
    """F8: every alert's rows of the whole population were gathered."""
    rnd = random.Random(11)
    made = [(f"C0000{c}-K1", T0 + rnd.randrange(40) * DAY + rnd.randrange(3) * hours(5), f"{c}-{i}", 42.5 + rnd.randrange(30) / 4)
            for c in range(6) for i in range(25)]
    led = ledger(spark, [row(i, us, amount, card[:6], card) for card, us, i, amount in made])
    alerts = [(f"A{i}", f"C0000{i % 6}-K1", T0 + rnd.randrange(80) * DAY + rnd.choice([0, 1, hours(5), hours(10)])) for i in range(60)]
    alerts += [("A0", "C00001-K1", T0 + 20 * DAY)]
    a = spark.createDataFrame(alerts, "case_id string, own_card string, as_of bigint")
    got = [tuple(r) for r in rings.structuring_ring(a.filter("case_id <> 'A0'"), led, TESTBED).collect()]
    want = brute_ring([(c, us, i, x) for c, us, i, x in made], [x for x in alerts if x[0] != "A0"], TESTBED)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    both = [r.card_id for r in rings.structuring_ring(a.filter("case_id = 'A0'"), led, TESTBED).collect()]
    one, other = (brute_ring(made, [x], TESTBED) for x in alerts if x[0] == "A0")
    assert len(both) == len(set(both)) and {c for _, c in one | other} == set(both)
    assert "_all" not in plan(rings.structuring_ring(a, led, TESTBED))


def test_links_are_shuffled_once(spark):
    """the pairs passed three joins."""
    alerts = spark.createDataFrame([("A", "C1", 10), ("B", "C2", 3)], "case_id string, customer_id string, as_of bigint")
    index = spark.createDataFrame([("X", "C1", "K1", 5, "cleared", "none"), ("Y", "C2", "K2", 4, "cleared", "none"), ("Z", "C3", "K3", 2, "confirmed_fraud", "p")],
                                  "case_id string, customer_id string, card_id string, closed_us bigint, outcome string, pattern string")
    keys = spark.createDataFrame([("X", "uid", "u"), ("Z", "device", "d"), ("Y", "device", "d")], "case_id string, kind string, value string")
    one = lambda c, v: spark.createDataFrame(v, f"case_id string, {c} string")
    links = memory.graph_links(alerts, one("uid", [("A", "u")]), one("card_id", [("A", "K1")]), one("device_profile_id", [("A", "d"), ("B", "d")]), index, keys)
    got = {(r.case_id, r.closed_case, r.link, r.outcome) for r in links.collect()}
    assert got == {("A", "X", "same cardholder (uid)", "cleared"), ("A", "Y", "same device profile", "cleared"),
                   ("A", "Z", "same device profile", "confirmed_fraud"), ("B", "Z", "same device profile", "confirmed_fraud")}
    top = plan(links).split("Union")[0]       # what comes after all pairs are found
    assert "Join" not in top


def test_ring_members_meet_one_use_of_a_card(spark):
    """a ring met every day of every card's use."""
    rnd = random.Random(3)
    made = [row(i, T0 + rnd.randrange(90) * DAY, 5.0, f"C0000{i % 4}", device=rnd.choice([DEVICE, "x|y|z|w"])) for i in range(40)]
    led = ledger(spark, made)
    asked = [(f"R{i}", d, T0 + rnd.randrange(130) * DAY) for i in range(30) for d in (DEVICE, "x|y|z|w")[:1 + i % 2]]
    got = rings.ring_members(spark.createDataFrame(asked, "case_id string, device_profile_id string, as_of bigint"), led, TESTBED)
    want = {(c, r["customer_id"], r["card_id"]) for c, d, t in asked for r in made if r["device_profile_id"] == d and t - TESTBED.ring_us <= r["us"] < t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "sequence(" not in plan(got)


def test_device_links_without_distinct(spark):
    """all pairs were shuffled to be made distinct."""
    led = ledger(spark, [row(i, T0 + i * DAY, 5.0, device=DEVICE) for i in range(6)])
    closed = spark.createDataFrame([("X", "cleared", T0 + 9 * DAY), ("Y", "confirmed_fraud", T0 + 20 * DAY)], "case_id string, outcome string, closed_us bigint")
    members = spark.createDataFrame([("X", "0"), ("X", "1"), ("Y", "3"), ("Y", "5")], "case_id string, TransactionID string")
    probes = spark.createDataFrame([("A", DEVICE, T0 + 10 * DAY), ("A", DEVICE, T0 + 11 * DAY), ("B", DEVICE, T0 + 30 * DAY)],
                                   "case_id string, device_profile_id string, as_of bigint")
    links = asof.device_case_links(probes, closed, members, led, confirmed_only=False)
    assert sorted((r.case_id, r.closed_case) for r in links.collect()) == [("A", "X"), ("B", "X"), ("B", "Y")]
    assert "Join" in plan(links).split("Aggregate")[0]


def test_tokens_are_not_sorted(spark):
    """Token rows passed a window, which sorted and spilled them."""
    docs = spark.createDataFrame([(1, "Fraud ring, fraud RING of the card"), (1, "ring"), (2, None), (None, "lone wolf"), (3, "ab")], "doc_id long, text string")
    counts = X.token_counts(docs)
    got = {tuple(r) for r in counts.collect()}
    assert got == {(1, "fraud", 2, 3), (1, "ring", 3, 3), (1, "fraud_ring", 2, 3), (1, "ring_fraud", 1, 3),
                   (None, "lone", 1, 1), (None, "wolf", 1, 1), (None, "lone_wolf", 1, 1)}
    assert "Window" not in plan(counts) and "token" not in plan(counts).split("Sort")[-1]


def test_approximate_pairs_leave_tasks_only_when_close(spark, monkeypatch):
    """every candidate pair was shuffled with both vectors."""
    monkeypatch.setattr(similarity, "SIDE", 30)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(150, 5))
    v = np.vstack([v, v[:1]])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    found = similarity.approximate_pairs(df.select(F.col("id").alias("query_id"), "v"), df.select(F.col("id").alias("point_id"), "v"), 1.2, bucket=1.0)
    got = [(r.query_id, r.point_id) for r in found.collect()]
    d = np.sqrt(((v[:, None] - v) ** 2).sum(axis=2))
    near = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(d < 1.2)))}
    assert len(got) == len(set(got)) and set(got) <= near and len(got) > 0.8 * len(near)
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    lsh = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=1.0, numHashTables=4, seed=7)
    x = df.select("id", array_to_vector("v").alias("x"))
    want = lsh.fit(x).approxSimilarityJoin(x, x, 1.2, "distance").select("datasetA.id", "datasetB.id")
    assert set(got) == {tuple(r) for r in want.collect()}
    assert "FlatMapGroupsInArrow" in plan(found)


def test_many_dimensions_meet_a_chunk_at_once(spark, monkeypatch):
    """where boxes rule nothing out, queries went through all leaves one by one."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 40))
    v[700:] = v[:200]                      # copies: ties go to the smaller id
    ids = [f"p{i:03d}" for i in range(len(v))]
    since = rng.integers(0, 5, len(v))
    leaves = similarity.Leaves(ids, since, v)
    calls = []
    all_of = similarity.Leaves.all_of
    monkeypatch.setattr(similarity.Leaves, "all_of", lambda self, q, *a: calls.append(len(q)) or all_of(self, q, *a))
    as_of = rng.integers(0, 6, len(v))
    for u in (np.inf, 7.5):
        d, at, compared = leaves.find(v, as_of, np.full(len(v), u), np.arange(len(v)), 4)
        for i in range(len(v)):
            e = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
            ok = [j for j in np.lexsort((np.arange(len(v)), np.round(e, 9))) if j != i and since[j] < as_of[i] and e[j] <= u][:4]
            assert at[i][at[i] >= 0].tolist() == ok and np.allclose(d[i][:len(ok)], e[ok])
    assert sum(calls) > 900
