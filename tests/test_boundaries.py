from pyspark.sql import functions as F

from helpers import DEVICE, hours, ledger, row
from ledgerlens.functions import columns as C
from ledgerlens.operators import asof, bursts, episodes, features
from ledgerlens.params import DAY, DEFAULT, HOUR, MINUTE

T = 1_479_204_000_000_000     # 2016-11-15 10:00:00


def probing_ledger(spark):
    return ledger(spark, [row("1", T, 1.10), row("2", T + 15 * MINUTE, 2.40), row("3", T + 30 * MINUTE, 0.95), row("4", T + HOUR, 259.98)])


def test_card_probing_ledger(spark):
    led = probing_ledger(spark)
    hit = bursts.card_testing(led, ["card_id"]).first()
    assert (hit.n_tests, hit.purchase, hit.purchase_amt, hit.max_cleared) == (3, "4", 259.98, 259.98)
    roles = {r.TransactionID: r.role for r in bursts.testing_rows(bursts.card_testing(led, ["card_id"]), led, ["card_id"]).collect()}
    assert roles == {"1": "test", "2": "test", "3": "test", "4": "purchase"}
    v = asof.velocity(led).first()
    assert v.n == 4 and abs(v.total - 264.43) < 1e-6


def test_burst_of_exactly_one_hour(spark):
    exact = [row(i, T + i * 30 * MINUTE, 2.0) for i in range(3)] + [row(9, T + 2 * HOUR, 50)]
    assert bursts.card_testing(ledger(spark, exact), ["card_id"]).count() == 1
    exact[2]["us"] += 1
    assert bursts.card_testing(ledger(spark, exact), ["card_id"]).count() == 0


def test_structuring_edges(spark):
    band = lambda amounts: ledger(spark, [row(i, T + i * MINUTE, a) for i, a in enumerate(amounts)])
    hit = bursts.structuring(band([425.00, 450.0, 499.99, 500.00]), ["card_id"]).first()
    assert hit.n == 3 and hit.total == 1374.99 and hit.span_min == 2.0
    assert bursts.structuring(band([499.95] * 4), ["card_id"]).count() == 0
    assert bursts.structuring(band([450.0, 451.0, 452.0]), ["card_id"]).count() == 0      # spread under five


def test_many_rows_in_band_repeat_a_price(spark):
    rows = [row(i, T + i * 1_000_000, 425 + (i * 0.0937) % 74.9) for i in range(800)]
    got = bursts.structuring_bursts(ledger(spark, rows), ["card_id"])
    # every start with many rows holds two prices closer than ten cents; brute force over all starts agrees
    want = 0
    amounts = [r["TransactionAmt"] for r in rows]
    for i in range(len(rows) - 2):
        a = sorted(amounts[i:])
        if all(y - x >= 0.10 for x, y in zip(a, a[1:])) and a[-1] - a[0] >= 5:
            want += 1
    assert got.count() == want


def test_episode_gap(spark):
    for extra, expect in ((0, {"1", "2"}), (1_000_000, {"1"})):
        led = ledger(spark, [row("1", T, 10, p=0.9), row("2", T + 48 * HOUR + extra, 10, p=0.9)])
        a = spark.createDataFrame([("A", "C00001", "1", T, T + 5 * DAY)],
                                  "case_id string, customer_id string, flagged_txn_id string, flag_us bigint, opened_us bigint")
        assert {r.TransactionID for r in episodes.reconstruct(a, led).collect()} == expect


def test_flagged_row_bridges_two_chains(spark):
    led = ledger(spark, [row("1", T, 10, p=0.9), row("2", T + 40 * HOUR, 10, p=0.1), row("3", T + 80 * HOUR, 10, p=0.9),
                         row("4", T + 200 * HOUR, 10, p=0.9)])
    a = spark.createDataFrame([("A", "C00001", "2", T + 40 * HOUR, T + 100 * HOUR)],
                              "case_id string, customer_id string, flagged_txn_id string, flag_us bigint, opened_us bigint")
    assert {r.TransactionID for r in episodes.reconstruct(a, led).collect()} == {"1", "2", "3"}


def test_closing_at_the_same_instant_does_not_count(spark):
    led = ledger(spark, [row("1", T, 10), row("2", T + HOUR, 10), row("3", T + HOUR + 1, 10)])
    labels = spark.createDataFrame([("C00001-K1", T + HOUR)], "card_id string, closed_us bigint")
    got = {r.TransactionID: r.known for r in asof.known_before(led, labels, "card_id", "known").collect()}
    assert got == {"1": 0, "2": 0, "3": 1}


def test_velocity_is_left_open_and_ties_follow_the_id(spark):
    led = ledger(spark, [row("1", T, 1), row("2", T + HOUR, 1), row("3", T + HOUR, 1)])
    none = spark.createDataFrame([], "case_id string, customer_id string, opened_us bigint, closed_us bigint, outcome string, pattern string")
    members = spark.createDataFrame([], "case_id string, TransactionID string")
    got = {r.TransactionID: (r.vel1h, r.n_prev_customer_id, r.small1h) for r in features.build_features(led, none, members).collect()}
    assert got == {"1": (0, 0, 1), "2": (0, 1, 1), "3": (1, 2, 2)}


def test_device_keys(spark):
    df = spark.createDataFrame([(None, " ", None, ""), ("Windows", None, "chrome 62.0", None), ("SM-G950U", "Android 8.0", "chrome", "2220x1080")],
                               "a string, b string, c string, d string")
    k = C.device_key(*[F.col(x) for x in "abcd"])
    got = [(r.k, r.s) for r in df.select(k.alias("k")).withColumn("s", C.is_specific_device(F.col("k"))).collect()]
    assert got == [(None, False), ("Windows|UNK|chrome 62.0|UNK", False), ("SM-G950U|Android 8.0|chrome|2220x1080", True)]
    assert C is not None and DEVICE


def test_monthly_charge(spark):
    rows = [row(i, T - (3 - i) * 30 * DAY, 20.0 + 0.1 * i) for i in range(4)]
    led = ledger(spark, rows).withColumn("uid", F.col("card_id"))
    f = led.filter(F.col("TransactionID") == "3").select(F.lit("A").alias("case_id"), "uid", "ProductCD", "TransactionAmt", F.col("us").alias("flag_us"))
    probe = asof.baseline(f, params=DEFAULT)
    r = bursts.recurring(probe, led).first()
    assert (r.n_prior, r.n_monthly) == (3, 3)
    assert hours(1) == HOUR
