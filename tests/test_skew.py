"""Totals over time slices must give exactly what plain windows give."""
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helpers import DEVICE, hours, ledger, row
from ledgerlens.operators import bursts, features, skew
from ledgerlens.operators.contract import CARD_ID
from ledgerlens.params import DAY, HOUR, TESTBED
from ledgerlens.session import new_folder
from ledgerlens.sources.testbed import Bank


def busy(spark, n=300):
    rnd = random.Random(5)
    rows, t = [], 1_700_000_000_000_000
    for i in range(n):
        t += rnd.choice([0, 60_000_000, hours(0.3), hours(1), hours(5), hours(60)])
        who = rnd.choice(["C00001", "C00001", "C00001", "C00002"])
        rows.append(row(i, t, rnd.choice([1.0, 3.0, 30.0, 43.0 + i % 7, 90.0]), who, f"{who}-K{rnd.choice([1, 2])}", p=rnd.random(),
                        addr=rnd.choice(["1", "2", None]), device=rnd.choice([None, DEVICE, "Windows|UNK|chrome|UNK"]), D1=float(i % 3)))
    return ledger(spark, rows)


def same(a, b):
    cols = sorted(a.columns)
    pick = lambda d: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in d.select(*cols).collect())
    return pick(a) == pick(b)


def test_running_and_trailing(spark):
    df = busy(spark).select("customer_id", "addr1", "TransactionID", "us", "TransactionAmt").persist()
    totals = {"n": ("count", F.lit(1)), "s": ("sum", F.col("TransactionAmt")), "last": ("max", F.col("us")), "low": ("min", F.col("TransactionAmt"))}
    for key in ("customer_id", "addr1"):      # addresses are null at times
        w = W.partitionBy(key).orderBy("us", "TransactionID").rowsBetween(W.unboundedPreceding, -1)
        plain = df.withColumns({"n": F.count(F.lit(1)).over(w), "s": F.coalesce(F.sum("TransactionAmt").over(w), F.lit(0.0)),
                                "last": F.max("us").over(w), "low": F.min("TransactionAmt").over(w)})
        assert same(plain, skew.running_totals(df, [key], ["us", "TransactionID"], totals))
    back = lambda v, width: F.sum(v).over(W.partitionBy("customer_id").orderBy("us").rangeBetween(-width + 1, 0))
    ties = lambda v: F.sum(v).over(W.partitionBy("customer_id", "us").orderBy("TransactionID").rowsBetween(1, W.unboundedFollowing))
    plain = df.withColumns({"a": back(F.lit(1), HOUR) - F.coalesce(ties(F.lit(1)), F.lit(0)),
                            "b": back(F.col("TransactionAmt"), DAY) - F.coalesce(ties(F.col("TransactionAmt")), F.lit(0.0))})
    assert same(plain, skew.trailing_totals(df, ["customer_id"], "TransactionID", "us", {"a": (HOUR, F.lit(1)), "b": (DAY, F.col("TransactionAmt"))}))


def test_islands_and_bursts(spark):
    df = busy(spark).persist()
    keyed = df.select("customer_id", "TransactionID", "us")
    w = W.partitionBy("customer_id").orderBy("us", "TransactionID")
    gap = F.col("us") - F.lag("us").over(w)
    plain = keyed.withColumn("new", F.when(gap <= 48 * HOUR, 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).drop("new")
    assert same(plain, skew.islands(keyed, ["customer_id"], 48 * HOUR))
    small = df.filter((F.col("TransactionAmt") < 5) & (F.col("channel") == "online"))
    upto = W.partitionBy("card_id").orderBy("us").rangeBetween(W.unboundedPreceding, HOUR)
    before = W.partitionBy("card_id").orderBy("us", "TransactionID").rowsBetween(W.unboundedPreceding, -1)
    plain = small.select("card_id", "us", "TransactionID", (F.count(F.lit(1)).over(upto) - F.count(F.lit(1)).over(before)).alias("n"),
                         F.max("us").over(upto).alias("last_us"))
    assert same(plain, bursts.burst_starts(small, ["card_id"], HOUR))
    for fn in (bursts.card_testing, bursts.structuring):
        assert fn(df, ["card_id"], TESTBED).count() > 0


def test_long_ids_stay_apart(spark):
    events = spark.createDataFrame([(i, 123456 + i % 2, "view", 1.0 + i, '{"k": %d}' % i) for i in range(40)],
                                   "event_id long, user_id long, event_type string, value double, props string")
    folder = new_folder(spark)
    events.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, event_id)")).write.parquet(f"{folder}/events.parquet")
    assert {r.customer_id for r in Bank(spark, folder).ledger.select("customer_id").collect()} == {"C123456", "C123457"}
    ids = spark.createDataFrame([("C123456-K12",), ("C00001-K1",), ("C1-K1",)], "c string")
    assert [r.ok for r in ids.select(F.col("c").rlike(CARD_ID).alias("ok")).collect()] == [True, True, False]


def test_features(spark):
    df = busy(spark).persist()
    closed = spark.createDataFrame([("CC-1", "C00001", 1_700_000_000_000_000 + hours(30), 1_700_000_000_000_000 + hours(40), "confirmed_fraud", "card_testing")],
                                   "case_id string, customer_id string, opened_us bigint, closed_us bigint, outcome string, pattern string")
    members = df.limit(0).select(F.lit("CC-1").alias("case_id"), "TransactionID").unionByName(
        spark.createDataFrame([("CC-1", str(i)) for i in range(5)], "case_id string, TransactionID string"))
    all_rows = features.build_features(df, closed, members).persist()
    # nothing a row's features use lies after it
    cut = 1_700_000_000_000_000 + hours(200)
    early = features.build_features(df.filter(F.col("us") < cut), closed, members)
    assert same(all_rows.filter(F.col("us") < cut), early)


def test_window_pieces_equals_rows(spark):
    df = busy(spark).persist()
    probes = df.select(F.col("TransactionID").alias("case_id"), "customer_id", (F.col("us") - 5 * DAY).alias("start_us"), F.col("us").alias("end_us"))
    pieces = skew.window_pieces(probes, df.drop("case_id"), ["customer_id"], "start_us", "end_us", ["addr1"], {"n": F.lit(1)})
    rows = skew.band_join(probes, df.select("customer_id", "us", "addr1"), ["customer_id"], "start_us", "end_us")
    a = pieces.groupBy("case_id", "addr1").agg(F.sum("n").alias("n"))
    b = rows.groupBy("case_id", "addr1").agg(F.count(F.lit(1)).alias("n"))
    assert a.count() > 100 and same(a, b)


def test_window_pieces_of_an_endless_span(spark):
    # a probe goes to the buckets its key has rows in, not to every day of its span
    df = busy(spark).persist()
    probes = df.select("customer_id").distinct().select(F.col("customer_id").alias("case_id"), "customer_id",
                                                        F.lit(-9 * 10**18).alias("start_us"), F.lit(9 * 10**18).alias("end_us"))
    pieces = skew.window_pieces(probes, df, ["customer_id"], "start_us", "end_us", ["addr1"], {"n": F.lit(1)})
    a = pieces.groupBy("case_id", "addr1").agg(F.sum("n").alias("n"))
    assert same(a, df.groupBy(F.col("customer_id").alias("case_id"), "addr1").agg(F.count(F.lit(1)).alias("n")))
