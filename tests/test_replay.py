"""Chains of rows over slices, and the replay of closed cases."""
import random

from ledgerlens.operators import metrics, skew
from ledgerlens.params import DAY, HOUR, Params


def test_chains_over_slices(spark):
    rng = random.Random(3)
    rows = [(k, str(i), rng.choice([None, *[rng.randrange(40 * DAY) for _ in range(20)], 5 * DAY, 6 * DAY - 1]))
            for i, k in enumerate(rng.choices(["a", "a", "b", None], k=300))]
    want = {}
    for key in ("a", "b", None):
        last, n = None, 0
        for k, i, us in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            n += not (us is not None and last is not None and us - last <= 30 * HOUR)
            want[i], last = n, us
    df = spark.createDataFrame(rows, "customer_id string, TransactionID string, us long")
    got = skew.islands(df, ["customer_id"], 30 * HOUR)
    assert got.columns == [*df.columns, "island"]
    assert {r.TransactionID: r.island for r in got.collect()} == want


def test_replay_chains_rows_once(spark):
    p = Params(thresholds=(0.2, 0.5))
    rows = [("c", "t1", 0, 5.0, .6), ("c", "t2", 20 * HOUR, 7.0, .3), ("c", "t3", 60 * HOUR, 9.0, .9), ("c", "t4", 200 * HOUR, 1.0, .9)]
    ledger = spark.createDataFrame([(*r, "k", r[4]) for r in rows], "customer_id string, TransactionID string, us long, TransactionAmt double, p_txn double, card_id string, risk_score double")
    closed = spark.createDataFrame([("x", "c", 100 * HOUR, "cleared", "none", 12.0, "No")], "case_id string, customer_id string, opened_us long, outcome string, pattern string, exposure_usd double, report_filed string")
    members = spark.createDataFrame([("x", "t1"), ("x", "t2")], "case_id string, TransactionID string")
    got = metrics.replay(closed, members, ledger, p)
    assert {(r.threshold, r.n, r.exposure, round(r.jaccard, 4)) for r in got.collect()} == {(0.2, 3, 21.0, round(2 / 3, 4)), (0.5, 1, 5.0, 0.5)}
    # the chains and episodes both figures need are made once
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
