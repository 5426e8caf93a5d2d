"""What steps move: narrow rows, and no rows of pairs."""
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from helpers import ledger, row
from ledgerlens.operators import features, memory, rings, similarity
from ledgerlens.params import DAY, HOUR

T = 1_479_204_000_000_000


def test_histories_move_only_what_they_read(spark, monkeypatch):
    led = ledger(spark, [row(i // 2, T + i // 2 * HOUR, 5 + i // 2, device="d|x|y|z") for i in range(12)]).withColumn("note", F.lit("wide"))
    closed = spark.createDataFrame([], "case_id string, customer_id string, opened_us bigint, closed_us bigint, outcome string, pattern string")
    moved, histories = [], features._histories
    monkeypatch.setattr(features, "_histories", lambda rows: moved.extend(rows.columns) or histories(rows))
    got = features.build_features(led, closed, spark.createDataFrame([], "case_id string, TransactionID string"))
    assert "note" not in moved and "has_device_record" not in moved and "us" in moved
    rows = got.select("TransactionID", "note", "n_prev_customer_id").collect()
    assert len(rows) == 12 and {r.note for r in rows} == {"wide"}      # rows that share an id stay two
    assert sorted(r.n_prev_customer_id for r in rows) == list(range(12))


def test_pairs_on_a_device_are_made_once(spark):
    make, rng = spark.createDataFrame, random.Random(5)
    asked = {(f"AL-{i}", f"d{rng.randrange(3)}", 10 + i % 30) for i in range(40) for _ in range(2)}
    uses = {(f"CC-{i}", f"d{rng.randrange(3)}", i % 35) for i in range(50) for _ in range(2)}
    known = {(f"AL-{rng.randrange(40)}", f"CC-{rng.randrange(50)}") for _ in range(200)}
    got = memory.device_pairs(make(list(asked), "case_id string, device_profile_id string, until long"),
                              make(list(uses), "closed_case string, device_profile_id string, since long"), make(list(known), "case_id string, closed_case string"))
    want = {(a, c) for a, d, until in asked for c, e, since in uses if d == e and since < until} - known
    found = [(r.case_id, r.closed_case) for r in got.select("case_id", "closed_case").collect()]
    assert sorted(found) == sorted(want) and len(want) > 300


def test_cards_of_one_ring_are_not_shuffled(spark):
    rng = random.Random(6)
    uses = [(i, f"C{rng.randrange(9)}", f"d{rng.randrange(3)}", T + rng.randrange(90) * DAY) for i in range(120)]
    led = ledger(spark, [row(i, us, 5, customer=u, device=d) for i, u, d, us in uses for _ in range(1 + i % 2)])
    asked = [(f"AL-{i}", f"d{i % 3}", T + rng.randrange(100) * DAY) for i in range(30)] + [("AL-0", "d1", T + 50 * DAY), (None, "d2", T + 40 * DAY)]
    got = rings.ring_members(spark.createDataFrame(asked, "case_id string, device_profile_id string, as_of long"), led)
    want = {(a, u, f"{u}-K1") for a, d, at in asked for _, u, e, us in uses if d == e and at - 30 * DAY <= us < at}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"     # no aggregate over all pairs


def test_close_pairs_travel_in_few_wide_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SIDE", 10)
    monkeypatch.setattr(similarity, "WIDE", 40)
    rng = np.random.default_rng(3)
    for kind in (np.float32, np.float64):       # the second is not held by single precision
        v = rng.normal(size=(90, 4)).astype(kind).astype(float)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "query_id long, v array<double>")
        points, moved = df.withColumnRenamed("query_id", "point_id"), []
        group = DataFrame.groupBy

        def grouped(self, *cols):
            if cols == ("table", "value", "_q", "_p"):
                moved.append((self.count(), self.schema["v"].dataType.simpleString()))
            return group(self, *cols)

        monkeypatch.setattr(DataFrame, "groupBy", grouped)
        got = similarity.approximate_pairs(df, points, 1.0, bucket=1e6).collect()
        monkeypatch.setattr(DataFrame, "groupBy", group)
        d = np.sqrt(((v[:, None] - v) ** 2).sum(axis=2))
        assert {(r.query_id, r.point_id) for r in got} == {(int(i), int(j)) for i, j in zip(*np.nonzero(d < 1))} and len(got) == (d < 1).sum()
        assert all(abs(r.distance - d[r.query_id, r.point_id]) < 1e-12 for r in got)
        rows, sent = moved[0]
        # each of at most two hash values a table: three blocks of up to 40 at the very most, not nine of 10
        assert rows <= 2 * 4 * 90 * 3 and sent == ("array<float>" if kind is np.float32 else "array<double>")
