"""The list of earlier fraud cases of each alert."""
from types import SimpleNamespace

from pyspark.sql import functions as F

from ledgerlens.plans import investigate as I


def test_all_earlier_cases_are_listed(spark, monkeypatch):
    rows = [(f"c{i}", f"u{i // 3}", 100 - i // 2, [f"k{i}"], f"k{i}", "fraud" if i != 4 else "legitimate") for i in range(9)]
    c = spark.createDataFrame(rows, "case_id string, customer_id string, opened_us long, own_cards array<string>, card_id string, judged string")
    devices = c.select("case_id", F.lit("SM-1|Android|Chrome|1x1").alias("device_profile_id"))
    seen = []

    def decide(c, x):
        seen.append(c)
        return c.withColumns({"verdict": F.col("judged"), "memory_cards": F.col("own_cards")})

    monkeypatch.setattr(I, "decide_level", decide)
    monkeypatch.setattr(I, "is_specific_device", lambda d: d.isNotNull())
    got = {r.case_id: r for r in I.run_rounds(SimpleNamespace(), c, {"devices": devices}).collect()}
    at = {r[0]: (r[2], r[0]) for r in rows}
    for case, row in got.items():
        want = sorted(r[0] for r in rows if r[5] == "fraud" and at[r[0]] < at[case])
        assert list(row.earlier) == want and row.n_earlier == len(want) and row.f_earlier == bool(want)
    assert max(r.n_earlier for r in got.values()) > 2
