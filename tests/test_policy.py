import pytest

from ledgerlens.operators import policy as P

BASE = dict(p=0.5, verdict="uncertain", exposure=100.0, pattern="none", n_signals=0, trigger="risk_score", response=None,
            evidence_requested=False, request_type="", shared_origin="", connected_cards=0, cross_customer=False,
            card_testing_cleared_max=0.0, recurring_match=False, conflicting=False)
SCHEMA = ("name string, p double, verdict string, exposure double, pattern string, n_signals int, trigger string, response string, "
          "evidence_requested boolean, request_type string, shared_origin string, connected_cards int, cross_customer boolean, "
          "card_testing_cleared_max double, recurring_match boolean, conflicting boolean")
FRAUD = dict(p=0.9, verdict="fraud", n_signals=3)
ROWS = {
    "weak": (dict(p=0.6, n_signals=1), ["VERIFY_WITH_CUSTOMER"], ["BLOCK_CARD", "DECLINE_TRANSACTION"]),
    "strong": (dict(FRAUD, exposure=400.0), ["BLOCK_CARD", "CREATE_CASE"], ["FILE_REPORT"]),
    "denied": (dict(FRAUD, response="denied", exposure=1200.0), ["BLOCK_CARD", "CREATE_CASE", "FILE_REPORT"], []),
    "denied_small": (dict(FRAUD, response="denied", exposure=200.0), [], ["FILE_REPORT"]),
    "confirmed": (dict(p=0.05, verdict="legitimate", response="confirmed", evidence_requested=True), ["CLOSE_NO_FRAUD"],
                  ["BLOCK_CARD", "FILE_REPORT", "DECLINE_TRANSACTION"]),
    "silent": (dict(response="no_reply", exposure=600.0, evidence_requested=True), ["MONITOR_CARD", "DECLINE_TRANSACTION", "ESCALATE_TO_ANALYST"], []),
    "silent_small": (dict(response="no_reply", exposure=400.0, evidence_requested=True), [], ["ESCALATE_TO_ANALYST"]),
    "testing_90": (dict(FRAUD, pattern="card_testing", card_testing_cleared_max=90.0), ["DECLINE_TRANSACTION", "STEP_UP_AUTH"], ["BLOCK_CARD"]),
    "testing_150": (dict(FRAUD, pattern="card_testing", card_testing_cleared_max=150.0), ["BLOCK_CARD"], []),
    "shared": (dict(FRAUD, shared_origin="device X", connected_cards=4), ["CREATE_CASE", "FILE_REPORT", "MONITOR_CONNECTED_CARDS"], []),
    "recurring": (dict(trigger="customer_report", recurring_match=True), ["CREATE_CASE", "VERIFY_WITH_CUSTOMER", "WARN_CUSTOMER"], ["BLOCK_CARD"]),
    "uncertain_800": (dict(exposure=800.0), ["ESCALATE_TO_ANALYST"], []),
    "coordinated": (dict(FRAUD, pattern="undocumented", cross_customer=True), ["CREATE_CASE", "FILE_REPORT", "ESCALATE_TO_ANALYST"], ["BLOCK_ALL_CARDS"]),
    "high_denied": (dict(p=0.99, verdict="fraud", response="denied", exposure=9000.0), [], ["BLOCK_ALL_CARDS"]),
    "at_030": (dict(p=0.30, n_signals=2), ["CREATE_CASE"], []),
    "uncertain_5000": (dict(exposure=5000.0, n_signals=2), [], ["FILE_REPORT"]),
    "calm": (dict(p=0.05, verdict="legitimate"), ["CLOSE_NO_FRAUD", "ALLOW_TRANSACTION"], ["MONITOR_CARD"]),
}


@pytest.fixture(scope="module")
def decisions(spark):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(dict(BASE, name=n, **o)[c] for c in cols) for n, (o, _, _) in ROWS.items()], SCHEMA)
    return {r["name"]: r for r in P.decide(df).collect()}


@pytest.mark.parametrize("name", list(ROWS))
def test_actions(decisions, name):
    _, must, never = ROWS[name]
    got = [a["action"] for a in decisions[name]["actions"]]
    assert not [a for a in must if a not in got]
    assert not [a for a in never if a in got]
    assert got == [a for a in P.ACTIONS if a in got]
    assert decisions[name]["file_sar"] == ("FILE_REPORT" in got)
    assert all(a["reason"] for a in decisions[name]["actions"])


def test_reason_texts(decisions):
    block = {a["action"]: a["reason"] for a in decisions["strong"]["actions"]}
    assert block["BLOCK_CARD"] == "R1 satisfied (p=0.90 on 3 independent signals) and 3b: exposure $400.00 <= $2,500"
    assert block["CREATE_CASE"] == "3a: fraud probability 0.90 reaches 0.30"
    assert decisions["denied"]["sar_reason"] == "3a/R2: fraud confirmed and exposure $1,200.00 exceeds $1,000"


def test_routes(spark):
    df = spark.createDataFrame([(a, e) for a in P.ACTIONS for e in (2500.0, 2500.01)], "a string, e double")
    got = {(r.a, r.e): r.route for r in df.select("a", "e", P.route(df.a, df.e).alias("route")).collect()}
    assert got[("BLOCK_CARD", 2500.0)] == "L1" and got[("BLOCK_CARD", 2500.01)] == "L2"
    assert got[("FILE_REPORT", 2500.0)] == got[("BLOCK_ALL_CARDS", 2500.0)] == "L2" and got[("DECLINE_TRANSACTION", 2500.0)] == "L1"
    assert sum(v == "auto" for (a, e), v in got.items() if e == 2500.0) == 10
