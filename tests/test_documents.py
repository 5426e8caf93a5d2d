import json

from ledgerlens.operators import contract as K
from ledgerlens.sources import schema as S


def document(**kw):
    act = [{"action": "CLOSE_NO_FRAUD", "route": "auto", "reason": "R3: fine"}]
    case = dict(status="closed_legitimate", verdict="legitimate", fraud_probability=0.1, pattern="none", pattern_description="", affected_txn_ids=[],
                first_suspicious_txn_id="", connected_card_ids=[], connected_device_profiles=[], exposure_usd=0.0,
                evidence=[dict(claim="c", source="graph", ref="r", entity_ids=["1"])], similar_prior_cases=["CC-1"], summary="Fine.",
                written_to_graph=False, graph_case_id="")
    doc = dict(case_id="AL-1", case=case, evidence_requests=[], next_best_actions=dict(initial=act, final=act, what_changed="nothing"),
               sar=dict(file=False, reason="3a: no report", narrative="", subjects=[], total_amount_usd=0.0, activity_dates=[]),
               stop_reason="s", tool_calls=1, tokens=0, latency_s=0.1)
    for k, v in kw.items():
        part, _, field = k.partition("__")
        if field:
            doc[part] = dict(doc[part], **{field: v})
        else:
            doc[part] = v
    return doc


def rules(spark, tmp_path, doc, **tables):
    f = tmp_path / "d.json"
    f.write_text(json.dumps(doc))
    return {r.rule for r in K.violations(spark.read.schema(S.ANSWER).json(str(f)), **tables).collect()}


def test_clean_document(spark, tmp_path):
    assert rules(spark, tmp_path, document()) == set()


def test_broken_documents(spark, tmp_path):
    cases = {
        "bad status": document(case__status="done"),
        "legitimate needs pattern none": document(case__pattern="card_testing"),
        "legitimate with p above half": document(case__fraud_probability=0.9),
        "duplicate prior case": document(case__similar_prior_cases=["CC-1", "CC-1"]),
        "bad connected card id": document(case__connected_card_ids=["C1-K1"]),
        "bad device profile": document(case__connected_device_profiles=["plain"]),
        "graph id without write": document(case__graph_case_id="G"),
        "report fields must be empty": document(sar__narrative="text"),
        "missing case.summary": document(case__summary=None),
        "final: wrong route": document(next_best_actions__final=[{"action": "CLOSE_NO_FRAUD", "route": "L2", "reason": "R3"}]),
        "final: reason cites no rule": document(next_best_actions__final=[{"action": "CLOSE_NO_FRAUD", "route": "auto", "reason": "because"}]),
        "no request but something changed": document(next_best_actions__what_changed="Added"),
    }
    f = tmp_path / "all.json"
    f.write_text("\n".join(json.dumps(dict(doc, case_id=rule)) for rule, doc in cases.items()))
    found = {(r.case_id, r.rule) for r in K.violations(spark.read.schema(S.ANSWER).json(str(f))).collect()}
    assert not [rule for rule in cases if (rule, rule) not in found]


def test_table_backed_rules(spark, tmp_path):
    ledger = spark.createDataFrame([("1", "C00001", "C00001-K1", 5, 10.0), ("2", "C00001", "C00001-K1", 6, 20.0)],
                                   "TransactionID string, customer_id string, card_id string, us bigint, TransactionAmt double")
    closed = spark.createDataFrame([("CC-9",)], "case_id string")
    alerts = spark.createDataFrame([("AL-1", "2", "C00001-K1")], "case_id string, flagged_txn_id string, card_id string")
    doc = document(case__verdict="fraud", case__status="closed_fraud", case__fraud_probability=0.9, case__pattern="card_testing", case__affected_txn_ids=["1", "7"],
                   case__first_suspicious_txn_id="7", case__exposure_usd=30.0, case__connected_card_ids=["C00001-K1"])
    got = rules(spark, tmp_path, doc, ledger=ledger, closed=closed, alerts=alerts)
    assert {"unknown transaction", "unknown prior case", "exposure is not the sum", "first row is not the earliest", "flagged row not affected",
            "own card listed as connected"} <= got


def test_registry_is_consistent():
    import __spark_entry__ as e
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
