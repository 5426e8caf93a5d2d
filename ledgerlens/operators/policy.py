"""The bank's fraud policy as one declarative rule table.

A rule adds or vetoes an action under a condition. An action is taken when one of its add rules holds
and none of its veto rules does; its reason is the distinct texts of the add rules that hold, in table
order. All of it is a single projection, so any number of cases is decided without a shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money
from ..params import DEFAULT, Params

# Actions in the order they are reported, and their approval routes.
ACTIONS = ["DECLINE_TRANSACTION", "BLOCK_CARD", "BLOCK_ALL_CARDS", "STEP_UP_AUTH", "VERIFY_WITH_CUSTOMER",
           "MONITOR_CARD", "CREATE_CASE", "FILE_REPORT", "MONITOR_CONNECTED_CARDS", "ESCALATE_TO_ANALYST",
           "WARN_CUSTOMER", "GENERATE_REPORT", "ALLOW_TRANSACTION", "CLOSE_NO_FRAUD"]
FIRST_LINE = ["DECLINE_TRANSACTION"]
SECOND_LINE = ["BLOCK_ALL_CARDS", "FILE_REPORT"]

# The case state a decision needs, with the value used when a column is absent.
STATE = {"p": None, "verdict": None, "exposure": None, "pattern": "none", "n_signals": 0, "trigger": "risk_score",
         "response": None, "evidence_requested": False, "request_type": "", "shared_origin": "", "connected_cards": 0,
         "cross_customer": False, "card_testing_cleared_max": 0.0, "recurring_match": False, "conflicting": False,
         "cards_confirmed_fraud": 0, "credentials_compromised": False}


@dataclass
class Rule:
    action: str
    when: Column
    reason: Column | None = None     # None marks a veto


def route(action: Column, exposure: Column, params: Params = DEFAULT) -> Column:
    return (F.when(action.isin(SECOND_LINE), "L2").when(action.isin(FIRST_LINE), "L1")
            .when(action == "BLOCK_CARD", F.when(exposure <= params.block_l1_max, "L1").otherwise("L2"))
            .when(action.isin(ACTIONS), "auto"))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _limit(x: float) -> str:
    return f"${x:,.0f}"


def _facts(c, params: Params) -> dict[str, Column]:
    """Named conditions shared by several rules; ``response`` is compared null-safely."""
    f = {}
    answered = lambda v: c["response"].eqNullSafe(F.lit(v))
    f["confirmed"], f["denied"], f["silent"] = answered("confirmed"), answered("denied"), answered("no_reply")
    f["open"] = c["response"].isNull()
    f["strong"] = (c["verdict"] == "fraud") | ((c["p"] >= params.p_verify_below) & (c["verdict"] != "legitimate"))
    f["weak"] = (c["n_signals"] <= 1) & (c["p"] < params.p_verify_below)
    f["testing"] = (c["pattern"] == "card_testing")
    f["linked"] = (c["shared_origin"] != "") & (c["connected_cards"] > 0)
    f["coordinated"] = (c["pattern"] == "undocumented") & c["cross_customer"]
    f["report"] = c["trigger"] == "customer_report"
    f["known_charge"] = c["recurring_match"] & f["report"] & f["open"]
    undecided = f["open"] & ~c["recurring_match"]
    f["ask_first"] = undecided & f["weak"] & (c["p"] >= params.stop_low)
    f["block_now"] = (undecided & ~f["ask_first"] & (c["verdict"] == "fraud") & (c["p"] >= params.p_verify_below)
                      & ~f["testing"])
    f["ask_middle"] = (undecided & ~f["ask_first"] & ~f["block_now"] & (c["verdict"] != "legitimate")
                       & (c["p"] > params.stop_low) & (c["p"] < params.stop_high) & ~f["testing"])
    f["passcode"] = undecided & c["evidence_requested"] & (c["request_type"] == "step_up_auth")
    f["ask_requested"] = (undecided & c["evidence_requested"] & (c["request_type"] == "customer_validation")
                          & ~(f["ask_first"] | f["ask_middle"]))
    f["verifies"] = f["known_charge"] | f["ask_first"] | f["ask_middle"] | f["ask_requested"]
    f["steps_up"] = (f["testing"] & ~f["confirmed"]) | f["passcode"]
    f["costly"] = c["exposure"] > params.sar_exposure
    grounds = f["costly"] | f["linked"] | c["cross_customer"]
    f["file"] = f["strong"] & ~f["confirmed"] & (c["verdict"] != "legitimate") & grounds
    f["exposed"] = c["exposure"] > params.escalate_exposure
    return f


def _texts(c, f, params: Params) -> dict[str, Column]:
    """Wording shared by reasons."""
    amount, p = money(c["exposure"]), F.format_string("%.2f", c["p"])
    side = F.when(c["exposure"] <= params.block_l1_max, "<=").otherwise(">")
    over = _say("exposure ", amount, " exceeds ", _limit(params.sar_exposure))
    grounds = F.concat_ws("; ",
                          F.when(f["costly"], over),
                          F.when(f["linked"], _say("activity connects to a shared ", c["shared_origin"])),
                          F.when(c["cross_customer"], "activity connects to another customer's fraud"),
                          F.when(f["coordinated"], "coordinated undocumented pattern (R9)"))
    denied = F.concat_ws("; ",
                         F.when(f["costly"], over),
                         F.when(c["shared_origin"] != "", _say("connects to shared ", c["shared_origin"])),
                         F.when(c["cross_customer"], "connects to another card's fraud"))
    how = F.when(c["verdict"] == "fraud", "confirmed").otherwise("strongly suspected")
    return {"amount": amount, "p": p, "side": side, "grounds": grounds, "denied": denied, "how": how}


def rules(c, params: Params = DEFAULT) -> tuple[list[Rule], dict, dict]:
    f = _facts(c, params)
    t = _texts(c, f, params)
    p, amount, live = t["p"], t["amount"], ~f["confirmed"]
    block = _limit(params.block_l1_max)
    ring = f["linked"] & f["strong"] & live
    spread = f["coordinated"] & f["strong"] & live
    doubt = (c["verdict"] == "uncertain") & (f["exposed"] | c["conflicting"]) & live
    table = [
        # The customer confirms
        Rule("CLOSE_NO_FRAUD", f["confirmed"], _say("R3: customer confirmed the transaction; confirmation noted in the case file")),
        Rule("CREATE_CASE", f["confirmed"] & (c["evidence_requested"] | f["report"]),
             _say("3a: case opened when evidence was requested; closed as legitimate under R3")),
        Rule("WARN_CUSTOMER", f["confirmed"] & c["recurring_match"],
             _say("R7: recurring-charge reminder so the customer recognises it next month")),
        # R2: the customer denies
        Rule("BLOCK_CARD", f["denied"], _say("R2: customer denied the transaction; exposure ", amount, " ", t["side"], " ", block)),
        Rule("CREATE_CASE", f["denied"], _say("R2: customer denied the transaction")),
        Rule("FILE_REPORT", f["denied"] & (t["denied"] != ""), _say("R2: ", t["denied"])),
        # No reply
        Rule("MONITOR_CARD", f["silent"], _say("R4: no reply within 24 hours; monitoring raised for 72 hours")),
        Rule("DECLINE_TRANSACTION", f["silent"], _say("R4: decline pending authorizations while the customer is unreachable")),
        Rule("CREATE_CASE", f["silent"], _say("3a: evidence was requested, so a case is open")),
        Rule("ESCALATE_TO_ANALYST", f["silent"] & f["exposed"],
             _say("R4: no reply and exposure ", amount, " exceeds ", _limit(params.escalate_exposure))),
        # Card testing
        Rule("DECLINE_TRANSACTION", f["testing"] & live,
             _say("R5: three or more small online authorizations within an hour, then a larger purchase")),
        Rule("STEP_UP_AUTH", f["testing"] & live, _say("R5: require a one-time passcode before further activity")),
        Rule("BLOCK_CARD", f["testing"] & live & (c["card_testing_cleared_max"] > params.testing_cleared),
             _say("R5: a purchase of ", money(c["card_testing_cleared_max"]), " (> ", _limit(params.testing_cleared),
                  ") has already cleared")),
        Rule("CREATE_CASE", f["testing"] & live, _say("R5 / 3a: card-testing case")),
        # Shared origin
        Rule("CREATE_CASE", ring, _say("R6: several cards show fraud from the same ", c["shared_origin"])),
        Rule("FILE_REPORT", ring, _say("R6: shared origin named: ", c["shared_origin"])),
        Rule("MONITOR_CONNECTED_CARDS", ring, _say("R6: monitor the ", c["connected_cards"].cast("string"),
                                                   " other card(s) sharing the ", c["shared_origin"])),
        # Coordinated, undocumented
        Rule("CREATE_CASE", spread, _say("R9: coordinated abuse outside the five documented patterns")),
        Rule("FILE_REPORT", spread, _say("R9: undocumented pattern repeated across customers")),
        Rule("ESCALATE_TO_ANALYST", spread, _say("R9: undocumented pattern handed to an analyst with the evidence")),
        # Disputed but recurring
        Rule("CREATE_CASE", f["known_charge"], _say("R7: disputed charge matches the customer's own monthly recurring charge")),
        Rule("VERIFY_WITH_CUSTOMER", f["known_charge"], _say("R7: confirm the recurring merchant with the customer")),
        Rule("WARN_CUSTOMER", f["known_charge"], _say("R7: recurring-charge reminder")),
        Rule("BLOCK_CARD", f["known_charge"]), Rule("DECLINE_TRANSACTION", f["known_charge"]),
        # Strength of the evidence
        Rule("VERIFY_WITH_CUSTOMER", f["ask_first"],
             _say("R1: probability ", p, " rests on a single signal; verify before any block")),
        Rule("BLOCK_CARD", f["ask_first"]), Rule("DECLINE_TRANSACTION", f["ask_first"]),
        Rule("BLOCK_CARD", f["block_now"], _say("R1 satisfied (p=", p, " on ", c["n_signals"].cast("string"),
                                                " independent signals) and 3b: exposure ", amount, " ", t["side"], " ", block)),
        Rule("CREATE_CASE", f["block_now"], _say("3a: fraud probability ", p, " reaches 0.30")),
        Rule("VERIFY_WITH_CUSTOMER", f["ask_middle"],
             _say("6: probability ", p, " is between 0.15 and 0.85; ask the customer")),
        Rule("STEP_UP_AUTH", f["passcode"], _say("6/R1: probability ", p, " is not yet decisive; confirm the cardholder by "
                                                 "one-time passcode")),
        Rule("VERIFY_WITH_CUSTOMER", f["ask_requested"],
             _say("6: probability ", p, " is below 0.85; one customer answer settles it")),
        # uncertain
        Rule("ESCALATE_TO_ANALYST", doubt, _say("R8: verdict uncertain and ", F.when(
            f["exposed"], _say("exposure ", amount, " exceeds ", _limit(params.escalate_exposure))).otherwise("the evidence conflicts"))),
        # 3a: case and report
        Rule("CREATE_CASE", live & (c["p"] >= params.p_open_case), _say("3a: fraud probability ", p, " reaches 0.30")),
        Rule("CREATE_CASE", live & (c["evidence_requested"] | f["verifies"] | f["steps_up"]), _say("3a: evidence requested")),
        Rule("CREATE_CASE", live & f["report"], _say("3a: the customer disputes a charge")),
        Rule("FILE_REPORT", f["file"], _say("3a: fraud ", t["how"], " and ", t["grounds"])),
        Rule("CREATE_CASE", f["file"], _say("3a: a report always has a case behind it")),
        Rule("FILE_REPORT", ~f["file"]),
        # R10
        Rule("BLOCK_ALL_CARDS", ~((c["cards_confirmed_fraud"] >= 2) | c["credentials_compromised"])),
    ]
    return table, f, t


def decide(cases: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Add ``actions`` (ordered array of action, route, reason), ``file_sar`` and ``sar_reason``."""
    absent = {n: F.lit(v) if v is not None else F.lit(None).cast("string") for n, v in STATE.items() if n not in cases.columns}
    c = {n: absent.get(n, F.col(n)) for n in STATE}
    table, f, t = rules(c, params)
    present, reasons = {}, {}
    for a in ACTIONS:
        adds = [r for r in table if r.action == a and r.reason is not None]
        vetoes = [r for r in table if r.action == a and r.reason is None]
        any_add, any_veto = F.lit(False), F.lit(False)
        for r in adds:
            any_add = any_add | r.when
        for r in vetoes:
            any_veto = any_veto | r.when
        present[a] = any_add & ~any_veto
        texts = [F.when(r.when, r.reason) for r in adds]
        reasons[a] = F.array_join(F.array_distinct(F.array_compact(F.array(*texts))), "; ") if texts else F.lit("")
    nothing = F.lit(True)
    for a in ACTIONS:
        nothing = nothing & ~present[a]
    calm = (c["verdict"] == "legitimate") & (c["p"] <= params.stop_low)
    fallback = {
        "CLOSE_NO_FRAUD": (nothing & calm, _say("6/3a: probability ", t["p"], " at or below 0.15 on independent evidence; "
                                                "close as legitimate")),
        "ALLOW_TRANSACTION": (nothing & calm, _say("Policy 1: legitimate activity stands")),
        "MONITOR_CARD": (nothing & ~calm, _say("Policy 1: probability ", t["p"], "; raise monitoring for 72 hours"))}
    entries = []
    for a in ACTIONS:
        extra, text = fallback.get(a, (F.lit(False), F.lit("")))
        entries.append(F.when(present[a] | extra, F.struct(
            F.lit(a).alias("action"), route(F.lit(a), c["exposure"], params).alias("route"),
            F.when(present[a], reasons[a]).otherwise(text).alias("reason"))))
    cited = F.concat(F.lit("3a"), F.when(f["denied"], "/R2").otherwise(""), F.when(f["linked"], "/R6").otherwise(""),
                     F.when(f["coordinated"], "/R9").otherwise(""), F.lit(": fraud "), t["how"], F.lit(" and "), t["grounds"])
    sar = (F.when(f["file"], cited)
           .when((c["verdict"] == "legitimate") | f["confirmed"], "3a: no report — the activity was assessed as legitimate")
           .when(~f["strong"], _say("3a: no report — fraud is neither confirmed nor strongly suspected (p=", t["p"], ")"))
           .otherwise(_say("3a: no report — exposure ", t["amount"], " is at most ", _limit(params.sar_exposure),
                           " and there is no shared device, region cluster, other customer's fraud, or coordinated "
                           "pattern; case only")))
    return cases.withColumns({"actions": F.array_compact(F.array(*entries)), "file_sar": f["file"], "sar_reason": sar})


def action_names(actions: Column) -> Column:
    return F.transform(actions, lambda a: a["action"])


def takes(actions: Column, name: str) -> Column:
    return F.exists(actions, lambda a: a["action"] == name)


def changes(initial: Column, final: Column) -> Column:
    """Text of the actions added and removed, or ``nothing``."""
    added = F.array_sort(F.array_except(action_names(final), action_names(initial)))
    removed = F.array_sort(F.array_except(action_names(initial), action_names(final)))
    text = F.concat_ws("; ",
                       F.when(F.size(added) > 0, F.concat(F.lit("Added: "), F.array_join(added, ", "))),
                       F.when(F.size(removed) > 0, F.concat(F.lit("Removed: "), F.array_join(removed, ", "))))
    return F.when(text == "", "nothing").otherwise(text)
