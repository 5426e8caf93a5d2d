"""Graph links: the first ones of each outcome, without rows of all pairs that share a device."""
import random

from ledgerlens.operators import memory


def linked(spark, rng, n_alerts=60, n_closed=80, n_devices=3):
    customers = [f"u{i}" for i in range(12)]
    closed = [(f"CC-{i:03d}", rng.choice(customers)) for i in range(n_closed)]
    rng.shuffle(closed)
    index = [(c, u, f"{u}-K{rng.randint(1, 2)}", rng.randint(0, 40), rng.choice(("confirmed_fraud", "cleared")), "none") for c, u in closed]
    index += [(*index[0][:3], 17, "cleared", "none"), (*index[1][:3], None, "cleared", "none")]
    keys = [(c, "uid", f"uid{u}{rng.randint(0, 2)}") for c, u in closed]
    keys += [(c, "device", f"d{rng.randrange(n_devices)}") for c, _ in closed for _ in range(2)]
    alerts = [(f"AL-{i}", rng.choice(customers), rng.randint(0, 45)) for i in range(n_alerts)]
    alerts += [(alerts[0][0], alerts[0][1], 3), ("AL-null", "u1", None)]
    uids = [(a, f"uid{u}{rng.randint(0, 2)}") for a, u, _ in alerts]
    cards = [(a, f"{u}-K{k}") for a, u, _ in alerts for k in (1, 2) if rng.random() < 0.6]
    devices = [(a, f"d{rng.randrange(n_devices + 1)}") for a, _, _ in alerts for _ in range(2)] + [("AL-1", None)]
    make = spark.createDataFrame
    return (make(alerts, "case_id string, customer_id string, as_of long"), make(uids, "case_id string, uid string"),
            make(cards, "case_id string, card_id string"), make(devices, "case_id string, device_profile_id string"),
            make(index, "case_id string, customer_id string, card_id string, closed_us long, outcome string, pattern string"),
            make(keys, "case_id string, kind string, value string"))


def test_first_links_of_each_outcome_are_those_of_all(spark):
    x = linked(spark, random.Random(3))
    every, most = memory.graph_links(*x).collect(), 3
    want, places = [], {}
    for r in sorted(every, key=lambda r: (r.case_id, r.outcome, r.link_rank, r.closed_case)):
        seen = places.setdefault((r.case_id, r.outcome), [])
        if (r.link_rank, r.closed_case) not in seen:
            seen.append((r.link_rank, r.closed_case))
        if len(seen) <= most:
            want.append(r)
    got = memory.graph_links(*x, most=most).collect()
    assert sorted(got) == sorted(want) and len(want) < len(every)


def test_a_busy_device_brings_few_rows(spark):
    n = 200
    make = spark.createDataFrame
    asked = make([(f"AL-{i}", "d", i, [i]) for i in range(n)], "case_id string, device_profile_id string, until long, as_of array<long>")
    uses = make([(f"CC-{(i * 37) % n:03d}", "d", i, [(i, "cleared", "none")]) for i in range(n)],
                "closed_case string, device_profile_id string, since long, closed array<struct<closed_us:long,outcome:string,pattern:string>>")
    none = make([], "case_id string, closed_case string")
    got = memory.first_on_device(asked, uses, none, 3).collect()
    want = {(f"AL-{t}", c) for t in range(n) for c in sorted(f"CC-{(i * 37) % n:03d}" for i in range(t))[:3]}
    assert {(r.case_id, r.closed_case) for r in got} == want and len(got) == len(want)
