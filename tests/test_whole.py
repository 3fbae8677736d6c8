"""Whole jobs: the twins of sampled queries against brute force, and paths that no query reaches."""

import pytest

from dealframe.operators import matching
from dealframe.plans import registry
from dealframe.plans.deals import AUCTIONS
from dealframe.session import table


@pytest.mark.parametrize("most", [500_000, 0])
def test_range_match_on_both_paths(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "BROADCAST_ROWS", most)
    points = [(i, i % 11, i % 7) for i in range(200)]
    boxes = [(b, b % 9, b % 9 + b % 4, b % 5, b % 5 + 2) for b in range(60)]
    d = spark.createDataFrame(points, "k long, x int, y int")
    r = spark.createDataFrame(boxes, "b long, x_min int, x_max int, y_min int, y_max int")
    want = {(k, b) for k, x, y in points for b, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}
    got = [tuple(p) for p in matching.bucket_range_match(d, r, ["x", "y"], "k", "b").collect()]
    assert len(got) == len(want) and set(got) == want
    held = {b: sorted(k for k, c in want if c == b) for b in {b for _, b in want}}
    sums = {tuple(x) for x in matching.bucket_range_summary(d, r, ["x", "y"], "k", "b").collect()}
    assert sums == {(b, len(k), k[0], k[-1]) for b, k in held.items()}


def test_bucket_range_match_whole_reads_all_rows(spark, sf):
    rows = [(r[0] * 10 + r[1], r[2], r[1]) for r in table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").collect()]
    want = {}
    for b, s in table(spark, sf, "part").select("p_partkey", "p_size").collect():
        if k := [k for k, q, n in rows if s <= q <= s + 5 and b % 5 <= n <= b % 5 + 2]:
            want[b] = (len(k), min(k), max(k))
    got = registry.queries()["bucket_range_match"](spark, sf).collect()
    assert {r["bt"]: (r["n"], r["first_k"], r["last_k"]) for r in got} == want
    assert max(want) > 60


EACH = {"seat_rotation": 16, "expected_values": 1, "result_from_score": 1, "best_contract": 1, "explain_text": 1, "lin_round_trip": 1}


@pytest.mark.parametrize("name", EACH)
def test_every_deal_has_its_rows(spark, sf, name):
    deals = {r[0]: EACH[name] for r in table(spark, sf, "orders").select("o_orderkey").collect()}
    got = registry.queries()[f"{name}"](spark, sf).groupBy("index").count().collect()
    assert {r["index"]: r["count"] for r in got} == deals


def test_sequences_hold_every_event(spark, sf):
    seqs = {}
    for r in sorted(table(spark, sf, "events").select("ts", "event_id", "user_id", "event_type").collect()):
        seqs.setdefault(r["user_id"], []).append(r["event_type"])
    want = {s for s in map("-".join, seqs.values()) if s[0] in "cv"}
    got = [r["seq"] for r in registry.queries()["group_by_sequence"](spark, sf).collect()]
    assert len(got) == min(25, len(want)) and set(got) <= want


def test_loosest_bounds_of_all_rows(spark, sf):
    want = {}
    for k, n, p, v in table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey", "l_quantity").collect():
        at = (k, ["HCP", "SL_S", "TP"][n % 3], [">=", "<=", ">", "<"][p % 4])
        want[at] = (min if at[2][0] == ">" else max)(v, want.get(at, v))
    got = {(r["k"], r["name"], r["op"]): r["v"] for r in registry.queries()["dedupe_bounds"](spark, sf).collect()}
    assert got and all(want[at] == v for at, v in got.items())
    new = {}
    for (k, name, op), v in want.items():
        if k % 2:
            new[name, op] = max(v, new.get((name, op), v))
    learned = {(r["name"], r["op"]): r["value"] for r in registry.queries()["rule_merge"](spark, sf).where("learned").collect()}
    assert learned == {at: v for at, v in new.items() if at in learned} and learned


def test_steps_of_all_events(spark, sf):
    seqs, rich = {}, {r[0]: r[1] > 0 for r in table(spark, sf, "customer").select("c_custkey", "c_acctbal").collect()}
    for r in sorted(table(spark, sf, "events").select("ts", "event_id", "user_id", "event_type").collect()):
        seqs.setdefault(r["user_id"], []).append(r["event_type"])
    want, lift = {}, {}
    for u, s in seqs.items():
        for i, t in enumerate(s):
            at = ("-".join(s[:i]), t)
            want[at] = want.get(at, 0) + 1
            if u in rich:
                lift[at] = lift.get(at, 0) + 1
    got = {(r["prefix"], r["next_bid"]): r["n"] for r in registry.queries()["prefix_explode"](spark, sf).collect()}
    assert got == want and max(p.count("-") for p, _ in got) > 3
    rows = registry.queries()["prefix_lift"](spark, sf).where("criterion = 'rich'").collect()
    assert {(r["prefix"], r["next_bid"]): r["pos_count"] for r in rows} == lift


def test_every_step_of_an_auction(spark, sf):
    want = {"-".join(t[: i + 1]) for a in AUCTIONS for t in [a.split("-")] for i in range(len(t))}
    assert {r["node"] for r in registry.queries()["belief_trace"](spark, sf).collect()} == want
    calls = {(n.rpartition("-")[0], n.rpartition("-")[2]) for n in want}
    assert {(r["parent"], r["call"]) for r in registry.queries()["list_next_bids"](spark, sf).collect()} == calls


def test_elo_carries_ratings_across_event_types(spark, sf):
    rows = table(spark, sf, "events").select("ts", "event_id", "user_id", "value").collect()
    rating, played, want = {}, {}, {}
    for r in sorted(rows):
        a, b, won = r["user_id"] % 50, r["event_id"] % 49 + 50, float(r["value"] % 2 >= 1)
        x, y = rating.get(a, 1500.0), rating.get(b, 1500.0)
        gain = won - 1 / (1 + 10 ** ((y - x) / 400))
        for player, own, sign in ((a, x, 1), (b, y, -1)):
            rating[player] = own + sign * gain * (36 if played.get(player, 0) < 100 else 24)
            played[player] = played.get(player, 0) + 1
        want[r["event_id"]] = (rating[a], rating[b])
    got = {r["event_id"]: (r["new_first"], r["new_second"]) for r in registry.queries()["elo_fold"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)
