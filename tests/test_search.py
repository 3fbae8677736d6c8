"""Tree intervals, searches, bitmaps and summed areas against plain loops; criteria that are compound."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealframe.functions import criteria as C
from dealframe.functions import par, scoring
from dealframe.operators import bidding, boxes, posteriors, relational, rules, tree
from dealframe.plans import search_queries as Q


def test_running_sums_and_intervals(spark):
    rng = random.Random(3)
    nodes = sorted({"-".join(rng.choices(["P", "X", "XX", "1C", "1N", "7S"], k=n)[:d]) for n in range(1, 5) for d in range(1, n + 1) for _ in range(30)})
    every = sorted({"-".join(x.split("-")[:i]) for x in nodes for i in range(1, x.count("-") + 2)})
    df = spark.createDataFrame([(n, len(n)) for n in every], "node string, v int").repartition(5)
    placed = tree.intervals(df)
    got = {r["node"]: (r["enter"], r["leave"]) for r in placed.collect()}
    assert got == {n: (i, i + sum(m.startswith(n + "-") for m in every)) for i, n in enumerate(every)}
    sums = {r["node"]: r["total"] for r in tree.below(placed, "v", "total").collect()}
    assert sums == {n: sum(len(m) for m in every if m == n or m.startswith(n + "-")) for n in every}
    run = relational.running_sum(df, ["node"], "v", "s").orderBy("node").collect()
    assert [r["s"] for r in run] == list(np.cumsum([len(n) for n in every]))


def test_search_equals_the_exhaustive_join(spark):
    """A random tree and random scores and permissions: the best ends of all allowed paths, ties by text."""
    rng = random.Random(5)
    ends = sorted({"-".join(rng.choice("ABCD") for _ in range(rng.randint(2, 5))) + "-E" for _ in range(120)})
    sig = {e: rng.randrange(12) for e in ends}
    nodes = sorted({"-".join(e.split("-")[:i]) for e in ends for i in range(1, e.count("-") + 2)})
    at = {n: i for i, n in enumerate(nodes)}
    rows = [(at[n], n, n.count("-") + 1, sig.get(n), sorted({sig[e] for e in ends if e == n or e.startswith(n + "-")}), rng.randrange(4)) for n in nodes]
    edges = [(at.get(n.rpartition("-")[0]), at[n]) for n in nodes]
    deals = [(i, [rng.randrange(-5, 9) for _ in range(12)], rng.randrange(3)) for i in range(60)]
    n = spark.createDataFrame(rows, "bt_index long, node string, depth int, signature int, signatures array<int>, ask int")
    e = spark.createDataFrame(edges, "parent_index long, bt_index long")
    d = spark.createDataFrame(deals, "index long, scores array<int>, has int")
    search = tree.Search(n, e, F.col("ask") != F.col("has"), 3)
    got = sorted((r["index"], r["rank"], r["node"], r["score"]) for r in search.run(d).collect())
    ask = {r[1]: r[5] for r in rows}
    want = []
    for i, scores, has in deals:
        ok = [x for x in ends if all(ask["-".join(x.split("-")[:k])] != has for k in range(1, x.count("-") + 2))]
        want += [(i, k + 1, x, scores[sig[x]]) for k, x in enumerate(sorted(ok, key=lambda x: (-scores[sig[x]], x))[:3])]
    assert got == sorted(want)
    assert not search.run(d.where("index < 0")).collect()


def test_search_keeps_a_small_frontier(spark, sf):
    search, nodes = Q.auction_search(spark, sf)
    deals = Q.search_deals(spark, sf)
    assert search.run(deals).count() > 0
    ends = nodes.where("signature is not null").count()
    # On this tree of 151 ends both walks together write 35 % of deals x ends; larger trees share more.
    assert sum(search.rounds) < 0.4 * deals.count() * ends


@pytest.mark.parametrize("small", [False, True])
def test_bitmaps_are_range_matches(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(boxes, "BOXES", 7)
        monkeypatch.setattr(boxes, "POINTS", 20)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 9, (90, 4))
    low = rng.integers(-4, 6, (40, 4))
    high = low + rng.integers(-1, 9, (40, 4))
    dims = ["a", "b", "c", "d"]
    p = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)] + [(500, None, 1, 1, 1)], "k long, " + ", ".join(f"{d} int" for d in dims)).repartition(3)
    bounds = [f"{d}_{e}" for d in dims for e in ("min", "max")]
    b = spark.createDataFrame([(j, *[int(v) for d in range(4) for v in (low[j, d], high[j, d])]) for j in range(40)], "b long, " + ", ".join(f"{c} int" for c in bounds))
    want = sorted((i, j) for i in range(90) for j in range(40) if ((low[j] <= x[i]) & (x[i] <= high[j])).all())
    groups = [["a", "b"], ["c"], ["d"]]
    assert sorted(map(tuple, boxes.matches(p, b, groups, "k", "b").collect())) == want
    sums = sorted(map(tuple, boxes.summary(p, b, groups, "k", "b").collect()))
    by = {j: [i for i, k in want if k == j] for _, j in want}
    assert sums == sorted((j, len(v), min(v), max(v)) for j, v in by.items())
    assert not boxes.matches(p.where("k < 0"), b, groups, "k", "b").collect() and not boxes.summary(p, b.where("b < 0"), groups, "k", "b").collect()
    areas = boxes.summed_area(p.withColumn("v", (F.col("k") * 7 % 11 - 4).cast("int")).withColumn("odd", F.col("k") % 2), dims, ["odd"], "v", b, "b").collect()
    got = {(r["b"], r["odd"]): (r["n"], round(r["mean"], 9), round(r["deviation"], 9)) for r in areas}
    by = {}
    for i, j in want:
        by.setdefault((j, i % 2), []).append(i * 7 % 11 - 4)
    assert got == {k: (len(v), round(float(np.mean(v)), 9), round(float(np.std(v)), 9)) for k, v in by.items()}


def test_tables_of_scores(spark):
    cells = [(v, b, t) for v in (0, 1) for b in range(35) for t in range(14)]
    df = spark.createDataFrame([(i, v, b // 5 + 1, b % 5, t) for i, (v, b, t) in enumerate(cells)], "i int, v int, level int, strain int, t int")
    dbl = F.when(F.col("t") >= F.col("level") + 6, 0).otherwise(1)
    got = df.select("i", *[scoring.score(F.col("level"), F.col("strain"), d, F.col("v") == 1, F.col("t")) for d in (dbl, F.lit(0))]).orderBy("i").collect()
    assert [r[1] for r in got] == scoring.doubled_if_down_scores() and [r[2] for r in got] == scoring.undoubled_scores()


def test_par_is_null_without_all_tricks(spark):
    df = spark.createDataFrame([([7] * 20, "None", "N"), (None, "None", "N"), ([7] * 19 + [None], "Both", "E"), ([7] * 3, "Both", "E"), ([13] * 20, None, None)], "t array<int>, v string, d string")
    got = [r[0] for r in df.select(par.par(F.col("t"), F.col("v"), F.col("d"))).collect()]
    assert got[0] is not None and got[1:4] == [None] * 3 and got[4] is not None


def test_compound_criteria_are_told(spark):
    """A compound criterion fails the hands that it should fail; an unknown name fails nobody."""
    hands = {1: "AKQ32.QJ.T987.43", 2: "2.AKQJ32.T98.432"}
    texts = ["HCP > 3 & SL_S >= SL_H", "HCP >= 20 | SL_H >= 6", "HCP >= 2", "Unknown_Thing"]
    df = spark.createDataFrame([(hands[1], hands[2], texts, texts)], "h1 string, h2 string, c1 array<string>, c2 array<string>")
    odd = C.compounds(df, ["c1", "c2"])
    assert odd == sorted(texts[:2])
    df = df.withColumns({f"c{s}": C.parsed(F.col(f"c{s}")) for s in (1, 2)})
    got = bidding.wrong_bids(df, {s: F.col(f"h{s}") for s in (1, 2)}, {s: F.col(f"c{s}") for s in (1, 2)}, odd, as_json=False).first()
    assert got["Invalid_Criteria_S1"] == [texts[1]] and got["Invalid_Criteria_S2"] == [texts[0]] and got["first_wrong_seat"] == 1


def test_counted_bits_are_plain_counts(spark):
    """130 candidates over three words, the sign bits among them, nulls as false."""
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), [rng.choice([True, False, None]) for _ in range(130)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, g int, f array<boolean>").repartition(3)
    bits = df.select("g", rules.packed([F.get("f", F.lit(i)) for i in range(130)]).alias("bits"))
    got = {r["g"]: (r["rows"], r["counts"]) for r in rules.counted_bits(bits, ["g"], "bits", 130).collect()}
    assert got == {g: (sum(r[1] == g for r in rows), [sum(bool(r[2][i]) for r in rows if r[1] == g) for i in range(130)]) for g in range(3)}


def test_partner_fit_is_the_convolution(spark):
    rng = random.Random(1)
    rows = [("x" if i % 3 else "y", rng.randrange(14), rng.randrange(9)) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = {r["k"]: r for r in posteriors.partner_fit(df, ["k"], "a", "b", 13, 8).collect()}
    for k in "xy":
        a, b = [r[1] for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k]
        every = [x + y for x, y in itertools.product(a, b)]
        assert got[k]["p_fit"] == pytest.approx(np.mean([v >= 8 for v in every])) and got[k]["mean_fit"] == pytest.approx(np.mean(every))
        assert got[k]["p_fit_seen"] == pytest.approx(np.mean([x + y >= 8 for x, y in zip(a, b)])) and got[k]["n"] == len(a)


def test_sessions_count_copies_once(spark, tmp_path):
    from dealframe.streaming import events

    rows = [(1, 7, "2024-01-01 00:00:00"), (1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 01:00:00"), (3, 7, "2024-01-01 09:00:00"), (4, 8, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "e"))
    stream = events.event_stream(spark, str(tmp_path / "e"), df.schema)
    got = events.finished(events.sessions_once(stream, "user_id", "event_id", "2 hours", "1 hour"), str(tmp_path)).orderBy("start").collect()
    assert [(r["user_id"], r["n"]) for r in got] == [(7, 2), (7, 1)]


def test_longest_prefix_by_bits(spark):
    """Random trees and auctions up to 21 calls: as many shared calls as a plain loop finds."""
    from dealframe.operators import divergence

    rng = random.Random(11)
    said = lambda n: "-".join(rng.choice("PXA") for _ in range(n))
    tree_ends = [said(rng.randint(1, 21)) for _ in range(60)]
    nodes = {"-".join(e.split("-")[:i]) for e in tree_ends for i in range(1, e.count("-") + 2)}
    auctions = [said(rng.randint(1, 23)) for _ in range(80)] + tree_ends[:9] + [e + "-A-A" for e in tree_ends[9:30]] + ["", "Z", tree_ends[0]]
    n = spark.createDataFrame([(x,) for x in nodes] + [("",), (tree_ends[0],)], "node string")
    a = spark.createDataFrame([(x,) for x in auctions] + [(None,)], "auction string").repartition(3)
    got = {r["auction"]: r["depth"] for r in divergence.longest_prefix(a, n).collect()}
    depth = lambda x: max((i for i in range(1, x.count("-") + 2) if "-".join(x.split("-")[:i]) in nodes), default=0)
    assert got == {x: depth(x) for x in set(auctions)}
    assert {r["depth"] for r in divergence.longest_prefix(a, n.where("false")).collect()} == {0}
    assert not divergence.longest_prefix(a.where("false"), n).collect()


def test_losses_find_the_call_that_lost_most(spark):
    from dealframe.operators import divergence

    nodes = spark.createDataFrame([("", [0, 1, 2]), ("A", [0, 1]), ("B", [2]), ("A-A", [0]), ("A-B", [1])], "node string, signatures array<int>")
    scores = [10, 50, 90]
    rows = [(1, "A-A", 10), (2, "A-C-D", -20), (3, "B", 90), (4, "", 5), (5, "C", 200), (6, None, 0)]
    d = spark.createDataFrame([(i, a, scores, s) for i, a, s in rows], "index long, auction string, scores array<int>, score int")
    shared = divergence.shared_nodes(divergence.longest_prefix(d.select("auction"), nodes), nodes)
    got = {r["index"]: tuple(r)[4:] for r in divergence.losses(d, shared).collect()}
    assert got == {
        1: (None, "A-A", 10, 0, 1, 40),
        2: (2, "A", 50, 70, 2, 70),
        3: (None, "B", 90, 0, None, None),
        4: (None, "", 90, 85, None, None),
        5: (1, "", 90, -110, None, None),
        6: (None, None, None, None, None, None),
    }


def test_par_contracts(spark):
    from dealframe.operators import divergence

    df = spark.createDataFrame([("4SX-N-1, 4HN=; 5cx EW -2,3NT,junk,,8S",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(divergence.par_contracts(F.col("t"))).collect()]
    assert [tuple(x) for x in got[0]] == [(4, 3, 1, "N", -1), (4, 2, 0, "N", 0), (5, 0, 1, "EW", -2), (3, 4, 0, None, None)]
    assert got[1] == [] and got[2] is None


def _joins(spark, sf, name):
    """The joins in a query's plan, as its optimizer leaves them."""
    from dealframe.plans import registry

    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "Join" in x]


def test_deals_are_not_joined_to_deals(spark, sf):
    """Spark takes 70 scores of every deal for one and would broadcast them (auction_losses, range_statistics)."""
    for name in ("auction_losses", "range_statistics"):
        assert not [x for x in _joins(spark, sf, name) if x.count("index#") > 1], name


def test_queries_without_hands_deal_none(spark, sf):
    """Contracts, par and auctions are worked out from the key; no deal is written for them."""
    from dealframe.plans import deals, registry

    before = dict(deals._DEALT)
    deals._DEALT.clear()
    try:
        for name in ("contract_scores", "par_scores", "auction_contract", "best_auctions", "result_from_score", "dd_score_by_auction", "auctions_by_contract", "auction_dd_analysis", "worst_mistakes", "opening_seat_and_leader"):
            registry.queries()[name](spark, sf)
            assert not deals._DEALT, name
    finally:
        deals._DEALT.update(before)


def test_once_each_keeps_null_keys(spark):
    from dealframe.operators.bidding import once_each

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "i int, k string")
    got = once_each(df, ["k"], {"n": F.coalesce(F.length("k"), F.lit(-1))}).orderBy("i").collect()
    assert [(r["i"], r["k"], r["n"]) for r in got] == [(1, "a", 1), (2, None, -1), (3, "a", 1)]


def test_summary_sends_each_distinct_point_once(spark):
    """Repeated points are counted, and their least and greatest keys kept, but only one of them is shuffled."""
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 2)) for i in range(600)]
    pts = spark.createDataFrame([*rows, (600, None, 1)], "k long, a int, b int")
    bx = [(j, lo, lo + rng.randint(0, 2), m, m + rng.randint(0, 1)) for j in range(40) for lo, m in [(rng.randint(-1, 3), rng.randint(-1, 3))]]
    box = spark.createDataFrame(bx, "j long, a_min int, a_max int, b_min int, b_max int")
    sent = []
    real = boxes._met
    boxes._met = lambda p, *a, **kw: (sent.append(p.count()), real(p, *a, **kw))[1]
    try:
        got = {tuple(r) for r in boxes.summary(pts, box, [["a"], ["b"]], "k", "j").select("j", "n", "first", "last").collect()}
    finally:
        boxes._met = real
    want = set()
    for j, a0, a1, b0, b1 in bx:
        ks = [k for k, a, b in rows if a0 <= a <= a1 and b0 <= b <= b1]
        if ks:
            want.add((j, len(ks), min(ks), max(ks)))
    assert got == want and sent == [12]


def test_ratings_by_event_are_not_sorted_in_the_rating_task(spark, sf):
    """Between the fold of all games and the aggregation by sorting lies an exchange."""
    from dealframe.plans import registry

    plan = registry.queries()["event_elo"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("MapInPandas")
