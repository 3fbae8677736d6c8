"""Shapes of plans that decide how a query grows: what is broadcast, how many tasks work, what is worked out how often."""

from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summed_area_sends_no_grid_through_the_driver(spark):
    from dealframe.operators import boxes

    points = spark.createDataFrame([(1, 2, True, 10), (3, 4, True, -20), (3, 1, False, 5)], "a int, b int, v boolean, own int")
    bx = spark.createDataFrame([(7, 0, 3, 0, 4), (8, 2, 3, 2, 9), (9, 5, 4, 0, 9)], "box long, a_min int, a_max int, b_min int, b_max int")
    out = boxes.summed_area(points, ["a", "b"], ["v"], "own", bx, "box")
    assert "Broadcast" not in _plan(out)
    assert sorted((r.box, r.v, r.n, r["mean"]) for r in out.collect()) == [(7, False, 1, 5.0), (7, True, 2, -5.0), (8, True, 1, -20.0)]


def test_lists_are_parsed_in_many_tasks(spark, sf):
    from dealframe.plans.table_queries import _parsed_table

    assert "REPARTITION_BY_NUM" in _plan(_parsed_table(spark, sf))


def test_bids_are_worked_out_in_many_tasks_without_python(spark, sf):
    from dealframe.plans.deals import bids

    plan = _plan(bids(spark, sf))
    assert "REPARTITION_BY_NUM" in plan
    assert "ExistingRDD" not in plan


def test_par_is_folded_once_for_equal_boards(spark, monkeypatch):
    import numpy as np

    from dealframe.functions import par

    rows = [(i, [(i % 3 + d * s) % 14 for d in range(4) for s in range(5)], v, d) for i in range(30) for v in ("None", "N_S", "E_W", "Both") for d in "NE"] + [(99, None, "None", "N"), (98, [1] * 19, "None", "N"), (97, [14] * 20, "None", "N")]
    df = spark.createDataFrame(rows, "i int, t array<int>, Vul string, Dealer string")
    got = [r.par for r in df.select(par.par(F.col("t"), F.col("Vul"), F.col("Dealer")).alias("par")).collect()]
    for (_, t, v, d), p in zip(rows[:-3], got, strict=False):
        hands = np.array(t).reshape(1, 2, 2, 5).max(1)
        assert p == par._folded(hands, np.array([[int(v in ("N_S", "Both")), int(v in ("E_W", "Both"))]]), np.array([d == "N"]))[0]
    assert got[-3:] == [None, None, None]


def test_tasks_of_percentages_grow_with_the_rows(spark, monkeypatch, sf):
    from dealframe.operators import tournament
    from dealframe.plans import analytics_queries

    df = spark.createDataFrame([(1, 2.5, 2), (1, 2.5, None), (1, 4.0, 4), (1, None, 9), (2, 1.0, 0)], "g int, q double, h int")
    got = tournament.distinct_score_percentage(df, ["g"], "q", "h", "pct", 5)
    assert "hashpartitioning(g" in _plan(got) and ", 5)" in _plan(got)
    assert sorted((r.g, r.h or 0, r.pct) for r in got.collect()) == [(1, 0, None), (1, 2, 0.0), (1, 4, 0.75), (1, 9, 1.0), (2, 0, 0.0)]
    monkeypatch.setattr(analytics_queries, "LINES", 100)
    assert analytics_queries._best_lines(spark, sf)[1] > 50


def test_criteria_are_parsed_once_a_row_of_the_table(spark, sf):
    from dealframe.plans.registry import queries

    assert "regexp_extract" not in _plan(queries()["criterion_pass_rates"](spark, sf))


def test_lin_records_are_searched_as_plain_text(spark):
    from dealframe.sources import ledger

    deal = "qx|o1|md|3SAKQJT98765432,HAKQJT98765432,D2345678910jqka|sv|o|ah|Board 4|mb|1n|an|12-14|mb|D!|mb|P|mb|p|mb|p|pg||pc|SA|pc|h10|pc|x|"
    mixed = "mb|1C|md|1S2AH3KDC98765432A,,|sv|e|mb|2NT"
    out = ledger.read_records(spark.createDataFrame([(1, deal), (2, mixed), (3, None)], "i int, text string"))
    assert "regexp_extract_all" not in _plan(out)
    a, b, c = sorted(out.collect(), key=lambda r: r.i)
    assert (a.board, a.dealer, a.vul, a.Hand_S, a.Hand_W, a.Hand_N, a.Hand_E) == (4, "N", "None", "AKQJT98765432...", ".AKQJT98765432..", "..AKQJT98765432.", "...AKQJT98765432")
    assert a.auction == "1N-X-P-P-P" and [tuple(x) for x in a.calls][:2] == [(1, "1N", False, "12-14"), (2, "X", True, None)]
    assert [tuple(p) for p in a.plays] == [(1, 1, "SA"), (2, 1, "HT")] and a.reason is None
    assert (b.Hand_S, b.auction, b.reason) == ("A2.K3..A98765432", "1C-2N", "cards")
    assert (c.auction, c.reason) == (None, "no deal")


def test_lin_files_are_looked_up_in_few_tasks(spark, tmp_path):
    from dealframe.sources.ledger import LinStore

    for i in range(40):
        (tmp_path / f"{i}.lin").write_text(f"qx|o{i}|md|3SA,HA,DA|")
    spark.sparkContext.setJobGroup("looked up", "")
    LinStore(spark, str(tmp_path / "store"))._opened([str(tmp_path / f"{i}.lin") for i in range(40)])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = [s for j in told.getJobIdsForGroup("looked up") for s in told.getJobInfo(j).stageIds]
    assert sum(told.getStageInfo(s).numTasks for s in stages) <= 4
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_club_results_are_named_from_one_read_without_a_join(spark):
    from dealframe.sources import club

    texts = [
        ('{"event_id": 1, "pairs": [{"section": "A", "pair": 1, "names": "x"}, {"section": "A", "pair": 1, "names": "y"}, {"section": "B", "pair": 9, "names": "z"}], "results": [{"section": "A", "board": 1, "ns": 1, "ew": 9}, {"section": "B", "board": 2, "ns": 3, "ew": 9}, {"board": 3, "ns": 1}]}',),
        ('{"event_id": 2, "results": [{"section": "A", "board": 1, "ns": 1, "ew": 9}]}',),
        ('{"pairs": [{"section": "A", "pair": 1, "names": "x"}], "results": [{"section": "A", "board": 1, "ns": 1, "ew": 9}]}',),
        ('{"event_id": 3, "pairs": []}',),
        ("no json",),
        (None,),
    ]
    df = spark.createDataFrame(texts, "text string")
    got, want = club.named_results(df, "text"), club.with_names(club.event_tables(df, "text"))
    assert "Join" not in _plan(got) and "Exchange" not in _plan(got)
    rows = lambda d: sorted((tuple(r[c] for c in sorted(want.columns)) for r in d.collect()), key=repr)
    assert rows(got) == rows(want) and len(rows(got)) == 6


def test_search_shuffles_its_deals_once(spark, sf, monkeypatch):
    """In one pass, and as a walk that writes each round; the same ends."""
    from dealframe.operators import tree
    from dealframe.plans import search_queries as Q

    search, nodes = Q.auction_search(spark, sf)
    got = search.run(Q.search_deals(spark, sf))
    plan = _plan(got)
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert "SortMergeJoin" not in plan and not search.rounds
    got = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(tree, "NODES_MAX", 0)
    deals = Q.search_deals(spark, sf)
    assert sorted(map(tuple, search.run(deals).collect())) == got
    assert 0 < sum(search.rounds) < 0.4 * deals.count() * nodes.where("signature is not null").count()


def test_search_in_one_pass_goes_on_below_an_end(spark):
    """An end that has nodes below it counts once, and so do the ends below; ties by text."""
    from dealframe.operators import tree

    rows = [(0, "A", 1, 0, [0, 1, 2], 9), (1, "A-B", 2, 1, [1, 2], 9), (2, "A-B-C", 3, 2, [2], 9), (3, "A-D", 2, 1, [1], 1), (4, "B", 1, 2, [2], 0)]
    n = spark.createDataFrame(rows, "bt_index long, node string, depth int, signature int, signatures array<int>, ask int")
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 3)], "parent_index long, bt_index long")
    d = spark.createDataFrame([(7, [5, 6, 6], 0), (8, [5, 6, 7], 1), (9, [5, 6, 7], 9)], "index long, scores array<int>, has int")
    got = sorted(map(tuple, tree.Search(n, e, F.col("ask") != F.col("has"), 4).run(d).collect()))
    want = {7: ["A-B", "A-B-C", "A-D", "A"], 8: ["A-B-C", "B", "A-B", "A"], 9: ["B"]}
    assert [(i, r, x) for i, r, x, _ in got] == [(i, r + 1, x) for i, v in want.items() for r, x in enumerate(v)]


def test_best_auctions_ranks_deals_where_they_are(spark, sf):
    from dealframe.plans import service_queries as Q

    plan = _plan(Q.best_auctions(spark, sf))
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
