"""Par against a plain search, PBN and club texts with odd rows, faults of criteria, displayed texts."""

import random
from functools import cache

from pyspark.sql import functions as F

from dealframe.functions import display, dsl, par
from dealframe.functions import scoring as S
from dealframe.sources import boards, club
from dealframe.written import Written


def plain_score(level, strain, vul, tricks):
    """Undoubled where it makes, doubled where it fails."""
    over = tricks - level - 6
    if over < 0:
        down = -over
        return -(300 * down - 100 if vul else [100, 300, 500][down - 1] if down <= 3 else 300 * down - 400)
    each = 20 if strain <= 1 else 30
    points = level * each + (10 if strain == 4 else 0)
    bonus = (500 if vul else 300) if points >= 100 else 50
    slam = {6: 750 if vul else 500, 7: 1500 if vul else 1000}.get(level, 0)
    return points + bonus + slam + over * each


def plain_par(tricks, vul, dealer):
    """The auction as a game: at each turn a side bids any higher contract or passes, which ends it (once the other side had its turn)."""

    def value(bid, side):
        v = vul == "Both" or vul == ("N_S", "E_W")[side]
        best = max(plain_score(bid // 5 + 1, bid % 5, v, tricks[d * 5 + bid % 5]) for d in (side, side + 2))
        return best if side == 0 else -best

    @cache
    def play(bid, side, turn, opened):
        """bid: the standing one (-1: none) of a side; opened: the other side passed before."""
        pick = max if turn == 0 else min
        if bid < 0:
            rest = 0 if opened else play(-1, 0, 1 - turn, True)
        else:
            rest = value(bid, side)
        return pick([rest] + [play(b, turn, 1 - turn, True) for b in range(bid + 1, 35)])

    return play(-1, 0, 0 if dealer in "NS" else 1, False)


def test_par(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(14) for _ in range(20)] if i % 2 else [rng.choice([3, 4, 5, 6, 7, 8, 9, 10]) for _ in range(20)], rng.choice(["None", "N_S", "E_W", "Both"]), rng.choice("NESW")) for i in range(60)]
    rows += [(60, [0] * 20, "None", "N"), (61, [13] * 20, "Both", "E"), (62, [7] * 20, "None", "S")]
    df = spark.createDataFrame(rows, "i int, t array<int>, vul string, dealer string").repartition(3)
    got = {r.i: r.par for r in df.select("i", par.par(F.col("t"), F.col("vul"), F.col("dealer")).alias("par")).collect()}
    assert got == {i: plain_par(tuple(t), v, d) for i, t, v, d in rows}


def test_scores_grow_with_tricks(spark):
    t = spark.range(14).select(F.col("id").cast("int").alias("t"))
    for level, strain, vul in ((1, 0, True), (3, 4, False), (7, 3, True)):
        s = [r.s for r in t.select(S.score(F.lit(level), F.lit(strain), F.when(F.col("t") >= level + 6, 0).otherwise(1), F.lit(vul), F.col("t")).alias("s"), "t").orderBy("t").collect()]
        assert s == sorted(s) == [plain_score(level, strain, vul, k) for k in range(14)]


def test_pbn_from_any_seat(spark):
    hands = {d: f"{d}.A.K.Q" for d in "NESW"}
    cols = {d: F.lit(h) for d, h in hands.items()}
    out = spark.range(1).select(*[boards.normal_pbn(boards.pbn_of(F.lit(d), cols)).alias(d) for d in "NESW"], boards.pbn_of(F.lit("W"), cols).alias("text")).first()
    want = "N:" + " ".join(hands[d] for d in "NESW")
    assert {out[d] for d in "NESW"} == {want}
    assert out["text"].startswith("W:W.A.K.Q N.A.K.Q")
    odd = spark.createDataFrame([("",), (None,), ("N:a b c",), ("X:a b c d",), (" e:a.  b. c. d. ",)], "v string")
    assert [r[0] for r in odd.select(boards.normal_pbn(F.col("v"))).collect()] == [None, None, None, None, "N:D. A. B. C."]


def test_club_odd_rows(spark):
    text = '{"event_id": 1, "pairs": [{"section": "A", "pair": 1, "names": "x-y"}], "results": [%s]}'
    line = '{"section": "A", "board": %d, "ns": 1, "ew": 2, "contract": %s, "result": %s, "pct": %s}'
    lines = [(1, '"3ntx w"', '"-2"', '"105.5"'), (2, '"PASS"', '"0"', '"50"'), (3, "null", "null", "null"), (4, '"8S N"', '"="', '"?"'), (5, '"1C E"', '"7"', '""')]
    df = spark.createDataFrame([(text % ",".join(line % x for x in lines),), ("no json",), (None,), ("{}",)], "t string")
    tables = club.event_tables(df, "t")
    rows = {r.board: r for r in club.cleaned(club.with_names(tables)).collect()}
    assert len(rows) == 5 and tables["pairs"].count() == 1
    r = rows[1]
    assert (r.level, r.strain, r.dbl, r.declarer, r.over, r.tricks, r.pct, r.names_ns, r.names_ew) == (3, 4, 1, "W", -2, 7, 1.0, "x-y", None)
    assert rows[2].passed and rows[2].level is None and rows[2].pct == 0.5
    assert not rows[3].passed and rows[3].level is None and rows[3].pct is None
    assert rows[4].level is None and rows[4].over is None
    assert rows[5].level == 1 and rows[5].over is None and rows[5].tricks is None
    empty = club.cleaned(club.with_names(club.event_tables(df.limit(0), "t")))
    assert empty.count() == 0
    xml = spark.createDataFrame([(7, '<board number="3"><line ns="1" ew="2" contract="4S N" tricks="10"/><line ns="3" ew="4"/></board>'), (8, '<board number="4"></board>'), (9, None)], "event int, x string")
    got = sorted(tuple(r) for r in club.xml_lines(xml, "x").collect())
    assert got == [(7, 3, 1, 2, "4S N", 10), (7, 3, 3, 4, None, None)]


def test_faults(spark):
    assert dsl.fault("HCP >= 12 & SL_S > 4", ["HCP", "SL_S"]) is None
    assert dsl.fault("HCP >=", ["HCP"]) and dsl.fault("Other > 1", ["HCP"]) and dsl.fault("(HCP > 1", ["HCP"])


def test_displayed(spark):
    row = spark.createDataFrame([("p-p-1n-P", 4, 3, 1, "NS", -1)], "a string, level int, strain int, dbl int, pair string, over int")
    c = F.struct("level", "strain", "dbl", "pair", "over")
    ids = {d: F.lit(i) for i, d in enumerate("NESW")}
    out = row.select(
        display.at_seat(F.col("a"), 2).alias("seat"),
        display.at_seat(F.col("a"), 9).alias("last"),
        display.contracts_text(F.array(c, c)).alias("text"),
        display.of_direction(ids, F.lit(None).cast("string")).alias("none"),
        display.roles(ids, F.lit("W"))["leader"].alias("leader"),
        display.pair_id(F.lit(9), F.lit(4)).alias("pair_id"),
    ).first()
    assert tuple(out) == ("P-1N-P", "P-P-P-1N-P", "4SX NS -1", None, 0, "4_9")


def test_written_formats(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'q"<&>')], "k int, v string")
    for kind, options in (("csv", {"header": True}), ("json", {}), ("xml", {"rowTag": "r"}), ("parquet", {})):
        w = Written(df, kind, **options)
        assert sorted(tuple(r) for r in w.df.collect()) == [(1, "a,b"), (2, None), (3, 'q"<&>')], kind
        w.drop()
