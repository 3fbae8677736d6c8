"""Operators on hand-made cases: frame shapes, criteria as data, ratings of partners, streams, the facade."""

import json

import pytest
from pyspark.sql import functions as F

from dealframe import sqlapi
from dealframe.functions import auction as A
from dealframe.functions import criteria as C
from dealframe.functions import dsl
from dealframe.functions import hand as H
from dealframe.operators import analysis, relational, tournament
from dealframe.sources import boards
from dealframe.streaming import events as E


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_row_index_and_hstack(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int").repartition(5)
    got = {r["v"]: r["i"] for r in relational.with_row_index(df, ["v"], "i", 3).collect()}
    assert got == {v: v + 3 for v in range(101)}
    both = relational.hstack(df.limit(3), df.withColumnRenamed("v", "w").limit(2), ["v"], ["w"]).collect()
    assert len(both) == 3 and sum(r["w"] is None for r in both) == 1
    assert relational.with_row_index(df.where("v < 0"), ["v"]).collect() == []


def test_sample_is_seeded(spark):
    df = spark.range(1000)
    a, b, c = (sorted(r["id"] for r in relational.sample_rows(df, "id", 20, s).collect()) for s in (5, 5, 6))
    assert a == b != c and len(a) == 20 == len(set(a))
    assert relational.sample_rows(df, "id", 20, 0).count() == 20


def test_lookup(spark):
    assert one(spark, relational.lookup(F.lit("a"), {"a": 1}, 0)) == 1
    assert one(spark, relational.lookup(F.lit("b"), {"a": 1}, 0)) == 0
    with pytest.raises(Exception, match="no entry"):
        one(spark, relational.lookup(F.lit("b"), {"a": 1}, strict=True))
    assert one(spark, relational.horizontal_sum(F.lit(1), F.lit(None).cast("int"), F.lit(2))) == 3


@pytest.mark.parametrize(("name", "want"), [("HCP", "HCP_N"), ("SL_S", "SL_N_S"), ("C_CA", "C_NCA"), ("Total_Points", "Total_Points_N")])
def test_directional(name, want):
    assert C.directional(name, "N") == want


def test_criteria_as_data(spark):
    known = C.features(F.lit("AKQ32.QJ.T987.43"))
    check = lambda c, **k: one(spark, C.holds(F.lit(c), known, **k))
    assert [check(c) for c in ("HCP >= 12", "HCP > 12", "SL_S >= SL_H", "SL_S < 5", "Balanced", "nothing >= 1")] == [True, False, True, False, False, False]
    assert check("nothing >= 1", missing=True)
    assert one(spark, C.annotated(F.lit("HCP >= 20"), known)) == "HCP >= 20 [12]"
    assert one(spark, C.normal(F.lit(" HCP>=12   # strong"))) == "HCP >= 12"
    crit = F.array(*[F.lit(x) for x in ("HCP >= 3", "HCP > 4", "HCP <= 9", "SL_S == 5", "Balanced", "SL_H < 4")])
    bounds = lambda m: list(spark.range(1).select(C.parsed(crit).alias("p")).select(*C.bounds_of("p", m)).first())
    assert bounds("HCP") == [5, 9] and bounds("SL_S") == [5, 5] and bounds("SL_H") == [0, 3]
    for given in (["HCP >= 3", "HCP >= 5", "HCP <= 10"], ["HCP >= 12", "HCP <= 10", "SL_S >= 2"], ["SL_S >= 4", "SL_S >= 2", "Balanced", "Balanced"], []):
        col = F.array(*[F.lit(x) for x in given]) if given else F.array().cast("array<string>")
        assert one(spark, C.loosest(col)) == dsl.dedupe_least_restrictive(given)


@pytest.mark.parametrize("text", ["not a > 1", "not a > 1 & a < 5", "not not a > 1"])
def test_not_denies_the_comparison(spark, text):
    df = spark.createDataFrame([(0,), (3,), (7,)], "a int")
    got = [r["x"] for r in df.select(dsl.compile_criteria(text, df.columns).alias("x")).collect()]
    assert got == [bool(eval(text.replace("&", " and "), {"a": a})) for a in (0, 3, 7)]


@pytest.mark.parametrize(("pattern", "want"), [("1c-p-p-d", "1C-P-P-X-P-P-P"), ("1h-dbl-rdbl", "1H-X-XX-P-P-P"), ("[1-3]d-.*", "[1-3]d-.*"), ("1nt-pass", "1N-P-P-P")])
def test_patterns_with_doubles(pattern, want):
    assert A.normalize_pattern(pattern) == want


def test_seat1_pattern():
    assert A.normalize_pattern_to_seat1("p-p-1n-p-3n") == "1N-P-3N-P-P-P" and A.normalize_pattern_to_seat1("p-p-p-p") == "P-P-P-P"


@pytest.mark.parametrize(("said", "want"), [("1NT AP", "1N-P-P-P"), ("Pass Pass AP", "P-P-P-P"), ("1S Pass AP", "1S-P-P-P"), ("1S X 2S Pass Pass Pass", "1S-X-2S-P-P-P")])
def test_closing_passes(spark, said, want):
    pbn = f'[Event "x"]\n[Board "1"]\n[Dealer "N"]\n[Vulnerable "None"]\n[Deal "N:A.K.Q.J A.K.Q.J A.K.Q.J A.K.Q.J"]\n[Auction "N"]\n{said}\n'
    r = boards.parse_pbn(spark.createDataFrame([(pbn,)], "value string")).first()
    assert r["auction"] == want and one(spark, A.complete(A.tokens(F.lit(want))))


def test_bits_round_trip(spark, sf):
    from dealframe.plans.deals import hands

    bad = hands(spark, sf).where(H.decode_bits(H.encode_bits(F.col("hand"))) != F.col("hand"))
    assert bad.count() == 0


def test_facade_is_closed(spark):
    sqlapi.register(spark, facade=spark.range(4))
    for bad in ("select java_method('java.lang.System', 'getProperty', 'user.dir')", "select reflect('a', 'b') from facade", "select * from parquet.`/root/testdata/sf0.001/part.parquet`", "select (select count(*) from csv.`/etc/passwd`) from facade"):
        with pytest.raises(sqlapi.NotASelect):
            sqlapi.execute(spark, bad)
    assert sqlapi.execute(spark, "with t as (select id from facade where id > 1) select count(*) as n from t").first()["n"] == 2


def test_elo_of_partners(spark):
    rows = [(1, ["a", "b"], ["c", "d"], 1.0, 3), (2, ["a", "c"], ["b", "d"], 0.0, 12), (3, ["d", "a"], ["c", "b"], 0.5, 1)]
    df = spark.createDataFrame(rows, "t int, x array<string>, y array<string>, r double, n int")
    got = [tuple(r[c] for c in ("elo_first", "elo_second", "new_first", "new_second")) for r in tournament.pair_elo(df, "x", "y", "r", ["t"], pairs="n").orderBy("t").collect()]
    rating = {}
    for (_, x, y, r, n), have in zip(rows, got, strict=True):
        mean = lambda s: sum(rating.get(p, 1500.0) for p in s) / 2
        a, b = mean(x), mean(y)
        gain = (r - 1 / (1 + 10 ** ((b - a) / 400))) * 36 * (max(n - 1, 1) / 11) ** 0.5 / 2
        rating |= {p: rating.get(p, 1500.0) + gain for p in x} | {p: rating.get(p, 1500.0) - gain for p in y}
        assert have == pytest.approx((a, b, mean(x), mean(y)))


def test_points_against_a_field(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 1), ("g", 2, None), ("h", 7, 7), ("g", None, 2)], "k string, v int, h int")
    got = {(r["k"], r["v"], r["h"]): (r["MP_h"],) for r in tournament.hypothetical_matchpoints(df, ["k"], "v", ["h"]).collect()}
    assert got == {("g", 1, 5): (3.0,), ("g", 2, 1): (0.5,), ("g", 2, None): (None,), ("h", 7, 7): (0.5,), ("g", None, 2): (2.0,)}
    mp = {(r["k"], r["v"]): r["mp"] for r in tournament.matchpoints(df, ["k"], "v", "mp").collect()}
    assert mp == {("g", 1): 0.0, ("g", 2): 1.5, ("g", None): None, ("h", 7): 0.0}


def test_models(spark):
    with pytest.raises(ValueError, match="no model"):
        analysis.run_model("none", spark.range(1))
    assert analysis.models() == ["Actual", "Passive"]


def test_manifest_is_of_the_table_and_swaps(spark, tmp_path):
    at = str(tmp_path / "t")
    boards.write_with_manifest(spark.range(5), at, source="x")
    first = spark.read.json(at + ".manifest").first()
    boards.write_with_manifest(spark.read.parquet(at).where("id < 3"), at)
    m = spark.read.json(at + ".manifest").first()
    assert (first["rows"], m["rows"], spark.read.parquet(at).count()) == (5, 3, 3)
    assert len(m["sha256"]) == 64 and m["sha256"] != first["sha256"] and json.loads(m["schema"])["fields"][0]["name"] == "id"
    assert [p.name for p in tmp_path.iterdir() if ".new-" in p.name or ".old-" in p.name] == []


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    for name, frame, mode in (
        ("slides", lambda s: E.sliding_counts(s, "event_type", "2 hours", "1 hour", "1 hour"), "complete"),
        ("states", lambda s: E.running_state(s, "event_type"), "update"),
        ("runs", lambda s: E.session_counts(s, "user_id", "1 day", "1 hour"), "complete"),
    ):
        q = frame(E.event_stream(spark, str(tmp_path / "in"), e.schema)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    total = e.count()
    assert spark.sql("select sum(n) as n from slides").first()["n"] == 2 * total
    assert spark.sql("select sum(n) as n from runs").first()["n"] == total
    last = {r["event_type"]: r["n"] for r in spark.sql("select event_type, max(n) as n from states group by 1").collect()}
    assert last == {r["event_type"]: r["count"] for r in e.groupBy("event_type").count().collect()}
