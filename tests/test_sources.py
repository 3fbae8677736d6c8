"""Sources, the SQL facade and the stream."""

import pytest
from pyspark.sql import functions as F

from dealframe import sqlapi
from dealframe.sources import boards
from dealframe.streaming.events import event_stream, windowed_counts

LIN = "pn|a,b,c,d|st||md|3SAKQJHT98D765C432,ST98HAKQJDT98C765,S765H765HAKQJ|sv|n|ah|Board 7|mb|1N!|mb|p|mb|3NT|mb|p|mb|p|mb|p|pg||"
PBN = '[Event "x"]\n[Board "5"]\n[Dealer "N"]\n[Vulnerable "NS"]\n[Deal "E:AKQJ.T98.765.432 T98.AKQJ.T98.765 765.765.AKQJ.T98 432.432.432.AKQJ"]\n[Auction "N"]\n1NT Pass 3NT =1= AP\n[Contract "3NT"]\n[Result "9"]\n'


def test_lin(spark):
    r = boards.parse_lin(spark.createDataFrame([("f", LIN)], "path string, value string")).first()
    assert (r["board"], r["dealer"], r["vul"], r["auction"]) == (7, "N", "N_S", "1N-P-3N-P-P-P")
    assert r["Hand_S"] == "AKQJ.T98.765.432"
    assert r["Hand_E"].split(".")[0] == "432"


def test_pbn(spark):
    r = boards.parse_pbn(spark.createDataFrame([(PBN + PBN,)], "value string")).collect()
    assert len(r) == 2
    assert (r[0]["board"], r[0]["Hand_E"], r[0]["Hand_S"], r[0]["Hand_N"], r[0]["tricks"]) == (5, "AKQJ.T98.765.432", "T98.AKQJ.T98.765", "432.432.432.AKQJ", 9)
    assert r[0]["auction"] == "1N-P-3N-P-P-P"


def test_overlay(spark, tmp_path):
    f = tmp_path / "overlay.csv"
    f.write_text("# rules\n1n-p, HCP >= 15, is_artificial # note\n1N-P-2C,SL_S >= 4,replace_criteria\n\n")
    o = boards.read_overlay(spark, str(f))
    assert {(r["partial"], r["seat"], tuple(r["criteria"]), r["replace"], r["artificial"]) for r in o.collect()} == {("1N-P", 2, ("HCP >= 15",), False, True), ("1N-P-2C", 3, ("SL_S >= 4",), True, False)}
    nodes = spark.createDataFrame([("1N-P-2C", ["a"]), ("1N-P-2D", ["a", "HCP >= 15"]), ("1C", ["b"])], "auction string, criteria array<string>")
    got = {r["auction"]: r["criteria"] for r in boards.apply_overlay(nodes, o).collect()}
    assert got == {"1N-P-2C": ["SL_S >= 4", "HCP >= 15"], "1N-P-2D": ["a", "HCP >= 15"], "1C": ["b"]}


def test_manifest(spark, tmp_path):
    at = str(tmp_path / "t")
    boards.write_with_manifest(spark.range(5), at, source="x")
    m = spark.read.json(at + ".manifest").first()
    assert (m["rows"], m["source"]) == (5, "x")


def test_sql(spark):
    sqlapi.register(spark, deals=spark.range(10).withColumn("created_at", F.lit(1)))
    assert sqlapi.execute(spark, "select id, created_at from deals order by id desc;", 3).count() == 3
    for bad in ("drop view deals", "create table x as select 1", "insert into deals values (1, 2)", "set a=b"):
        with pytest.raises(sqlapi.NotASelect):
            sqlapi.execute(spark, bad)
    assert sqlapi.report(spark, "select max({col}) as m from deals where id < :top", {"col": "id"}, top=4).first()["m"] == 3


def test_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    out = windowed_counts(event_stream(spark, str(tmp_path / "in"), e.schema))
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) as n from counts").first()["n"] == e.count()


def test_lin_store_reads_new_files_only(spark, tmp_path):
    """Added, changed, touched and put-back files, two boards in a file, rejects, Latin-1, an empty file."""
    import os

    from dealframe.sources.ledger import LinStore

    src = tmp_path / "in"
    src.mkdir()
    deal = "SAKQJHT98D765C432,ST98HAKQJDT98C765,S765H765DAKQJCT98"
    board = lambda n, calls="mb|1N!|an|strong|mb|p|mb|p|mb|p|", vul="n", dealer="3": f"qx|o{n}|md|{dealer}{deal}|sv|{vul}|ah|Board {n}|{calls}pg||pc|s10|pc|S2|pc|x|mc|9|"
    (src / "a.lin").write_text("vg|x|pn|a,b,c,d|" + board(1) + board(2, vul="q"))
    (src / "b.lin").write_bytes(("pn|é,b,c,d|" + board(3)).encode("latin-1"))
    (src / "c.lin").write_text(" \n")
    (src / "none.lin").write_text("")
    (src / "d.lin").write_text(board(4, dealer="") + board(5).replace("SAKQJ", "SAKQJT"))
    (src / "e.txt").write_text(board(9))
    store = LinStore(spark, str(tmp_path / "store"), files=3)
    assert not store.boards().collect() and not store.rejects().collect()

    def run():
        n = store.ingest(str(src))
        return tuple(store.runs().where(f"run = {n}").first())

    assert run() == (1, 4, 4, 0, 2, 4)
    assert sorted((os.path.basename(r["path"]), r["record"], r["reason"]) for r in store.rejects().collect()) == [("a.lin", 2, "no vulnerability"), ("c.lin", 1, "no deal"), ("d.lin", 1, "no dealer"), ("d.lin", 2, "cards")]
    one = store.boards().where("board = 1").first()
    assert [tuple(c) for c in one["calls"]][:2] == [(1, "1N", True, "strong"), (2, "P", False, None)]
    assert [tuple(c) for c in one["plays"]] == [(1, 1, "ST"), (2, 1, "S2")]
    assert (one["dealer"], one["vul"], one["auction"], one["claim"], one["Hand_E"]) == ("N", "N_S", "1N-P-P-P", 9, "432.432.432.AKQJ")
    assert run() == (2, 4, 0, 4, 0, 0)
    old = (src / "a.lin").read_text()
    os.utime(src / "b.lin", (1, 1))
    (src / "a.lin").write_text(board(7) + board(8))
    (src / "f.lin").write_text(board(6))
    assert run() == (3, 5, 2, 3, 3, 0)
    assert sorted(r["board"] for r in store.boards().collect()) == [3, 6, 7, 8]
    (src / "a.lin").write_text(old)
    os.utime(src / "a.lin", (5, 5))
    assert run() == (4, 5, 0, 5, 0, 0)
    assert sorted(r["board"] for r in store.boards().collect()) == [1, 3, 6]
    assert run()[2:] == (0, 5, 0, 0)
    # A chunk whose ledger rows were never written doesn't count.
    store.boards().select("path", "board").limit(1).selectExpr("*", "'lost' as chunk", "1 as extra").write.mode("append").partitionBy("chunk").parquet(str(tmp_path / "store" / "boards"))
    assert sorted(r["board"] for r in store.boards().collect()) == [1, 3, 6]
    assert "extra" in store.boards().columns
