"""Tree search, intervals of the tree, previews of overlays, and statistics of the table's bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import scoring as S
from dealframe.operators import boxes, divergence, tree
from dealframe.plans.bridge_queries import SCORE_SQL, TOK, W
from dealframe.plans.deals import bids, deals
from dealframe.plans.registry import query
from dealframe.plans.service_queries import PAR_SQL, _tricks
from dealframe.plans.table_queries import BT, DIMS, NODE_SQL, OVERLAY, RANGES, SEATED, WIDE, _boxes, _points, _table, bidding_table
from dealframe.functions.par import par
from dealframe.session import table
from dealframe.written import Written

INTERVAL_SQL = "iv as (select a.node, a.bt_index as enter, a.bt_index + (select count(*) from nx b where starts_with(b.node, a.node || '-')) as leave, a.complete_below from nx a)"


@query("subtree_intervals", f"{W}, {NODE_SQL}, {INTERVAL_SQL} select node, enter, leave, leave - enter + 1 as nodes_below, complete_below from iv")
def subtree_intervals(spark, sf_dir):
    """Each node's places in pre-order, and the deals whose auction ends at or below it, from running sums over the places."""
    ends = bids(spark, sf_dir).groupBy(F.array_join(A.tokens(F.col("auction")), "-").alias("node")).agg(F.count("*").alias("own"))
    placed = Written(tree.intervals(_table(spark, sf_dir).select("node").join(ends, "node", "left").fillna(0, ["own"]))).df
    out = tree.below(placed, "own", "complete_below")
    return out.select("node", "enter", "leave", (F.col("leave") - F.col("enter") + 1).alias("nodes_below"), "complete_below")


SAMPLES, SEED = 10, 7


@query(
    "custom_criteria_preview",
    f"""with {BT}, ov(partial) as (values {", ".join(f"('{p}')" for p, _ in OVERLAY)}), h as (select partial, bt_index from bt join ov on Auction = partial or starts_with(Auction, partial || '-')),
    r as (select *, row_number() over (partition by partial order by md5('{SEED}:' || bt_index), bt_index) as r from h)
    select partial, count(*) as n, array_to_string(list_sort(list(bt_index) filter (where r <= {SAMPLES})), ' ') as sample from r group by 1""",
)
def custom_criteria_preview(spark, sf_dir):
    """For each rule of the overlay how many rows of the table it would change, and ten of them, drawn by a seed."""
    bt = bidding_table(spark, sf_dir)
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("Auction", "-"))), lambda n: F.array_join(F.slice(F.split("Auction", "-"), F.lit(1), n), "-")))
    placed = Written(tree.intervals(bt.select("Auction").distinct().select(steps.alias("node")).distinct())).df
    rules = spark.createDataFrame([(p,) for p, _ in OVERLAY], "partial string").join(placed.withColumnRenamed("node", "partial"), "partial")
    rows = bt.select("bt_index", F.col("Auction").alias("node")).join(placed.select("node", "enter"), "node")
    out = tree.preview(rows, "enter", "bt_index", rules, SAMPLES, SEED)
    return out.select("partial", "n", F.array_join("sample", " ").alias("sample"))


@query(
    "range_statistics",
    f"""{PAR_SQL.replace("pr as (select index", "pp as (select index").replace("st as (select index", "fs as (select index").replace("select st.index, sc.q", "select fs.index, sc.q").replace("from st join", "from fs join").replace("sc.index = st.index and sc.q = st.q", "sc.index = fs.index and sc.q = fs.q")}, {RANGES}, {SEATED}, {WIDE}, bx as (select min(bt_index) as first_bt, {", ".join(f"{d}_lo, {d}_hi" for d in DIMS[1])} from wd group by all),
    pv as (select pt.*, Vul = 'Both' or (Vul = 'N_S' and Dealer in ('N', 'S')) or (Vul = 'E_W' and Dealer in ('E', 'W')) as vulnerable, case when Dealer in ('N', 'S') then par else -par end as own from pt join pp using (index))
    select first_bt, vulnerable, count(*) as n, round(avg(own), 4) as mean, round(stddev_pop(own), 4) as deviation from bx join pv on {" and ".join(f"{d} between {d}_lo and {d}_hi" for d in DIMS[1])} group by 1, 2""",
)
def range_statistics(spark, sf_dir):
    """Par for the dealer's side over the deals within each distinct box of the dealer's six metrics, by vulnerability."""
    dims = DIMS[1]
    # Par is worked out on the deal's own row: deals joined to deals by key may be taken for a small side and sent to the driver.
    points = _points(spark, sf_dir, ["Dealer", "Vul"]).select("index", "Dealer", "Vul", *dims, par(_tricks(), F.col("Vul"), F.col("Dealer")).alias("par"))
    own = F.when(F.col("Dealer").isin("N", "S"), F.col("par")).otherwise(-F.col("par"))
    # Both sides are read more than once, and their metrics and bounds again and again: written once.
    points = Written(points.select(*dims, A.side_vulnerable(F.col("Vul"), F.col("Dealer")).alias("vulnerable"), own.alias("own"))).df
    b = _boxes(spark, sf_dir)
    b = Written(b.groupBy(*[f"{x}_{e}" for x in dims for e in ("min", "max")]).agg(F.min("bt_index").alias("first_bt"))).df
    out = boxes.summed_area(points, dims, ["vulnerable"], "own", b, "first_bt")
    return out.select("first_bt", "vulnerable", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


# A tree of uncontested auctions by arithmetic on the part's key: two to five bids of the
# opener (the dealer, odd calls) and the responder, each followed by a pass, three passes at the end.
BIDS_SQL = """bk as (select distinct p_partkey % 9 as b1, p_partkey % 9 + 1 + p_partkey // 9 % 6 as b2, p_partkey % 9 + 2 + p_partkey // 9 % 6 + p_partkey // 54 % 5 as b3, p_partkey % 9 + 3 + p_partkey // 9 % 6 + p_partkey // 54 % 5 + p_partkey // 270 % 7 as b4, 2 + p_partkey % 3 as n from part),
en as (select distinct ([b1, b2, b3, b4])[:n] as bids from bk),
ev as (select array_to_string(list_transform(bids, lambda b: (b // 5 + 1)::text || substr('CDHSN', b % 5 + 1, 1)), '-P-') || '-P-P-P' as node, bids from en)"""


def bids_of_parts(spark, sf_dir):
    """(node, bids) of each distinct whole auction; bids from 1C, 0."""
    k = F.col("p_partkey")
    b1 = k % 9
    b2 = b1 + 1 + F.floor(k / 9) % 6
    b3 = b2 + 1 + F.floor(k / 54) % 5
    b4 = b3 + 1 + F.floor(k / 270) % 7
    ends = table(spark, sf_dir, "part").select(F.slice(F.array(*[b.cast("int") for b in (b1, b2, b3, b4)]), F.lit(1), (k % 3 + 2).cast("int")).alias("bids")).distinct()
    return ends.select(_text("bids").alias("node"), "bids")


def _signature():
    """Of an auction's bids: the last one, and whether opener or responder declares it."""
    last = F.element_at("bids", -1)
    # Declarer: the first of the side to name the strain, opener 0 or responder 1; both are the dealer's side.
    first = F.array_position(F.transform("bids", lambda b: b % 5), last % 5)
    return (last + 35 * ((first - 1) % 2)).cast("int")


def _text(bids):
    """An uncontested auction with these bids, each followed by a pass."""
    return F.concat(F.array_join(F.transform(bids, lambda b: F.concat((F.floor(b / 5) + 1).cast("string"), F.substring(F.lit("CDHSN"), b % 5 + 1, F.lit(1)))), "-P-"), F.lit("-P-P-P"))


def search_tree(spark, sf_dir):
    """Nodes with the number of their last bid, the seat that called, the signature of an end, and the signatures below."""
    ends = Written(bids_of_parts(spark, sf_dir).select("node", _signature().alias("signature"))).df
    t = F.split("node", "-")
    steps = ends.select("signature", F.explode(F.sequence(F.lit(1), F.size(t))).alias("depth"), t.alias("t"))
    steps = steps.select("signature", "depth", F.array_join(F.slice("t", F.lit(1), F.col("depth")), "-").alias("node"), F.get("t", F.col("depth") - 1).alias("call"))
    below = steps.groupBy("node", "depth", "call").agg(F.array_sort(F.collect_set("signature")).alias("signatures"))
    bid = F.when(F.col("call") != "P", (F.substring("call", 1, 1).cast("int") - 1) * 5 + F.instr(F.lit("CDHSN"), F.substring("call", 2, 1)) - 1)
    # Passes between bids ask for nothing and have one child: bids and ends are the tree.
    kept = below.select("node", bid.alias("bid"), "signatures").join(ends, "node", "left").where("bid is not null or signature is not null")
    parent = F.regexp_replace("node", "(-P-P-P|-P-[^-]*)$", "")
    depth = F.size(F.filter(F.split("node", "-"), lambda c: c != "P")) + F.col("signature").isNotNull().cast("int")
    return tree.intervals(kept.select("node", "bid", "signature", "signatures", depth.alias("depth"), F.when(depth > 1, parent).alias("parent"))).withColumnRenamed("enter", "bt_index")


def _need_sql(side: str, bid: str) -> str:
    suit = f"({side}_l)[(4 - {bid} % 5)::int]"
    return f"{side}_h >= ({bid} * 7) % 13 and {side}_h <= ({bid} * 7) % 13 + 11 and ({bid} % 5 = 4 or {suit} >= 1 + {bid} % 3)"


def _asks():
    """A bid's criteria as columns of the tree: points within eleven of a lower bound, a length of the suit (its place in S H D C; null: none); passes ask for nothing."""
    bid = F.col("bid")
    suit = F.when(bid % 5 < 4, 3 - bid % 5)
    return {"low": (bid * 7) % 13, "suit": suit.cast("int"), "need": (1 + bid % 3).cast("int")}


def _allowed():
    """Whether the hand that is to bid meets what a node asks for."""
    own = lambda x: F.when(F.col("depth") % 2 == 1, F.col(f"{x}1")).otherwise(F.col(f"{x}3"))
    points, length = own("h"), F.get(own("l"), F.col("suit"))
    return F.col("low").isNull() | (points.between(F.col("low"), F.col("low") + 11) & (F.col("suit").isNull() | (length >= F.col("need"))))


#: Deals of a task of the search.
DEALS = 32_768


def search_deals(spark, sf_dir):
    """(index, opener's and responder's points and lengths S H D C, scores by signature for the dealer's side)."""
    p = _points(spark, sf_dir, ["Dealer", "Vul"])
    hands = [*[F.col(f"HCP_{s}").alias(f"h{s}") for s in (1, 3)], *[F.array(*[F.col(f"SL_{x}_{s}") for x in "SHDC"]).alias(f"l{s}") for s in (1, 3)]]
    # Dealt to tasks by index, in which they are searched. The exchange comes after the scores:
    # joined in the same stage they would be worked out anew for each end that is reached.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-deals(spark, sf_dir).count() // DEALS))
    return scores_by_signature(p.select("index", "Dealer", "Vul", *hands)).drop("Dealer", "Vul").repartition(tasks, "index")


def scores_by_signature(deals):
    """deals (index, Dealer, Vul, ...) with scores: of the 35 contracts by the dealer, then by the dealer's partner.

    A column of the deal's row and no table to be joined: Spark takes an array for one
    element, and would broadcast 70 scores of every deal as a small side.
    """
    first = F.instr(F.lit("NESW"), F.col("Dealer")) - 1
    vulnerable = A.side_vulnerable(F.col("Vul"), F.col("Dealer")).cast("int")
    # One element, so that the lists are made once a deal: a column would be worked out anew for each of 70 scores.
    deal = F.struct(_tricks().alias("dd"), first.alias("first"), vulnerable.alias("v"))
    places = F.lit([s % 35 * 14 for s in range(70)])
    # Of each contract the place in the list of tricks: the declarer's strains, the dealer's and then the partner's.
    of = lambda d, own: F.transform(places, lambda p, i: F.get(F.lit(S.undoubled_scores()), d["v"] * 490 + p + F.get(own, i % 5 + F.when(i < 35, 0).otherwise(5))))
    side = lambda d: F.concat(F.slice(d["dd"], d["first"] * 5 + 1, 5), F.slice(d["dd"], (d["first"] + 2) % 4 * 5 + 1, 5))
    scores = F.transform(F.array(deal), lambda d: F.element_at(F.transform(F.array(side(d)), lambda own: of(d, own)), 1))
    return deals.withColumn("scores", F.element_at(scores, 1))


def auction_search(spark, sf_dir, best: int = 3) -> tuple[tree.Search, object]:
    nodes = Written(search_tree(spark, sf_dir)).df
    up = nodes.select(F.col("bt_index").alias("parent_index"), F.col("node").alias("parent"))
    edges = nodes.select("bt_index", "parent").join(up, "parent").select("parent_index", "bt_index")
    asked = nodes.withColumns(_asks()).drop("leave", "parent", "bid")
    return tree.Search(asked, edges, _allowed(), best), nodes


@query(
    "best_auctions_search",
    f"""{W}, {SEATED}, {BIDS_SQL}, dl as (select pt.index, deals.Dealer as d0, pt.Dealer, pt.Vul, HCP_1 as o_h, [SL_S_1, SL_H_1, SL_D_1, SL_C_1] as o_l, HCP_3 as r_h, [SL_S_3, SL_H_3, SL_D_3, SL_C_3] as r_l from pt join deals using (index)),
    x as (select dl.*, node, bids, bids[-1] as b, list_position(list_transform(bids, lambda v: v % 5), bids[-1] % 5) as f from dl join ev on
      ({_need_sql("o", "bids[1]")}) and ({_need_sql("r", "bids[2]")}) and (len(bids) < 3 or ({_need_sql("o", "bids[3]")})) and (len(bids) < 4 or ({_need_sql("r", "bids[4]")}))),
    y as (select index, node, (b // 5 + 1)::int as level, (b % 5)::int as strain, 0 as dbl, Vul = 'Both' or (Vul = 'N_S' and Dealer in ('N', 'S')) or (Vul = 'E_W' and Dealer in ('E', 'W')) as v,
      ((index * (((instr('NESW', Dealer) - 1 + 2 * ((f - 1) % 2)) % 4) * 5 + b % 5 + 3)) % 14)::int as tricks from x),
    z as (select index, node, ({SCORE_SQL})::int as score from y), r as (select *, row_number() over (partition by index order by score desc, node)::int as rank from z) select index, rank, node, score from r where rank <= 3""",
)
def best_auctions_search(spark, sf_dir):
    """The three best ends that each deal's hands may reach, by a search of the tree round by round."""
    search, _ = auction_search(spark, sf_dir)
    return search.run(search_deals(spark, sf_dir))


# The auction that each deal's dealer and partner bid, by arithmetic on the order's key; some of it lies in the tree.
SAID_SQL = """sb as (select index, index % 9 as b1, index % 9 + 1 + index // 9 % 7 as b2, index % 9 + 2 + index // 9 % 7 + index // 63 % 6 as b3, index % 9 + 3 + index // 9 % 7 + index // 63 % 6 + index // 378 % 7 as b4, 2 + index % 3 as n from deals),
sd as (select index, ([b1, b2, b3, b4])[:n] as bids from sb),
sa as (select index, bids, array_to_string(list_transform(bids, lambda b: (b // 5 + 1)::text || substr('CDHSN', b % 5 + 1, 1)), '-P-') || '-P-P-P' as auction from sd)"""
SIGNATURE_SQL = "(bids[-1] + 35 * ((list_position(list_transform(bids, lambda v: v % 5), bids[-1] % 5) - 1) % 2))::int"


def said(spark, sf_dir):
    """(index, Dealer, Vul, auction, signature) of each deal and the auction that it says."""
    k = F.col("index")
    b1 = k % 9
    b2 = b1 + 1 + F.floor(k / 9) % 7
    b3 = b2 + 1 + F.floor(k / 63) % 6
    b4 = b3 + 1 + F.floor(k / 378) % 7
    d = bids(spark, sf_dir).select("index", "Dealer", "Vul", F.slice(F.array(*[b.cast("int") for b in (b1, b2, b3, b4)]), F.lit(1), (k % 3 + 2).cast("int")).alias("bids"))
    return d.select("index", "Dealer", "Vul", _text("bids").alias("auction"), _signature().alias("signature"))


def whole_tree(spark, sf_dir):
    """(node, signatures) of every prefix of the tree's auctions, the root's node being ''."""
    ends = bids_of_parts(spark, sf_dir).select(F.split("node", "-").alias("t"), _signature().alias("signature"))
    steps = ends.select("signature", "t", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("n"))
    node = F.array_join(F.slice("t", F.lit(1), F.col("n")), "-")
    return steps.groupBy(node.alias("node")).agg(F.array_sort(F.collect_set("signature")).alias("signatures"))


@query(
    "auction_losses",
    f"""{PAR_SQL}, {BIDS_SQL}, {SAID_SQL}, es as (select string_split(node, '-') as t, {SIGNATURE_SQL} as sg from ev),
    tn as (select array_to_string(t[1:i], '-') as node, list(distinct sg) as sgs from es, range(0, 40) r(i) where i <= len(t) group by 1),
    ds as (select index, s.v::int as sg, (s.v % 35 // 5 + 1)::int as level, (s.v % 5)::int as strain, 0 as dbl, Vul = 'Both' or (Vul = 'N_S' and Dealer in ('N', 'S')) or (Vul = 'E_W' and Dealer in ('E', 'W')) as v,
      ((index * (((instr('NESW', Dealer) - 1 + 2 * (s.v // 35)) % 4) * 5 + s.v % 5 + 3)) % 14)::int as tricks from deals, range(70) s(v)),
    sv as (select index, sg, ({SCORE_SQL})::int as score from ds),
    ow as (select sa.index, auction, score from sa join sv on sv.index = sa.index and sv.sg = {SIGNATURE_SQL}),
    px as (select auction, i::int as step, array_to_string(string_split(auction, '-')[1:i], '-') as node from (select distinct auction from sa), range(0, 40) r(i) where i <= len(string_split(auction, '-'))),
    sh as (select auction, step, px.node, sgs from px join tn on tn.node = px.node),
    bd as (select ow.index, sh.auction, sh.step, sh.node, max(sv.score) as best from ow join sh using (auction), unnest(sh.sgs) g(x) join sv on sv.index = ow.index and sv.sg = g.x group by all),
    ls as (select index, max(step) as depth, arg_max(node, step) as node, arg_max(best, step) as best from bd group by 1),
    rc as (select index, step, best from bd union all select index, depth + 1, score from ls join ow using (index) where depth < len(string_split(auction, '-'))),
    fl as (select index, step, lag(best) over (partition by index order by step) - best as fall from rc),
    cr as (select index, arg_max(step, fall * 100 - step) as step, max(fall) as fall from fl where fall > 0 group by 1)
    select index, auction, case when depth < len(string_split(auction, '-')) then depth + 1 end as step, node, best, score, case when Dealer in ('N', 'S') then par else -par end as par, best - score as loss, cr.step as critical_step, cr.fall as critical_loss
    from ow join ls using (index) join (select index, Dealer from deals) d using (index) join pr using (index) left join cr using (index)""",
)
def auction_losses(spark, sf_dir):
    """Where each deal's auction leaves the tree, what could still be reached there, and the call that lost most; par for the dealer's side."""
    nodes = Written(whole_tree(spark, sf_dir)).df
    # Dealt round: 70 scores a deal are no work for the few tasks of a file with few row groups.
    d = said(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.when(F.col("Dealer").isin("N", "S"), F.col("_par")).otherwise(-F.col("_par"))
    told = scores_by_signature(d.withColumn("_par", par(_tricks(), F.col("Vul"), F.col("Dealer"))))
    told = told.select("index", "auction", "scores", own.alias("par"), F.get("scores", F.col("signature")).alias("score"))
    shared = divergence.shared_nodes(divergence.longest_prefix(d.select("auction"), nodes), nodes)
    out = divergence.losses(told, shared)
    return out.select("index", "auction", "step", "node", "best", "score", "par", "loss", "critical_step", "critical_loss")
