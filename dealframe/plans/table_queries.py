"""A bidding table with criteria for each seat, derived from part, and the deals against it."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import criteria as C
from dealframe.functions import dsl
from dealframe.functions import hand as H
from dealframe.operators import bidding, boxes, relational
from dealframe.plans.bridge_queries import DP, HCP, LEN, SUIT, TOK, W
from dealframe.plans.deals import AUCTIONS, bids, deals
from dealframe.plans.registry import query
from dealframe.session import table
from dealframe.written import Written


def bidding_table(spark, sf_dir):
    """bt_index, Auction, Agg_Expr_Seat_1..4: lists of criteria by arithmetic on the part's key."""
    k = F.col("p_partkey")

    def seat(s):
        text = lambda f, *v: F.format_string(f, *[x.cast("long") for x in v])
        suit = F.substring(F.lit("SHDC"), ((k + s) % 4 + 1).cast("int"), F.lit(1))
        return F.array_compact(
            F.array(
                F.when((k + s) % 11 != 0, text("HCP >= %d", (k + 3 * s) % 9)),
                text("HCP <= %d", (k + 3 * s) % 9 + 10 + k % 5),
                F.when((k + s) % 6 == 0, F.concat(F.lit("SL_"), suit, text(" >= %d", k % 4))),
                F.when((k + s) % 7 == 0, text("Total_Points > %d", k % 6)),
                F.when((k + s) % 13 == 0, F.lit("SL_S >= SL_H")),
                F.when((k + s) % 17 == 0, text("SL_D < %d", k % 5 + 2)),
                F.when((k + s) % 29 == 0, text("HCP == %d", k % 20)),
                F.when((k + s) % 31 == 0, F.lit("Balanced")),
            )
        )

    auction = F.get(F.array(*[F.lit(a) for a in AUCTIONS]), F.pmod(k * 5 + 3, F.lit(len(AUCTIONS))).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("bt_index"), auction.alias("Auction"), *[seat(s).alias(f"Agg_Expr_Seat_{s}") for s in (1, 2, 3, 4)])


def _seat_sql(s: int) -> str:
    k = f"(p_partkey + {s})"
    cells = [
        f"case when {k} % 11 <> 0 then 'HCP >= ' || ((p_partkey + {3 * s}) % 9) end",
        f"'HCP <= ' || ((p_partkey + {3 * s}) % 9 + 10 + p_partkey % 5)",
        f"case when {k} % 6 = 0 then 'SL_' || substr('SHDC', ({k} % 4 + 1)::int, 1) || ' >= ' || (p_partkey % 4) end",
        f"case when {k} % 7 = 0 then 'Total_Points > ' || (p_partkey % 6) end",
        f"case when {k} % 13 = 0 then 'SL_S >= SL_H' end",
        f"case when {k} % 17 = 0 then 'SL_D < ' || (p_partkey % 5 + 2) end",
        f"case when {k} % 29 = 0 then 'HCP == ' || (p_partkey % 20) end",
        f"case when {k} % 31 = 0 then 'Balanced' end",
    ]
    return f"list_filter([{', '.join(cells)}], lambda x: x is not null) as e{s}"


BT = f"bt as (select p_partkey as bt_index, ({AUCTIONS!r})[((p_partkey * 5 + 3) % {len(AUCTIONS)} + 1)::int] as Auction, {', '.join(_seat_sql(s) for s in (1, 2, 3, 4))} from part)"
#: Criteria as rows, with their parts.
CRIT = f"""{BT}, cr as ({" union all ".join(f"select bt_index, Auction, {s} as seat, unnest(e{s}) as c from bt" for s in (1, 2, 3, 4))}),
pr as (select *, regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 1) as name, regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 2) as op, try_cast(regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 3) as int) as v from cr)"""
METRIC_VALUES = ", ".join(f"('{m}', {lo}, {hi})" for m, (lo, hi) in C.METRICS.items())
RANGES = f"""{CRIT}, mt(metric, dlo, dhi) as (values {METRIC_VALUES}), st(seat) as (values (1), (2), (3), (4)),
rg as (select b.bt_index, st.seat, mt.metric, coalesce(max(case when op in ('>=', '==') then v when op = '>' then v + 1 end), any_value(dlo))::int as lo, coalesce(min(case when op in ('<=', '==') then v when op = '<' then v - 1 end), any_value(dhi))::int as hi
  from bt b, st, mt left join pr p on p.bt_index = b.bt_index and p.seat = st.seat and p.name = mt.metric group by 1, 2, 3)"""


def _parsed_table(spark, sf_dir):
    """(bt_index, Auction, _e1.._e4): the lists parsed, as columns that all bounds read."""
    # Dealt out: a file of one row group is no reason to parse its lists in one task.
    bt = bidding_table(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bt_index")
    return bt.select("bt_index", "Auction", *[C.parsed(F.col(f"Agg_Expr_Seat_{s}")).alias(f"_e{s}") for s in (1, 2, 3, 4)])


def _ranges(spark, sf_dir):
    bt = _parsed_table(spark, sf_dir)
    cells = [F.struct(F.lit(s).alias("seat"), F.lit(m).alias("metric"), *[x.alias(n) for n, x in zip(("lo", "hi"), C.bounds_of(f"_e{s}", m), strict=True)]) for s in (1, 2, 3, 4) for m in C.METRICS]
    return bt.select("bt_index", F.inline(F.array(*cells)))


@query("bt_criteria_ranges", f"with {RANGES} select * from rg")
def bt_criteria_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir)


DIMS = {s: [f"{m}_{s}" for m in C.METRICS] for s in (1, 2, 3, 4)}


def _boxes(spark, sf_dir):
    """A row of the table with the 48 bounds of its 24 dims."""
    bt = _parsed_table(spark, sf_dir)
    cols = [x.alias(f"{m}_{s}_{e}") for s in (1, 2, 3, 4) for m in C.METRICS for e, x in zip(("min", "max"), C.bounds_of(f"_e{s}", m), strict=True)]
    return bt.select("bt_index", *cols)


def _points(spark, sf_dir, keep=()):
    """A deal with the 24 metrics of its seats, the dealer's first, and those of its columns that are kept."""
    d = deals(spark, sf_dir)
    own = F.array(*[F.col(f"Hand_{x}") for x in "NESW"])
    first = F.instr(F.lit("NESW"), F.col("Dealer")) - 1
    d = d.select("index", *keep, *[F.get(own, F.pmod(first + s - 1, F.lit(4))).alias(f"_h{s}") for s in (1, 2, 3, 4)])
    return d.select("index", *keep, *[c.cast("int").alias(f"{m}_{s}") for s in (1, 2, 3, 4) for m, c in C.metrics(F.col(f"_h{s}")).items()])


def _hand_sql(h: str) -> str:
    f = lambda x: x.replace(SUIT, f"string_split({h}, '.')")
    return f"{{'HCP': ({f(HCP)})::int, 'SL_S': ({f(LEN)})[1]::int, 'SL_H': ({f(LEN)})[2]::int, 'SL_D': ({f(LEN)})[3]::int, 'SL_C': ({f(LEN)})[4]::int, 'Total_Points': ({f(HCP)} + {f(DP)})::int}}"


SEATED = f"""sd as (select index, auction, Dealer, Vul, [{", ".join(_hand_sql(f"Hand_{d}") for d in "NESW")}] as f, instr('NESW', Dealer) - 1 as z from deals),
pt as (select index, auction, Dealer, Vul, {", ".join(f"f[((z + {s - 1}) % 4 + 1)::int].{m} as {m}_{s}" for s in (1, 2, 3, 4) for m in C.METRICS)} from sd)"""
WIDE = "wd as (select bt_index, " + ", ".join(f"max({e}) filter (where seat = {s} and metric = '{m}') as {m}_{s}_{e}" for s in (1, 2, 3, 4) for m in C.METRICS for e in ("lo", "hi")) + " from rg group by 1)"
INSIDE = " and ".join(f"{m}_{s} between {m}_{s}_lo and {m}_{s}_hi" for s in (1, 2, 3, 4) for m in C.METRICS)


@query("deals_matching_table", f"{W}, {RANGES}, {SEATED}, {WIDE} select bt_index, count(*) as n, min(index) as first_deal, max(index) as last_deal from pt join wd on {INSIDE} group by 1")
def deals_matching_table(spark, sf_dir):
    """All deals against all rows of the table, by six metrics of four seats."""
    m = boxes.summary(_points(spark, sf_dir), _boxes(spark, sf_dir), list(DIMS.values()), "index", "bt_index")
    return m.select("bt_index", "n", F.col("first").alias("first_deal"), F.col("last").alias("last_deal"))


@query("bt_range_groups", f"with {RANGES}, {WIDE} select min(bt_index) as first_bt, count(*) as n, max(bt_index) as last_bt from wd group by " + ", ".join(f"{m}_{s}_{e}" for s in (1, 2, 3, 4) for m in C.METRICS for e in ("lo", "hi")))
def bt_range_groups(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return b.groupBy(*[c for c in b.columns if c != "bt_index"]).agg(F.min("bt_index").alias("first_bt"), F.count("*").alias("n"), F.max("bt_index").alias("last_bt")).select("first_bt", "n", "last_bt")


@query("criteria_dictionary", f"with {CRIT} select c as criterion, row_number() over (order by c) - 1 as id, n from (select c, count(*) as n from cr group by 1) x")
def criteria_dictionary(spark, sf_dir):
    bt = bidding_table(spark, sf_dir)
    every = bt.select(F.explode(F.concat(*[F.col(f"Agg_Expr_Seat_{s}") for s in (1, 2, 3, 4)])).alias("criterion")).groupBy("criterion").agg(F.count("*").alias("n"))
    return relational.with_row_index(every, ["criterion"], "id").select("criterion", "id", "n")


@query("bt_join_by_auction", f"{W}, {BT} select index, auction, f.bt_index, f.n_rows from deals left join (select Auction, min(bt_index) as bt_index, count(*) as n_rows from bt group by 1) f using (auction)")
def bt_join_by_auction(spark, sf_dir):
    bt = bidding_table(spark, sf_dir).withColumnRenamed("Auction", "auction")
    return bidding.join_by_auction(bids(spark, sf_dir).select("index", "auction"), bt, "auction", "bt_index").select("index", "auction", "bt_index", "n_rows")


OVERLAY = [("1N", ["HCP >= 8", "HCP <= 17"]), ("1S-P-2S", ["SL_S >= 3"]), ("P", ["Total_Points < 14"])]
HOLDS = """case when c = 'Balanced' then bal when c = 'SL_S >= SL_H' then f.SL_S >= f.SL_H
  when op = '>=' then x >= v when op = '<=' then x <= v when op = '>' then x > v when op = '<' then x < v when op = '==' then x = v end"""
METRIC_CASE = "case name " + " ".join(f"when '{m}' then f.{m}" for m in C.METRICS) + " end"


def _overlay_rows(spark):
    return spark.createDataFrame(OVERLAY, "partial string, added array<string>")


FIRST = f"{BT}, fb as (select * from bt where bt_index in (select min(bt_index) from bt group by Auction))"
OVERLAY_VALUES = ", ".join(f"('{p}', '{c}')" for p, cs in OVERLAY for c in cs)
#: Criteria of the first row of each auction for seat 1 and the others, the overlay's added to seat 1's, the loosest bounds kept.
MERGED = f"""{FIRST}, ov(partial, c) as (values {OVERLAY_VALUES}),
c0 as ({" union all ".join(f"select bt_index, Auction, {s} as seat, unnest(e{s}) as c from fb" for s in (1, 2, 3, 4))} union all select bt_index, Auction, 1, c from fb join ov on Auction = partial or starts_with(Auction, partial || '-')),
c1 as (select distinct *, regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 1) as name, regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 2) as op, try_cast(regexp_extract(c, '^(\\w+) (<=|>=|==|<|>) (\\w+)$', 3) as int) as v from c0),
c2 as (select * from c1 a where v is null or not exists (select 1 from c1 b where b.bt_index = a.bt_index and b.seat = a.seat and b.name = a.name and b.op = a.op and case when a.op in ('>=', '>') then b.v < a.v when a.op in ('<=', '<') then b.v > a.v else false end)),
sp as (select bt_index, seat, name, max(case when op in ('>=', '==') then v when op = '>' then v + 1 end) as lo, min(case when op in ('<=', '==') then v when op = '<' then v - 1 end) as hi from c2 where v is not null group by 1, 2, 3),
c3 as (select c2.* from c2 left join sp using (bt_index, seat, name) where v is null or lo is null or hi is null or lo <= hi)"""
BALANCED = f"(array_to_string(list_reverse_sort({LEN}), '') in ('4333', '4432') or (array_to_string(list_reverse_sort({LEN}), '') in ('5332', '5422') and (({LEN})[3] = 5 or ({LEN})[4] = 5)))"
SEAT_HANDS = f"""hs as (select index, auction, s.seat, ([Hand_N, Hand_E, Hand_S, Hand_W])[((instr('NESW', Dealer) - 1 + s.seat - 1) % 4 + 1)::int] as hand from deals, (values (1), (2), (3), (4)) s(seat)),
hf as (select index, auction, seat, {_hand_sql("hand")} as f, {BALANCED.replace(SUIT, "string_split(hand, '.')")} as bal from hs)"""


def _checked(spark, sf_dir):
    bt = bidding_table(spark, sf_dir)
    first = bt.groupBy("Auction").agg(F.min_by(F.struct(*[c for c in bt.columns if c != "Auction"]), "bt_index").alias("b")).select(F.col("Auction").alias("auction"), "b.*")
    first = bidding.overlaid(first, "auction", "Agg_Expr_Seat_1", _overlay_rows(spark))
    first = first.withColumns({f"Agg_Expr_Seat_{s}": C.loosest(F.col(f"Agg_Expr_Seat_{s}")) for s in (2, 3, 4)})
    lists = [f"Agg_Expr_Seat_{s}" for s in (1, 2, 3, 4)]
    # Written, so that each of its rows is parsed once and not beside every deal.
    first = Written(first.withColumns({c: C.parsed(F.col(c)) for c in lists})).df
    d = deals(spark, sf_dir).select("index", "auction", "Dealer", *[f"Hand_{x}" for x in "NESW"]).join(first, "auction")
    own = F.map_from_arrays(F.array(*[F.lit(x) for x in "NESW"]), F.array(*[F.col(f"Hand_{x}") for x in "NESW"]))
    seats = (1, 2, 3, 4)
    return bidding.wrong_bids(d, {s: F.element_at(own, C.seat_direction(F.col("Dealer"), s)) for s in seats}, {s: F.col(f"Agg_Expr_Seat_{s}") for s in seats}, as_json=False)


WRONG = f"""{W}, {MERGED}, {SEAT_HANDS},
bad as (select index, h.seat, list_sort(list(c)) as failed from (select h.index, h.auction, h.seat, c, name, op, v, f, bal, {METRIC_CASE} as x from hf h join c3 on c3.Auction = h.auction and c3.seat = h.seat) h where not ({HOLDS}) group by 1, 2)"""


@query(
    "wrong_bids_by_seat",
    f"""{WRONG} select d.index, {", ".join(f"coalesce(array_to_string(max(failed) filter (where seat = {s}), '; '), '') as failed_s{s}" for s in (1, 2, 3, 4))}, min(seat)::int as first_wrong_seat from deals d join fb on fb.Auction = d.auction left join bad on bad.index = d.index group by 1""",
)
def wrong_bids_by_seat(spark, sf_dir):
    w = _checked(spark, sf_dir)
    return w.select("index", *[F.array_join(F.array_sort(f"Invalid_Criteria_S{s}"), "; ").alias(f"failed_s{s}") for s in (1, 2, 3, 4)], "first_wrong_seat")


@query("wrong_bid_rates", f"{WRONG} select s.seat, count(distinct d.index) as boards, round(count(bad.index) / count(*), 6) as rate from deals d join fb on fb.Auction = d.auction cross join (values (1), (2), (3), (4)) s(seat) left join bad on bad.index = d.index and bad.seat = s.seat group by 1")
def wrong_bid_rates(spark, sf_dir):
    one = _checked(spark, sf_dir).agg(F.count("*").alias("boards"), *[F.avg(F.col(f"Wrong_Bid_S{s}").cast("int")).alias(f"r{s}") for s in (1, 2, 3, 4)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("seat"), F.col("boards"), F.round(F.col(f"r{s}"), 6).alias("rate")) for s in (1, 2, 3, 4)])))


@query("annotated_failures", f"{WRONG}, fl as (select h.index, h.seat, c || ' [' || case when c = 'Balanced' then bal::int else coalesce({METRIC_CASE}, 0) end || ']' as text, name, op, v, c, f, bal, {METRIC_CASE} as x from hf h join c3 on c3.Auction = h.auction and c3.seat = h.seat) select seat, text, count(*) as n from fl where not ({HOLDS}) group by 1, 2")
def annotated_failures(spark, sf_dir):
    w = _checked(spark, sf_dir)
    own = F.map_from_arrays(F.array(*[F.lit(x) for x in "NESW"]), F.array(*[F.col(f"Hand_{x}") for x in "NESW"]))
    cells = F.array(*[F.struct(F.lit(s).alias("seat"), F.element_at(own, C.seat_direction(F.col("Dealer"), s)).alias("hand"), F.col(f"Invalid_Criteria_S{s}").alias("bad")) for s in (1, 2, 3, 4)])
    e = w.select(F.inline(cells)).where(F.size("bad") > 0).select("seat", C.features(F.col("hand")).alias("known"), F.explode("bad").alias("c"))
    return e.groupBy("seat", C.annotated(F.col("c"), F.col("known")).alias("text")).agg(F.count("*").alias("n"))


DIRECTED = ["HCP >= 12", "SL_S >= SL_H & SL_S >= 5", "HCP + SL_S > 16", "not C_CA"]
DIRECTED_SQL = ["f.HCP >= 12", "f.SL_S >= f.SL_H and f.SL_S >= 5", "f.HCP + f.SL_S > 16", "not contains(string_split(hand, '.')[4], 'A')"]


@query(
    "directional_criteria",
    f"""{W}, h as (select Dealer, dir, hand, {_hand_sql("hand")} as f from hands), x as (select Dealer, ((instr('NESW', dir) - instr('NESW', Dealer) + 4) % 4 + 1)::int as seat, [{", ".join(f"({c})" for c in DIRECTED_SQL)}] as ok from h)
    select Dealer, seat, i.v::int as criterion, count(*) filter (where ok[i.v]) as n_true, count(*) as n from x, range(1, {len(DIRECTED) + 1}) i(v) group by 1, 2, 3""",
)
def directional_criteria(spark, sf_dir):
    """One boolean column a criterion and direction, from directional columns; then keyed by seat and dealer."""
    d = deals(spark, sf_dir)
    wide = {}
    for x in "NESW":
        h = F.col(f"Hand_{x}")
        s = H.suits(h)
        wide[f"HCP_{x}"] = H.points(h)
        wide |= {f"SL_{x}_{y}": F.length(F.get(s, F.lit(i))) for i, y in enumerate("SHDC")}
        wide |= {f"C_{x}{y}A": F.get(s, F.lit(i)).contains("A") for i, y in enumerate("SHDC")}
    d = d.withColumns(wide)
    flags = {f"{x}_{i}": dsl.compile_criteria(c, d.columns, rename=lambda n, x=x: C.directional(n, x)) for x in "NESW" for i, c in enumerate(DIRECTED)}
    one = d.groupBy("Dealer").agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    cells = F.array(*[F.struct(F.lit(x).alias("dir"), F.lit(i + 1).alias("criterion"), F.col(f"{x}_{i}").alias("n_true")) for x in "NESW" for i in range(len(DIRECTED))])
    e = one.select("Dealer", "n", F.inline(cells))
    seat = (F.pmod(F.instr(F.lit("NESW"), F.col("dir")) - F.instr(F.lit("NESW"), F.col("Dealer")), F.lit(4)) + 1).cast("int")
    return e.select("Dealer", seat.alias("seat"), "criterion", "n_true", "n")


RULES = [("1N", ["HCP >= 10", "HCP <= 22"]), ("1S", ["SL_S >= 3"]), ("1N-P-3N", ["HCP >= 6"])]


@query(
    "rejected_deals",
    f"""{W}, r(partial, seat, c, lo) as (values ('1N', 1, 'HCP >= 10', 10), ('1N', 1, 'HCP <= 22', 22), ('1S', 1, 'SL_S >= 3', 3), ('1N-P-3N', 3, 'HCP >= 6', 6)), {SEAT_HANDS},
    x as (select h.index, r.partial, r.c from hf h join r on r.seat = h.seat and (h.auction = r.partial or starts_with(h.auction, r.partial || '-')) where not case when c like 'HCP >=%' then f.HCP >= lo when c like 'HCP <=%' then f.HCP <= lo else f.SL_S >= lo end)
    select index, partial, array_to_string(list_sort(list(c)), '; ') as failed from x group by 1, 2""",
)
def rejected_deals(spark, sf_dir):
    """Deals that a rule (partial auction, criteria of the seat that makes its last call) rejects, with what fails."""
    rules = spark.createDataFrame([(p, len(p.split("-")), c) for p, c in RULES], "partial string, seat int, criteria array<string>")
    t = F.split("auction", "-")
    own = F.map_from_arrays(F.array(*[F.lit(x) for x in "NESW"]), F.array(*[F.col(f"Hand_{x}") for x in "NESW"]))
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size(t)), lambda n: F.array_join(F.slice(t, F.lit(1), n), "-"))).alias("partial")
    d = deals(spark, sf_dir).select("index", "Dealer", own.alias("own"), steps)
    # The rules are a hand-written list.
    d = d.join(F.broadcast(rules), "partial")
    bad = C.failing(F.col("criteria"), C.features(F.element_at("own", C.seat_direction(F.col("Dealer"), (F.col("seat") - 1) % 4 + 1))))
    return d.select("index", "partial", F.array_join(F.array_sort(bad), "; ").alias("failed")).where("failed <> ''")


NODE_SQL = f"nd as (select node, parent, call, depth, sum(n)::bigint as complete_below from (select array_to_string({TOK}[1:i], '-') as node, case when i > 1 then array_to_string({TOK}[1:i - 1], '-') else '' end as parent, {TOK}[i] as call, i::int as depth, count(*) as n from deals, range(1, 16) r(i) where i <= len({TOK}) group by all) x group by 1, 2, 3, 4), nx as (select *, row_number() over (order by node) - 1 as bt_index from nd)"


def _table(spark, sf_dir):
    return bidding.nodes(bids(spark, sf_dir).select(A.tokens(F.col("auction")).alias("t")), "t")


@query("bt_nodes", f"{W}, {NODE_SQL} select bt_index, node, parent, call, depth, complete_below from nx")
def bt_nodes(spark, sf_dir):
    return _table(spark, sf_dir).select("bt_index", "node", "parent", "call", "depth", "complete_below")


@query("bt_edges", f"{W}, {NODE_SQL}, e as (select p.bt_index as parent_index, c.bt_index, c.call from nx c left join nx p on p.node = c.parent), k as (select parent_index, count(*) as n_children from e where parent_index is not null group by 1) select e.parent_index, e.bt_index, e.call, coalesce(k.n_children, 0) as n_children from e left join k on k.parent_index = e.bt_index")
def bt_edges(spark, sf_dir):
    e = bidding.edges(_table(spark, sf_dir))
    kids = e.where("parent_index is not null").groupBy(F.col("parent_index").alias("bt_index")).agg(F.count("*").alias("n_children"))
    return e.join(kids, "bt_index", "left").select("parent_index", "bt_index", "call", F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query("bt_auction_walk", f"{W}, {NODE_SQL} select d.index, nx.bt_index, nx.depth from deals d join nx on nx.node = d.auction")
def bt_auction_walk(spark, sf_dir):
    """Each deal's auction walked to its node."""
    return bids(spark, sf_dir).select("index", F.col("auction").alias("node")).join(_table(spark, sf_dir), "node").select("index", "bt_index", "depth")


LEARNED_SQL = f"lr as (select distinct array_to_string({TOK}[1:2], '-') as prefix, 'HCP >= ' || ((length(auction) * 3) % 9) as criterion from deals union select distinct {TOK}[1], 'SL_H <= ' || (length(auction) % 5 + 4) from deals)"


@query(
    "compiled_rules",
    f"""{W}, {BT}, {LEARNED_SQL}, b as (select bt_index, Auction, c.x as c, regexp_extract(c.x, '^(\\w+) ([<>=])', 1) || regexp_extract(c.x, '^(\\w+) ([<>=])', 2) as side, try_cast(regexp_extract(c.x, '(\\w+)$', 1) as int) as v from bt, unnest(e1) c(x)),
    l as (select distinct bt_index, criterion as c, regexp_extract(criterion, '^(\\w+) ([<>=])', 1) || regexp_extract(criterion, '^(\\w+) ([<>=])', 2) as side, regexp_extract(criterion, '(\\d+)$', 1)::int as v from bt join lr on Auction = prefix or starts_with(Auction, prefix || '-')),
    f as (select * from l where not exists (select 1 from b where b.bt_index = l.bt_index and b.side = l.side and b.v is not null)),
    k as (select bt_index, side, case when side like '%>' then min(v) else max(v) end as v from f group by 1, 2), kk as (select f.bt_index, f.c from f join k using (bt_index, side, v)),
    m as (select bt_index, c from b union select bt_index, c from kk)
    select bt_index, count(*) as n_merged, array_to_string(list_sort(list(c)), '; ') as merged from m group by 1""",
)
def compiled_rules(spark, sf_dir):
    t = A.tokens(F.col("auction"))
    a = bids(spark, sf_dir).select("auction").distinct()
    long = F.length("auction")
    rules = a.select(F.array_join(F.slice(t, 1, 2), "-").alias("prefix"), F.format_string("HCP >= %d", (long * 3) % 9).alias("criterion")).unionByName(a.select(F.get(t, F.lit(0)).alias("prefix"), F.format_string("SL_H <= %d", long % 5 + 4).alias("criterion")))
    out = bidding.compile_rules(bidding_table(spark, sf_dir), rules, "Auction", "Agg_Expr_Seat_1")
    return out.select("bt_index", F.size("merged").cast("long").alias("n_merged"), F.array_join(F.array_sort("merged"), "; ").alias("merged"))


@query(
    "criteria_audit",
    f"""with {RANGES}, nm as (select bt_index, seat, count(*) as n, bool_or(name in ('HCP', 'Total_Points')) as strong, bool_or(name like 'SL_%') as lens, bool_or(name = 'HCP') as h, bool_or(name = 'Total_Points') as t,
      bool_or(name = 'HCP' and op in ('<=', '<', '==')) as hb, bool_or(name = 'Total_Points' and op in ('<=', '<', '==')) as tb from pr where seat = 1 group by 1, 2),
    w as (select nm.*, (select hi - lo from rg where rg.bt_index = nm.bt_index and rg.seat = 1 and metric = 'HCP') as hw from nm join bt using (bt_index) where string_split(Auction, '-')[1] <> 'P'),
    fl as (select bt_index, unnest(list_filter([case when not strong then 'NO_STRENGTH/high' end, case when h and not hb then 'UNBOUNDED_HCP/low' end, case when t and not tb then 'UNBOUNDED_TOTAL_POINTS/low' end, case when h and hb and hw > 10 then 'WIDE_HCP_RANGE/low' end, case when not lens then 'NO_SUIT_LENGTH/medium' end], lambda x: x is not null)) as x from w)
    select split_part(x, '/', 1) as flag, split_part(x, '/', 2) as severity, count(*) as n, min(bt_index) as first_bt from fl group by 1, 2""",
)
def criteria_audit(spark, sf_dir):
    bt = bidding_table(spark, sf_dir).withColumn("call", F.get(F.split("Auction", "-"), F.lit(0)))
    return bidding.audit(bt, "Agg_Expr_Seat_1", "call").groupBy("flag", "severity").agg(F.count("*").alias("n"), F.min("bt_index").alias("first_bt"))


@query(
    "criteria_contradictions",
    f"""with {RANGES}, x as (select bt_index, seat, bool_or(lo > hi) as imp, max(lo) filter (where metric = 'HCP') > max(hi) filter (where metric = 'Total_Points') as ex, sum(lo) filter (where metric like 'SL_%') > 13 as gt, sum(least(hi, 13)) filter (where metric like 'SL_%') < 13 as lt, max(lo) filter (where metric like 'SL_%') >= 8 as ext from rg group by 1, 2),
    k as (select bt_index, seat, unnest(list_filter([case when imp then 'IMPOSSIBLE_RANGE' end, case when ex then 'HCP_EXCEEDS_TP' end, case when gt then 'SUIT_LENGTHS_EXCEED_13' end, case when lt then 'SUIT_LENGTHS_BELOW_13' end, case when ext then 'EXTREME_SUIT_LENGTH' end], lambda x: x is not null)) as kind from x)
    select seat::int as seat, kind, count(*) as n from k group by 1, 2""",
)
def criteria_contradictions(spark, sf_dir):
    bt = bidding_table(spark, sf_dir)
    long = bt.select("bt_index", F.inline(F.array(*[F.struct(F.lit(s).alias("seat"), F.col(f"Agg_Expr_Seat_{s}").alias("criteria")) for s in (1, 2, 3, 4)])))
    return bidding.contradictions(long, "criteria").groupBy("seat", "kind").agg(F.count("*").alias("n"))
