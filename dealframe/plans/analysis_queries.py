"""Frame shapes, auction helpers, error analysis, models and rankings over derived deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import hand as H
from dealframe.functions import scoring as S
from dealframe.operators import analysis, bidding, relational, stats, tournament
from dealframe.plans.bridge_queries import HCP, IMP_VALUES, LEN, SCORE_SQL, SUIT, TOK, W
from dealframe.plans.deals import AUCTIONS, VUL_SQL, bids, contract_of, deals, hands
from dealframe.plans.registry import query
from dealframe.session import table


@query("row_index", "select c_custkey, (row_number() over (order by c_acctbal, c_custkey) - 1)::bigint as idx from customer")
def row_index(spark, sf_dir):
    return relational.with_row_index(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "idx").select("c_custkey", "idx")


@query(
    "positional_join",
    "with a as (select s_suppkey, row_number() over (order by s_acctbal desc, s_suppkey) - 1 as i from supplier), b as (select p_partkey, row_number() over (order by p_retailprice, p_partkey) - 1 as i from part) select coalesce(a.i, b.i)::bigint as index, s_suppkey, p_partkey from a full join b on a.i = b.i",
)
def positional_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (-F.col("s_acctbal")).alias("_b"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return relational.hstack(s, p, ["_b", "s_suppkey"], ["p_retailprice", "p_partkey"]).select("index", "s_suppkey", "p_partkey")


@query("regex_columns", "select l_returnflag, round(sum(l_extendedprice + l_discount), 2) as total from lineitem group by 1")
def regex_columns(spark, sf_dir):
    t = relational.select_matching(table(spark, sf_dir, "lineitem"), "l_(extended|dis)[a-z]+", "l_returnflag")
    money = relational.horizontal_sum(*[F.col(c) for c in t.columns if c != "l_returnflag"])
    return t.groupBy("l_returnflag").agg(F.round(F.sum(money), 2).alias("total"))


@query("implication_filter", "select l_returnflag, count(*) as n from lineitem where not (l_quantity > 25) or l_discount >= 0.05 group by 1")
def implication_filter(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.where(relational.implies(F.col("l_quantity") > 25, F.col("l_discount") >= 0.05)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("id_intersection", "select l_suppkey from lineitem where l_returnflag = 'A' intersect select l_suppkey from lineitem where l_returnflag = 'R' intersect select l_suppkey from lineitem where l_returnflag = 'N'")
def id_intersection(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey").where(F.col("l_returnflag").isin("A", "R", "N"))
    return relational.common_items(t, "l_returnflag", "l_suppkey")


@query("anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def anti_join(spark, sf_dir):
    """Customers without a large order."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_totalprice > 450000").select("o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("multi_key_join", "select o_orderpriority, count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem join orders on l_orderkey = o_orderkey and l_shipdate >= o_orderdate and l_linenumber % 3 = o_custkey % 3 group by 1")
def multi_key_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).alias("m"), "l_shipdate", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).alias("m"), "o_orderdate", "o_orderpriority")
    j = li.join(o, ["k", "m"]).where("l_shipdate >= o_orderdate")
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("supplier_pairs", "select a.s_nationkey as nation, count(*) as pairs, round(max(abs(a.s_acctbal - b.s_acctbal)), 2) as widest from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey group by 1")
def supplier_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    # Number of pairs and widest gap follow from a nation's count and its extremes.
    g = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.max("s_acctbal") - F.min("s_acctbal"), 2).alias("widest"))
    return g.where("n > 1").select("nation", F.expr("n * (n - 1) div 2").alias("pairs"), "widest")


@query("except_rows", "select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A' except select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R'")
def except_rows(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    side = lambda f: t.where(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey")
    return side("A").subtract(side("R"))


@query("strict_lookup", "select case r_name when 'ASIA' then 'A' when 'EUROPE' then 'E' else '?' end as code, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1")
def strict_lookup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(relational.lookup(F.col("r_name"), {"ASIA": "A", "EUROPE": "E"}, "?").alias("code")).agg(F.count("*").alias("n"))


@query("value_shares", "with d(v) as (values (1), (2), (3), (4), (5), (6), (7), (8), (9)), g as (select l_returnflag, count(*) as t from lineitem group by 1) select g.l_returnflag, d.v::int as l_linenumber, count(l.l_orderkey) as n, round(count(l.l_orderkey) / any_value(g.t), 6) as share from g cross join d left join lineitem l on l.l_returnflag = g.l_returnflag and l.l_linenumber = d.v group by 1, 2")
def value_shares(spark, sf_dir):
    s = relational.value_shares(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), ["l_returnflag"], "l_linenumber", list(range(1, 10)))
    return s.select("l_returnflag", "l_linenumber", "n", F.round("share", 6).alias("share"))


@query("nulls_last_sort", "select c_custkey, case when c_nationkey % 3 = 0 then null else c_nationkey end as k from customer order by k asc nulls last, c_acctbal desc, c_custkey limit 30")
def nulls_last_sort(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")).alias("k"))
    return c.orderBy(F.asc_nulls_last("k"), F.desc("c_acctbal"), "c_custkey").limit(30).select("c_custkey", "k")


@query("math_and_null_functions", "select round(sum(case when l_linenumber % 2 = 0 then floor(l_quantity / 2) else ceil(l_quantity / 2) end), 2)::double as halves, round(sum(ln(l_quantity)), 4) as logs, round(sum(least(greatest(l_discount, 0.02), 0.06)), 4) as clipped, sum(case when l_linenumber = 3 then 0 else l_linenumber end)::bigint as nan_to_zero, sum(abs(l_linenumber - 4))::bigint as gaps from lineitem")
def math_and_null_functions(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    # A NaN is a value: it becomes 0 by nanvl, where a null would by coalesce.
    nan = F.nanvl(F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_linenumber").cast("double")), F.lit(0.0))
    half = F.when(F.col("l_linenumber") % 2 == 0, F.floor(F.col("l_quantity") / 2)).otherwise(F.ceil(F.col("l_quantity") / 2))
    return t.agg(
        F.round(F.sum(half), 2).cast("double").alias("halves"),
        F.round(F.sum(F.log("l_quantity")), 4).alias("logs"),
        F.round(F.sum(F.least(F.greatest("l_discount", F.lit(0.02)), F.lit(0.06))), 4).alias("clipped"),
        F.sum(nan).cast("long").alias("nan_to_zero"),
        F.sum(F.abs(F.col("l_linenumber") - 4)).cast("long").alias("gaps"),
    )


@query("hash_and_json", "select o_orderpriority, sha256(o_orderpriority || '|' || o_orderstatus) as digest, '{\"p\":\"' || o_orderpriority || '\",\"n\":' || count(*) || '}' as row from orders group by o_orderpriority, o_orderstatus")
def hash_and_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return o.select("o_orderpriority", F.sha2(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), 256).alias("digest"), F.to_json(F.struct(F.col("o_orderpriority").alias("p"), "n")).alias("row"))


MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()


@query("french_dates", f"select o_orderkey, day(o_orderdate) || ' ' || ({MONTHS!r})[month(o_orderdate)] || ' ' || year(o_orderdate) as text, o_orderdate::date as day from orders")
def french_dates(spark, sf_dir):
    """Dates written in French and read back."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", F.day("o_orderdate").cast("string"), F.get(names, F.month("o_orderdate") - 1), F.year("o_orderdate").cast("string")).alias("text"))
    part = lambda i: F.get(F.split("text", " "), F.lit(i))
    return o.select("o_orderkey", "text", F.make_date(part(2).cast("int"), F.array_position(names, part(1)).cast("int"), part(0).cast("int")).alias("day"))


@query(
    "opening_seat_and_leader",
    f"""{W}, x as (select index, Dealer, {TOK} as t, decl from deals), y as (select *, list_position(list_transform(t, lambda c: c <> 'P'), true) as f, list_position(list_transform(t, lambda c: regexp_matches(c, '^[1-7]')), true) as b from x)
    select index, case when b > 0 then substr('NESW', ((instr('NESW', Dealer) - 1 + b - 1) % 4 + 1)::int, 1) end as opener, case when decl is not null then substr('NESW', (instr('NESW', decl) % 4 + 1)::int, 1) end as leader, t[3] as third_call, coalesce(f > 0 and (f - 1) % 4 = 1, false) as opened_second from y""",
)
def opening_seat_and_leader(spark, sf_dir):
    t, d = A.tokens(F.col("auction")), F.col("Dealer")
    told = {"opener": A.opener(t, d), "leader": A.leader(t, d), "third_call": A.bid_at_seat(t, 3), "opened_second": A.opens_at_seat(t, 2)}
    return bidding.once_each(bids(spark, sf_dir).select("index", "auction", "Dealer"), ["auction", "Dealer"], told).select("index", *told)


@query(
    "vulnerability_codes",
    f"""{W}, t(v, k, kk) as (values ('None', 'None', 0), ('ns', 'N_S', 1), ('E-W', 'E_W', 2), ('All', 'Both', 3), ('?', null, null)), x as (select (['None', 'ns', 'E-W', 'All', '?'])[(index % 5 + 1)::int] as v, Dealer from deals)
    select x.v, x.Dealer as dealer, k, kk, case when k = 'Both' or (k = 'N_S' and x.Dealer in ('N', 'S')) or (k = 'E_W' and x.Dealer in ('E', 'W')) then 'V' else 'NV' end as b, count(*) as n from x join t on x.v = t.v group by all""",
)
def vulnerability_codes(spark, sf_dir):
    """Vulnerability as written in several ways, its code, and the bucket of the dealer's side, over all deals."""
    v = F.get(F.array(*[F.lit(x) for x in ("None", "ns", "E-W", "All", "?")]), (F.col("index") % 5).cast("int"))
    t = bids(spark, sf_dir).groupBy(v.alias("v"), F.col("Dealer").alias("dealer")).agg(F.count("*").alias("n"))
    k = A.normal_vul(F.col("v"))
    return t.select("v", "dealer", A.decode_vul(A.encode_vul(k)).alias("k"), A.encode_vul(k).alias("kk"), A.vul_bucket(k, F.col("dealer")).alias("b"), "n")


@query(
    "suit_arrays",
    f"""{W}, x as (select index, dir, [length(string_split(hand, '.')[4]), length(string_split(hand, '.')[3]), length(string_split(hand, '.')[2]), length(string_split(hand, '.')[1])] as n from hands)
    select index, dir, array_to_string(n, '-') as cdhs, array_to_string(list_reverse_sort(n), '') as sorted, array_to_string(list_transform(list_sort(list_transform(n, lambda v, i: (13 - v) * 4 + i - 1)), lambda z: z % 4), '') as order_by_length, substr('SHDC', list_position([n[4], n[3], n[2], n[1]], list_max(n))::int, 1) as longest from x""",
)
def suit_arrays(spark, sf_dir):
    """Lengths in C, D, H, S order, sorted, their stable order by length, and the first longest suit (S, H, D, C)."""
    s = H.lengths(H.suits(F.col("hand")))
    d = hands(spark, sf_dir).select("index", "dir", F.reverse(s).alias("n"), s.alias("s"))
    text = lambda a, sep: F.array_join(F.transform(a, lambda x: x.cast("string")), sep)
    keyed = F.array_sort(F.transform("n", lambda v, i: (13 - v) * 4 + i))
    first = F.array_position("s", F.array_max("s")).cast("int")
    return d.select("index", "dir", text("n", "-").alias("cdhs"), text(F.reverse(F.array_sort("n")), "").alias("sorted"), text(F.transform(keyed, lambda z: z % 4), "").alias("order_by_length"), F.substring(F.lit("SHDC"), first, F.lit(1)).alias("longest"))


@query(
    "pair_points",
    f"""{W}, x as (select index, dir, ({HCP.replace(SUIT, "string_split(hand, '.')")})::int as p, length(string_split(hand, '.')[1]) as sl from hands)
    select index, sum(p) filter (where dir in ('N', 'S'))::bigint as hcp_ns, sum(p) filter (where dir in ('E', 'W'))::bigint as hcp_ew, sum(sl) filter (where dir in ('N', 'S'))::bigint as spades_ns, 26::bigint as total_lengths_ns from x group by 1""",
)
def pair_points(spark, sf_dir):
    d = deals(spark, sf_dir)
    spades = lambda x: F.length(F.get(H.suits(F.col(f"Hand_{x}")), F.lit(0)))
    cards = lambda x: F.length(F.replace(F.col(f"Hand_{x}"), F.lit("."), F.lit("")))
    both = lambda f, a, b: (f(a) + f(b)).cast("long")
    p = lambda x: H.points(F.col(f"Hand_{x}"))
    return d.select("index", both(p, "N", "S").alias("hcp_ns"), both(p, "E", "W").alias("hcp_ew"), both(spades, "N", "S").alias("spades_ns"), both(cards, "N", "S").alias("total_lengths_ns"))


CODES = "".join
BRS_SQL = "list_sum(list_transform(range(1, 5), lambda i: list_sum(list_transform(string_split('AKQJT98765432', ''), lambda r, j: case when r <> '' and contains(string_split(hand, '.')[i], r) then (1::hugeint << (52 - ((i - 1) * 13 + j))) else 0 end))))"


@query("hand_codes", f"{W} select index, dir, ({BRS_SQL})::bigint as bits, length(replace(hand, '.', ''))::int as cards from hands")
def hand_codes(spark, sf_dir):
    """A hand as 52 bits, the ace of spades highest, and read back from them."""
    h = hands(spark, sf_dir)
    coded = h.select("index", "dir", H.encode_bits(F.col("hand")).alias("bits"), "hand")
    return coded.select("index", "dir", "bits", F.length(F.replace(H.decode_bits(F.col("bits")), F.lit("."), F.lit(""))).alias("cards"))


@query(
    "dd_scores",
    f"""{W}, g as (select l.v::int as level, s.v::int as strain from range(1, 8) l(v), range(5) s(v)), x as (select index, g.level, g.strain, 0 as dbl, Vul = 'Both' or (Vul = 'N_S' and p.d in ('N', 'S')) or (Vul = 'E_W' and p.d in ('E', 'W')) as v, p.d as dir, ((index * (instr('NESW', p.d) * 5 - 5 + g.strain + 3)) % 14)::int as tricks from deals, g, (values ('N'), ('E'), ('S'), ('W')) p(d)),
      s as (select index, dir, level, strain, ({SCORE_SQL})::int as sc from x), r as (select *, row_number() over (partition by index, dir order by sc desc, level, strain) as r from s)
    select index, dir, sc as best_score, level::varchar || substr('CDHSN', strain + 1, 1) as best_contract from r where r = 1""",
)
def dd_scores(spark, sf_dir):
    """Of the 35 contracts of each declarer the best by double-dummy score, within the row."""
    d = bids(spark, sf_dir).select("index", "Vul", F.explode(F.array(*[F.lit(x) for x in "NESW"])).alias("dir"))
    seat = F.instr(F.lit("NESW"), F.col("dir")) - 1
    v = A.side_vulnerable(F.col("Vul"), F.col("dir"))
    d = d.select("index", "dir", v.alias("v"), *[((F.col("index") * (seat * 5 + s + 3)) % 14).cast("int").alias(f"t{s}") for s in range(5)])
    cells = [F.struct(S.score(F.lit(lv), F.lit(s), F.lit(0), F.col("v"), F.col(f"t{s}")).alias("sc"), F.lit(-lv).alias("l"), F.lit(-s).alias("s"), F.lit(f"{lv}{'CDHSN'[s]}").alias("name")) for lv in range(1, 8) for s in range(5)]
    return d.select("index", "dir", F.array_max(F.array(*cells)).alias("b")).select("index", "dir", F.col("b.sc").alias("best_score"), F.col("b.name").alias("best_contract"))


PAR = "(index * 37) % 1200 - 600"
FLAT = [contract_of(a) for a in AUCTIONS]
CHOSEN_SQL = f"""ch as (select index, Dealer, Vul, level, strain, dbl, decl, tricks, {PAR} as par, (index // 7 % 7 + 1)::int as plevel, (index // 3 % 5)::int as pstrain, (index % 2)::int as pdbl, substr('NESW', (index // 2 % 4 + 1)::int, 1) as pdecl from deals),
cs as (select *, coalesce(case when decl in ('N', 'S') then ({SCORE_SQL}) else -({SCORE_SQL}) end, 0)::int as score from (select *, {VUL_SQL} as v from ch)),
zz as (select *, case when level is null then 0 when level = 7 then 4 when level = 6 then 3 when level = 5 or (level = 4 and strain >= 2) or (level = 3 and strain = 4) then 2 else 1 end as z, case when plevel = 7 then 4 when plevel = 6 then 3 when plevel = 5 or (plevel = 4 and pstrain >= 2) or (plevel = 3 and pstrain = 4) then 2 else 1 end as pz,
  coalesce((decl in ('N', 'S')) = (pdecl in ('N', 'S')), false) as ours, coalesce((level - 1) * 5 + strain, -1) as rk, (plevel - 1) * 5 + pstrain as prk from cs),
er as (select *, case when score < par then case when level is not null and not ours and pdbl > 0 then 'missed_sacrifice' when level is null then 'premature_pass' when ours and strain <> pstrain and z = pz then 'wrong_strain' when rk > prk then 'overbid' when rk < prk then 'underbid' else 'other' end end as family from zz)"""


def _judged(spark, sf_dir):
    d = bids(spark, sf_dir)
    k = F.col("index")
    v = A.side_vulnerable(F.col("Vul"), F.col("decl"))
    sc = S.score(F.col("level"), F.col("strain"), F.col("dbl"), v, F.col("tricks"))
    score = F.coalesce(F.when(F.col("decl").isin("N", "S"), sc).otherwise(-sc), F.lit(0))
    par = (k * 37) % 1200 - 600
    best = F.struct((F.floor(k / 7) % 7 + 1).cast("int").alias("level"), (F.floor(k / 3) % 5).cast("int").alias("strain"), (k % 2).cast("int").alias("dbl"), F.substring(F.lit("NESW"), (F.floor(k / 2) % 4 + 1).cast("int"), F.lit(1)).alias("declarer"))
    chosen = F.struct("level", "strain", "dbl", F.col("decl").alias("declarer"))
    d = d.select("index", "Dealer", "auction", score.alias("score"), par.alias("par"), chosen.alias("chosen"), best.alias("best"))
    return d.withColumn("family", analysis.error_family(F.col("chosen"), F.col("best"), F.col("score"), F.col("par")))


@query("auction_errors", f"{W}, {CHOSEN_SQL} select index, score, par, family from er")
def auction_errors(spark, sf_dir):
    return _judged(spark, sf_dir).select("index", "score", "par", "family")


IMP_JOIN = f"join (values {IMP_VALUES}) t(lo, hi, imp) on abs(par - score) between lo and hi"


@query("auction_error_summary", f"{W}, {CHOSEN_SQL} select Dealer, family, count(*) as n, sum(imp)::bigint as \"IMP_Loss\", sum(greatest(par - score, 0))::bigint as \"EV_Loss\", (sum(imp) * 1000 + sum(greatest(par - score, 0)))::bigint as \"Priority_Score\" from er {IMP_JOIN} where family is not null group by 1, 2")
def auction_error_summary(spark, sf_dir):
    j = _judged(spark, sf_dir).withColumn("gap", F.col("par") - F.col("score")).withColumn("imps", S.imp(F.col("gap")))
    return analysis.error_summary(j, "family", ["Dealer"], "imps", "gap").select("Dealer", "family", "n", "IMP_Loss", "EV_Loss", "Priority_Score")


@query("worst_mistakes", f"{W}, {CHOSEN_SQL} select index, family, (par - score)::bigint as loss from er where family is not null order by loss desc, index limit 20")
def worst_mistakes(spark, sf_dir):
    j = _judged(spark, sf_dir).where("family is not null")
    return j.select("index", "family", (F.col("par") - F.col("score")).cast("long").alias("loss")).orderBy(F.desc("loss"), "index").limit(20)


def _passive_sql(i: int) -> str:
    """The Passive model's contract of an auction: its first bid, undoubled, by the one who made it."""
    return "[" + ", ".join("null" if (x := next(((int(c[0]), "CDHSN".index(c[1]), k % 4) for k, c in enumerate(a.split("-")) if c[0].isdigit()), None)) is None else str(x[i]) for a in AUCTIONS) + "]"


ARENA_SQL = f"""a1 as (select index, coalesce(case when decl in ('N', 'S') then ({SCORE_SQL}) else -({SCORE_SQL}) end, 0)::int as score_1 from (select *, {VUL_SQL} as v from deals)),
p0 as (select index, Dealer, Vul, tricks, 0 as dbl, ({_passive_sql(0)})[(index % {len(AUCTIONS)} + 1)::int] as level, ({_passive_sql(1)})[(index % {len(AUCTIONS)} + 1)::int] as strain, substr('NESW', ((instr('NESW', Dealer) - 1 + ({_passive_sql(2)})[(index % {len(AUCTIONS)} + 1)::int]) % 4 + 1)::int, 1) as decl from deals),
a2 as (select index, coalesce(case when decl in ('N', 'S') then ({SCORE_SQL}) else -({SCORE_SQL}) end, 0)::int as score_2 from (select *, {VUL_SQL} as v from p0)),
ar as (select index, score_1, score_2, score_1 - score_2 as diff, (sign(score_1 - score_2) * imp)::int as imps from a1 join a2 using (index) join (values {IMP_VALUES}) t(lo, hi, imp) on abs(score_1 - score_2) between lo and hi)"""


def _arena(spark, sf_dir):
    return analysis.arena(bids(spark, sf_dir), "Actual", "Passive", "index", F.col("tricks"))


@query("model_arena", f"{W}, {ARENA_SQL} select index, score_1, score_2, diff, imps from ar")
def model_arena(spark, sf_dir):
    return _arena(spark, sf_dir).select("index", "score_1", "score_2", "diff", "imps")


@query("arena_summary", f"{W}, {ARENA_SQL} select count(*) as boards, count(*) filter (where diff > 0) as wins, count(*) filter (where diff = 0) as ties, sum(imps)::bigint as imps, round(avg(diff), 4) as avg_diff from ar")
def arena_summary(spark, sf_dir):
    a = _arena(spark, sf_dir)
    return a.agg(F.count("*").alias("boards"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") == 0).alias("ties"), F.sum("imps").alias("imps"), F.round(F.avg("diff"), 4).alias("avg_diff"))


@query("arena_running_imps", f"{W}, {ARENA_SQL} select index, (index // 64)::bigint as match, sum(imps) over (partition by index // 64 order by index)::bigint as total from ar")
def arena_running_imps(spark, sf_dir):
    a = _arena(spark, sf_dir).select("index", F.floor(F.col("index") / 64).alias("match"), "imps")
    return analysis.running_board_totals(a, "match", "index", "imps", "total").select("index", "match", "total")


@query("bidding_models", f"{W} select m.name, count(*) as n, count(*) filter (where case m.name when 'Actual' then level is not null else regexp_matches(auction, '^((P|X|XX)-)*[1-7][CDHSN]') end) as n_contracts from deals, (values ('Actual'), ('Passive')) m(name) group by 1")
def bidding_models(spark, sf_dir):
    """Each registered model, the deals that it bids, and how many of them it brings to a contract."""
    d = bids(spark, sf_dir)
    out = None
    for name in analysis.models():
        bid = analysis.run_model(name, d).select(F.lit(name).alias("name"), A.contract(A.tokens(F.col("auction_model"))).rlike("^[1-7]").alias("c"))
        out = bid if out is None else out.unionByName(bid)
    return out.groupBy("name").agg(F.count("*").alias("n"), F.count_if("c").alias("n_contracts"))


@query(
    "rank_next_bids",
    f"""{W}, st as (select index, case when i.v > 1 then array_to_string({TOK}[1:i.v - 1], '-') else '' end as node, {TOK}[i.v] as call, {PAR} as par, substr('NESW', ((instr('NESW', Dealer) - 1 + i.v - 1) % 4 + 1)::int, 1) as dir, Vul, coalesce(case when decl in ('N', 'S') then ({SCORE_SQL}) else -({SCORE_SQL}) end, 0)::int as score from (select *, {VUL_SQL} as v from deals), range(1, 16) i(v) where i.v <= len({TOK})),
      g as (select node, call, count(*) filter (where not vv) as n_nv, count(*) filter (where vv) as n_v, sum(case when not vv then par else 0 end) / count(*) as par_nv, sum(case when vv then par else 0 end) / count(*) as par_v, avg(par) as avg_par, avg(score) as ev, stddev_samp(score) as ev_std from (select *, Vul = 'Both' or (Vul = 'N_S' and dir in ('N', 'S')) or (Vul = 'E_W' and dir in ('E', 'W')) as vv from st) group by 1, 2)
    select node, call, n_nv, n_v, round(par_nv, 4) as par_nv, round(par_v, 4) as par_v, round(avg_par, 4) as avg_par, round(ev, 4) as ev, round(ev_std, 4) as ev_std, row_number() over (partition by node order by avg_par desc, call)::int as rank from g""".replace("i.v", "i.w").replace("i(v)", "i(w)"),
)
def rank_next_bids(spark, sf_dir):
    v = A.side_vulnerable(F.col("Vul"), F.col("decl"))
    sc = S.score(F.col("level"), F.col("strain"), F.col("dbl"), v, F.col("tricks"))
    score = F.coalesce(F.when(F.col("decl").isin("N", "S"), sc).otherwise(-sc), F.lit(0))
    d = bids(spark, sf_dir).select("Dealer", "Vul", ((F.col("index") * 37) % 1200 - 600).alias("par"), score.alias("score"), A.tokens(F.col("auction")).alias("t"))
    e = d.select("Dealer", "Vul", "par", "score", "t", F.posexplode("t").alias("i", "call"))
    node = F.array_join(F.slice("t", F.lit(1), F.col("i")), "-")
    vul = A.side_vulnerable(F.col("Vul"), A.next_direction(F.col("Dealer"), F.col("i")))
    e = e.select(node.alias("node"), "call", "par", "score", vul.alias("vul"))
    r = analysis.rank_next_bids(e, ["node", "call"], F.col("vul"), F.col("par"), F.col("score"))
    return r.select("node", "call", "n_nv", "n_v", *[F.round(c, 4).alias(c) for c in ("par_nv", "par_v", "avg_par", "ev", "ev_std")], "rank")


@query("auction_divergence", f"{W} select auction, case when auction = '1N-P-3N-P-P-P' then null else list_position(list_transform(range(1, greatest(len({TOK}), 6) + 1), lambda i: ({TOK})[i] is not null and ['1N', 'P', '3N', 'P', 'P', 'P'][i] is not null and ({TOK})[i] = ['1N', 'P', '3N', 'P', 'P', 'P'][i]), false)::int end as step, count(*) as n from deals group by 1, 2")
def auction_divergence(spark, sf_dir):
    want = F.array(*[F.lit(c) for c in "1N-P-3N-P-P-P".split("-")])
    a = bids(spark, sf_dir).groupBy("auction").agg(F.count("*").alias("n"))
    return a.select("auction", analysis.divergence(A.tokens(F.col("auction")), want).alias("step"), "n")


@query(
    "role_posteriors",
    f"""{W}, h as (select h.index, dir, ({HCP.replace(SUIT, "string_split(hand, '.')")})::int as p, ({LEN.replace(SUIT, "string_split(hand, '.')")})[1] as sl, ((instr('NESW', dir) - instr('NESW', Dealer) + 4) % 4)::int as role from hands h)
    select (['SELF', 'LHO', 'PARTNER', 'RHO'])[role + 1] as role, p as hcp, count(*) as n, round(avg(sl), 4) as avg_spades, round(count(*) / sum(count(*)) over (partition by role), 6) as share from h group by role, p""",
)
def role_posteriors(spark, sf_dir):
    """Points by the hand's role towards the dealer."""
    role = F.pmod(F.instr(F.lit("NESW"), F.col("dir")) - F.instr(F.lit("NESW"), F.col("Dealer")), F.lit(4))
    names = F.array(*[F.lit(x) for x in ("SELF", "LHO", "PARTNER", "RHO")])
    h = hands(spark, sf_dir).select(F.get(names, role).alias("role"), H.points(F.col("hand")).alias("hcp"), F.length(F.get(H.suits(F.col("hand")), F.lit(0))).alias("sl"))
    g = h.groupBy("role", "hcp").agg(F.count("*").alias("n"), F.round(F.avg("sl"), 4).alias("avg_spades"))
    t = g.groupBy("role").agg(F.sum("n").alias("t"))
    return g.join(t, "role").select("role", "hcp", "n", "avg_spades", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(
    "event_elo",
    """with recursive g as (select row_number() over (order by ts, event_id) as i, event_id, ts, date_trunc('day', ts)::date as day, user_id % 50 as a, event_id % 49 + 50 as b, (value % 2 >= 1)::int::double as r from events),
st as (select 0::bigint as i, list_transform(range(100), lambda x: 1500.0::double) as rating, list_transform(range(100), lambda x: 0) as played, 0::double as ra, 0::double as na union all
  select i, list_transform(rating, lambda x, p: case p - 1 when a then na when b then nb else x end), list_transform(played, lambda x, p: x + (p - 1 in (a, b))::int), ra, na from (
    select g.i, g.a, g.b, s.rating, s.played, s.ra, s.ra + case when s.played[g.a + 1] < 100 then 36 else 24 end * (g.r - e) as na, rb + case when s.played[g.b + 1] < 100 then 36 else 24 end * (e - g.r) as nb
    from (select st.i, st.rating, st.played, st.rating[g.a + 1] as ra, st.rating[g.b + 1] as rb, 1 / (1 + pow(10, (st.rating[g.b + 1] - st.rating[g.a + 1]) / 400)) as e from st join g on g.i = st.i + 1) s join g on g.i = s.i + 1))
select day, a as player, round(first(st.ra order by g.i), 5) as elo_start, round(last(st.na order by g.i), 5) as elo_end from g join st using (i) group by 1, 2""",
)
def event_elo(spark, sf_dir):
    """Ratings before the first and after the last game of a player's day."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("a"), (F.col("event_id") % 49 + 50).alias("b"), (F.col("value") % 2 >= 1).cast("double").alias("r"))
    games = tournament.pair_elo(e, "a", "b", "r", ["ts", "event_id"]).withColumn("day", F.to_date("ts"))
    out = tournament.event_elo(games, ["day"], ["ts", "event_id"], "a", "elo_first", "new_first")
    return out.select("day", F.col("a").alias("player"), F.round("elo_start", 5).alias("elo_start"), F.round("elo_end", 5).alias("elo_end"))


@query("shape_overlap", "select count(*) as n from part where p_size % 6 <= 5 and p_size % 6 + 4 >= 5 and p_size % 5 <= 4 and p_size % 5 + 3 >= 4 and p_partkey % 4 <= 3 and p_partkey % 4 + 2 >= 3 and p_partkey % 3 <= 1 and p_partkey % 3 + 2 >= 1")
def shape_overlap(spark, sf_dir):
    """Rows of a table of ranges that a 5431 could fall in."""
    from dealframe.functions.shape import shape_overlaps

    z, k = F.col("p_size"), F.col("p_partkey")
    ranges = {"S": (z % 6, z % 6 + 4), "H": (z % 5, z % 5 + 3), "D": (k % 4, k % 4 + 2), "C": (k % 3, k % 3 + 2)}
    return table(spark, sf_dir, "part").where(shape_overlaps(ranges, "5431")).agg(F.count("*").alias("n"))


@query("scaled_features", "with s as (select avg(l_quantity) as m, stddev_samp(l_quantity) as d from lineitem) select l_linenumber, round(avg((l_quantity - m) / d), 5) as z from lineitem, s group by 1")
def scaled_features(spark, sf_dir):
    """A column scaled by its mean and deviation; NaN becomes 0 and infinities a million."""
    t = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity")
    z = stats.scaled(t, stats.scaling(t, ["l_quantity"]), ["l_quantity"])
    return z.groupBy("l_linenumber").agg(F.round(F.avg("l_quantity"), 5).alias("z"))
