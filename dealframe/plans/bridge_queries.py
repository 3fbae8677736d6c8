"""Hand, auction and scoring operators over derived deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import hand as H
from dealframe.functions import scoring as S
from dealframe.operators import bidding
from dealframe.plans.deals import DEALS_SQL, VUL_SQL, bids, deals, hands
from dealframe.plans.registry import query
from dealframe.session import table

W = f"with {DEALS_SQL}"
SUIT = "string_split(Hand_N, '.')"


def _sum(expr: str) -> str:
    """Sum over North's four suits of an expression in s."""
    return f"list_sum(list_transform({SUIT}, lambda s: {expr}))"


HCP = _sum("4 * (length(s) - length(replace(s, 'A', ''))) + 3 * (length(s) - length(replace(s, 'K', ''))) + 2 * (length(s) - length(replace(s, 'Q', ''))) + length(s) - length(replace(s, 'J', ''))")
DP = _sum("greatest(3 - length(s), 0)")
QT = _sum("case when s like 'AK%' then 2.0 when s like 'AQ%' then 1.5 when s like 'A%' then 1.0 when s like 'KQ%' then 1.0 when s like 'K%' then 0.5 else 0.0 end")
LTC = _sum("case when length(s) = 0 then 0 when length(s) = 1 then 1 - (contains(s, 'A'))::int when length(s) = 2 then 2 - contains(s, 'A')::int - contains(s, 'K')::int else 3 - contains(s, 'A')::int - contains(s, 'K')::int - contains(s, 'Q')::int end")
LEN = f"list_transform({SUIT}, lambda s: length(s))"
SHAPE = f"array_to_string(list_reverse_sort({LEN}), '')"


@query("deal_hands", f"{W} select index, Dealer, Vul, Hand_N, Hand_E, Hand_S, Hand_W from deals")
def deal_hands(spark, sf_dir):
    return deals(spark, sf_dir).select("index", "Dealer", "Vul", "Hand_N", "Hand_E", "Hand_S", "Hand_W")


HAND = "string_split(hand, '.')"


def _of_hand(sql: str) -> str:
    """The same expression over each of the four hands."""
    return sql.replace(SUIT, HAND)


@query("hand_hcp", f"{W} select index, dir, ({_of_hand(HCP)})::int as hcp, ({_of_hand(DP)})::int as dp, ({_of_hand(HCP)} + {_of_hand(DP)})::int as total_points from hands")
def hand_hcp(spark, sf_dir):
    h, s = H.points(F.col("hand")), H.suits(F.col("hand"))
    d = hands(spark, sf_dir).select("index", "dir", h.cast("int").alias("hcp"), H.distribution_points(s).cast("int").alias("dp"))
    return d.withColumn("total_points", F.col("hcp") + F.col("dp"))


@query("hand_quick_tricks", f"{W} select index, dir, ({_of_hand(QT)})::double as quick_tricks, ({_of_hand(LTC)})::int as losers from hands")
def hand_quick_tricks(spark, sf_dir):
    s = H.suits(F.col("hand"))
    return hands(spark, sf_dir).select("index", "dir", H.quick_tricks(s).alias("quick_tricks"), H.losers(s).cast("int").alias("losers"))


@query(
    "hand_shape",
    _of_hand(
        f"""{W} select index, dir, {SHAPE} as shape, ({SHAPE} in ('4333', '4432') or ({SHAPE} in ('5332', '5422') and (({LEN})[3] = 5 or ({LEN})[4] = 5))) as balanced,
    (({LEN})[1])::int as sl_s, (({LEN})[2])::int as sl_h, (({LEN})[3])::int as sl_d, (({LEN})[4])::int as sl_c from hands"""
    ),
)
def hand_shape(spark, sf_dir):
    s = H.suits(F.col("hand"))
    n = H.lengths(s)
    return hands(spark, sf_dir).select("index", "dir", H.shape(s).alias("shape"), H.balanced(s).alias("balanced"), *[F.element_at(n, i + 1).cast("int").alias(f"sl_{x}") for i, x in enumerate("shdc")])


@query(
    "hand_keycards",
    f"""{W} select index, dir, (length(hand) - length(replace(hand, 'A', '')) + case when strain < 4 and contains(({HAND})[4 - strain], 'K') then 1 else 0 end)::int as keycards from hands""",
)
def hand_keycards(spark, sf_dir):
    trump = F.when(F.col("strain") < 4, 4 - F.col("strain")).otherwise(0)
    return hands(spark, sf_dir).select("index", "dir", H.keycards(H.suits(F.col("hand")), trump).cast("int").alias("keycards"))


@query(
    "card_presence",
    f"""{W} select h.dir as dir, s.suit as suit, r.rank as rank, sum(contains(string_split(hand, '.')[s.i], r.rank)::int)::bigint as n
    from hands h, (values (1, 'S'), (2, 'H'), (3, 'D'), (4, 'C')) s(i, suit), (values {", ".join(f"('{r}')" for r in "AKQJT98765432")}) r(rank) group by all""",
)
def card_presence(spark, sf_dir):
    # The 52 flags of a hand are counted in one pass and turned to rows after that.
    s = H.suits(F.col("hand"))
    cells = [(y, r, F.count_if(F.get(s, F.lit(i)).contains(r))) for i, y in enumerate("SHDC") for r in "AKQJT98765432"]
    one = hands(spark, sf_dir).groupBy("dir").agg(*[c.alias(f"{y}{r}") for y, r, c in cells])
    return one.select("dir", F.inline(F.array(*[F.struct(F.lit(y).alias("suit"), F.lit(r).alias("rank"), F.col(f"{y}{r}").alias("n")) for y, r, _ in cells])))


@query(
    "pair_fit",
    f"""{W} select index, (list_max(list_transform(range(1, 5), lambda i: length(string_split(Hand_N, '.')[i]) + length(string_split(Hand_S, '.')[i]))))::int as best_fit_ns,
    (list_sum(list_transform(range(1, 5), lambda i: greatest(length(string_split(Hand_N, '.')[i]) + length(string_split(Hand_S, '.')[i]), 13 - length(string_split(Hand_N, '.')[i]) - length(string_split(Hand_S, '.')[i])))))::int as fit_sum from deals""",
)
def pair_fit(spark, sf_dir):
    n, s = H.lengths(H.suits(F.col("Hand_N"))), H.lengths(H.suits(F.col("Hand_S")))
    fit = F.zip_with(n, s, lambda a, b: a + b)
    both = F.aggregate(F.transform(fit, lambda x: F.greatest(x, 13 - x)), F.lit(0), lambda a, x: a + x)
    return deals(spark, sf_dir).select("index", F.array_max(fit).cast("int").alias("best_fit_ns"), both.cast("int").alias("fit_sum"))


SCORE_SQL = """case when tricks - level - 6 >= 0 then
  (level * (case when strain <= 1 then 20 else 30 end) + case when strain = 4 then 10 else 0 end) * (1 << dbl)
  + case when (level * (case when strain <= 1 then 20 else 30 end) + case when strain = 4 then 10 else 0 end) * (1 << dbl) >= 100 then (case when v then 500 else 300 end) else 50 end
  + case when level = 6 then (case when v then 750 else 500 end) when level = 7 then (case when v then 1500 else 1000 end) else 0 end
  + dbl * 50
  + (tricks - level - 6) * case when dbl = 0 then (case when strain <= 1 then 20 else 30 end) else (case when v then 200 else 100 end) * dbl end
else -(case when dbl = 0 then (level + 6 - tricks) * (case when v then 100 else 50 end)
  else dbl * case when v then 300 * (level + 6 - tricks) - 100 when level + 6 - tricks <= 3 then 200 * (level + 6 - tricks) - 100 else 300 * (level + 6 - tricks) - 400 end end)
end"""


@query(
    "score_table",
    f"""{W}, x as (select level, strain, dbl, {VUL_SQL} as v, tricks from deals where level is not null) select level, strain, dbl, v as vul, tricks, ({SCORE_SQL})::int as score, count(*) as n from x group by all""",
)
def score_table(spark, sf_dir):
    """The score of every kind of result that the deals have, with how often it comes."""
    d = bids(spark, sf_dir).where("level is not null").select("level", "strain", "dbl", A.side_vulnerable(F.col("Vul"), F.col("decl")).alias("vul"), "tricks")
    g = d.groupBy("level", "strain", "dbl", "vul", "tricks").agg(F.count("*").alias("n"))
    return g.select("level", "strain", "dbl", "vul", "tricks", S.score(F.col("level"), F.col("strain"), F.col("dbl"), F.col("vul"), F.col("tricks")).alias("score"), "n")


@query("contract_scores", f"{W}, x as (select *, {VUL_SQL} as v from deals) select index, ({SCORE_SQL})::int as score, tricks - level - 6 as result from x")
def contract_scores(spark, sf_dir):
    d = bids(spark, sf_dir)
    v = A.side_vulnerable(F.col("Vul"), F.col("decl"))
    return d.select("index", S.score(F.col("level"), F.col("strain"), F.col("dbl"), v, F.col("tricks")).alias("score"), (F.col("tricks") - F.col("level") - 6).alias("result"))


IMP_ROWS = [(lo, hi - 1, i) for i, (lo, hi) in enumerate(zip([0, *S.IMP_LOWER], [*S.IMP_LOWER, 10**9], strict=True))]
IMP_VALUES = ", ".join(map(str, IMP_ROWS))


@query("imp_scale", f"select d as diff, imp, n from (select abs(floor(l_extendedprice)::bigint % 6000) as d, count(*) as n from lineitem group by 1) x, (values {IMP_VALUES}) t(lo, hi, imp) where d between lo and hi")
def imp_scale(spark, sf_dir):
    """IMPs of every difference that the lines have."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.abs(F.floor("l_extendedprice") % 6000).alias("diff")).agg(F.count("*").alias("n"))
    return d.select("diff", S.imp(F.col("diff")).alias("imp"), "n")


@query(
    "imp_bucket_join",
    f"""select imp, count(*) as n, round(avg(d), 4) as avg_diff from (select floor(abs(l_extendedprice - 30000) / 10)::bigint as d from lineitem) x, (values {IMP_VALUES}) t(lo, hi, imp) where d between lo and hi group by imp""",
)
def imp_bucket_join(spark, sf_dir):
    t = spark.createDataFrame(IMP_ROWS, "lo long, hi long, imp int")
    x = table(spark, sf_dir, "lineitem").select(F.floor(F.abs(F.col("l_extendedprice") - 30000) / 10).alias("d"))
    return x.join(F.broadcast(t), F.col("d").between(F.col("lo"), F.col("hi"))).groupBy("imp").agg(F.count("*").alias("n"), F.round(F.avg("d"), 4).alias("avg_diff"))


TOK = "string_split(auction, '-')"
BIDS = f"list_filter(list_transform({TOK}, lambda t, i: {{'i': i - 1, 't': t}}), lambda x: regexp_matches(x.t, '^[1-7][CDHSN]$'))"
AUC = f"{W}, au as (select index, Dealer, auction, {TOK} as toks, {BIDS} as bids from deals), au2 as (select *, bids[len(bids)] as last from au)"
DECL = "substr('NESW', ((instr('NESW', Dealer) - 1 + (list_filter(bids, lambda x: substr(x.t, 2, 1) = substr(last.t, 2, 1) and (last.i - x.i) % 2 = 0))[1].i) % 4 + 1)::int, 1)"


@query(
    "auction_contract",
    f"""{AUC}, au3 as (select *, list_filter(toks[last.i + 2:], lambda t: t in ('X', 'XX')) as ds from au2)
    select index, case when len(bids) > 0 then last.t end as contract, case when len(bids) > 0 then {DECL} end as declarer,
      coalesce(case when len(bids) > 0 then last.t || coalesce(ds[len(ds)], '') || {DECL} end, 'PASS') as full_contract from au3""",
)
def auction_contract(spark, sf_dir):
    t, dealer = A.tokens(F.col("auction")), F.col("Dealer")
    told = {"contract": A.contract(t), "declarer": A.declarer(t, dealer), "full_contract": A.ai_contract(t, dealer)}
    return bidding.once_each(bids(spark, sf_dir).select("index", "auction", "Dealer"), ["auction", "Dealer"], told).select("index", *told)


@query(
    "auction_seat1",
    f"""{W} select index, regexp_replace(auction, '^(P-)+', '') as seat1, (length(regexp_extract(auction, '^((P-)*)', 1)) // 2)::int as passes,
    substr('NESW', ((instr('NESW', Dealer) - 1 + len({TOK})) % 4 + 1)::int, 1) as to_act from deals""",
)
def auction_seat1(spark, sf_dir):
    a = F.col("auction")
    told = {"seat1": A.seat1_view(a), "passes": A.leading_passes(a), "to_act": A.seat_to_act(A.tokens(a), F.col("Dealer"))}
    return bidding.once_each(bids(spark, sf_dir).select("index", "auction", "Dealer"), ["auction", "Dealer"], told).select("index", *told)


@query(
    "auction_bid_codes",
    f"""{W}, t as (select unnest({TOK}) as tok from deals) select tok, (case when tok = 'P' then 1 when tok = 'X' then 2 when tok = 'XX' then 3
      when regexp_matches(tok, '^[1-7][CDHSN]$') then 3 + (substr(tok, 1, 1)::int - 1) * 5 + instr('CDHSN', substr(tok, 2, 1)) else 0 end)::int as code, count(*) as n from t group by all""",
)
def auction_bid_codes(spark, sf_dir):
    t = bids(spark, sf_dir).select(F.explode(A.tokens(F.col("auction"))).alias("tok"))
    return t.groupBy("tok").count().select("tok", A.bid_code(F.col("tok")).cast("int").alias("code"), F.col("count").alias("n"))


#: Legality, call by call, of the distinct auctions.
LEGAL_SQL = f"""tk as (select distinct auction, {TOK} as toks from deals),
st as (select auction, 0 as i, 0 as top, -1 as side, 0 as dbl, 0 as run, true as ok, false as done from tk union all
  select s.auction, s.i + 1, case when c >= 4 then c else top end, case when c >= 4 then s.i % 2 else side end, case when c >= 4 then 0 when c = 2 then 1 when c = 3 then 2 else dbl end, case when c = 1 then run + 1 else 0 end,
    ok and not done and (c = 1 or (c >= 4 and c > top) or (c = 2 and top > 0 and dbl = 0 and side <> s.i % 2) or (c = 3 and top > 0 and dbl = 1 and side = s.i % 2)),
    case when c = 1 then run + 1 >= case when top > 0 then 3 else 4 end else false end
  from (select st.*, case t.toks[st.i + 1] when 'P' then 1 when 'X' then 2 when 'XX' then 3 else 3 + (substr(t.toks[st.i + 1], 1, 1)::int - 1) * 5 + instr('CDHSN', substr(t.toks[st.i + 1], 2, 1)) end as c from st join tk t using (auction) where st.i < len(t.toks)) s),
last as (select st.auction, ok, done from st join tk using (auction) where st.i = len(toks))"""


@query("auction_legality", f"{W.replace('with ', 'with recursive ', 1)}, {LEGAL_SQL} select index, ok as legal, ok and done as complete from deals join last using (auction)")
def auction_legality(spark, sf_dir):
    t = A.tokens(F.col("auction"))
    told = {"legal": A.valid(t), "complete": A.complete(t)}
    return bidding.once_each(bids(spark, sf_dir).select("index", "auction"), ["auction"], told).select("index", *told)


@query("auction_competitive", f"{W} select auction, (len(list_filter(list_transform({TOK}, lambda t, i: case when t <> 'P' then i % 2 end), lambda x: x = 0)) > 0 and len(list_filter(list_transform({TOK}, lambda t, i: case when t <> 'P' then i % 2 end), lambda x: x = 1)) > 0) as competitive, count(*) as n from deals group by all")
def auction_competitive(spark, sf_dir):
    g = bids(spark, sf_dir).groupBy("auction").agg(F.count("*").alias("n"))
    return g.select("auction", A.competitive(A.tokens(F.col("auction"))).alias("competitive"), "n")


@query("auction_pattern_counts", f"{W} select count(*) filter (where auction like '1N-P%') as nt_prefix, count(*) filter (where regexp_matches(auction, '(?i)^(?:1[HS]-P-.*)')) as major_raise, count(*) filter (where regexp_matches(auction, '(?i)^(?:.*X.*-P-P-P)')) as doubled from deals")
def auction_pattern_counts(spark, sf_dir):
    a = F.col("auction")
    pats = {"nt_prefix": "1n-p", "major_raise": "1[HS]-P-.*", "doubled": ".*X.*-P-P-P"}
    return bids(spark, sf_dir).agg(*[F.count_if(A.matches(a, p)).alias(n) for n, p in pats.items()])


@query(
    "seat_directions",
    f"""{W} select Dealer, s.v::int as seat, substr('NESW', ((instr('NESW', Dealer) - 1 + s.v - 1) % 4 + 1)::int, 1) as dir, count(*) as n,
      count(*) filter (where Vul = 'Both' or (Vul = 'N_S' and substr('NESW', ((instr('NESW', Dealer) + s.v - 2) % 4 + 1)::int, 1) in ('N', 'S')) or (Vul = 'E_W' and substr('NESW', ((instr('NESW', Dealer) + s.v - 2) % 4 + 1)::int, 1) in ('E', 'W'))) as vulnerable
    from deals, range(1, 5) s(v) group by all""",
)
def seat_directions(spark, sf_dir):
    e = bids(spark, sf_dir).select("Dealer", "Vul", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("seat"))
    e = e.withColumn("dir", F.substring(F.lit("NESW"), (F.instr(F.lit("NESW"), F.col("Dealer")) - 1 + F.col("seat") - 1) % 4 + 1, F.lit(1)))
    return e.groupBy("Dealer", "seat", "dir").agg(F.count("*").alias("n"), F.count_if(A.side_vulnerable(F.col("Vul"), F.col("dir"))).alias("vulnerable"))


@query(
    "board_schedule",
    f"""select b as board, substr('NESW', ((b - 1) % 4 + 1)::int, 1) as dealer, case when (b - 1) % 16 + 1 in {tuple(set(A.SCHEDULE_NS) & set(A.SCHEDULE_EW))} then 'Both'
      when (b - 1) % 16 + 1 in {tuple(A.SCHEDULE_NS)} then 'N_S' when (b - 1) % 16 + 1 in {tuple(A.SCHEDULE_EW)} then 'E_W' else 'None' end as vul, n from (select (o_orderkey % 64 + 1)::int as b, count(*) as n from orders group by 1) x""",
)
def board_schedule(spark, sf_dir):
    """Dealer and vulnerability of the boards that the orders are played on."""
    b = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 64 + 1).cast("int").alias("board")).agg(F.count("*").alias("n"))
    return b.select("board", A.board_dealer(F.col("board")).alias("dealer"), A.board_vul(F.col("board")).alias("vul"), "n")


@query("contract_types", f"{W} select case when level is null then 'Pass' when level = 7 then 'GSlam' when level = 6 then 'SSlam' when level = 5 or (level = 4 and strain >= 2) or (level = 3 and strain = 4) then 'Game' else 'Partial' end as kind, count(*) as n from deals group by 1")
def contract_types(spark, sf_dir):
    return bids(spark, sf_dir).groupBy(S.contract_type(F.col("level"), F.col("strain")).alias("kind")).agg(F.count("*").alias("n"))


@query("contract_keys", f"{W} select (((level * 5 + strain) * 3 + dbl) * 2 + index % 2)::bigint as key, count(*) as n from deals group by 1")
def contract_keys(spark, sf_dir):
    key = A.contract_key(F.col("level"), F.col("strain"), F.col("dbl"), F.col("index") % 2)
    return bids(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query(
    "expected_values",
    f"""{W}, p as (select index, level, strain, dbl, {VUL_SQL} as v, t.v::int as tricks, 1 + (index * (t.v + 3)) % 17 as w from deals, range(14) t(v)),
      s as (select index, w, ({SCORE_SQL}) as score from p)
    select index, round(sum(w * score)::double / sum(w), 4) as ev from s group by index""",
)
def expected_values(spark, sf_dir):
    d = bids(spark, sf_dir)
    v = A.side_vulnerable(F.col("Vul"), F.col("decl"))
    tricks = F.sequence(F.lit(0), F.lit(13))
    weights = F.transform(tricks, lambda t: (1 + (F.col("index") * (t + 3)) % 17).cast("double"))
    scores = F.transform(tricks, lambda t: S.score(F.col("level"), F.col("strain"), F.col("dbl"), v, t).cast("double"))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return d.select("index", F.round(S.expected_value(weights, scores) / total, 4).alias("ev"))


@query(
    "result_from_score",
    f"""{W}, x as (select *, {VUL_SQL} as v from deals), s as (select index, tricks, level, ({SCORE_SQL}) as score from x)
    select index, tricks - level - 6 as result, score from s""",
)
def result_from_score(spark, sf_dir):
    d = bids(spark, sf_dir).select("index", "level", "strain", "dbl", A.side_vulnerable(F.col("Vul"), F.col("decl")).alias("v"), "tricks")
    # All scores of a contract are worked out once a contract.
    scores = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda t: S.score(F.col("level"), F.col("strain"), F.col("dbl"), F.col("v"), t))
    d = bidding.once_each(d, ["level", "strain", "dbl", "v"], {"_all": scores})
    d = d.select("index", "level", F.get("_all", F.col("tricks")).alias("score"), "_all")
    # The tricks are read back from the score's place among all scores of the contract.
    return d.select("index", (F.array_position("_all", F.col("score")).cast("int") - 1 - F.col("level") - 6).alias("result"), "score")


@query(
    "contract_parse",
    """with c as (select p_partkey, substr('1234567', (p_partkey % 7 + 1)::int, 1) || (['', 'X', 'XX'])[(p_partkey % 3 + 1)::int] || substr('CDHSN', (p_partkey % 5 + 1)::int, 1) || substr('NESW', (p_partkey % 4 + 1)::int, 1) as c from part)
    select p_partkey, c as contract, substr(c, 1, 1)::int as level, substr(c, length(c) - 1, 1) as strain, right(c, 1) as declarer, (length(c) - 3)::int as dbl from c""",
)
def contract_parse(spark, sf_dir):
    k = F.col("p_partkey")
    c = F.concat(
        F.substring(F.lit("1234567"), (k % 7 + 1).cast("int"), F.lit(1)),
        F.element_at(F.array(F.lit(""), F.lit("X"), F.lit("XX")), (k % 3 + 1).cast("int")),
        F.substring(F.lit("CDHSN"), (k % 5 + 1).cast("int"), F.lit(1)),
        F.substring(F.lit("NESW"), (k % 4 + 1).cast("int"), F.lit(1)),
    )
    t = table(spark, sf_dir, "part").select("p_partkey", c.alias("contract"))
    got = lambda i: F.regexp_extract("contract", "^([1-7])(X{0,2})([CDHSN])([NESW])$", i)
    return t.select("p_partkey", "contract", got(1).try_cast("int").alias("level"), got(3).alias("strain"), got(4).alias("declarer"), F.length(got(2)).alias("dbl"))
