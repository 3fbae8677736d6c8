"""Tournament, matching, rule, statistics and audit operators over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealframe.operators import matching, relational, rules, stats, tournament
from dealframe.plans.registry import query
from dealframe.session import table


@query(
    "avg_rank_matchpoints",
    """with r as (select l_orderkey, l_linenumber, rank() over (partition by l_suppkey order by l_quantity) as r, count(*) over (partition by l_suppkey, l_quantity) as c, count(*) over (partition by l_suppkey) as n from lineitem)
    select l_orderkey, l_linenumber, r + (c - 1) / 2.0 - 1 as mp, (n - 1)::double as top from r""",
)
def avg_rank_matchpoints(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return tournament.matchpoints(t, ["l_suppkey"], "l_quantity", "mp", "top").select("l_orderkey", "l_linenumber", "mp", "top")


@query(
    "matchpoint_window",
    "select o_orderkey, rank() over (partition by o_orderpriority, o_orderstatus order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_orderstatus, o_totalprice) - 1) / 2.0 - 1 as mp from orders",
)
def matchpoint_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return tournament.matchpoints(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice", "mp").select("o_orderkey", "mp")


#: Lines of a task.
LINES = 1 << 19


def _best_lines(spark, sf_dir):
    """(l_orderkey, l_linenumber, q, h) dealt out, and in how many parts: their number grows with the table, so that a task's memory doesn't."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t.count() // LINES))
    t = t.repartition(parts, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return t.withColumn("h", F.col("l_linenumber") * 7), parts


@query(
    "hypothetical_mp",
    """with t as (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem group by 1, 2)
    select a.l_orderkey, a.l_linenumber, sum(case when a.l_linenumber * 7 > b.q then 1 when a.l_linenumber * 7 = b.q then 0.5 else 0 end)::double as "MP_h"
    from t a join t b on a.l_orderkey = b.l_orderkey group by 1, 2""",
)
def hypothetical_mp(spark, sf_dir):
    t, parts = _best_lines(spark, sf_dir)
    return tournament.hypothetical_matchpoints(t, ["l_orderkey"], "q", ["h"], parts).select("l_orderkey", "l_linenumber", "MP_h")


@query(
    "distinct_score_pct",
    """with t as (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem group by 1, 2), d as (select distinct l_orderkey, q as s from t)
    select l_orderkey, l_linenumber, round((count(*) filter (where l_linenumber * 7 > s) + 0.5 * count(*) filter (where l_linenumber * 7 = s)) / count(*), 5)::double as pct from t join d using (l_orderkey) group by 1, 2""",
)
def distinct_score_pct(spark, sf_dir):
    t, parts = _best_lines(spark, sf_dir)
    return tournament.distinct_score_percentage(t, ["l_orderkey"], "q", "h", "pct", parts).select("l_orderkey", "l_linenumber", F.round("pct", 5).alias("pct"))


@query("group_mean_over", "select l_orderkey, l_linenumber, round(avg(l_discount) over (partition by l_suppkey), 6) as rating from lineitem")
def group_mean_over(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    return tournament.group_mean(t, "l_suppkey", "l_discount", "rating").select("l_orderkey", "l_linenumber", F.round("rating", 6).alias("rating"))


@query(
    "session_first_last",
    "select user_id, date_trunc('day', ts)::date as day, first(value order by ts, event_id) as first_value, last(value order by ts, event_id) as last_value from events group by 1, 2",
)
def session_first_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "value")
    return tournament.session_bounds(e, ["user_id", "day"], ["ts", "event_id"], "value")


@query("running_total", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as total from events")
def running_total(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return tournament.running_total(e, ["user_id"], ["ts", "event_id"], "value", "total").select("event_id", F.round("total", 4).alias("total"))


#: The games in order, and the recurrence over them: ratings and games played are carried as maps.
ELO_SQL = """with recursive g as (select row_number() over (order by ts, event_id) as i, event_id, user_id % 50 as a, event_id % 49 + 50 as b, (value % 2 >= 1)::int::double as r from events),
st as (select 0::bigint as i, 0::bigint as event_id, list_transform(range(100), lambda x: 1500.0::double) as rating, list_transform(range(100), lambda x: 0) as played, 0::double as na, 0::double as nb union all
  select i, event_id, list_transform(rating, lambda x, p: case p - 1 when a then na when b then nb else x end), list_transform(played, lambda x, p: x + (p - 1 in (a, b))::int), na, nb from (
    select g.i, g.event_id, g.a, g.b, s.rating, s.played, ra + case when s.played[g.a + 1] < 100 then 36 else 24 end * (g.r - e) as na, rb + case when s.played[g.b + 1] < 100 then 36 else 24 end * (e - g.r) as nb
    from (select st.*, rating[g.a + 1] as ra, rating[g.b + 1] as rb, 1 / (1 + pow(10, (rating[g.b + 1] - rating[g.a + 1]) / 400)) as e from st join g on g.i = st.i + 1) s join g on g.i = s.i + 1))"""


@query("elo_fold", f"{ELO_SQL} select event_id, round(na, 6) as new_first, round(nb, 6) as new_second from st where i > 0")
def elo_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("a"), (F.col("event_id") % 49 + 50).alias("b"), (F.col("value") % 2 >= 1).cast("double").alias("r"))
    # Players meet across event types, so there is no league to split by: one task streams the table.
    return tournament.pair_elo(e, "a", "b", "r", ["ts", "event_id"]).select("event_id", F.round("new_first", 6).alias("new_first"), F.round("new_second", 6).alias("new_second"))


@query(
    "bucket_range_match",
    """with d as (select l_orderkey * 10 + l_linenumber as k, l_quantity as q, l_linenumber as ln from lineitem),
      r as (select p_partkey as bt, p_size as q_min, p_size + 5 as q_max, p_partkey % 5 as ln_min, p_partkey % 5 + 2 as ln_max from part)
    select bt, count(*) as n, min(k) as first_k, max(k) as last_k from d join r on q between q_min and q_max and ln between ln_min and ln_max group by bt""",
)
def bucket_range_match(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("ln"))
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    r = p.select(k.alias("bt"), s.alias("q_min"), (s + 5).alias("q_max"), (k % 5).alias("ln_min"), (k % 5 + 2).alias("ln_max"))
    return matching.bucket_range_summary(d, r, ["q", "ln"], "k", "bt").select("bt", "n", F.col("first").alias("first_k"), F.col("last").alias("last_k"))


@query(
    "template_division",
    """with h as (select distinct l_suppkey as s, l_returnflag || l_linestatus as p from lineitem), t(t, p) as (values (1, 'AF'), (1, 'RF'), (2, 'NO'), (2, 'AF'), (3, 'NO'))
    select s, t from h join t using (p) group by 1, 2 having count(*) = (select count(*) from t x where x.t = t.t)""",
)
def template_division(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.concat("l_returnflag", "l_linestatus").alias("p"))
    t = spark.createDataFrame([(1, "AF"), (1, "RF"), (2, "NO"), (2, "AF"), (3, "NO")], "t int, p string")
    return matching.template_division(h, t, "s", "t", "p")


@query("invert_capped", "select l_partkey, array_to_string(list_sort(list(l_orderkey)), ',') as deals from (select distinct l_partkey, l_orderkey, dense_rank() over (partition by l_partkey order by l_orderkey) as r from lineitem) x where r <= 4 group by 1")
def invert_capped(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return matching.invert_capped(m, "l_orderkey", "l_partkey", 4).select("l_partkey", F.array_join(F.transform("deals", lambda x: x.cast("string")), ",").alias("deals"))


@query(
    "array_key_filter",
    """with m as (select o_custkey as d, list(distinct (o_orderkey % 40)) as keys from orders group by 1), e as (select d, unnest(keys) as k from m)
    select c_custkey, coalesce(array_to_string(list_sort(list(k) filter (where k is not null)), ','), '') as kept from customer left join (select d, k from e where k % 5 = d % 5) x on c_custkey = d group by 1""",
)
def array_key_filter(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("d")).agg(F.collect_set(F.col("o_orderkey") % 40).alias("keys"))
    kept = F.array_sort(F.filter("keys", lambda k: k % 5 == F.col("d") % 5))
    m = m.select("d", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(m, c.c_custkey == m.d, "left").select("c_custkey", F.coalesce("kept", F.lit("")).alias("kept"))


STEPS_SQL = """ev as (select user_id as u, event_type as t, row_number() over (partition by user_id order by ts, event_id) as i from events), first4 as (select * from ev),
  steps as (select a.u, a.i as step, coalesce(string_agg(b.t, '-' order by b.i), '') as prefix, a.t as next_bid from first4 a left join first4 b on a.u = b.u and b.i < a.i group by a.u, a.i, a.t)"""


def _steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    toks = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return rules.auction_steps(e.groupBy(F.col("user_id").alias("u")).agg(toks.alias("toks")), "u", "toks")


@query("prefix_explode", f"with {STEPS_SQL} select prefix, next_bid, count(*) as n from steps group by 1, 2")
def prefix_explode(spark, sf_dir):
    return _steps(spark, sf_dir).groupBy("prefix", "next_bid").agg(F.count("*").alias("n"))


LIFT_SQL = f"""{STEPS_SQL}, facts as (select c_custkey as u, (c_acctbal > 0)::int as rich, (c_nationkey % 2 = 0)::int as even from customer),
  cells as (select s.prefix, s.next_bid, 'rich' as criterion, rich as f from steps s join facts using (u) union all select s.prefix, s.next_bid, 'even', even from steps s join facts using (u)),
  own as (select prefix, next_bid, criterion, count(*) as pos_count, sum(f) as p from cells group by all), tot as (select prefix, criterion, count(*) as n, sum(f) as f from cells group by all),
  m as (select o.prefix, o.next_bid, o.criterion, pos_count, n - pos_count as neg_count, p / pos_count as pos_rate, case when n > pos_count then (f - p) / (n - pos_count) end as neg_rate from own o join tot t using (prefix, criterion))"""


def _metrics(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), (F.col("c_acctbal") > 0).alias("rich"), (F.col("c_nationkey") % 2 == 0).alias("even"))
    return rules.score_criteria(_steps(spark, sf_dir), c, "u", ["rich", "even"])


@query("prefix_lift", f"with {LIFT_SQL} select prefix, next_bid, criterion, pos_count, neg_count::bigint as neg_count, round(pos_rate, 6) as pos_rate, round(neg_rate, 6) as neg_rate, round(case when neg_rate > 0 then pos_rate / neg_rate end, 6) as lift from m")
def prefix_lift(spark, sf_dir):
    return _metrics(spark, sf_dir).select("prefix", "next_bid", "criterion", "pos_count", "neg_count", *[F.round(c, 6).alias(c) for c in ("pos_rate", "neg_rate", "lift")])


@query("rule_filter", f"with {LIFT_SQL} select prefix, next_bid, criterion, pos_count from m where (neg_rate is null or neg_rate = 0 or pos_rate / neg_rate >= 1.02) and pos_rate >= 0.3 and floor(pos_rate * pos_count) >= 2 and coalesce(neg_rate, 0) <= 0.99")
def rule_filter(spark, sf_dir):
    return rules.accept(_metrics(spark, sf_dir), 1.02, 0.3, 2, 0.99).select("prefix", "next_bid", "criterion", "pos_count")


BOUNDS_SQL = """b as (select l_suppkey as k, (['HCP', 'SL_S', 'TP'])[(l_linenumber % 3 + 1)::int] as name, (['>=', '<=', '>', '<'])[(l_partkey % 4 + 1)::int] as op, l_quantity as v from lineitem),
  loose as (select k, name, op, case when op in ('>=', '>') then min(v) else max(v) end as v from b group by k, name, op)"""


def _bounds(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    name = F.element_at(F.array(F.lit("HCP"), F.lit("SL_S"), F.lit("TP")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    op = F.element_at(F.array(F.lit(">="), F.lit("<="), F.lit(">"), F.lit("<")), (F.col("l_partkey") % 4 + 1).cast("int"))
    return t.select(F.col("l_suppkey").alias("k"), name.alias("name"), op.alias("op"), F.col("l_quantity").alias("v"))


@query(
    "dedupe_bounds",
    f"""with {BOUNDS_SQL}, s as (select k, name, max(case op when '>=' then v when '>' then v + 1 end) as lo, min(case op when '<=' then v when '<' then v - 1 end) as hi from loose group by 1, 2)
    select l.k, l.name, l.op, l.v from loose l join s using (k, name) where lo is null or hi is null or lo <= hi""",
)
def dedupe_bounds(spark, sf_dir):
    return rules.dedupe_bounds(_bounds(spark, sf_dir), ["k"], "name", "op", "v").select("k", "name", "op", "v")


@query(
    "rule_merge",
    f"""with {BOUNDS_SQL}, base as (select name, op, min(v) as v from loose where k % 2 = 0 and op <> '<' group by 1, 2), new as (select name, op, max(v) as v from loose where k % 2 = 1 group by 1, 2)
    select name, op, coalesce(b.v, n.v) as value, b.v is null as learned from base b full join new n using (name, op)""",
)
def rule_merge(spark, sf_dir):
    b = _bounds(spark, sf_dir)
    loose = b.groupBy("k", "name", "op").agg(F.when(F.col("op").isin(">=", ">"), F.min("v")).otherwise(F.max("v")).alias("v"))
    base = loose.where("k % 2 = 0 and op <> '<'").groupBy("name", "op").agg(F.min("v").alias("value"))
    new = loose.where("k % 2 = 1").groupBy("name", "op").agg(F.max("v").alias("value"))
    return rules.merge_bounds(base, new, ["name", "op"])


@query(
    "hist_quantiles",
    """with h as (select l_suppkey as k, l_quantity as v, count(*) as n from lineitem group by 1, 2), c as (select *, sum(n) over (partition by k order by v) as c, sum(n) over (partition by k) as t from h)
    select k, max(t)::bigint as n, min(v) filter (where c >= ceil(t * 0.1)) as p10, min(v) filter (where c >= ceil(t * 0.5)) as p50, min(v) filter (where c >= ceil(t * 0.9)) as p90 from c group by 1""",
)
def hist_quantiles(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity")
    return stats.histogram_quantiles(t, ["k"], "l_quantity", [0.1, 0.5, 0.9])


@query(
    "cube_weighted_stats",
    """with c as (select l_quantity as q, count(*) as n from lineitem group by 1), r as (select p_partkey as k, p_size as lo, p_size + 6 as hi from part)
    select k, coalesce(sum(n), 0)::bigint as n, round(sum(q * n) / sum(n), 6) as mean, round(sqrt(greatest(sum(q * q * n) / sum(n) - (sum(q * n) / sum(n)) * (sum(q * n) / sum(n)), 0)), 5) as std, min(q) as lo, max(q) as hi from r left join c on q between lo and hi group by k""",
)
def cube_weighted_stats(spark, sf_dir):
    c = stats.cube(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag"])
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("_lo"), (F.col("p_size") + 6).alias("_hi"))
    s = stats.weighted_stats(c, r, "k", "l_quantity", "_lo", "_hi")
    return s.select("k", "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"), F.col("min").alias("lo"), F.col("max").alias("hi"))


@query("histogram_cube", "select l_returnflag, l_linestatus, l_quantity, count(*) as n, round(sum(l_discount), 4) as sum_l_discount from lineitem group by 1, 2, 3")
def histogram_cube(spark, sf_dir):
    c = stats.cube(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"], ["l_discount"])
    return c.withColumn("sum_l_discount", F.round("sum_l_discount", 4))


@query(
    "trick_quality",
    """with h as (select l_suppkey as k, l_linenumber as t, count(*) as n from lineitem group by 1, 2)
    select k, lv.v::int as level, sum(n)::bigint as n, round(sum(n) filter (where t >= lv.v) / sum(n), 6) as p_make, round(coalesce(sum(n) filter (where t >= lv.v + 1), 0) / sum(n), 6) as p_plus1, round(sum((t - lv.v) * n) / sum(n), 6) as exp_extra from h, range(1, 8) lv(v) group by 1, 2""",
)
def trick_quality(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[F.count_if(F.col("l_linenumber") == i).alias(f"t{i}") for i in range(1, 8)], F.count("*").alias("n"))
    hist = F.array(*[F.col(f"t{i}") for i in range(1, 8)])
    e = h.select(F.col("l_suppkey").alias("k"), "n", hist.alias("h"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("level"))
    tail = lambda at: F.aggregate(F.slice("h", at, 8), F.lit(0).cast("long"), lambda a, x: a + x)
    extra = F.aggregate(F.transform("h", lambda x, i: x * (i + 1 - F.col("level"))), F.lit(0).cast("long"), lambda a, x: a + x)
    made = F.when(tail(F.col("level")) > 0, F.round(tail(F.col("level")) / F.col("n"), 6))
    return e.select("k", "level", "n", made.alias("p_make"), F.round(tail(F.col("level") + 1) / F.col("n"), 6).alias("p_plus1"), F.round(extra / F.col("n"), 6).alias("exp_extra"))


@query("entropy_topk", "with c as (select p_brand as k, p_type as t, count(*) as n from part group by 1, 2), p as (select k, n / sum(n) over (partition by k) as p from c) select k, round(-sum(p * ln(p)), 6) as entropy, count(*) as n_items from p group by 1 order by entropy desc, k limit 10")
def entropy_topk(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), "p_type")
    return stats.entropy_nats(p, ["k"], "p_type").select("k", F.round("entropy", 6).alias("entropy"), "n_items").orderBy(F.desc("entropy"), "k").limit(10)


@query("mid_rank_percentile", "select l_returnflag, round(100.0 * (count(*) filter (where l_quantity < 25) + 0.5 * count(*) filter (where l_quantity = 25)) / count(*), 6)::double as pct from lineitem group by 1")
def mid_rank_percentile(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return stats.midrank_percentile(t, ["l_returnflag"], "l_quantity", F.lit(25), "pct").select("l_returnflag", F.round("pct", 6).alias("pct"))


@query("scaling_params", "select 'l_quantity' as name, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as std from lineitem union all select 'l_discount', round(avg(l_discount), 6), round(stddev_samp(l_discount), 6) from lineitem")
def scaling_params(spark, sf_dir):
    s = stats.scaling(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return s.select("name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("category_encoding", "select o_orderstatus, (dense_rank() over (order by o_orderstatus) - 1)::int as code, count(*) as n from orders group by 1")
def category_encoding(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return relational.with_row_index(o, ["o_orderstatus"], "code").select("o_orderstatus", F.col("code").cast("int").alias("code"), "n")


@query(
    "audit_flags",
    """with f as (select p_partkey, unnest(list_filter([case when p_size < 5 then 'NO_STRENGTH' end, case when p_size > 45 then 'WIDE_RANGE' end, case when p_retailprice > 1500 then 'UNBOUNDED_HCP' end, case when p_type like '%BRASS%' then 'EMPTY_CRITERIA' end], lambda x: x is not null)) as flag from part)
    select flag, case when flag in ('NO_STRENGTH', 'UNBOUNDED_HCP') then 'high' else 'low' end as severity, count(*) as n from f group by 1, 2""",
)
def audit_flags(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tests = {"NO_STRENGTH": F.col("p_size") < 5, "WIDE_RANGE": F.col("p_size") > 45, "UNBOUNDED_HCP": F.col("p_retailprice") > 1500, "EMPTY_CRITERIA": F.col("p_type").contains("BRASS")}
    flags = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))).alias("flag")
    return p.select(flags).groupBy("flag").agg(F.count("*").alias("n")).select("flag", F.when(F.col("flag").isin("NO_STRENGTH", "UNBOUNDED_HCP"), "high").otherwise("low").alias("severity"), "n")


@query(
    "contradiction_audit",
    """with b as (select l_suppkey as k, min(l_quantity) filter (where l_linenumber = 1) as hi, max(l_quantity) filter (where l_linenumber = 2) as lo, sum(l_linenumber) as sl from lineitem group by 1)
    select case when lo > hi then 'IMPOSSIBLE_RANGE' when sl > 13 then 'SUIT_LENGTHS_EXCEED_13' when sl < 13 then 'SUIT_LENGTHS_BELOW_13' else 'OK' end as kind, count(*) as n from b group by 1""",
)
def contradiction_audit(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    b = t.groupBy("l_suppkey").agg(F.min(F.when(n == 1, F.col("l_quantity"))).alias("hi"), F.max(F.when(n == 2, F.col("l_quantity"))).alias("lo"), F.sum(n).alias("sl"))
    kind = F.when(F.col("lo") > F.col("hi"), "IMPOSSIBLE_RANGE").when(F.col("sl") > 13, "SUIT_LENGTHS_EXCEED_13").when(F.col("sl") < 13, "SUIT_LENGTHS_BELOW_13").otherwise("OK")
    return b.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


FLAGS_SQL = "(l_quantity > 25)::int as a, (l_discount > 0.05)::int as b, (l_tax > 0.04)::int as c"


@query(
    "category_jaccard",
    f"""with f as (select {FLAGS_SQL} from lineitem)
    select 'a|b' as pair, round(sum(a * b) / sum(greatest(a, b)), 6) as jaccard from f union all select 'a|c', round(sum(a * c) / sum(greatest(a, c)), 6) from f union all select 'b|c', round(sum(b * c) / sum(greatest(b, c)), 6) from f""",
)
def category_jaccard(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    f = {"a": F.col("l_quantity") > 25, "b": F.col("l_discount") > 0.05, "c": F.col("l_tax") > 0.04}
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    # All pairs from one pass.
    one = t.agg(*[x for p, q in pairs for x in (F.count_if(f[p] & f[q]).alias(f"i{p}{q}"), F.count_if(f[p] | f[q]).alias(f"u{p}{q}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f"{p}|{q}").alias("pair"), F.round(F.col(f"i{p}{q}") / F.col(f"u{p}{q}"), 6).alias("jaccard")) for p, q in pairs])))


@query("edge_join", "select r_name, n_name, c_mktsegment, count(*) as n from region join nation on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey group by all")
def edge_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.sum("n").alias("n"))


@query(
    "reachability",
    """with recursive e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 1), r as (select p_partkey as node from part where p_size = 1 union select e.parent from r join e on e.child = r.node)
    select node from r""",
)
def reachability(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    edges = p.where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).alias("parent"), F.col("p_partkey").alias("child"))
    return matching.reachable(edges, p.where("p_size = 1").select("p_partkey"), "parent", "child")


@query("terminal_filter", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 200000")
def terminal_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_totalprice")


TAX_SQL = """x as (select l_returnflag as sev, l_quantity - 25 as imp_diff, l_extendedprice / 1000 - 30 as ev_diff,
  case when l_linenumber = 1 then 'missed_sacrifice' when l_linenumber = 2 then 'premature_pass' when l_discount > 0.08 then 'wrong_strain' when l_quantity > 40 then 'overbid' when l_quantity < 10 then 'underbid' else 'other' end as family from lineitem)"""


@query(
    "error_taxonomy_summary",
    f"""with {TAX_SQL} select family, sev, count(*) as n, round(sum(-imp_diff), 2) as imp_loss, round(sum(greatest(-ev_diff, 0)), 2) as ev_loss, round(sum(-imp_diff) * 1000 + sum(greatest(-ev_diff, 0)), 1) as priority from x group by 1, 2""",
)
def error_taxonomy_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    family = (
        F.when(F.col("l_linenumber") == 1, "missed_sacrifice").when(F.col("l_linenumber") == 2, "premature_pass").when(F.col("l_discount") > 0.08, "wrong_strain")
        .when(F.col("l_quantity") > 40, "overbid").when(F.col("l_quantity") < 10, "underbid").otherwise("other")
    )
    imp, ev = F.sum(25 - F.col("l_quantity")), F.sum(F.greatest(30 - F.col("l_extendedprice") / 1000, F.lit(0.0)))
    return t.groupBy(family.alias("family"), F.col("l_returnflag").alias("sev")).agg(F.count("*").alias("n"), F.round(imp, 2).alias("imp_loss"), F.round(ev, 2).alias("ev_loss"), F.round(imp * 1000 + ev, 1).alias("priority"))


@query(
    "next_bid_ranking",
    """select l_suppkey as bid, count(*) filter (where l_returnflag = 'N') as n_nv, count(*) filter (where l_returnflag <> 'N') as n_v, round(avg(l_extendedprice), 2) as avg_par, round(stddev_samp(l_discount), 6) as ev_std from lineitem group by 1 order by avg_par desc, 1 limit 15""",
)
def next_bid_ranking(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    g = t.groupBy(F.col("l_suppkey").alias("bid")).agg(
        F.count_if(F.col("l_returnflag") == "N").alias("n_nv"), F.count_if(F.col("l_returnflag") != "N").alias("n_v"), F.round(F.avg("l_extendedprice"), 2).alias("avg_par"), F.round(F.stddev_samp("l_discount"), 6).alias("ev_std")
    )
    return g.orderBy(F.desc("avg_par"), "bid").limit(15)


@query("par_distribution", "with c as (select l_suppkey % 7 as k, l_linenumber as c, 1.0::double / count(*) over (partition by l_orderkey) as mass from lineitem) select k, c, round(sum(mass), 4) as mass, count(*) as n from c group by 1, 2")
def par_distribution(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    n = t.groupBy("l_orderkey").agg((1.0 / F.count("*")).alias("mass"))
    return t.join(n, "l_orderkey").groupBy((F.col("l_suppkey") % 7).alias("k"), F.col("l_linenumber").alias("c")).agg(F.round(F.sum("mass"), 4).alias("mass"), F.count("*").alias("n"))


@query("describe_quantiles", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(stddev_pop(l_extendedprice), 3) as std from lineitem group by 1")
def describe_quantiles(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    std = t.groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_extendedprice"), 3).alias("std"))
    q = stats.exact_quantiles(t, ["l_returnflag"], "l_extendedprice", [0.25, 0.5])
    return q.join(std, "l_returnflag").select("l_returnflag", F.round("q25", 4).alias("q25"), F.round("q50", 4).alias("q50"), "std")


@query(
    "arena_head_to_head",
    """with m as (select l_orderkey as b, max(l_quantity) * 30 as s1, min(l_quantity) * 30 as s2 from lineitem group by 1), d as (select b, (s1 - s2)::bigint as d from m)
    select count(*) as boards, sum(case when d > 0 then 1 else 0 end)::bigint as wins, sum(d)::bigint as total, round(avg(d), 4) as avg_diff from d""",
)
def arena_head_to_head(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") * 30 - F.min("l_quantity") * 30).cast("long").alias("d"))
    return m.agg(F.count("*").alias("boards"), F.count_if(F.col("d") > 0).alias("wins"), F.sum("d").alias("total"), F.round(F.avg("d"), 4).alias("avg_diff"))
