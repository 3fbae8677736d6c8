"""The benchmark query shapes and engine-level primitives over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealframe.functions.dsl import compile_criteria, compile_filter, failed
from dealframe.plans.registry import query
from dealframe.session import table


@query("criteria_range_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 15 AND l_quantity <= 17")
def criteria_range_count(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.where(compile_filter("l_quantity >= 15 & l_quantity <= 17", t.columns)).agg(F.count("*").alias("n"))


@query(
    "group_by_sequence",
    """with s as (select e.user_id, string_agg(event_type, '-' order by ts, event_id) as seq, avg(value) as v from events e group by e.user_id)
    select seq, count(*) as n, round(avg(v), 4) as avg_value from s where seq like 'c%' or seq like 'v%' group by seq order by n desc, seq limit 25""",
)
def group_by_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), "-").alias("seq"),
        F.avg("value").alias("v"),
    )
    s = s.where(F.col("seq").startswith("c") | F.col("seq").startswith("v"))
    return s.groupBy("seq").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("avg_value")).orderBy(F.desc("n"), "seq").limit(25)


@query("contract_summary", "select o_orderpriority, o_orderstatus, count(*) as n, round(avg(o_totalprice), 2) as avg_price, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by all")
def contract_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("pattern_regex_completed", "select p_type, count(*) as n from part where regexp_matches(p_name, '(?i)^(?:.*[aeiou].*)') and p_size > 10 group by p_type")
def pattern_regex_completed(spark, sf_dir):
    from dealframe.functions.auction import matches

    p = table(spark, sf_dir, "part")
    return p.where(matches(F.col("p_name"), ".*[aeiou].*") & (F.col("p_size") > 10)).groupBy("p_type").agg(F.count("*").alias("n"))


@query(
    "range_apply_cte",
    "with r as (select min(p_retailprice) * 20 as lo, max(p_retailprice) * 20 as hi from part where p_size <= 10) select count(*) as n, round(sum(l_quantity), 2) as q from lineitem, r where l_extendedprice between lo and hi",
)
def range_apply_cte(spark, sf_dir):
    r = table(spark, sf_dir, "part").where("p_size <= 10").agg((F.min("p_retailprice") * 20).alias("lo"), (F.max("p_retailprice") * 20).alias("hi"))
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    # One row by construction: safe to broadcast.
    j = li.join(F.broadcast(r), F.col("l_extendedprice").between(F.col("lo"), F.col("hi")))
    return j.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("modulo_sample", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 97 = 42")
def modulo_sample(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 97 = 42").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "criteria_dsl",
    "select l_returnflag, count(*) as n from lineitem where ((l_quantity + 2 * l_linenumber >= 20 and l_discount < 0.05) or not (l_tax > 0.04)) and l_quantity % 2 = 0 group by 1",
)
def criteria_dsl(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    rule = "((l_quantity + 2 * l_linenumber >= 20 & l_discount < 0.05) | not (l_tax > 0.04)) and l_quantity % 2 == 0"
    return t.where(compile_filter(rule, t.columns)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "criteria_missing_policy",
    "select count(*) filter (where p_size > 10) as n_pass, 0::bigint as n_fail from part",
)
def criteria_missing_policy(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rule = "p_size > 10 & no_such_metric >= 3"
    return p.agg(F.count_if(compile_criteria(rule, p.columns, on_missing="true")).alias("n_pass"), F.count_if(compile_criteria(rule, p.columns, on_missing="false")).alias("n_fail"))


CHECKS = ["l_quantity >= 10", "l_discount <= 0.05", "l_tax < 0.06", "l_linenumber != 3"]
FAIL_SQL = "list_filter([case when not l_quantity >= 10 then 'l_quantity >= 10' end, case when not l_discount <= 0.05 then 'l_discount <= 0.05' end, case when not l_tax < 0.06 then 'l_tax < 0.06' end, case when not l_linenumber != 3 then 'l_linenumber != 3' end], lambda x: x is not null)"


@query("criteria_fail_list", f"select array_to_string({FAIL_SQL}, '; ') as failed, count(*) as n from lineitem group by 1")
def criteria_fail_list(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.array_join(failed(CHECKS, t.columns), "; ").alias("failed")).agg(F.count("*").alias("n"))


@query(
    "failed_criteria_summary",
    f"select c as criterion, count(*) as n from (select unnest({FAIL_SQL}) as c from lineitem) x group by 1 order by n desc, 1 limit 3",
)
def failed_criteria_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    e = t.select(F.explode(failed(CHECKS, t.columns)).alias("criterion"))
    return e.groupBy("criterion").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "criterion").limit(3)


@query(
    "wrong_flag_rates",
    """select l_suppkey % 10 as grp, avg((l_quantity < 10)::int) as r1, avg((l_discount > 0.05)::int) as r2, avg((l_tax >= 0.06)::int) as r3,
      count(*) filter (where l_quantity < 10) as first1, count(*) filter (where l_quantity >= 10 and l_discount > 0.05) as first2, count(*) filter (where l_quantity >= 10 and l_discount <= 0.05 and l_tax >= 0.06) as first3
    from lineitem group by 1""",
)
def wrong_flag_rates(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    w = [~compile_criteria(c, t.columns) for c in CHECKS[:3]]
    first = F.when(w[0], 1).when(w[1], 2).when(w[2], 3)
    t = t.select((F.col("l_suppkey") % 10).alias("grp"), *[x.cast("int").alias(f"w{i + 1}") for i, x in enumerate(w)], first.alias("first"))
    return t.groupBy("grp").agg(*[F.avg(f"w{i}").alias(f"r{i}") for i in (1, 2, 3)], *[F.count_if(F.col("first") == i).alias(f"first{i}") for i in (1, 2, 3)])


@query(
    "wrong_bid_leaderboard",
    "select p_brand, count(*) as n, round(avg((l_quantity < 10 or l_discount > 0.05)::int), 6) as rate from lineitem join part on l_partkey = p_partkey group by 1 order by rate desc, 1 limit 10",
)
def wrong_bid_leaderboard(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", (~compile_criteria("l_quantity >= 10 & l_discount <= 0.05", ["l_quantity", "l_discount"])).cast("int").alias("wrong"))
    # Counts by part first: the join meets one row a part.
    by = li.groupBy("l_partkey").agg(F.count("*").alias("c"), F.sum("wrong").alias("w"))
    j = by.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    out = j.groupBy("p_brand").agg(F.sum("c").alias("n"), F.round(F.sum("w") / F.sum("c"), 6).alias("rate"))
    return out.orderBy(F.desc("rate"), "p_brand").limit(10)


@query("join_inner_left", "select n_name, r_name, count(c_custkey) as customers, round(coalesce(sum(c_acctbal), 0), 2) as balance from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_acctbal > 5000 group by all")
def join_inner_left(spark, sf_dir):
    n, r, c = (table(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    c = c.where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.sum("c_acctbal").alias("b"))
    j = n.join(r, n.n_regionkey == r.r_regionkey).join(c, n.n_nationkey == c.c_nationkey, "left")
    return j.groupBy("n_name", "r_name").agg(F.sum(F.coalesce("c", F.lit(0))).alias("customers"), F.round(F.coalesce(F.sum("b"), F.lit(0.0)), 2).alias("balance"))


@query("join_semi_anti", "select (select count(*) from customer where c_custkey in (select o_custkey from orders)) as with_orders, (select count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)) as without_orders")
def join_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey")
    # The customers without orders are the rest of the semi-join: one pass over orders.
    a = c.join(o, c.c_custkey == o.o_custkey, "left_semi").agg(F.count("*").alias("with_orders"))
    b = c.agg(F.count("*").alias("_n"))
    return a.join(F.broadcast(b)).select("with_orders", (F.col("_n") - F.col("with_orders")).alias("without_orders"))


@query("order_preserving_take", "select i.pos::int as pos, o_orderkey, o_totalprice from (values (0, 7), (1, 3), (2, 64), (3, 1), (4, 33)) i(pos, k) join orders on o_orderkey = i.k order by pos")
def order_preserving_take(spark, sf_dir):
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (7, 3, 64, 1, 33)])).alias("pos", "k"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.join(F.broadcast(ids), o.o_orderkey == F.col("k")).select("pos", "o_orderkey", "o_totalprice").orderBy("pos")


@query("swapped_key_self_join", "select a.s_nationkey as nation, count(*) as pairs from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey group by 1")
def swapped_key_self_join(spark, sf_dir):
    # Pairs within a nation follow from its count: no self-join rows.
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return s.where("n > 1").select(F.col("s_nationkey").alias("nation"), F.expr("n * (n - 1) div 2").alias("pairs"))


@query(
    "cache_upsert",
    """with cache as (select p_partkey as k, p_size as a, p_retailprice as b from part where p_partkey % 3 <> 0),
      new as (select p_partkey as k, case when p_partkey % 2 = 0 then p_size + 100 end as a, p_retailprice + 1 as b from part where p_partkey % 4 = 0)
    select coalesce(c.k, n.k) as k, coalesce(n.a, c.a) as a, round(coalesce(n.b, c.b), 2) as b from cache c full join new n on c.k = n.k""",
)
def cache_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cache = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    new = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 100).alias("na"), (F.col("p_retailprice") + 1).alias("nb"))
    return cache.join(new, "k", "full_outer").select("k", F.coalesce("na", "a").alias("a"), F.round(F.coalesce("nb", "b"), 2).alias("b"))


@query(
    "pivot_overrides",
    """with o as (select l_partkey % 50 as k, (['strong', 'weak', 'forcing'])[(l_linenumber % 3 + 1)::int] as cat, l_quantity as v, row_number() over (partition by l_partkey % 50, l_linenumber % 3 order by l_orderkey desc, l_linenumber desc, l_quantity desc) as r from lineitem),
      w as (select k, max(v) filter (where cat = 'strong') as strong, max(v) filter (where cat = 'weak') as weak, max(v) filter (where cat = 'forcing') as forcing from o where r = 1 group by k)
    select p_partkey, coalesce(strong, p_size) as strong, coalesce(weak, 0) as weak, coalesce(forcing, -1) as forcing from part left join w on p_partkey = k""",
)
def pivot_overrides(spark, sf_dir):
    cats = ["strong", "weak", "forcing"]
    o = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("k"), F.element_at(F.array(*[F.lit(c) for c in cats]), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("cat"), "l_quantity", "l_orderkey", "l_linenumber")
    # The last by file order wins; max_by keeps it without a sort.
    wide = o.groupBy("k").pivot("cat", cats).agg(F.max_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_quantity")))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = p.join(wide, p.p_partkey == wide.k, "left")
    return j.select("p_partkey", F.coalesce("strong", F.col("p_size").cast("double")).alias("strong"), F.coalesce("weak", F.lit(0.0)).alias("weak"), F.coalesce("forcing", F.lit(-1.0)).alias("forcing"))


@query(
    "seat_unpivot",
    """select ((s.i + l_linenumber) % 4 + 1)::int as seat, count(*) as n, round(sum(case s.i when 0 then l_quantity when 1 then l_extendedprice when 2 then l_discount else l_tax end), 2) as total from lineitem, (values (0), (1), (2), (3)) s(i) group by 1""",
)
def seat_unpivot(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    long = t.select("l_linenumber", F.posexplode(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("i", "v"))
    return long.groupBy(((F.col("i") + F.col("l_linenumber")) % 4 + 1).cast("int").alias("seat")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("unnest_json", "select event_type, sum(json_extract(props, '$.k')::bigint)::bigint as total, count(*) filter (where json_extract(props, '$.k') is null) as missing from events group by 1")
def unnest_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p")).select("event_type", "p.*")
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("missing"))


@query("union_aligned", "select src, count(*) as n, count(extra) as n_extra from (select 'c' as src, c_custkey as k, c_acctbal as extra from customer union all select 's', s_suppkey, null from supplier) x group by 1")
def union_aligned(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("src"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("extra"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("src"), F.col("s_suppkey").alias("k"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("src").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra"))


@query("distinct_first", "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as r from lineitem) x where r = 1")
def distinct_first(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m")).select("l_partkey", "m.*")


@query("set_difference", "select count(*) as n from (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A' except select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R') x")
def set_difference(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    # Both sides come from one scan and one aggregate.
    g = t.groupBy("l_suppkey", "l_partkey").agg(F.max("l_returnflag").alias("f"))
    return g.where("f = 'A'").agg(F.count("*").alias("n"))


@query("top_k_sorted", "select c_custkey, c_mktsegment, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20")
def top_k_sorted(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("horizontal_ops", "select l_returnflag, round(sum(greatest(l_discount, l_tax)), 4) as hi, round(sum(least(l_discount, l_tax)), 4) as lo, count(*) filter (where l_discount > 0.05 and l_tax > 0.05) as both, count(*) filter (where l_discount > 0.05 or l_tax > 0.05) as either from lineitem group by 1")
def horizontal_ops(spark, sf_dir):
    d, x = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(F.greatest(d, x)), 4).alias("hi"), F.round(F.sum(F.least(d, x)), 4).alias("lo"), F.count_if((d > 0.05) & (x > 0.05)).alias("both"), F.count_if((d > 0.05) | (x > 0.05)).alias("either")
    )


@query("text_contract_parse", "select substr(o_orderpriority, 1, 1)::int as level, upper(regexp_extract(o_orderpriority, '^[0-9]-(.*)$', 1)) as name, count(*) as n from orders group by all")
def text_contract_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return o.groupBy(F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"), F.upper(F.regexp_extract("o_orderpriority", "^[0-9]-(.*)$", 1)).alias("name")).agg(F.sum("n").alias("n"))


@query("date_parts", "select extract(year from o_orderdate)::int as y, extract(month from o_orderdate)::int as m, count(*) as n, min(epoch(o_orderdate)::bigint) as first_s from orders group by all")
def date_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"), F.min(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("first_s"))


@query("per_group_cap", "select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as r from lineitem) x where r <= 5")
def per_group_cap(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    # Spark's window group limit cuts each map task to five rows a key before the shuffle.
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber").withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")
