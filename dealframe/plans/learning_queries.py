"""Rules learned from the table's own candidates, partners' posteriors, and a stream that ends."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import criteria as C
from dealframe.functions import dsl
from dealframe.functions.hand import balanced, suits
from dealframe.operators import posteriors, rules
from dealframe.plans.bridge_queries import TOK, W
from dealframe.plans.deals import bids, deals
from dealframe.plans.registry import query
from dealframe.plans.table_queries import CRIT, HOLDS, METRIC_CASE, SEATED, SEAT_HANDS, _points, bidding_table
from dealframe.session import table
from dealframe.streaming import events
from dealframe.written import Written, shared_dir

MIN_LIFT, MIN_RATE, MIN_COUNT = 1.02, 0.2, 20


@query(
    "learned_rules",
    f"""{W}, {CRIT}, {SEAT_HANDS}, cand as (select distinct c, name, op, v from pr),
    st as (select index, case when i.w > 1 then array_to_string({TOK}[1:i.w - 1], '-') else '' end as prefix, {TOK}[i.w] as call, ((i.w - 1) % 4 + 1)::int as seat from deals, range(1, 16) i(w) where i.w <= len({TOK})),
    ev as (select index, seat, c, name, op, ({HOLDS}) as ok from (select hf.*, cand.*, {METRIC_CASE} as x from hf, cand) y),
    g as (select prefix, call, c, name, op, count(*) as n, count(*) filter (where ok) as p from st join ev using (index, seat) group by all),
    r as (select g.*, sum(n) over w - n as nn, sum(p) over w - p as pp from g window w as (partition by prefix, c)),
    q as (select prefix, call, c as criterion, name, op, n as pos_count, nn as neg_count, p / n as pos_rate, case when nn > 0 then pp / nn end as neg_rate, case when pp > 0 then (p / n) / (pp / nn) end as lift from r),
    k as (select * from q where (lift is null or lift >= {MIN_LIFT}) and pos_rate >= {MIN_RATE} and floor(pos_rate * pos_count) >= {MIN_COUNT} and coalesce(neg_rate, 0) <= 0.8),
    b as (select *, row_number() over (partition by prefix, call, coalesce(name, ''), coalesce(op, '') order by coalesce(lift, 'inf'::double) desc, criterion) as rn from k)
    select prefix, call, criterion, pos_count::bigint as pos_count, neg_count::bigint as neg_count, round(pos_rate, 6) as pos_rate, round(lift, 6) as lift from b where rn = 1""",
)
def learned_rules(spark, sf_dir):
    """What calls say, out of the candidates that the table's criteria give: packed bits a hand, counted by prefix and call."""
    bt = bidding_table(spark, sf_dir)
    texts = bt.select(F.explode(F.concat(*[F.col(f"Agg_Expr_Seat_{s}") for s in (1, 2, 3, 4)])).alias("c")).distinct()
    # A dictionary, as long as there are criteria and not rows.
    names = sorted(r["c"] for r in texts.collect())
    part = lambda c, i: (m[i] if (m := re.fullmatch(r"(\w+) (<=|>=|==|<|>) (\w+)", c)) else None)
    known = spark.createDataFrame([(i, c, part(c, 1), part(c, 2)) for i, c in enumerate(names)], "place int, criterion string, name string, op string")
    d = deals(spark, sf_dir)
    own = F.array(*[F.col(f"Hand_{x}") for x in "NESW"])
    hands = d.select("index", "Dealer", F.posexplode(own).alias("_at", "hand"))
    seat = (F.pmod(F.col("_at") - (F.instr(F.lit("NESW"), F.col("Dealer")) - 1), F.lit(4)) + 1).cast("int")
    cells = C.metrics(F.col("hand")) | {"Balanced": balanced(suits(F.col("hand"))).cast("int")}
    flat = hands.select("index", seat.alias("seat"), *[c.alias(n) for n, c in cells.items()])
    bits = flat.select("index", "seat", rules.packed([dsl.compile_criteria(c if part(c, 2) else f"{c} != 0", flat.columns) for c in names]).alias("bits"))
    steps = rules.auction_steps(d.select("index", A.tokens(F.col("auction")).alias("t")), "index", "t")
    steps = steps.select("index", "prefix", F.col("next_bid").alias("call"), (F.col("step") % 4 + 1).cast("int").alias("seat"))
    counts = Written(rules.counted_bits(steps.join(bits, ["index", "seat"]), ["prefix", "call"], "bits", len(names))).df
    found = rules.accept(rules.learned(counts, "prefix", "call", known), MIN_LIFT, MIN_RATE, MIN_COUNT)
    best = rules.best_by_side(found, ["prefix", "call"])
    return best.select("prefix", "call", "criterion", "pos_count", "neg_count", F.round("pos_rate", 6).alias("pos_rate"), F.round("lift", 6).alias("lift"))


FIT_SQL = f"""{W}, {SEATED}, s as (select auction, suit, a, b from (select auction, unnest(['S', 'H', 'D', 'C']) as suit, unnest([SL_S_1, SL_H_1, SL_D_1, SL_C_1]) as a, unnest([SL_S_3, SL_H_3, SL_D_3, SL_C_3]) as b from pt) x),
x as (select auction, suit, a, count(*) as na from s group by all), y as (select auction, suit, b, count(*) as nb from s group by all),
c as (select auction, suit, sum(case when a + b >= 8 then na * nb else 0 end) / sum(na * nb) as p_fit, sum((a + b) * na * nb) / sum(na * nb) as mean_fit from x join y using (auction, suit) group by 1, 2)"""


@query(
    "partner_fit_posteriors",
    f"{FIT_SQL}, e as (select auction, suit, count(*) as n, avg((a + b >= 8)::int) as seen from s group by 1, 2) select auction, suit, n, round(p_fit, 6) as p_fit, round(seen, 6) as p_fit_seen, round(mean_fit, 6) as mean_fit from c join e using (auction, suit)",
)
def partner_fit_posteriors(spark, sf_dir):
    """The chance of an eight-card fit in each suit given the auction, from the opener's and the responder's histograms."""
    p = _points(spark, sf_dir).join(bids(spark, sf_dir).select("index", "auction"), "index")
    cells = F.array(*[F.struct(F.lit(x).alias("suit"), F.col(f"SL_{x}_1").alias("a"), F.col(f"SL_{x}_3").alias("b")) for x in "SHDC"])
    out = posteriors.partner_fit(p.select("auction", F.inline(cells)), ["auction", "suit"], "a", "b", 13, 8)
    return out.select("auction", "suit", "n", *[F.round(c, 6).alias(c) for c in ("p_fit", "p_fit_seen", "mean_fit")])


LATE, GAP = "1 hour", "2 hours"


@query(
    "stream_sessions",
    """with e as (select distinct event_id, user_id, ts from events), g as (select *, case when ts - lag(ts) over w < interval 2 hours then 0 else 1 end as new from e window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g),
    t as (select user_id, min(ts) as first_ts, max(ts) + interval 2 hours as closes, count(*) as n from s group by user_id, s)
    select user_id, epoch_us(first_ts) as first_us, epoch_us(closes) as closes_us, n from t where closes <= (select max(ts) - interval 1 hour from events)""",
)
def stream_sessions(spark, sf_dir):
    """Sessions of users that are closed when the events have been read as a stream: equal events once, by state; late ones by the watermark."""
    # A pattern, since the stream's source takes a folder or a pattern and the table may be a file.
    path = f"{sf_dir}/event[s].parquet"
    stream = events.event_stream(spark, path, table(spark, sf_dir, "events").schema)
    return events.finished(events.sessions_once(stream, "user_id", "event_id", GAP, LATE), shared_dir(spark)).select(
        "user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("closes_us"), "n"
    )
