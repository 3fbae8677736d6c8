"""Errors of auctions, bidding models and their arena, next-bid rankings and posteriors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealframe.functions import auction as A
from dealframe.functions import scoring as S


def contract_parts(text: Column) -> Column:
    """struct(level, strain 0-4, dbl, declarer) of ``4SXN``; all null for a pass or what is no contract."""
    got = lambda i: F.nullif(F.regexp_extract(F.upper(F.replace(text, F.lit(" "), F.lit(""))), "^([1-7])(?:NT?|[CDHS])(X{0,2})([NESW]?)$", i), F.lit(""))
    strain = F.instr(F.lit("CDHSN"), F.substring(F.upper(F.trim(text)), 2, 1)) - 1
    level = got(1).try_cast("int")
    return F.struct(level.alias("level"), F.when(level.isNotNull(), strain).alias("strain"), F.when(level.isNotNull(), F.length(F.coalesce(got(2), F.lit("")))).alias("dbl"), got(3).alias("declarer"))


def contract_rank(level: Column, strain: Column) -> Column:
    """1C 0 ... 7N 34; -1 for a pass."""
    return F.coalesce((level - 1) * 5 + strain, F.lit(-1))


def zone(level: Column, strain: Column) -> Column:
    """0 pass, 1 part score, 2 game, 3 small slam, 4 grand slam."""
    kind = S.contract_type(level, strain)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"Pass": 0, "Partial": 1, "Game": 2, "SSlam": 3, "GSlam": 4}.items() for x in kv]), kind), F.lit(0))


def error_family(chosen: Column, par: Column, score: Column, par_score: Column, tolerance: float = 0.0) -> Column:
    """What kind of error a chosen contract is against the par contract; null where its score reaches par.

    chosen and par are ``contract_parts``; sides are those of their declarers.
    """
    side = lambda c: F.when(c["declarer"].isin("N", "S"), "NS").when(c["declarer"].isin("E", "W"), "EW")
    passed = chosen["level"].isNull()
    ours = side(chosen) == side(par)
    rank = contract_rank(chosen["level"], chosen["strain"])
    best = contract_rank(par["level"], par["strain"])
    family = (
        F.when(~passed & ~F.coalesce(ours, F.lit(False)) & (par["dbl"] > 0), "missed_sacrifice")
        .when(passed, "premature_pass")
        .when(F.coalesce(ours, F.lit(False)) & (chosen["strain"] != par["strain"]) & (zone(chosen["level"], chosen["strain"]) == zone(par["level"], par["strain"])), "wrong_strain")
        .when(rank > best, "overbid")
        .when(rank < best, "underbid")
        .otherwise("other")
    )
    return F.when(score + tolerance < par_score, family)


def error_summary(rows: DataFrame, family: str, keys: list[str], imp_loss: str, ev_loss: str) -> DataFrame:
    """(keys, family, n, IMP_Loss, EV_Loss, Priority_Score): grouped losses; priority is 1000 IMPs' worth and the points lost."""
    g = rows.where(F.col(family).isNotNull()).groupBy(*keys, family)
    g = g.agg(F.count("*").alias("n"), F.sum(imp_loss).alias("IMP_Loss"), F.sum(F.greatest(F.col(ev_loss), F.lit(0))).alias("EV_Loss"))
    return g.withColumn("Priority_Score", F.col("IMP_Loss") * 1000 + F.col("EV_Loss"))


#: Bidding models by name: deals with their columns -> deals with a column ``auction_model``.
Model = Callable[[DataFrame], DataFrame]
_MODELS: dict[str, Model] = {}


def model(name: str):
    """Register a bidding model."""

    def put(fn: Model) -> Model:
        _MODELS[name] = fn
        return fn

    return put


def models() -> list[str]:
    return sorted(_MODELS)


def run_model(name: str, deals: DataFrame) -> DataFrame:
    if name not in _MODELS:
        raise ValueError(f"no model {name}; there are {', '.join(models())}")
    return _MODELS[name](deals)


@model("Actual")
def _actual(deals: DataFrame) -> DataFrame:
    return deals.withColumn("auction_model", F.col("auction"))


@model("Passive")
def _passive(deals: DataFrame) -> DataFrame:
    """The first bid of the auction and no more."""
    start = F.regexp_extract("auction", "^((?:P-|X-|XX-)*[1-7][CDHSN])", 1)
    return deals.withColumn("auction_model", F.when(start != "", F.concat(start, F.lit("-P-P-P"))).otherwise(F.lit("P-P-P-P")))


def ns_scores(deals: DataFrame, key: str, tricks: Column, out: str) -> DataFrame:
    """(key, out): North-South's score of each row's ``auction_model``; 0 when passed out.

    Auctions are read once each: rows meet their contract by equality.
    """
    t = A.tokens(F.col("auction_model"))
    c = A.contract(t)
    said = deals.select("auction_model").distinct().select("auction_model", c.alias("_c"), F.length(A.doubling(t)).alias("_x"), A.declarer(t, F.lit("N")).alias("_d"))
    j = deals.select(key, "Dealer", "Vul", "auction_model", tricks.alias("_t")).join(said, "auction_model")
    decl = A.next_direction(F.col("Dealer"), F.instr(F.lit("NESW"), F.col("_d")) - 1)
    sc = S.score(F.substring("_c", 1, 1).cast("int"), F.instr(F.lit("CDHSN"), F.substring("_c", 2, 1)) - 1, F.col("_x"), A.side_vulnerable(F.col("Vul"), decl), F.col("_t"))
    return j.select(key, F.coalesce(F.when(decl.isin("N", "S"), sc).otherwise(-sc), F.lit(0)).alias(out))


def arena(deals: DataFrame, first: str, second: str, key: str, tricks: Column) -> DataFrame:
    """(key, score_1, score_2, diff, imps): two models on the same deals, North-South's view."""
    a, b = (ns_scores(run_model(m, deals), key, tricks, f"score_{i}") for i, m in ((1, first), (2, second)))
    j = a.join(b, key).withColumn("diff", F.col("score_1") - F.col("score_2"))
    return j.withColumn("imps", S.imp_signed(F.col("diff")))


def rank_next_bids(matched: DataFrame, keys: list[str], vulnerable: Column, par: Column, score: Column) -> DataFrame:
    """(keys, n_nv, n_v, par_nv, par_v, avg_par, ev, ev_std, rank): next calls of a node by their mean par, those without deals last.

    par_nv and par_v are sums over their deals divided by all deals of the call.
    """
    g = matched.groupBy(*keys).agg(
        F.count_if(~vulnerable).alias("n_nv"),
        F.count_if(vulnerable).alias("n_v"),
        (F.sum(F.when(~vulnerable, par).otherwise(0)) / F.count("*")).alias("par_nv"),
        (F.sum(F.when(vulnerable, par).otherwise(0)) / F.count("*")).alias("par_v"),
        F.avg(par).alias("avg_par"),
        F.avg(score).alias("ev"),
        F.stddev_samp(score).alias("ev_std"),
    )
    # One row a node and call: the window sorts the calls of a node.
    order = Window.partitionBy(*keys[:-1]).orderBy(F.col("avg_par").isNull(), F.desc("avg_par"), keys[-1])
    return g.withColumn("rank", F.row_number().over(order))


def running_board_totals(boards: DataFrame, match: str, order: str, value: str, out: str) -> DataFrame:
    """A match's running total, board by board."""
    w = Window.partitionBy(match).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return boards.withColumn(out, F.sum(value).over(w))


def divergence(first: Column, second: Column) -> Column:
    """The step (from 1) at which two token arrays part; null where they are equal."""
    same = F.zip_with(first, second, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at.cast("int"))
