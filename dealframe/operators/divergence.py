"""Where auctions leave a bidding tree, and which call lost most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.written import Scratch, Written


def _first(auction: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(auction, "-"), F.lit(1), n), "-")


def _calls(auction: Column) -> Column:
    return F.when(auction == "", 0).otherwise(F.size(F.split(auction, "-")))


def _level(depth: Column) -> Column:
    """The lowest set bit of a depth from 1 on: 1, 2, 1, 4, 1, 2, 1, 8 ..."""
    return depth.bitwiseAND(-depth)


def longest_prefix(auctions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(auction, depth): for each distinct auction how many of its first calls are a node of the tree.

    nodes: (node, ...), closed under prefixes; repeated nodes count once. Null auctions
    have no row; an auction with no call, or whose first call is no node, has depth 0.

    Each auction's depth is found bit by bit from the highest: a round asks by an equality
    join for the prefix that is longer by the bit, and keeps the bit where that is a node.
    A depth is asked for only in the round of its lowest set bit, so that all rounds
    together read and shuffle the tree once; there are as many rounds as bits in the
    greatest depth. Auctions too short for a bit skip its join. Prefixes that very many
    auctions ask for are split by adaptive execution.
    """
    tree, tmp = Scratch(), Scratch()
    level = _level(_calls(F.col("node")))
    levels = tree.keep(Written(nodes.select("node").where("node <> ''").distinct().withColumn("level", level), by=["level"]))
    state = tmp.keep(auctions.select("auction").where("auction is not null").distinct().withColumn("depth", F.lit(0)))
    bit = levels.agg(F.max("level")).first()[0] or 0
    while bit:
        goal = F.col("depth") + bit
        asks = state.withColumn("_size", _calls(F.col("auction")))
        ask = asks.where(F.col("_size") >= goal).select("auction", "depth", _first(F.col("auction"), goal).alias("node"))
        hit = levels.where(F.col("level") == bit).select("node", F.lit(bit).alias("_bit"))
        found = ask.join(hit, "node", "left").select("auction", (F.col("depth") + F.coalesce("_bit", F.lit(0))).alias("depth"))
        last, tmp = tmp, Scratch()
        state = tmp.keep(found.unionByName(asks.where(F.col("_size") < goal).select("auction", "depth")))
        last.drop()
        bit //= 2
    tree.drop()
    return state


def shared_nodes(matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """(auction, depth, below): the signatures below each shared node, from the root (step 0) to the last.

    matched: ``longest_prefix``; nodes: (node, signatures), the root's node being ''. An
    auction's list is as long as its shared calls.
    """
    steps = matched.select("auction", "depth", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("_step"))
    steps = steps.withColumn("node", _first(F.col("auction"), F.col("_step")))
    met = steps.join(nodes.select("node", "signatures"), "node", "left")
    listed = met.groupBy("auction", "depth").agg(F.array_sort(F.collect_list(F.struct("_step", "signatures"))).alias("_b"))
    return listed.select("auction", "depth", F.transform("_b", lambda x: x["signatures"]).alias("below"))


def losses(deals: DataFrame, shared: DataFrame) -> DataFrame:
    """deals (index, auction, scores, score, ...) with step, node, best, loss, critical_step and critical_loss.

    scores: by signature, for the side that bids; score: that of the auction's own end.
    step: the first call that isn't in the tree, null where the whole auction is; node:
    the last shared one; best: the highest score of an end below it; loss: best less score.
    The critical step is the call after which the best that can be reached falls most, the
    first of equals; where the auction leaves the tree its own score is what is reached.
    Null where no call loses anything. Null auctions keep their row, with nulls.
    """
    size = _calls(F.col("auction"))
    best = F.transform("below", lambda s: F.array_max(F.transform(s, lambda i: F.get(F.col("scores"), i))))
    j = deals.join(shared, "auction", "left").withColumn("_best", best).withColumn("_left", F.col("depth") < size)
    # A column each, so that none is worked out anew where the next reads it twice.
    j = j.withColumn("_reached", F.when(F.col("_left"), F.concat("_best", F.array("score"))).otherwise(F.col("_best")))
    falls = lambda a, i: F.get(F.col("_reached"), i) - a
    j = j.withColumn("_falls", F.transform(F.slice("_reached", 2, 1 << 20), falls)).withColumn("_most", F.array_max("_falls"))
    most = F.col("_most")
    falls = most > 0
    at = F.element_at("_best", -1)
    return j.select(
        *deals.columns,
        F.when(F.col("_left"), F.col("depth") + 1).alias("step"),
        _first(F.col("auction"), F.col("depth")).alias("node"),
        at.alias("best"),
        (at - F.col("score")).alias("loss"),
        F.when(falls, F.array_position("_falls", most).cast("int")).alias("critical_step"),
        F.when(falls, most).alias("critical_loss"),
    )


def par_contracts(text: Column) -> Column:
    """Contracts of a par list such as ``4SX-N-1, 4HN=, 5CX EW -2``: structs (level, strain 0-4, dbl, declarer, over).

    Separated by commas or semicolons; what is no contract is left out; over is the
    tricks above (or, below zero, under) the contract, 0 for ``=``, null if not told;
    declarer may be a seat or a pair.
    """
    cell = F.transform(F.split(F.upper(text), r"\s*[,;]\s*"), lambda c: F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), "NT", "N"))
    form = r"^([1-7])([CDHSN])(X{0,2})-?(NS|EW|[NESW])?(=|[+-]\d+)?$"
    part = lambda c, i: F.nullif(F.regexp_extract(c, form, i), F.lit(""))

    def one(c: Column) -> Column:
        return F.struct(
            part(c, 1).cast("int").alias("level"),
            (F.instr(F.lit(A.STRAINS), part(c, 2)) - 1).alias("strain"),
            F.length(F.regexp_extract(c, form, 3)).alias("dbl"),
            part(c, 4).alias("declarer"),
            F.when(part(c, 5) == "=", 0).otherwise(part(c, 5).try_cast("int")).alias("over"),
        )

    return F.transform(F.filter(cell, lambda c: c.rlike(form)), one)
