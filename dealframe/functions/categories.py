"""What kind of call the last token of an auction is, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealframe.functions.auction import bid_code, is_bid


def _strain(t: Column) -> Column:
    return F.substring(t, 2, 1)


def _level(t: Column) -> Column:
    return F.substring(t, 1, 1).try_cast("int")


def flags(toks: Column) -> dict[str, Column]:
    """Categories of the last call, from the calls before it."""
    n = F.size(toks)
    call = F.try_element_at(toks, F.lit(-1))
    before = F.slice(toks, 1, F.greatest(n - 1, F.lit(0)))
    at = F.transform(before, lambda t, i: F.struct(t.alias("t"), ((n - 1 - i) % 4).alias("ago"), i.alias("i")))
    bids = F.filter(at, lambda x: is_bid(x["t"]))
    partner = F.filter(bids, lambda x: x["ago"] == 2)
    own = F.filter(bids, lambda x: x["ago"] == 0)
    theirs = F.filter(bids, lambda x: x["ago"] % 2 == 1)
    has = lambda a: F.size(a) > 0
    bid = is_bid(call)
    last = F.when(has(bids), F.try_element_at(bids, F.lit(-1))["t"])
    jump = bid & has(bids) & (bid_code(call) - bid_code(last) > 5)
    opening = bid & ~has(bids)
    named = lambda a: F.exists(a, lambda x: _strain(x["t"]) == _strain(call))
    last_theirs = F.coalesce(F.try_element_at(bids, F.lit(-1))["ago"] % 2 == 1, F.lit(False))
    lv, suit = _level(call), _strain(call)
    raw = {
        "is_pass": call == "P",
        "is_double": call == "X",
        "is_redouble": call == "XX",
        "is_bid": bid,
        "is_opening": opening,
        "is_one_level_opening": opening & (lv == 1),
        "is_notrump_opening": opening & (suit == "N"),
        "is_weak_two": opening & (lv == 2) & suit.isin("D", "H", "S"),
        "is_strong_two_clubs": opening & (call == "2C"),
        "is_preempt": opening & (lv >= 3) & (suit != "N"),
        "is_major": bid & suit.isin("H", "S"),
        "is_minor": bid & suit.isin("C", "D"),
        "is_notrump": bid & (suit == "N"),
        "is_overcall": bid & has(theirs) & ~has(partner) & ~has(own),
        "is_response": bid & has(partner) & ~has(own),
        "is_rebid": bid & has(own),
        "is_raise": bid & named(partner),
        "is_single_raise": bid & named(partner) & ~jump,
        "is_jump_raise": jump & named(partner),
        "is_rebid_own_suit": bid & named(own),
        "is_cuebid": bid & named(theirs) & (suit != "N"),
        "is_jump": jump,
        "is_jump_shift": jump & ~named(partner) & ~named(own) & (suit != "N"),
        "is_new_suit": bid & has(bids) & ~named(bids) & (suit != "N"),
        "is_splinter": jump & has(partner) & ~named(bids) & (suit != "N") & (lv >= 3),
        "is_takeout_double": (call == "X") & last_theirs & ~has(partner) & ~has(own),
        "is_negative_double": (call == "X") & last_theirs & has(partner) & ~has(own),
        "is_penalty_double": (call == "X") & last_theirs & (_level(last) >= 4),
        "is_balancing": ~(call == "P") & has(theirs) & (n >= 3) & (F.get(toks, n - 2) == "P") & (F.get(toks, n - 3) == "P"),
        "is_stayman": (call == "2C") & F.coalesce(F.try_element_at(partner, F.lit(-1))["t"] == "1N", F.lit(False)) & ~has(own),
        "is_transfer": call.isin("2D", "2H") & F.coalesce(F.try_element_at(partner, F.lit(-1))["t"] == "1N", F.lit(False)) & ~has(own),
        "is_blackwood": (call == "4N") & has(partner),
        "is_gerber": (call == "4C") & F.coalesce(_strain(F.try_element_at(partner, F.lit(-1))["t"]) == "N", F.lit(False)),
        "is_game": bid & ((lv == 5) | ((lv == 4) & suit.isin("H", "S")) | ((lv == 3) & (suit == "N"))),
        "is_slam": bid & (lv >= 6),
        "is_competitive": ~(call == "P") & has(theirs),
        "is_passed_hand": F.coalesce(F.exists(at, lambda x: (x["ago"] == 0) & (x["t"] == "P") & ~F.exists(bids, lambda b: b["i"] < x["i"])), F.lit(False)),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in raw.items()}


def names(toks: Column) -> Column:
    """The names of the categories that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags(toks).items()]))
