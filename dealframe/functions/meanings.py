"""What a call says: facts of the auction before it, and named rules over those facts.

A player's passes count as calls: whoever has called before makes a rebid. Partner's
bid is the latest one. Rules are SQL conditions in layers; a layer may use the names
of the layers above it. A condition that is null doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealframe.functions.auction import is_bid

#: Facts by name: of the call (lv, st), partner's latest bid (pl, ps) and last call (pcall), the player's own, the opponents' and the auction's last bid, the two calls before.
FACTS = ["call", "lv", "st", "turn", "prev", "prev2", "pcall", "pl", "ps", "p_turns", "p_strains", "p_named", "own_call", "own_s", "one_s", "own_passed", "ours", "ol", "os", "strains", "named", "ll", "ls"]

_MAJOR_1 = "pl = 1 and ps in ('H', 'S')"
_RANK = "position({} in 'CDHSN')"

LAYERS: list[dict[str, str]] = [
    {
        "is_pass": "call = 'P'",
        "is_double": "call = 'X'",
        "is_redouble": "call = 'XX'",
        "is_bid": "lv > 0",
        "is_major": "st in ('H', 'S')",
        "is_minor": "st in ('C', 'D')",
        "is_notrump": "st = 'N'",
        "is_slam_level": "lv >= 6",
        "is_game_level": "(lv = 3 and st = 'N') or (lv = 4 and st in ('H', 'S')) or (lv = 5 and st in ('C', 'D'))",
        "is_opening": "lv > 0 and ll is null",
        "is_overcall": "lv > 0 and ol > 0 and not ours",
        "is_response": "lv > 0 and pl > 0 and turn < 4",
        "is_rebid": "lv > 0 and turn >= 4",
        "is_competitive": "lv > 0 and ol > 0",
        "is_balancing": "lv > 0 and turn >= 3 and prev = 'P' and prev2 = 'P'",
        "is_new_suit": "lv > 0 and st <> 'N' and not named",
        "is_minimum": f"lv > 0 and lv = case when ll is null then 1 when {_RANK.format('st')} > {_RANK.format('ls')} then ll else ll + 1 end",
        "is_passed_hand": "call <> 'P' and own_passed",
        "is_free_bid": "call <> 'P' and prev = 'P'",
        "is_responsive_double": "call = 'X' and pcall = 'X'",
        "is_takeout": "call = 'X' and substr(prev, 1, 1) in ('1', '2', '3') and pl is null",
        "is_penalty": "call = 'X' and substr(prev, 1, 1) in ('4', '5', '6', '7')",
        "is_negative_double": "call = 'X' and turn < 4 and substr(prev, 1, 1) between '1' and '7' and substr(pcall, 1, 1) between '1' and '7'",
        "is_lead_directing_double": "call = 'X' and (prev = '2C' or (substr(prev, 1, 1) in ('4', '5', '6', '7') and substr(prev, 2, 1) in ('C', 'D', 'H')))",
        "_notrump_transfer": "pl = 1 and ps = 'N' and call in ('2D', '2H', '4D', '4H')",
        "is_transfer": "ps = 'N' and ((pl = 1 and call in ('2D', '2H', '4D', '4H')) or (pl = 2 and call in ('3D', '3H')))",
        "_stayman": "ps = 'N' and ((pl = 1 and call = '2C') or (pl = 2 and call = '3C'))",
        "is_checkback": "call in ('2C', '2D') and pcall = '1N' and substr(own_call, 1, 1) = '1'",
        "is_bergen": f"call in ('3C', '3D') and {_MAJOR_1}",
        "is_jacoby_2nt": f"call = '2N' and {_MAJOR_1}",
        "is_transfer_completion": "(pcall = '2D' and call = '2H') or (pcall = '2H' and call = '2S')",
        "is_super_accept": "(pcall = '2D' and call = '3H') or (pcall = '2H' and call = '3S')",
        "is_negative_response": "pl = 2 and ps = 'C' and call = '2D'",
        "is_positive_response": "pl = 2 and ps = 'C' and lv > 0 and call <> '2D'",
    },
    {
        "is_jump": "is_bid and not is_minimum and (ll is null or lv > ll)",
        "is_part_score": "is_bid and not is_game_level and not is_slam_level",
        "is_cuebid": "is_overcall and lv = 2 and ol = 1 and os in ('H', 'S') and st = os",
        "_unusual": "is_overcall and call = '2N'",
        "is_preempt": "is_opening and lv >= 2 and st <> 'N' and call <> '2C'",
        "is_gambling": "is_opening and call = '3N'",
        "is_strong": "is_opening and call in ('2C', '2N')",
        "is_fourth_suit": "is_new_suit and strains = 3 and (is_rebid or is_response)",
        "is_drury": f"call = '2C' and is_passed_hand and {_MAJOR_1}",
        "is_optional_double": "is_double and substr(prev, 1, 1) = '3' and not is_takeout",
        "is_limit_bid": f"is_response and call = '1N' and {_MAJOR_1}",
        "is_direct": "is_bid and turn >= 1 and (prev <> 'P' or not is_balancing)",
        "is_reverse": f"is_rebid and lv = 2 and st <> 'N' and {_RANK.format('st')} > {_RANK.format('one_s')}",
        "is_relay": "_stayman or is_negative_response",
        "is_escape": "prev = 'X' and (is_redouble or is_new_suit)",
    },
    {
        "is_splinter": "is_jump and is_response and is_minor and ps in ('H', 'S') and lv >= 3",
        "is_two_suited": "is_cuebid or _unusual",
        "is_jump_shift": "is_jump and is_new_suit",
        "is_game_forcing": "(is_opening and call = '2C') or is_jacoby_2nt or (is_response and lv = 2 and is_new_suit and pl = 1)",
        "is_weak": "is_preempt or _unusual",
        "is_destructive": "is_preempt or is_gambling or _unusual or is_penalty",
        "is_aggressive": "is_balancing or is_preempt or is_gambling or _unusual or (is_overcall and (lv >= 2 or is_jump)) or (is_competitive and lv >= 4)",
        "is_long_suit_showing": "is_preempt or is_gambling or (is_rebid and not is_new_suit and st = own_s)",
    },
    {
        "_fit": "(is_bid and st = ps) or is_splinter",
        "_artificial": "is_two_suited or (is_opening and call = '2C') or is_splinter or is_fourth_suit",
        "is_extra_values": "is_reverse or (is_jump_shift and is_rebid)",
    },
    {
        "is_raise": "_fit or is_drury or is_bergen or is_jacoby_2nt",
        "is_preference": "is_bid and p_turns >= 2 and p_strains >= 2 and p_named and not _fit",
        "is_key_card_ask": "call = '4N' and _fit",
        "is_game_try": "_fit and is_jump and not is_preempt and is_game_level",
        "is_invitational": "_fit and is_jump and not is_preempt and is_part_score",
        "is_natural": "is_bid and not _artificial",
        "is_artificial": "_artificial or is_transfer or _stayman",
        "is_conventional": "_artificial or _notrump_transfer or is_checkback or is_drury or is_bergen or is_jacoby_2nt",
        "is_alertable": "_artificial or _notrump_transfer or is_drury or is_bergen or is_jacoby_2nt",
    },
    {
        "is_slam_try": "is_key_card_ask or (_fit and is_jump and not is_preempt and is_slam_level)",
        "is_asking": "is_key_card_ask or (_stayman and pl = 1)",
        "_minimum_raise": "is_raise and not is_jump and not is_game_forcing",
        "is_conservative": "is_pass or is_limit_bid or (not is_preempt and (is_minimum or (is_raise and not is_jump)))",
    },
    {
        "is_constructive": "is_bid and not is_preempt and (_fit or is_response or is_rebid or is_slam_try or is_game_try)",
        "is_non_forcing": "_minimum_raise or is_preference",
        "is_captain": "is_bid and ((ps = 'N' and pl in (1, 2)) or is_asking)",
        "is_describer": "is_opening or is_rebid or is_limit_bid",
        "is_vulnerability_action": "is_competitive and lv >= 4",
        "is_high_preempt": "is_preempt and lv >= 4",
    },
]
#: Names that say the same of a call as another does.
SAME = {
    "is_sign_off": "is_pass", "is_reopening": "is_balancing", "is_balanced_showing": "is_notrump", "is_fit_seek": "is_new_suit", "is_cheapest_bid": "is_minimum",
    "is_support_showing": "is_raise", "is_fit_established": "is_raise", "is_correction": "is_preference", "is_forcing": "is_fourth_suit", "is_short_showing": "is_splinter",
    "is_semi_forcing": "is_limit_bid", "is_telling": "is_limit_bid", "is_minimum_showing": "_minimum_raise", "is_maximum_showing": "is_super_accept", "is_waiting_bid": "is_negative_response",
}
NAMES = [n for layer in LAYERS for n in layer if not n.startswith("_")] + list(SAME)


def with_facts(df: DataFrame, toks: Column) -> DataFrame:
    """df with the columns FACTS of the last call of ``toks``."""
    n = F.size(toks)
    at = F.transform(F.slice(toks, 1, F.greatest(n - 1, F.lit(0))), lambda t, i: F.struct(t.alias("t"), ((n - 1 - i) % 4).alias("ago")))
    df = df.withColumns({"_n": n, "_at": at, "call": F.try_element_at(toks, F.lit(-1))})
    df = df.withColumns({"_bids": F.filter("_at", lambda x: is_bid(x["t"])), "st": F.when(is_bid(F.col("call")), F.substring("call", 2, 1)), "lv": F.when(is_bid(F.col("call")), F.substring("call", 1, 1).cast("int"))})

    def latest(calls: Column, part: int | None = None) -> Column:
        t = F.try_element_at(calls, F.lit(-1))["t"]
        return t if part is None else F.substring(t, 1, 1).cast("int") if part == 1 else F.substring(t, 2, 1)

    strain = lambda calls: F.array_distinct(F.transform(calls, lambda x: F.substring(x["t"], 2, 1)))
    by = lambda of, *ago: F.filter(of, lambda x: x["ago"].isin(*ago))
    bids, calls = F.col("_bids"), F.col("_at")
    df = df.withColumns({"_p": by(bids, 2), "_o": by(bids, 0), "_t": by(bids, 1, 3), "_pc": by(calls, 2), "_oc": by(calls, 0)})
    p, o, t = F.col("_p"), F.col("_o"), F.col("_t")
    facts = {
        "turn": F.col("_n") - 1, "prev": latest(calls), "prev2": F.try_element_at(calls, F.lit(-2))["t"], "pcall": latest(F.col("_pc")), "pl": latest(p, 1), "ps": latest(p, 2),
        "p_turns": F.size("_pc"), "p_strains": F.size(strain(p)), "p_named": F.array_contains(strain(p), F.col("st")), "own_call": latest(F.col("_oc")), "own_s": latest(o, 2),
        "one_s": latest(F.filter(o, lambda x: F.substring(x["t"], 1, 1) == "1"), 2), "own_passed": F.exists("_oc", lambda x: x["t"] == "P"), "ours": (F.size(p) > 0) | (F.size(o) > 0), "ol": latest(t, 1), "os": latest(t, 2),
        "strains": F.size(strain(bids)), "named": F.array_contains(strain(bids), F.col("st")), "ll": latest(bids, 1), "ls": latest(bids, 2),
    }
    return df.withColumns(facts).drop("_n", "_at", "_bids", "_p", "_o", "_t", "_pc", "_oc")


def with_meanings(df: DataFrame, toks: Column) -> DataFrame:
    """df with a boolean column for each of NAMES, of the last call of ``toks``; columns of these or of the facts' names are replaced."""
    keep = [c for c in df.columns if c not in NAMES and c not in FACTS]
    df = with_facts(df, toks)
    for layer in [*LAYERS, SAME]:
        df = df.withColumns({k: F.coalesce(F.expr(v), F.lit(False)) for k, v in layer.items()})
    return df.select(*keep, *NAMES)
