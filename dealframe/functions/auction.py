"""Auction and contract columns. An auction is a dash-joined token string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the game: seats, strains in bidding order, spellings of calls.
SEATS = "NESW"
STRAINS = "CDHSN"
PASSES = ["PASS", "P", "-"]
DOUBLES = ["X", "D", "DBL", "DOUBLE"]
REDOUBLES = ["XX", "R", "RDBL", "REDOUBLE"]


def tokens(auction: Column) -> Column:
    """Canonical tokens: P, X, XX and level + strain, upper case, whatever the separators."""
    text = F.translate(F.upper(F.trim(auction)), "♣♦♥♠", "CDHS")
    parts = F.filter(F.split(text, r"[\s,;\-]+"), lambda t: t != "")

    def one(t: Column) -> Column:
        return (
            F.when(t.isin(PASSES), F.lit("P"))
            .when(t.isin(DOUBLES), F.lit("X"))
            .when(t.isin(REDOUBLES), F.lit("XX"))
            .otherwise(F.regexp_replace(t, "^([1-7])NT$", "$1N"))
        )

    return F.transform(parts, one)


def normalize(auction: Column) -> Column:
    return F.array_join(tokens(auction), "-")


def seat1_view(auction: Column) -> Column:
    """The auction from its first call that isn't a pass."""
    return F.regexp_replace(F.upper(auction), "^(P-)+", "")


def leading_passes(auction: Column) -> Column:
    return (F.length(F.regexp_extract(F.upper(auction), "^((?:P-)*)", 1)) / 2).cast("int")


def bid_code(token: Column) -> Column:
    """P 1, X 2, XX 3, 1C 4 ... 7N 38; unknown 0."""
    level = F.substring(token, 1, 1).try_cast("int")
    strain = F.instr(F.lit(STRAINS), F.substring(token, 2, 1))
    return (
        F.when(token == "P", 1)
        .when(token == "X", 2)
        .when(token == "XX", 3)
        .when(token.rlike("^[1-7][CDHSN]$"), 3 + (level - 1) * 5 + strain)
        .otherwise(0)
    )


def is_bid(token: Column) -> Column:
    return token.rlike("^[1-7][CDHSN]$")


def _bids(toks: Column) -> Column:
    at = F.transform(toks, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    return F.filter(at, lambda x: is_bid(x["t"]))


def contract(toks: Column) -> Column:
    """Last bid of an auction, null when passed out."""
    bids = _bids(toks)
    return F.when(F.size(bids) > 0, F.try_element_at(bids, F.lit(-1))["t"])


def declarer(toks: Column, dealer: Column) -> Column:
    """Direction that first named the strain for the side of the last bid."""
    bids = _bids(toks)
    last = F.try_element_at(bids, F.lit(-1))
    same = F.filter(bids, lambda x: (F.substring(x["t"], 2, 1) == F.substring(last["t"], 2, 1)) & ((last["i"] - x["i"]) % 2 == 0))
    at = (F.instr(F.lit(SEATS), dealer) - 1 + F.try_element_at(same, F.lit(1))["i"]) % 4
    return F.when(F.size(bids) > 0, F.substring(F.lit(SEATS), at + 1, F.lit(1)))


def doubling(toks: Column) -> Column:
    """'', 'X' or 'XX': the last double after the last bid."""
    bids = _bids(toks)
    after = F.slice(toks, F.try_element_at(bids, F.lit(-1))["i"] + 2, F.size(toks))
    last = F.filter(after, lambda t: t.isin("X", "XX"))
    return F.when(F.size(bids) > 0, F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit("")))


def ai_contract(toks: Column, dealer: Column) -> Column:
    """Contract, doubling and declarer as one string; PASS when passed out."""
    return F.coalesce(F.concat(contract(toks), doubling(toks), declarer(toks, dealer)), F.lit("PASS"))


def seat_to_act(toks: Column, dealer: Column) -> Column:
    return F.substring(F.lit(SEATS), (F.instr(F.lit(SEATS), dealer) - 1 + F.size(toks)) % 4 + 1, F.lit(1))


def valid(toks: Column, require_complete: bool = False) -> Column:
    """The legality automaton as one fold over the tokens.

    State: top bid code, its side, doubling level, trailing passes, calls, ok, done.
    """
    zero = F.struct(
        F.lit(0).alias("top"), F.lit(-1).alias("side"), F.lit(0).alias("dbl"), F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(True).alias("ok"), F.lit(False).alias("done")
    )

    def step(s: Column, t: Column) -> Column:
        side = s["n"] % 2
        bid, code = is_bid(t), bid_code(t)
        passed = t == "P"
        dbl = (t == "X") & (s["top"] > 0) & (s["dbl"] == 0) & (s["side"] != side)
        rdbl = (t == "XX") & (s["top"] > 0) & (s["dbl"] == 1) & (s["side"] == side)
        legal = passed | (bid & (code > s["top"])) | dbl | rdbl
        run = F.when(passed, s["run"] + 1).otherwise(0)
        return F.struct(
            F.when(bid, code).otherwise(s["top"]).alias("top"),
            F.when(bid, side).otherwise(s["side"]).alias("side"),
            F.when(bid, 0).when(t == "X", 1).when(t == "XX", 2).otherwise(s["dbl"]).alias("dbl"),
            run.alias("run"),
            (s["n"] + 1).alias("n"),
            (s["ok"] & legal & ~s["done"]).alias("ok"),
            (((s["top"] > 0) & ~bid & (run >= 3)) | (run >= 4)).alias("done"),
        )

    return F.aggregate(toks, zero, step, lambda s: s["ok"] & (s["done"] if require_complete else F.lit(True)) & (s["n"] > 0))


def complete(toks: Column) -> Column:
    return valid(toks, True)


def contract_key(level: Column, strain: Column, dbl: Column, opener: Column) -> Column:
    """Signature (((level * 5 + strain) * 3 + doubling) * 2 + pair is the opener's)."""
    return ((level * 5 + strain) * 3 + dbl) * 2 + opener


def competitive(toks: Column) -> Column:
    """Both partnerships make a call other than pass."""
    calls = F.transform(toks, lambda t, i: F.when(t != "P", i % 2))
    return F.coalesce(F.array_contains(calls, 0), F.lit(False)) & F.coalesce(F.array_contains(calls, 1), F.lit(False))


#: Other spellings of calls in patterns.
CALLS = {**dict.fromkeys(PASSES, "P"), **dict.fromkeys(DOUBLES, "X"), **dict.fromkeys(REDOUBLES, "XX")}
META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def matches(text: Column, pattern: str) -> Column:
    """A pattern without metacharacters is a case-insensitive prefix; else a regex anchored at the start."""
    if META.search(pattern):
        return text.rlike("(?i)^(?:" + pattern.removeprefix("^") + ")")
    return F.upper(text).startswith(pattern.upper())


def normalize_pattern(pattern: str) -> str:
    """Upper-case calls of a pattern; append the passes that complete a literal end.

    Three after a call, four in all for a passed-out deal; none after an open wildcard.
    A final $ stays.
    """
    p = pattern.strip()
    tail = "$" if p.endswith("$") else ""
    p = p.removesuffix("$")
    p = re.sub(r"(?<![A-Za-z\\\[\]])([1-7](?:nt|[cdhsn])|pass|p|x{1,2}|rdbl|redouble|dbl|double|d|r)(?![A-Za-z\]])", lambda m: CALLS.get(m[0].upper(), re.sub("NT$", "N", m[0].upper())), p, flags=re.I)
    if re.search(r"(\.\*|\.\+|[*+\])}])$", p):
        return p + tail
    calls = p.lstrip("^").split("-")
    trailing = 0
    for c in reversed(calls):
        if c != "P":
            break
        trailing += 1
    need = 4 if trailing == len(calls) else 3
    return p + "-P" * max(0, need - trailing) + tail


def normalize_pattern_to_seat1(pattern: str) -> str:
    """The normalised pattern from its first call that isn't a pass."""
    p = normalize_pattern(pattern)
    return re.sub(r"^(\^?)(?:P-)+(?=[^P])", r"\1", p)


def bid_at_seat(toks: Column, seat: int, nth: int = 1) -> Column:
    """The ``nth`` call of seat 1 to 4 (1 opens the auction); null where there is none."""
    return F.get(toks, F.lit(seat - 1 + 4 * (nth - 1)))


def opens_at_seat(toks: Column, seat: int) -> Column:
    """The first call that isn't a pass is made at this seat."""
    first = F.array_position(F.transform(toks, lambda t: t != "P"), True)
    return (first > 0) & ((first - 1) % 4 + 1 == seat)


def opener(toks: Column, dealer: Column) -> Column:
    """Direction of the first bid; null without one."""
    first = F.try_element_at(_bids(toks), F.lit(1))["i"]
    return F.when(first.isNotNull(), F.substring(F.lit(SEATS), (F.instr(F.lit(SEATS), dealer) - 1 + first) % 4 + 1, F.lit(1)))


def next_direction(direction: Column, steps: int = 1) -> Column:
    return F.substring(F.lit(SEATS), F.pmod(F.instr(F.lit(SEATS), direction) - 1 + steps, F.lit(4)) + 1, F.lit(1))


def leader(toks: Column, dealer: Column) -> Column:
    """Direction that leads: the declarer's left."""
    return next_direction(declarer(toks, dealer))


def strict_dealer(text: Column) -> Column:
    """N, E, S or W of a direction's letter or name; an error otherwise."""
    letter = F.upper(F.substring(F.trim(text), 1, 1))
    return F.when(letter.isin(*SEATS), letter).otherwise(F.raise_error(F.concat(F.lit("not a dealer: "), F.coalesce(text, F.lit("null")))))


#: Other spellings of vulnerabilities.
VULS = {"NONE": "None", "O": "None", "-": "None", "LOVE": "None", "NS": "N_S", "N_S": "N_S", "N-S": "N_S", "EW": "E_W", "E_W": "E_W", "E-W": "E_W", "BOTH": "Both", "ALL": "Both", "B": "Both"}


def normal_vul(text: Column) -> Column:
    """None, N_S, E_W or Both; null for what is no vulnerability."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in VULS.items() for x in kv]), F.upper(F.trim(text)))


def vul_bucket(vul: Column, direction: Column) -> Column:
    """V or NV of a direction."""
    return F.when(side_vulnerable(vul, direction), "V").otherwise("NV")


def encode_vul(vul: Column) -> Column:
    """None 0, N_S 1, E_W 2, Both 3."""
    return F.array_position(F.array(F.lit("None"), F.lit("N_S"), F.lit("E_W"), F.lit("Both")), vul).cast("int") - 1


def decode_vul(code: Column) -> Column:
    return F.get(F.array(F.lit("None"), F.lit("N_S"), F.lit("E_W"), F.lit("Both")), code)


SCHEDULE_NS = [2, 4, 5, 7, 10, 12, 13, 15]
SCHEDULE_EW = [3, 4, 6, 7, 9, 10, 13, 16]


def board_dealer(board: Column) -> Column:
    return F.substring(F.lit(SEATS), F.pmod(board - 1, F.lit(4)) + 1, F.lit(1))


def board_vul(board: Column) -> Column:
    """None, N_S, E_W or Both, by the 16-board schedule."""
    b = F.pmod(board - 1, F.lit(16)) + 1
    ns, ew = b.isin(SCHEDULE_NS), b.isin(SCHEDULE_EW)
    return F.when(ns & ew, "Both").when(ns, "N_S").when(ew, "E_W").otherwise("None")


def side_vulnerable(vul: Column, direction: Column) -> Column:
    """Accepts None/N_S/E_W/Both and None/NS/EW/All."""
    v = F.replace(vul, F.lit("_"), F.lit(""))
    return v.isin("Both", "All") | ((v == "NS") & direction.isin("N", "S")) | ((v == "EW") & direction.isin("E", "W"))
