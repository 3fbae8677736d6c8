"""Natural descriptions of calls rewritten to the criteria language."""

from __future__ import annotations

import re

_COUNT = re.compile(r"(?P<at_best>at[_ ]best[_ ])?(?P<lo>\d+)(?:(?P<up>\+)|(?P<down>-)(?P<hi>\d+)?)?(?:-card)?(?:\s+|$)(?P<of>.*)", re.I)
_MEASURES = {"": "HCP", "hcp": "HCP", "total points": "Total_Points", "tp": "Total_Points", "losers": "Losers"}
#: What a hand may have in a suit, as fixed words; the criterion is named by the words and the suit.
_SUIT_QUALITIES = {
    "at best likely stop in", "at best partial stop in", "at best stop in", "biddable", "likely stop in", "partial stop in", "partial stop likely stop in",
    "rebiddable", "solid", "stop in", "strong rebiddable", "twice rebiddable", "two stops in",
}
_ALIASES = {"stopper in": "stop in", "likely stop stop in": "likely stop in", "partial stop stop in": "partial stop in", "forcing": "forcing one round"}
_PLAIN = {"balanced", "unbalanced", "forcing one round", "artificial"}
#: What a side may be forced to or not play below, up to a bid.
_TO_BID = {"forcing to", "opponents cannot play undoubled below"}


def _spoken(words: str) -> str:
    text = " ".join(re.split(r"[\s_-]+", words.strip().lower()))
    return _ALIASES.get(text, text)


def _name(*words: str) -> str:
    return "_".join(w[:1].upper() + w[1:] for part in words for w in part.split())


def _bounds(name: str, m: re.Match) -> list[str]:
    lo, hi = int(m["lo"]), m["hi"]
    if m["at_best"] or (m["down"] and not hi):
        return [f"{name} <= {lo}"]
    if hi:
        return [f"{name} >= {lo}", f"{name} <= {int(hi)}"]
    return [f"{name} {'>=' if m['up'] else '=='} {lo}"]


def _phrase(p: str) -> list[str] | None:
    if m := _COUNT.fullmatch(p):
        if suit := re.fullmatch(r"!([CDHS])", m["of"], re.I):
            return _bounds(f"SL_{suit[1].upper()}", m)
        measure = _MEASURES.get(_spoken(m["of"]))
        return _bounds(measure, m) if measure else None
    if m := re.fullmatch(r"!([CDHS])\s*([<>]=?|=)\s*!([CDHS])", p, re.I):
        return [f"SL_{m[1].upper()} {'==' if m[2] == '=' else m[2]} SL_{m[3].upper()}"]
    if m := re.fullmatch(r"(?P<no>no\s+)?!?([CDHS])([AKQ]+)|([AKQ]+)\+[_ ]in\s+!([CDHS])", p):
        suit, cards = m[2] or m[5], m[3] or m[4]
        return [f"C_{suit}{c}" + (" == False" if m["no"] else "") for c in cards]
    if m := re.fullmatch(r"no\s+!([CDHS])", p, re.I):
        return [f"SL_{m[1].upper()} == 0"]
    if m := re.fullmatch(r"solid\s+(\d+)-card\s+!([CDHS])", p, re.I):
        return [f"Solid_{m[2].upper()}", f"SL_{m[2].upper()} >= {int(m[1])}"]
    if (m := re.fullmatch(r"(.+?)\s+!([CDHS])", p, re.I)) and _spoken(m[1]) in _SUIT_QUALITIES:
        return [_name(_spoken(m[1]), m[2].upper())]
    if (m := re.fullmatch(r"(.+?)\s+([1-7][CDHSN])", p, re.I)) and _spoken(m[1]) in _TO_BID:
        return [_name(_spoken(m[1]), m[2].upper())]
    return [_name(_spoken(p))] if _spoken(p) in _PLAIN else None


def rewrite(text: str) -> list[str]:
    """``12-14 HCP; 5+ !S; stop in !H`` -> criteria; what isn't understood comes back as it is.

    A bare number or range is of high-card points.
    """
    parts = [p.strip() for p in re.split(r"[;,]", text)]
    return [c for p in parts if p for c in (_phrase(p) or [p])]
