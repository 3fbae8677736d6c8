"""Hand features from suit strings (ranks from ace down; empty: void)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUITS = "SHDC"
RANKS = "AKQJT98765432"


def suits(hand: Column) -> Column:
    """The four suits, spades first, of an S.H.D.C hand."""
    return F.split(hand, r"\.", -1)


def _count(s: Column, ranks: str) -> Column:
    return F.length(s) - F.length(F.translate(s, ranks, ""))


def suit_hcp(s: Column) -> Column:
    return 4 * _count(s, "A") + 3 * _count(s, "K") + 2 * _count(s, "Q") + _count(s, "J")


def suit_quick_tricks(s: Column) -> Column:
    """AK 2, AQ 1.5, A 1, KQ 1, K 0.5 (a singleton king counts)."""
    return F.when(s.startswith("AK"), 2.0).when(s.startswith("AQ"), 1.5).when(s.startswith("A"), 1.0).when(s.startswith("KQ"), 1.0).when(s.startswith("K"), 0.5).otherwise(0.0)


def suit_losers(s: Column) -> Column:
    """Of up to three cards, those that aren't covered by the ace, king and queen they reach."""
    n = F.length(s)
    a, k, q = (s.contains(r).cast("int") for r in "AKQ")
    return F.when(n == 0, 0).when(n == 1, 1 - a).when(n == 2, 2 - a - k).otherwise(3 - a - k - q)


def suit_distribution_points(s: Column) -> Column:
    return F.greatest(3 - F.length(s), F.lit(0))


def total(hand_suits: Column, f, zero: Column | None = None) -> Column:
    return F.aggregate(F.transform(hand_suits, f), F.lit(0) if zero is None else zero, lambda a, x: a + x)


def hcp(hand_suits: Column) -> Column:
    return total(hand_suits, suit_hcp)


def points(hand: Column) -> Column:
    """High-card points of a whole hand, from its string alone."""
    return 4 * _count(hand, "A") + 3 * _count(hand, "K") + 2 * _count(hand, "Q") + _count(hand, "J")


def quick_tricks(hand_suits: Column) -> Column:
    return total(hand_suits, suit_quick_tricks, F.lit(0.0))


def losers(hand_suits: Column) -> Column:
    return total(hand_suits, suit_losers)


def distribution_points(hand_suits: Column) -> Column:
    return total(hand_suits, suit_distribution_points)


def lengths(hand_suits: Column) -> Column:
    return F.transform(hand_suits, F.length)


def balanced(hand_suits: Column) -> Column:
    """4333, 4432, or 5332 / 5422 with a five-card minor."""
    n = lengths(hand_suits)
    shape = F.array_join(F.transform(F.reverse(F.array_sort(n)), lambda x: x.cast("string")), "")
    minor = (F.element_at(n, 3) == 5) | (F.element_at(n, 4) == 5)
    return shape.isin("4333", "4432") | (shape.isin("5332", "5422") & minor)


def shape(hand_suits: Column) -> Column:
    """Lengths in descending order, as a string."""
    return F.array_join(F.transform(F.reverse(F.array_sort(lengths(hand_suits))), lambda x: x.cast("string")), "")


def keycards(hand_suits: Column, trump: Column) -> Column:
    """Aces and the king of trumps; trump is 1-4 by suit order, 0 for none."""
    aces = total(hand_suits, lambda s: s.contains("A").cast("int"))
    king = F.when(trump > 0, F.element_at(hand_suits, F.greatest(trump, F.lit(1))).contains("K").cast("int")).otherwise(0)
    return aces + king


def suit_qualities(s: Column) -> dict[str, Column]:
    """Biddable, rebiddable and stopped, from a suit's length and points."""
    n, h = F.length(s), suit_hcp(s)
    return {
        "biddable": (n >= 5) | ((n == 4) & (h >= 3)),
        "rebiddable": (n >= 6) | ((n == 5) & (h >= 3)),
        "stopped": s.contains("A") | (s.contains("K") & (n >= 2)) | (s.contains("Q") & (n >= 3)),
    }


def encode_bits(hand: Column) -> Column:
    """A hand as 52 bits: the ace of spades is the highest, the two of clubs the lowest."""
    out = F.lit(0).cast("long")
    s = suits(hand)
    for i in range(4):
        for j, r in enumerate(RANKS):
            out = out + F.when(F.get(s, F.lit(i)).contains(r), F.lit(1 << (51 - 13 * i - j)).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def decode_bits(bits: Column) -> Column:
    """The S.H.D.C string of ``encode_bits``."""
    held = F.split(F.lit(",".join("".join(r for j, r in enumerate(RANKS) if m >> (12 - j) & 1) for m in range(1 << 13))), ",", -1)
    return F.concat_ws(".", *[F.get(held, F.shiftright(bits, 39 - 13 * i).bitwiseAND(F.lit(8191)).cast("int")) for i in range(4)])
