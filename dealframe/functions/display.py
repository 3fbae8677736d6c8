"""Texts that are shown: auctions from a seat, contracts with their results, roles' players."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealframe.functions.auction import SEATS, next_direction


def at_seat(auction: Column, seat: int | Column) -> Column:
    """The auction opened at seat 1 to 4: its own leading passes go, the seat's come."""
    lead = F.repeat(F.lit("P-"), F.least(F.greatest(F.lit(seat), F.lit(1)), F.lit(4)).cast("int") - 1)
    return F.concat(lead, F.regexp_replace(F.upper(auction), "^(P-)+", ""))


def over_text(over: Column) -> Column:
    """=, +n or -n; null without a result."""
    return F.when(over == 0, "=").when(over > 0, F.concat(F.lit("+"), over.cast("string"))).otherwise(over.cast("string"))


def contract_text(c: Column) -> Column:
    """``4SX NS -1`` of struct(level, strain, dbl, pair, over): strain 0-4, dbl 0-2; what is null is left out."""
    name = F.concat(c["level"].cast("string"), F.substring(F.lit("CDHSN"), c["strain"] + 1, F.lit(1)), F.repeat(F.lit("X"), c["dbl"]))
    return F.concat_ws(" ", name, c["pair"], over_text(c["over"]))


def contracts_text(contracts: Column) -> Column:
    """Each contract of an array once, in order, joined by commas."""
    return F.array_join(F.array_distinct(F.transform(contracts, contract_text)), ", ")


def of_direction(values: dict[str, Column], direction: Column) -> Column:
    """The value (a name, an id, tricks) of the direction that a column names; null for none."""
    return F.get(F.array(*[values[d] for d in SEATS]), F.nullif(F.instr(F.lit(SEATS), direction), F.lit(0)) - 1)


def roles(values: dict[str, Column], declarer: Column) -> dict[str, Column]:
    """The value of the declarer, of who leads, of dummy and of the fourth hand."""
    return {r: of_direction(values, next_direction(declarer, i)) for i, r in enumerate(("declarer", "leader", "dummy", "other"))}


def pair_id(a: Column, b: Column) -> Column:
    """One id of two players, whichever is named first."""
    return F.concat_ws("_", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
