"""Criteria held as data: lists of texts in rows, for each seat; and names of a direction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealframe.functions.auction import SEATS
from dealframe.functions.hand import balanced, points, suits

# The metrics that a range is kept for, and their widest bounds.
METRICS = {"HCP": (0, 37), "SL_S": (0, 13), "SL_H": (0, 13), "SL_D": (0, 13), "SL_C": (0, 13), "Total_Points": (0, 50)}
BOUND = r"^\s*([A-Za-z_]\w*)\s*(<=|>=|==|<|>)\s*(-?\d+(?:\.\d+)?|[A-Za-z_]\w*)\s*$"


def directional(name: str, direction: str) -> str:
    """HCP -> HCP_N, SL_S -> SL_N_S, C_CA -> C_NCA: the first part's name takes the direction."""
    if m := re.fullmatch(r"SL_([SHDC])", name):
        return f"SL_{direction}_{m[1]}"
    if m := re.fullmatch(r"C_([SHDC])([AKQJT2-9])", name):
        return f"C_{direction}{m[1]}{m[2]}"
    return f"{name}_{direction}"


def seat_direction(dealer: Column, seat: int | Column) -> Column:
    """Direction of seat 1 (the dealer) to 4."""
    return F.substring(F.lit(SEATS), F.pmod(F.instr(F.lit(SEATS), dealer) - 1 + seat - 1, F.lit(4)) + 1, F.lit(1))


def strip_comment(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "#.*$", ""))


def normal(text: Column) -> Column:
    """One space around an operator, none elsewhere; comments go."""
    return F.regexp_replace(F.regexp_replace(strip_comment(text), r"\s+", ""), r"(<=|>=|==|!=|<(?!=)|>(?!=))", " $1 ")


def parts(text: Column) -> Column:
    """struct(name, op, value, other): other is a name on the right side; all null where the text is no simple comparison."""
    got = lambda i: F.nullif(F.regexp_extract(text, BOUND, i), F.lit(""))
    return F.struct(got(1).alias("name"), got(2).alias("op"), got(3).try_cast("double").alias("value"), F.when(got(3).try_cast("double").isNull(), got(3)).alias("other"))


def metrics(hand: Column) -> dict[str, Column]:
    """A hand's metrics by name, as integers."""
    s = suits(hand)
    out = {"HCP": points(hand), **{f"SL_{x}": F.length(F.get(s, F.lit(i))) for i, x in enumerate("SHDC")}}
    short = sum((F.greatest(3 - out[f"SL_{x}"], F.lit(0)) for x in "HDC"), F.greatest(3 - out["SL_S"], F.lit(0)))
    return out | {"Total_Points": out["HCP"] + short}


def features(hand: Column) -> Column:
    """map of a hand's metrics by name, as doubles; Balanced is 1 or 0."""
    cells = [*metrics(hand).items(), ("Balanced", balanced(suits(hand)).cast("int"))]
    return F.create_map(*[x for k, v in cells for x in (F.lit(k), v.cast("double"))])


def told(p: Column, known: Column) -> Column:
    """Whether a ``parsed`` criterion holds for a map of metrics; null where that can't be told. A name alone is a flag."""
    left = F.try_element_at(known, F.coalesce(p["name"], p["text"]))
    right = F.coalesce(p["value"], F.try_element_at(known, p["other"]))
    op = p["op"]
    return F.when(op.isNull(), left != 0).when(op == ">=", left >= right).when(op == "<=", left <= right).when(op == ">", left > right).when(op == "<", left < right).when(op == "==", left == right)


def holds(text: Column, known: Column, missing: bool = False) -> Column:
    """Whether a criterion holds for a map of metrics. ``missing`` stands for what can't be told."""
    return F.coalesce(told(_parsed(text), known), F.lit(missing))


def failing(criteria: Column, known: Column, missing: bool = False) -> Column:
    return F.filter(criteria, lambda c: ~holds(c, known, missing))


def failing_parsed(criteria: Column, known: Column, missing: bool = False) -> Column:
    """The texts of the criteria that don't hold, out of a ``parsed`` list: nothing is parsed beside a hand."""
    return F.transform(F.filter(criteria, lambda p: ~F.coalesce(told(p, known), F.lit(missing))), lambda p: p["text"])


def compounds(rows: DataFrame, lists: list[str]) -> list[str]:
    """The distinct texts of compound criteria (neither a comparison nor a name) in columns of lists: a table's dictionary of them, not its rows."""
    every = rows.select(F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])).alias("c")).distinct()
    odd = every.where(parts(F.col("c"))["op"].isNull() & ~F.col("c").rlike(r"^\s*[A-Za-z_]\w*\s*$"))
    return sorted(r["c"] for r in odd.collect())


def annotated(text: Column, known: Column) -> Column:
    """A criterion with the value that its left side has: ``HCP >= 12 [9]``."""
    p = parts(text)
    value = F.try_element_at(known, F.coalesce(p["name"], F.trim(text)))
    return F.concat(text, F.lit(" ["), F.coalesce(F.format_string("%.0f", value), F.lit("?")), F.lit("]"))


def _parsed(text: Column) -> Column:
    p = parts(text)
    return F.struct(F.trim(text).alias("text"), *[p[n].alias(n) for n in ("name", "op", "value", "other")])


def parsed(criteria: Column) -> Column:
    """A list of criteria as struct(text, name, op, value, other): made once a table row, so that deals meet no texts."""
    got = lambda c, i: F.regexp_extract(c, BOUND, i)
    # Matched first and read after: within one lambda every mention of a part would match the text again.
    raw = F.transform(criteria, lambda c: F.struct(F.trim(c).alias("text"), *[got(c, i).alias(f"_{i}") for i in (1, 2, 3)]))
    some = lambda x: F.nullif(x, F.lit(""))
    read = F.transform(raw, lambda r: F.struct(r["text"].alias("text"), some(r["_1"]).alias("name"), some(r["_2"]).alias("op"), r["_3"].try_cast("double").alias("value"), some(r["_3"]).alias("other")))
    return F.transform(read, lambda r: F.struct(r["text"].alias("text"), r["name"].alias("name"), r["op"].alias("op"), r["value"].alias("value"), F.when(r["value"].isNull(), r["other"]).alias("other")))


def bounds_of(name: str, metric: str) -> tuple[Column, Column]:
    """(lo, hi) of a metric in the ``parsed`` list of column ``name``: the highest lower and the lowest upper bound; strict ones move by 1, == is both.

    Without a bound: the metric's widest. Comparisons of two names are no ranges. As
    text, since plans hold dozens of them.
    """
    own = f"filter({name}, p -> p.name = '{metric}' and p.value is not null)"
    low = f"array_max(transform({own}, p -> case when p.op in ('>=', '==') then p.value when p.op = '>' then p.value + 1 end))"
    high = f"array_min(transform({own}, p -> case when p.op in ('<=', '==') then p.value when p.op = '<' then p.value - 1 end))"
    lo, hi = METRICS[metric]
    return F.expr(f"cast(coalesce({low}, {lo}) as int)"), F.expr(f"cast(coalesce({high}, {hi}) as int)")


def loosest(criteria: Column) -> Column:
    """For each name and operator the least restrictive bound, without the names whose range is empty; then all other criteria once, in order."""
    split = F.transform(criteria, lambda c: F.struct(c.alias("text"), parts(c).alias("p")))
    ranged = F.filter(split, lambda x: x["p"]["value"].isNotNull())
    other = F.array_distinct(F.transform(F.filter(split, lambda x: x["p"]["value"].isNull()), lambda x: x["text"]))
    same = lambda x, y: (x["p"]["name"] == y["p"]["name"]) & (x["p"]["op"] == y["p"]["op"])
    best = F.filter(
        ranged,
        lambda x: ~F.exists(ranged, lambda y: same(x, y) & F.when(x["p"]["op"].isin(">=", ">"), y["p"]["value"] < x["p"]["value"]).when(x["p"]["op"].isin("<=", "<"), y["p"]["value"] > x["p"]["value"]).otherwise(F.lit(False))),
    )
    low = lambda y: F.when(y["p"]["op"].isin(">=", "=="), y["p"]["value"]).when(y["p"]["op"] == ">", y["p"]["value"] + 1)
    high = lambda y: F.when(y["p"]["op"].isin("<=", "=="), y["p"]["value"]).when(y["p"]["op"] == "<", y["p"]["value"] - 1)
    empty = lambda x: F.exists(best, lambda y: (y["p"]["name"] == x["p"]["name"]) & F.exists(best, lambda z: (z["p"]["name"] == x["p"]["name"]) & F.coalesce(low(y) > high(z), F.lit(False))))
    kept = F.array_sort(F.array_distinct(F.transform(F.filter(best, lambda x: ~empty(x)), lambda x: x["text"])))
    return F.concat(kept, other)
