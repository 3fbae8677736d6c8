"""Matchpoints, percentages, ratings and running totals of duplicate events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def places(df: DataFrame, keys: list[str], score: str, asked: list[str] = (), parts: int | None = None) -> DataFrame:
    """(keys, _x, _below, _same, _all, _kinds, _distinct): how many scores of a group lie below and at each value.

    Values are the group's distinct scores and those of the columns ``asked``; parts: into
    how many tasks the groups are dealt (by default as many as the session has).
    Scores are counted by value first, so a running sum sorts a group's values and not its
    rows. _kinds: distinct scores below; _distinct: of the group.
    """
    values = F.array(*[F.struct(F.col(c).alias("_x"), F.lit(int(c == score)).cast("long").alias("_one")) for c in [score, *asked]])
    hist = df.select(*keys, F.inline(values)) if asked else df.select(*keys, F.col(score).alias("_x"), F.lit(1).cast("long").alias("_one"))
    hist = hist.where("_x is not null")
    if parts:
        hist = hist.repartition(parts, *keys)
    hist = hist.groupBy(*keys, "_x").agg(F.sum("_one").alias("_same"))
    w = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    run = hist.withColumns({"_below": F.coalesce(F.sum("_same").over(w), F.lit(0)), "_kinds": F.coalesce(F.sum((F.col("_same") > 0).cast("int")).over(w), F.lit(0))})
    total = hist.groupBy(*keys).agg(F.sum("_same").alias("_all"), F.count_if(F.col("_same") > 0).alias("_distinct"))
    return run.join(total, keys)


def matchpoints(df: DataFrame, keys: list[str], score: str, out: str, top: str | None = None) -> DataFrame:
    """Average rank less one of each score within its group, and the group's top; null scores get null."""
    p = places(df, keys, score)
    p = p.select(*keys, F.col("_x").alias(score), (F.col("_below") + (F.col("_same") - 1) / 2.0).alias(out), *([(F.col("_all") - 1).cast("double").alias(top)] if top else []))
    return df.join(p, [*keys, score], "left")


def _met(df: DataFrame, p: DataFrame, keys: list[str], column: str, parts: int | None) -> DataFrame:
    """df joined to p (keys, _x, ...) where _x is the column; in ``parts`` tasks where that is given, which else are as many as the session has, whatever the rows."""
    on = [*keys, "_x"]
    df = df.withColumn("_x", F.col(column).cast(p.schema["_x"].dataType))
    if parts:
        df, p = df.repartition(parts, *on), p.repartition(parts, *on)
    return df.join(p, on, "left").drop("_x")


def hypothetical_matchpoints(df: DataFrame, keys: list[str], actual: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """For each column, the row's points against all actual scores of its group: one a win, half a tie. parts: of the joins."""
    p = places(df, keys, actual, columns, parts).select(*keys, "_x", (F.col("_below") + F.col("_same") * 0.5).alias("_p"))
    out = df
    for c in columns:
        out = _met(out, p.withColumnRenamed("_p", f"MP_{c}"), keys, c, parts)
    return out


def distinct_score_percentage(df: DataFrame, keys: list[str], actual: str, column: str, out: str, parts: int | None = None) -> DataFrame:
    """Share of a group's distinct scores that ``column`` beats, ties counting half. parts: of the join."""
    p = places(df, keys, actual, [column], parts)
    share = (F.col("_kinds") + 0.5 * (F.col("_same") > 0).cast("int")) / F.col("_distinct")
    return _met(df, p.select(*keys, "_x", share.alias(out)), keys, column, parts)


def percentage(mp: Column, top: Column) -> Column:
    return F.least(F.try_divide(mp, top), F.lit(1.0))


def group_mean(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Mean over the whole table by key, on every row; a partial aggregate and a join, so hot keys don't sort."""
    return df.join(df.groupBy(key).agg(F.avg(value).alias(out)), key)


def session_bounds(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First and last value of each group in the given order."""
    at = F.struct(*order, value)
    return df.groupBy(*keys).agg(F.min(at)[value].alias("first_value"), F.max(at)[value].alias("last_value"))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def event_elo(games: DataFrame, keys: list[str], order: list[str], player: str, before: str, after: str) -> DataFrame:
    """(keys, player, elo_start, elo_end): a player's rating before the first and after the last game of each event."""
    at = F.struct(*order, before, after)
    # Dealt out first: structs are aggregated by sorting, which else happens in the one task that rates the games.
    return games.repartition(*keys, player).groupBy(*keys, player).agg(F.min(at)[before].alias("elo_start"), F.max(at)[after].alias("elo_end"))


def pair_elo(
    boards: DataFrame,
    first: str,
    second: str,
    result: str,
    order: list[str],
    league: str | None = None,
    initial: float = 1500.0,
    k_base: float = 24.0,
    boost: float = 1.5,
    boost_until: int = 100,
    scale: float = 400.0,
    pairs: str | None = None,
) -> DataFrame:
    """Sequential Elo over boards in order: one row a board with both ratings before and after.

    Order-dependent by nature. ``league`` (any column whose values share no player)
    splits the recurrence; without it one task folds the whole table in a stream: each
    rating depends on all games before it, so no split of connected players is exact.
    first and second are players, or arrays of partners, who are rated by their mean and
    move by half the change each. ``pairs`` (pairs in the game's field) scales K by
    sqrt(max(pairs - 1, 1) / 11).
    """
    keys = [league] if league else []
    cols = [*keys, *order, first, second, result, *([pairs] if pairs else [])]
    data = boards.select(*cols)
    data = data.repartition(league) if league else data.coalesce(1)
    data = data.sortWithinPartitions(*keys, *order)
    types = dict(boards.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", elo_first double, elo_second double, new_first double, new_second double"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rating: dict = {}
        played: dict = {}
        side = lambda g, x: [(g, p) for p in x] if isinstance(x, list | tuple | np.ndarray) else [(g, x)]
        for f in frames:
            out = []
            for a, b, r, g, n in zip(f[first], f[second], f[result], f[league] if league else [None] * len(f), f[pairs] if pairs else [12] * len(f), strict=True):
                sides, weight = (side(g, a), side(g, b)), (max(n - 1, 1) / 11) ** 0.5
                ra, rb = (sum(rating.get(p, initial) for p in s) / len(s) for s in sides)
                gain = r - 1 / (1 + 10 ** ((rb - ra) / scale))
                for s, sign in zip(sides, (1, -1), strict=True):
                    for p in s:
                        k = k_base * weight * (boost if played.get(p, 0) < boost_until else 1) / len(s)
                        rating[p] = rating.get(p, initial) + sign * k * gain
                        played[p] = played.get(p, 0) + 1
                out.append((ra, rb, *(sum(rating[p] for p in s) / len(s) for s in sides)))
            yield f.assign(**dict(zip(["elo_first", "elo_second", "new_first", "new_second"], zip(*out, strict=True), strict=True)) if out else {})

    return data.mapInPandas(fold, schema)
