"""Results of clubs: JSON events and XML boards as tables, and their cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An event: its pairs and the results of its boards.
EVENT = (
    "event_id long, pairs array<struct<section string, pair int, names string>>, "
    "results array<struct<section string, board int, ns int, ew int, contract string, result string, pct string>>"
)
BOARD = "_number int, line array<struct<_ns int, _ew int, _contract string, _tricks int>>"
CONTRACT = "^([1-7])(NT|[CDHSN])(X{0,2})([NESW])$"


def event_tables(texts: DataFrame, text: str) -> dict[str, DataFrame]:
    """pairs and results of JSON events, one row an entry; a text that is no JSON gives none."""
    e = texts.select(F.from_json(text, EVENT).alias("e")).select("e.*")
    return {n: e.select("event_id", F.inline(n)) for n in ("pairs", "results")}


def with_names(tables: dict[str, DataFrame]) -> DataFrame:
    """The results with names_ns and names_ew; null where the event lists no such pair."""
    out = tables["results"]
    for side in ("ns", "ew"):
        who = tables["pairs"].withColumnsRenamed({"pair": side, "names": f"names_{side}"})
        out = out.join(who, ["event_id", "section", side], "left")
    return out


def named_results(texts: DataFrame, text: str) -> DataFrame:
    """``with_names`` of events that each are one text with their own pairs: read once, and no table joined.

    A pair that is listed twice gives two rows, as the join does. A text's results are
    held against its own pairs, so the work is bounded by a text's size.
    """
    e = texts.select(F.from_json(text, EVENT).alias("e")).select("e.*")
    out = e.select("event_id", "pairs", F.inline("results"))
    keep = [c for c in out.columns if c != "pairs"]
    for side in ("ns", "ew"):
        same = lambda p: (F.col("event_id").isNotNull()) & (p["section"] == F.col("section")) & (p["pair"] == F.col(side))  # noqa: B023, E731
        who = F.transform(F.filter("pairs", same), lambda p: p["names"])
        out = out.select(*keep, "pairs", F.explode_outer(who).alias(f"names_{side}"))
        keep.append(f"names_{side}")
    return out.select(*keep)


def result_of(text: Column) -> Column:
    """= is 0, +n and -n as they are; null for anything else."""
    t = F.trim(text)
    return F.when(t == "=", 0).when(t.rlike(r"^[+-]\d+$"), t.try_cast("int"))


def cleaned(results: DataFrame) -> DataFrame:
    """level, strain (0-4), dbl, declarer, over (tricks beyond the contract's), tricks and pct of the texts.

    A pass has none of the first five; a share above 1 becomes 1; what can't be read is null.
    """
    c = F.upper(F.regexp_replace("contract", r"\s", ""))
    part = lambda i: F.nullif(F.regexp_extract(c, CONTRACT, i), F.lit(""))
    level = part(1).cast("int")
    share = F.col("pct").try_cast("double") / 100
    over = F.when(level.isNotNull(), result_of(F.col("result")))
    return results.withColumns(
        {
            "passed": F.coalesce(c.isin("PASS", "P", "PASSED"), F.lit(False)),
            "level": level,
            "strain": F.instr(F.lit("CDHSN"), F.substring(part(2), 1, 1)) - 1,
            "dbl": F.when(level.isNotNull(), F.length(F.regexp_extract(c, CONTRACT, 3))),
            "declarer": part(4),
            "over": over,
            "tricks": level + 6 + over,
            "pct": F.when(share.isNotNull(), F.least(share, F.lit(1.0))),
        }
    )


def xml_lines(texts: DataFrame, text: str) -> DataFrame:
    """(…, board, ns, ew, contract, tricks): the lines of XML boards."""
    keep = [c for c in texts.columns if c != text]
    e = texts.select(*keep, F.from_xml(text, BOARD).alias("b")).select(*keep, F.col("b._number").alias("board"), F.explode("b.line").alias("l"))
    return e.select(*keep, "board", *[F.col(f"l._{n}").alias(n) for n in ("ns", "ew", "contract", "tricks")])
