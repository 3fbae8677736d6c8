"""Board files (LIN and PBN text) and small CSV tables, parsed with columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealframe.functions.auction import SEATS, tokens

RANKS = "AKQJT98765432"


def read_lin(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one LIN record a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _tag(value: Column, tag: str) -> Column:
    """The first value of a tag, which a bar closes; empty without one. Found as plain text: a regular expression is tried at every character."""
    text = F.concat(F.lit("|"), value)
    at = F.instr(text, f"|{tag}|")
    rest = F.substring(text, at + len(tag) + 2, F.length(text))
    return F.when((at > 0) & rest.contains("|"), F.substring_index(rest, "|", 1)).when(value.isNotNull(), "")


def tag_texts(value: Column, tag: str) -> Column:
    """What follows each occurrence of a tag, up to the next one: its value, a bar and more, or its value alone at the end."""
    # A mark that texts can't hold once it is taken out of them.
    text = F.replace(F.concat(F.lit("|"), value), F.lit("\x01"), F.lit(""))
    return F.slice(F.split(F.replace(text, F.lit(f"|{tag}|"), F.lit("\x01")), "\x01", -1), F.lit(2), F.length(value) + 1)


_ORDER = "abcdefghijklm"
_DOWN, _UP = ("?".join(r) + "?" for r in (RANKS, RANKS[::-1]))
_WHOLE = "^" + "".join(s + _DOWN for s in "SHDC") + r"\z"
_CALL = "(?:P|XX?|[1-7][CDHSN])"


def _lin_suit(text: Column, letter: str) -> Column:
    """A suit's ranks from ace down, out of SAKHQDJC2 style text. Those that stand in order, either way, aren't sorted."""
    held = F.regexp_extract(text, f"{letter}([AKQJT2-9]*)", 1)
    # Letters in the order of the ranks sort as text.
    ordered = F.translate(F.array_join(F.array_sort(F.split(F.translate(held, RANKS, _ORDER), "")), ""), _ORDER, RANKS)
    return F.when(held.rlike(f"^{_DOWN}$"), held).when(held.rlike(f"^{_UP}$"), F.reverse(held)).otherwise(ordered)


def _lin_hand(text: Column) -> Column:
    """S.H.D.C of a hand's text; one whose suits and ranks all stand in this order isn't taken apart."""
    return F.when(text.rlike(_WHOLE), F.translate(F.substring(text, F.lit(2), F.length(text)), "HDC", "...")).otherwise(F.concat_ws(".", *[_lin_suit(text, s) for s in "SHDC"]))


def lin_call(text: Column) -> Column:
    """The first canonical token of a call's text, null without one; a text that is one already isn't taken apart."""
    return F.when(text.rlike(rf"^{_CALL}\z"), text).otherwise(F.get(tokens(text), F.lit(0)))


def parse_lin(df: DataFrame, value: str = "value") -> DataFrame:
    """Boards of LIN text: board, dealer, vul, three given hands, auction; the fourth hand is what is left.

    Each step's values are columns before the next step reads them, so that none is
    worked out more than once a record.
    """
    rest = [c for c in df.columns if c != value]
    v = F.col(value)
    # A call's text ends before its alert.
    said = F.array_join(F.transform(tag_texts(v, "mb"), lambda x: F.substring_index(F.substring_index(x, "|", 1), "!", 1)), "-")
    parts = df.select(*rest, v.alias("_value"), _tag(v, "md").alias("_md"), said.alias("_said"))
    given = F.regexp_replace(F.upper(F.substring("_md", F.lit(2), F.length("_md"))), "10", "T")
    parts = parts.select(*rest, "_value", "_said", F.substring("_md", 1, 1).try_cast("int").alias("_dealer"), F.split(given, ",", -1).alias("_given"))
    parts = parts.select(*rest, "_value", "_said", "_dealer", *[F.get("_given", F.lit(i)).alias(f"_{d}") for i, d in enumerate("SWN")])
    parts = parts.select(*rest, "_value", "_said", "_dealer", *[_lin_hand(F.col(f"_{d}")).alias(f"_{d}") for d in "SWN"])
    held = lambda i: F.concat(*[F.split_part(F.nullif(F.col(f"_{d}"), F.lit("")), F.lit("."), F.lit(i)) for d in "SWN"])
    left = [F.call_function("translate", F.lit(RANKS), held(i), F.lit("")) for i in range(1, 5)]
    v = F.col("_value")
    auction = F.when(F.col("_said").rlike(rf"^{_CALL}(?:-{_CALL})*\z"), F.col("_said")).otherwise(F.array_join(tokens(F.col("_said")), "-"))
    return parts.select(
        *rest,
        F.regexp_extract(_tag(v, "ah"), r"(\d+)", 1).try_cast("int").alias("board"),
        F.substring(F.lit("SWNE"), F.col("_dealer"), F.lit(1)).alias("dealer"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("o", "None", "n", "N_S", "e", "E_W", "b", "Both", "0", "None")]), F.lower(_tag(v, "sv"))).alias("vul"),
        F.col("_N").alias("Hand_N"),
        F.concat_ws(".", *left).alias("Hand_E"),
        F.col("_S").alias("Hand_S"),
        F.col("_W").alias("Hand_W"),
        auction.alias("auction"),
    )


def parse_pbn(df: DataFrame, value: str = "value") -> DataFrame:
    """One row a board of PBN text: tags, hands by direction, auction and contract."""
    boards = df.select(*[c for c in df.columns if c != value], F.explode(F.split(F.col(value), r'(?=\[Event ")')).alias("_b")).where(F.col("_b").contains("[Deal "))
    b = F.col("_b")
    tag = lambda n: F.regexp_extract(b, rf'\[{n} "([^"]*)"\]', 1)
    deal = tag("Deal")
    first = F.instr(F.lit(SEATS), F.upper(F.substring(deal, 1, 1))) - 1
    hands = F.split(F.substring(deal, F.lit(3), F.length(deal)), " ")
    body = F.regexp_extract(b, r'\[Auction "[^"]*"\]\s*([^\[]*)', 1)
    calls = F.regexp_replace(body, r"\{[^}]*\}|=\d+=|\$\d+|[!?*]", " ")
    # AP: all pass. Three passes end an auction with a call, four one without.
    said = tokens(F.regexp_replace(calls, r"\bAP\b.*", " "))
    spoken = F.exists(said, lambda t: t != "P")
    trailing = F.aggregate(said, F.lit(0), lambda n, t: F.when(t == "P", n + 1).otherwise(0))
    closing = F.when(calls.rlike(r"\bAP\b"), F.array_repeat(F.lit("P"), F.greatest(F.when(spoken, 3).otherwise(4) - trailing, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return boards.select(
        *[c for c in df.columns if c != value],
        tag("Board").try_cast("int").alias("board"),
        tag("Dealer").alias("dealer"),
        tag("Vulnerable").alias("vul"),
        *[F.get(hands, F.pmod(F.lit(i) - first, F.lit(4))).alias(f"Hand_{d}") for i, d in enumerate(SEATS)],
        F.array_join(F.concat(said, closing), "-").alias("auction"),
        F.nullif(tag("Contract"), F.lit("")).alias("contract"),
        tag("Result").try_cast("int").alias("tricks"),
    )


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """Rules of an overlay file: (ordinal, partial, seat, criteria, replace, artificial).

    Lines are ``partial_auction,criterion,...``; # starts a comment; the flags
    is_artificial and replace_criteria may stand among the criteria.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("l")).where("l <> ''")
    cells = F.transform(F.split("l", ","), lambda c: F.trim(c))
    flags = ["is_artificial", "replace_criteria"]
    partial = F.array_join(tokens(F.element_at(cells, 1)), "-")
    rest = F.filter(F.slice(cells, 2, 1 << 20), lambda c: c != "")
    return lines.select(
        partial.alias("partial"),
        ((F.size(F.split(partial, "-")) - 1) % 4 + 1).alias("seat"),
        F.filter(rest, lambda c: ~c.isin(flags)).alias("criteria"),
        F.array_contains(rest, "replace_criteria").alias("replace"),
        F.array_contains(rest, "is_artificial").alias("artificial"),
    )


def apply_overlay(nodes: DataFrame, overlay: DataFrame, auction: str = "auction", criteria: str = "criteria") -> DataFrame:
    """Criteria of each node with the overlay's added (kept distinct, in order) or, on its exact node, replaced.

    A rule holds on whole calls: it meets the prefixes of each auction by equality.
    """
    keys = nodes.select(auction).distinct()
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split(auction, "-"))), lambda n: F.array_join(F.slice(F.split(auction, "-"), F.lit(1), n), "-"))
    hit = keys.select(auction, F.explode(steps).alias("partial")).join(overlay, "partial")
    add = hit.groupBy(auction).agg(
        F.flatten(F.collect_list(F.when(~F.col("replace"), F.col("criteria")))).alias("_add"),
        F.flatten(F.collect_list(F.when(F.col("replace") & (F.col("partial") == F.col(auction)), F.col("criteria")))).alias("_new"),
    )
    j = nodes.join(add, auction, "left")
    base = F.when(F.size(F.coalesce("_new", F.array())) > 0, F.col("_new")).otherwise(F.col(criteria))
    return j.withColumn(criteria, F.array_distinct(F.concat(base, F.coalesce("_add", F.array().cast("array<string>"))))).drop("_add", "_new")


def pbn_of(first: Column, hands: dict[str, Column]) -> Column:
    """PBN of a deal, ``N:hand hand hand hand``, from the direction named first onwards."""
    own = F.array(*[hands[d] for d in SEATS])
    at = F.instr(F.lit(SEATS), first) - 1
    return F.concat(first, F.lit(":"), F.concat_ws(" ", *[F.get(own, (at + i) % 4) for i in range(4)]))


def normal_pbn(text: Column) -> Column:
    """The same deal from North onwards, in upper case; null for what is no PBN deal."""
    t = F.upper(F.trim(text))
    four = F.split(F.substring(t, F.lit(3), F.length(t)), " +", -1)
    first = F.instr(F.lit(SEATS), F.substring(t, 1, 1)) - 1
    hands = {d: F.get(four, F.pmod(i - first, F.lit(4))) for i, d in enumerate(SEATS)}
    return F.when(t.rlike(f"^[{SEATS}]:") & (F.size(four) == 4), pbn_of(F.lit("N"), hands))


def write_with_manifest(df: DataFrame, path: str, **facts) -> DataFrame:
    """Write Parquet (zstd) beside the old table, swap it in by renaming, and write a manifest of it.

    The manifest has one JSON row: rows, schema, newest modification time, and a SHA-256
    over the files' own digests in order of name; ``facts`` are added.
    """
    spark = df.sparkSession
    new, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.option("compression", "zstd").parquet(new)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs, at = hadoop(path).getFileSystem(conf), hadoop(path)
    if fs.exists(at):
        fs.rename(at, hadoop(old))
    if not fs.rename(hadoop(new), at):
        fs.rename(hadoop(old), at)
        raise OSError(f"could not put {new} at {path}")
    fs.delete(hadoop(old), True)
    done = spark.read.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    each = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sha"), "modificationTime")
    whole = each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha"))), lambda x: x["sha"]), ""), 256).alias("sha256"), F.max("modificationTime").alias("modified"))
    manifest = done.agg(F.count("*").alias("rows")).join(F.broadcast(whole)).select("rows", "sha256", "modified", F.lit(df.schema.json()).alias("schema"), *[F.lit(v).alias(k) for k, v in facts.items()])
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return done
