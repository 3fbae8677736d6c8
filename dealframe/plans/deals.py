"""Deals, auctions and contracts derived from the orders table by arithmetic, in Spark and in SQL.

The shared tables hold no bridge data. Each order's 52 cards are put in the order of an
arithmetic key and dealt out; small lists of auctions are dealt out by key too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.session import table
from dealframe.written import Written

RANKS = "AKQJT98765432"
AUCTIONS = [
    "1N-P-3N-P-P-P",
    "P-P-P-P",
    "1S-P-2S-P-4S-P-P-P",
    "P-1H-X-2H-P-P-P",
    "1D-1S-X-2S-3D-P-P-P",
    "1C-X-XX-1H-P-P-2C-P-P-P",
    "P-P-1N-P-2C-P-2H-P-4H-P-P-P",
    "2H-P-4H-X-P-P-P",
    "1S-2H-2S-3H-X-P-P-P",
    "1H-1H-P-P-P",
    "X-P-P-P-P",
    "1N-P-2C",
    "1S-P-P-P-P",
    "3C-3D-3H-3S-3N-P-P-P",
    "P-P-P-1S-X-XX-P-P-P",
    "1C-P-1H-P-1N-P-P-P",
    "2N-P-6N-X-XX-P-P-P",
    "1D-P-P-X-P-1S-P-P-P",
]


def contract_of(auction: str) -> tuple[int | None, int | None, int | None, int | None]:
    """(level, strain, doubling, steps from the dealer to the declarer) of a list's auction, worked out call by call for the SQL."""
    level = strain = dbl = None
    named: dict[tuple[int, str], int] = {}
    at = 0
    for i, call in enumerate(auction.split("-")):
        if call[0].isdigit():
            level, strain, dbl = int(call[0]), "CDHSN".index(call[1]), 0
            at = named.setdefault((i % 2, call[1]), i)
        elif call in ("X", "XX") and level:
            dbl = len(call)
    return level, strain, dbl, at % 4 if level else None


_DEALT: dict[tuple[str, str], Written] = {}


def bids(spark, sf_dir: str) -> DataFrame:
    """index, Dealer, Vul, auction, its level, strain, dbl and decl, and tricks: a deal without its hands, so no card is dealt and nothing is written."""
    return _bids(spark, _keys(spark, sf_dir)).select("index", *_FACTS)


def deals(spark, sf_dir: str) -> DataFrame:
    """index, Dealer, Vul, Hand_N..Hand_W (S.H.D.C), auction, its level, strain, dbl and decl, and tricks.

    Dealt once a session and table, and read back. ``bids`` has all but the hands.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DEALT:
        _DEALT[key] = Written(_deal(spark, sf_dir))
    return _DEALT[key].df


_FACTS = ["Dealer", "Vul", "auction", "level", "strain", "dbl", "decl", "tricks"]


def _keys(spark, sf_dir: str) -> DataFrame:
    """index: the orders' keys, dealt out: a file of few row groups is no reason for few tasks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    return o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "index")


def _bids(spark, o: DataFrame) -> DataFrame:
    """o (index, ...) with the columns of ``_FACTS``."""
    k = F.col("index")
    # As SQL the list stays in the JVM; a frame made of Python rows starts a Python worker a task.
    rows = ", ".join(f"({i}L, '{a}')" for i, a in enumerate(AUCTIONS))
    said = spark.sql(f"select * from values {rows} as said(_k, auction)")
    t = A.tokens(F.col("auction"))
    strain = (F.instr(F.lit("CDHSN"), F.substring(A.contract(t), 2, 1)) - 1).cast("int")
    said = said.select("_k", "auction", F.substring(A.contract(t), 1, 1).cast("int").alias("level"), strain.alias("strain"), F.length(A.doubling(t)).alias("dbl"), A.declarer(t, F.lit("N")).alias("_decl"))
    o = o.join(F.broadcast(said), F.pmod(k, F.lit(len(AUCTIONS))) == F.col("_k"))
    dealer = F.substring(F.lit("NESW"), (k % 4 + 1).cast("int"), F.lit(1))
    return o.withColumns(
        {
            "Dealer": dealer,
            "Vul": F.element_at(F.array(*[F.lit(v) for v in ("None", "N_S", "E_W", "Both")]), (F.floor(k / 4) % 4 + 1).cast("int")),
            "decl": A.next_direction(dealer, F.instr(F.lit("NESW"), F.col("_decl")) - 1),
            "tricks": (F.floor(k / 11) % 14).cast("int"),
        }
    )


def _hands(batches):
    """index -> its four hands: the cards in the order of their keys, thirteen to a hand, whose bits name its suits."""
    c = np.arange(52)
    names = pa.array(["".join(r for i, r in enumerate(RANKS) if m >> i & 1) for m in range(1 << 13)])
    for batch in batches:
        k = batch.column(0).to_numpy()[:, None]
        cards = np.sort((((k % 100003) * (c * 7919 + 104729) + c * c * 31) % 10007 * 64 + c).astype(np.int32), axis=1) % 64
        bits = (np.int64(1) << cards.astype(np.int64)).reshape(-1, 4, 13).sum(2)
        suits = lambda h: [names.take(pa.array(bits[:, h] >> 13 * s & 8191)) for s in range(4)]  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pc.binary_join_element_wise(*suits(h), ".") for h in range(4)]], names=["index", *[f"Hand_{d}" for d in "NESW"]])


def _deal(spark, sf_dir: str) -> DataFrame:
    o = _keys(spark, sf_dir).mapInArrow(_hands, "index long, " + ", ".join(f"Hand_{d} string" for d in "NESW"))
    return _bids(spark, o).select("index", "Dealer", "Vul", *[f"Hand_{d}" for d in "NESW"], *_FACTS[2:])


def hands(spark, sf_dir: str) -> DataFrame:
    """The four hands of every deal as rows: index, Dealer, Vul, dir, hand, strain."""
    four = F.array(*[F.struct(F.lit(d).alias("dir"), F.col(f"Hand_{d}").alias("hand")) for d in "NESW"])
    return deals(spark, sf_dir).select("index", "Dealer", "Vul", "strain", F.inline(four))


def _suit_sql(h: int, s: int) -> str:
    return f"array_to_string(list_transform(list_filter(range(13), lambda r: list_contains(p[{13 * h + 1}:{13 * h + 13}], r + {13 * s})), lambda r: substr('{RANKS}', r + 1, 1)), '')"


def _hand_sql(h: int, d: str) -> str:
    return " || '.' || ".join(_suit_sql(h, s) for s in range(4)) + f" as Hand_{d}"


def _sql_list(i: int) -> str:
    return "[" + ", ".join("null" if (x := contract_of(a)[i]) is None else str(x) for a in AUCTIONS) + "]"


#: The same deals as a CTE named deals.
DEALS_SQL = f"""deals0 as (
  select o_orderkey as index, o_orderkey as k,
    list_transform(list_sort(list_transform(range(52), lambda c: (((o_orderkey % 100003) * (c * 7919 + 104729) + c * c * 31) % 10007) * 64 + c)), lambda x: x % 64) as p from orders
), deals as (
  select index, substr('NESW', (k % 4 + 1)::int, 1) as Dealer, (['None', 'N_S', 'E_W', 'Both'])[((k // 4) % 4 + 1)::int] as Vul,
    {", ".join(_hand_sql(h, d) for h, d in enumerate("NESW"))},
    ({AUCTIONS!r})[(k % {len(AUCTIONS)} + 1)::int] as auction,
    {", ".join(f"({_sql_list(i)})[(k % {len(AUCTIONS)} + 1)::int] as {n}" for i, n in enumerate(("level", "strain", "dbl")))},
    substr('NESW', ((k % 4 + ({_sql_list(3)})[(k % {len(AUCTIONS)} + 1)::int]) % 4 + 1)::int, 1) as decl, ((k // 11) % 14)::int as tricks
  from deals0
), hands as ({" union all ".join(f"select index, Dealer, Vul, strain, '{d}' as dir, Hand_{d} as hand from deals" for d in "NESW")})"""

#: Whether the declarer's side is vulnerable.
VUL_SQL = "(Vul = 'Both' or (Vul = 'N_S' and decl in ('N', 'S')) or (Vul = 'E_W' and decl in ('E', 'W')))"
