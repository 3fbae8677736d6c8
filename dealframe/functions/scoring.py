"""Contract scores, IMPs and expected values as closed-form columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the game: the least differences of scores for 1, 2, ... 24 IMPs.
IMP_LOWER = [20, 50, 90, 130, 170, 220, 270, 320, 370, 430, 500, 600, 750, 900, 1100, 1300, 1500, 1750, 2000, 2250, 2500, 3000, 3500, 4000]


def imp(diff: Column) -> Column:
    """0 to 24 IMPs of a difference of scores, unsigned."""
    d = F.abs(diff)
    return F.array_size(F.filter(F.array(*[F.lit(x) for x in IMP_LOWER]), lambda x: x <= d))


def imp_signed(diff: Column) -> Column:
    return F.signum(diff).cast("int") * imp(diff)


def score(level: Column, strain: Column, dbl: Column, vul: Column, tricks: Column) -> Column:
    """Declarer's score of a contract: level 1-7, strain 0-4 (C D H S N), dbl 0-2, vul boolean, tricks 0-13."""
    over = tricks - level - 6
    trick = level * F.when(strain <= 1, 20).otherwise(30) + F.when(strain == 4, 10).otherwise(0)
    points = trick * F.pow(F.lit(2), dbl).cast("int")
    game = F.when(points >= 100, F.when(vul, 500).otherwise(300)).otherwise(50)
    slam = F.when(level == 6, F.when(vul, 750).otherwise(500)).when(level == 7, F.when(vul, 1500).otherwise(1000)).otherwise(0)
    insult = dbl * 50
    each = F.when(dbl == 0, F.when(strain <= 1, 20).otherwise(30)).otherwise(F.when(vul, 200).otherwise(100) * dbl)
    made = points + game + slam + insult + over * each
    down = -over
    plain = down * F.when(vul, 100).otherwise(50)
    doubled = F.when(vul, 300 * down - 100).otherwise(F.when(down <= 3, 200 * down - 100).otherwise(300 * down - 400))
    return F.when(over >= 0, made).otherwise(-F.when(dbl == 0, plain).otherwise(doubled * dbl)).cast("int")


def doubled_if_down(level: int, strain: int, vul: bool, tricks: int) -> int:
    """The score of a contract that is doubled where it fails, as a number."""
    over = tricks - level - 6
    if over < 0:
        return 100 + 300 * over if vul else 100 + 200 * over if over >= -3 else 400 + 300 * over
    minor = strain <= 1
    points = level * (20 if minor else 30) + (10 if strain == 4 else 0)
    bonus = (500 if vul else 300) if points >= 100 else 50
    slam = {6: (500, 750), 7: (1000, 1500)}.get(level, (0, 0))[vul]
    return points + bonus + slam + over * (20 if minor else 30)


def doubled_if_down_scores() -> list[int]:
    """All of them: for not vulnerable and vulnerable, bids 1C to 7N, and tricks 0 to 13."""
    return [doubled_if_down(b // 5 + 1, b % 5, vul, t) for vul in (False, True) for b in range(35) for t in range(14)]


def undoubled_scores() -> list[int]:
    """Scores undoubled: for not vulnerable and vulnerable, bids 1C to 7N, and tricks 0 to 13."""
    down = lambda vul, over: over * (100 if vul else 50)
    return [down(vul, t - b // 5 - 7) if t < b // 5 + 7 else doubled_if_down(b // 5 + 1, b % 5, vul, t) for vul in (False, True) for b in range(35) for t in range(14)]


def expected_value(probs: Column, scores: Column) -> Column:
    """Sum of probability times score, over tricks 0 to 13."""
    return F.aggregate(F.zip_with(probs, scores, lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)


def contract_type(level: Column, strain: Column) -> Column:
    """Pass, Partial, Game, SSlam or GSlam."""
    return (
        F.when(level.isNull(), "Pass")
        .when(level == 7, "GSlam")
        .when(level == 6, "SSlam")
        .when((level == 5) | ((level == 4) & (strain >= 2)) | ((level == 3) & (strain == 4)), "Game")
        .otherwise("Partial")
    )
