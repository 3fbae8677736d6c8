"""Columns and parsers on hand-made cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealframe.functions import auction as A
from dealframe.functions import dsl, scoring
from dealframe.functions import hand as H


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("1n-p-3n", "1N-P-3N-P-P-P"), ("1N-p-p", "1N-P-P-P"), ("p-p-p-p", "P-P-P-P"), ("1c-.*", "1C-.*"), ("1s$", "1S-P-P-P$")],
)
def test_normalize_pattern(pattern, want):
    assert A.normalize_pattern(pattern) == want


@pytest.mark.parametrize(("text", "want"), [("pass, 1nt dbl", "P-1N-X"), ("1♠ - p - r", "1S-P-XX"), ("", "")])
def test_normalize(spark, text, want):
    assert one(spark, A.normalize(F.lit(text))) == want


@pytest.mark.parametrize(
    ("text", "legal", "done"),
    [("1N-P-P-P", True, True), ("P-P-P-P", True, True), ("1N-1C", False, False), ("X", False, False), ("1C-X-XX-P-P-P", True, True), ("1C-P-X", False, False), ("1N-P-P-P-P", False, False), ("1N", True, False)],
)
def test_legality(spark, text, legal, done):
    t = A.tokens(F.lit(text))
    assert (one(spark, A.valid(t)), one(spark, A.complete(t))) == (legal, done)


@pytest.mark.parametrize(("diff", "want"), [(0, 0), (10, 0), (19, 0), (20, 1), (4000, 24), (-4000, 24), (3999, 23), (45, 1)])
def test_imp(spark, diff, want):
    assert one(spark, scoring.imp(F.lit(diff))) == want


@pytest.mark.parametrize(
    ("level", "strain", "dbl", "vul", "tricks", "want"),
    [(3, 4, 0, False, 9, 400), (4, 3, 0, True, 10, 620), (1, 0, 0, False, 7, 70), (2, 3, 1, True, 8, 670), (7, 4, 2, True, 13, 2980), (4, 2, 1, False, 7, -500), (4, 2, 1, True, 6, -1100), (3, 4, 0, True, 5, -400), (1, 4, 2, False, 3, -1600), (6, 2, 0, False, 12, 980)],
)
def test_score(spark, level, strain, dbl, vul, tricks, want):
    assert one(spark, scoring.score(*[F.lit(x) for x in (level, strain, dbl, vul, tricks)])) == want


def test_hand(spark):
    s = H.suits(F.lit("AK32.QJ.T987.432"))
    assert one(spark, H.hcp(s)) == 10
    assert one(spark, H.quick_tricks(s)) == 2.0
    assert one(spark, H.losers(s)) == 1 + 2 + 3 + 3
    assert one(spark, H.shape(s)) == "4432"
    assert one(spark, H.balanced(s)) is True
    void = H.suits(F.lit("AKQJT98765432..."))
    assert one(spark, H.distribution_points(void)) == 9


def test_dedupe():
    assert dsl.dedupe_least_restrictive(["HCP >= 3", "HCP >= 5", "HCP <= 10"]) == ["HCP <= 10", "HCP >= 3"]
    assert dsl.dedupe_least_restrictive(["SL_S >= 4", "SL_S >= 2", "Balanced"]) == ["SL_S >= 2", "Balanced"]
    assert dsl.dedupe_least_restrictive(["HCP >= 12", "HCP <= 10", "SL_S >= 2"]) == ["SL_S >= 2"]
    assert dsl.dedupe_least_restrictive(["HCP == 1", "HCP == 2"]) == []


def test_missing_policies(spark):
    df = spark.createDataFrame([(5,)], "a int")
    rule = "a > 1 & nothing >= 3"
    assert df.select(dsl.compile_criteria(rule, df.columns, on_missing="true")).first()[0] is True
    assert df.select(dsl.compile_criteria(rule, df.columns)).first()[0] is False
    with pytest.raises(dsl.CriteriaError):
        dsl.compile_criteria(rule, df.columns, on_missing="error")


@pytest.mark.parametrize("bad", ["a >", "(a > 1", "a > 1)", "a $ 1", ""])
def test_bad_criteria(bad):
    with pytest.raises(dsl.CriteriaError):
        dsl.parse(bad)


NUMS = st.integers(0, 20)
TERM = st.one_of(st.sampled_from(["a", "b"]), NUMS.map(str))
CMP = st.builds(lambda x, o, y, p, z: f"{x} {o} {y} {p} {z}", TERM, st.sampled_from(["<", ">=", "==", "!="]), TERM, st.sampled_from(["+", "-", "*"]), TERM)
RULE = st.recursive(CMP, lambda r: st.one_of(st.builds(lambda x, o, y: f"({x} {o} {y})", r, st.sampled_from(["&", "|", "and", "or"]), r), r.map(lambda x: f"not ({x})")), max_leaves=6)


@settings(max_examples=20, deadline=None)
@given(RULE)
def test_compiler_agrees_with_python(spark, rule):
    rows = [(a, b) for a in (0, 3, 7) for b in (1, 3, 20)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {(r["a"], r["b"]): r["x"] for r in df.select("a", "b", dsl.compile_criteria(rule, df.columns).alias("x")).collect()}
    text = rule.replace("&", " and ").replace("|", " or ")
    assert got == {(a, b): bool(eval(text, {"a": a, "b": b})) for a, b in rows}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12-14 HCP; 5+ !S", ["HCP >= 12", "HCP <= 14", "SL_S >= 5"]),
        ("8- total points, stop in !H", ["Total_Points <= 8", "Stop_In_H"]),
        ("balanced; !S >= !H; 4 !C; odd words", ["Balanced", "SL_S >= SL_H", "SL_C == 4", "odd words"]),
        ("12; 12-; 12+; 12-14", ["HCP == 12", "HCP <= 12", "HCP >= 12", "HCP >= 12", "HCP <= 14"]),
        ("7 losers; 6- losers; 5-7 losers; 11 HCP; 9+ total_points", ["Losers == 7", "Losers <= 6", "Losers >= 5", "Losers <= 7", "HCP == 11", "Total_Points >= 9"]),
        ("6-card !D; at_best 3-card !H; 4-5 !S; no !C", ["SL_D == 6", "SL_H <= 3", "SL_S >= 4", "SL_S <= 5", "SL_C == 0"]),
        ("AK+_in !S; !HAQ; SK; no !DA", ["C_SA", "C_SK", "C_HA", "C_HQ", "C_SK", "C_DA == False"]),
        ("at_best_stop_in !C; at_best_likely_stop_in !D; at_best_partial_stop_in !H", ["At_Best_Stop_In_C", "At_Best_Likely_Stop_In_D", "At_Best_Partial_Stop_In_H"]),
        ("likely_stop-stop_in !S; partial_stop-stop_in !S; partial_stop-likely_stop_in !S", ["Likely_Stop_In_S", "Partial_Stop_In_S", "Partial_Stop_Likely_Stop_In_S"]),
        ("biddable !C; rebiddable !D; strong_rebiddable !H; twice_rebiddable !S; two_stops_in !H", ["Biddable_C", "Rebiddable_D", "Strong_Rebiddable_H", "Twice_Rebiddable_S", "Two_Stops_In_H"]),
        ("solid 7-card !S; forcing; forcing_to 3N; opponents_cannot_play_undoubled_below 2S", ["Solid_S", "SL_S >= 7", "Forcing_One_Round", "Forcing_To_3N", "Opponents_Cannot_Play_Undoubled_Below_2S"]),
        ("12 hats; stop in hand; ;,", ["12 hats", "stop in hand"]),
    ],
)
def test_phrases(text, want):
    from dealframe.functions.phrases import rewrite

    assert rewrite(text) == want


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("5431", [(5, 5), (4, 4), (3, 3), (1, 1)]), ("5-4-3-1", [(5, 5), (4, 4), (3, 3), (1, 1)]), ("[3:5],4+,3-,x", [(3, 5), (4, 13), (0, 3), (0, 13)]), ("3--x", None), ("54", None)],
)
def test_shapes(pattern, want):
    from dealframe.functions.shape import parse_shape

    assert parse_shape(pattern) == want


@pytest.mark.parametrize(
    ("auction", "some"),
    [
        ("1N", {"is_opening", "is_notrump_opening", "is_one_level_opening"}),
        ("1N-P-2C", {"is_stayman", "is_response"}),
        ("1S-P-2S", {"is_raise", "is_single_raise"}),
        ("1S-X", {"is_takeout_double"}),
        ("1S-P-4C", {"is_splinter", "is_jump"}),
        ("1H-P-P-1S", {"is_balancing", "is_overcall"}),
        ("1D-1S-2S", {"is_cuebid"}),
        ("P-P-1S", {"is_opening"}),
        ("P-1D-P-1S-P-2S-X", set()),
    ],
)
def test_categories(spark, auction, some):
    from dealframe.functions import categories

    got = set(one(spark, categories.names(A.tokens(F.lit(auction)))))
    assert some <= got


MEANINGS = {
    "": set(),
    "P": {"is_pass", "is_sign_off", "is_conservative"},
    "2H": {"is_opening", "is_preempt", "is_weak", "is_jump", "is_jump_shift", "is_long_suit_showing"},
    "2C": {"is_strong", "is_game_forcing", "is_artificial", "is_conventional"},
    "3N": {"is_gambling", "is_destructive", "is_game_level"},
    "2C-P-2D": {"is_negative_response", "is_waiting_bid", "is_relay", "is_response"},
    "2C-P-2H": {"is_positive_response"},
    "1N-P-2H": {"is_transfer", "is_artificial", "is_captain", "is_alertable", "is_natural"},
    "1N-P-2H-P-2S": {"is_transfer_completion", "is_rebid"},
    "1N-P-2H-P-3S": {"is_super_accept", "is_maximum_showing", "is_jump"},
    "1N-P-2C": {"is_relay", "is_asking", "is_captain"},
    "1S-P-2N": {"is_jacoby_2nt", "is_raise", "is_game_forcing", "is_fit_established"},
    "1H-P-3C": {"is_bergen", "is_raise", "is_splinter", "is_jump_shift"},
    "P-P-1S-P-2C": {"is_drury", "is_passed_hand", "is_raise"},
    "1S-P-1N": {"is_semi_forcing", "is_limit_bid", "is_telling", "is_describer"},
    "1S-P-2D": {"is_game_forcing", "is_new_suit", "is_minimum"},
    "1S-P-4S": {"is_game_try", "is_raise", "is_jump"},
    "1S-P-3S": {"is_invitational", "is_part_score"},
    "1S-P-2S-P-4N": {"is_notrump", "is_rebid"},
    "1S-P-4N": {"is_notrump"},
    "1D-P-1H-P-2S": {"is_reverse", "is_extra_values", "is_jump_shift"},
    "1D-P-1S-P-1N-P-2C": {"is_checkback", "is_rebid"},
    "1D-P-1H-P-1S-P-2C": {"is_fourth_suit", "is_forcing", "is_artificial"},
    "1C-P-1H-P-1S-P-2C": {"is_preference", "is_correction", "is_non_forcing"},
    "1H-2H": {"is_cuebid", "is_two_suited", "is_overcall", "is_aggressive"},
    "1H-2N": {"is_two_suited", "is_weak", "is_destructive"},
    "1H-P-P-1S": {"is_balancing", "is_reopening", "is_free_bid"},
    "1S-X": {"is_takeout"},
    "4S-X": {"is_penalty"},
    "4H-X": {"is_penalty", "is_lead_directing_double"},
    "1D-1S-X": {"is_negative_double"},
    "1H-X-2H-X": {"is_responsive_double", "is_takeout"},
    "1D-3S-X": {"is_negative_double", "is_optional_double"},
    "1S-X-XX": {"is_escape", "is_redouble"},
    "1S-X-2H": {"is_escape", "is_new_suit"},
    "1S-P-2S-4H-4S": {"is_competitive", "is_vulnerability_action", "is_long_suit_showing"},
    "4H": {"is_high_preempt", "is_preempt"},
}
NOT = {
    "1H-P-P-1S": {"is_direct", "is_opening"},
    "2C": {"is_preempt", "is_natural"},
    "1H-P-2H": {"is_jump", "is_new_suit"},
    "1S-P-4N": {"is_key_card_ask", "is_raise"},
    "1D-P-1H-P-1S-P-2C": {"is_natural", "is_preference"},
    "1S-X": {"is_negative_double", "is_penalty", "is_overcall"},
    "1N-P-2C": {"is_conventional"},
    "1C-P-1H-P-1S-P-2C": {"is_raise", "is_new_suit"},
}


def test_meanings(spark):
    from dealframe.functions import meanings

    auctions = sorted(set(MEANINGS) | set(NOT)) + [None]
    df = spark.createDataFrame([(a, 1) for a in auctions], "auction string, lv int")
    toks = F.when(F.col("auction") == "", F.array().cast("array<string>")).otherwise(F.split("auction", "-"))
    rows = meanings.with_meanings(df, toks).collect()
    got = {r["auction"]: {n for n in meanings.NAMES if r[n]} for r in rows}
    assert all(r[n] is not None for r in rows for n in meanings.NAMES)
    assert got[""] == got[None] == set()
    for a, some in MEANINGS.items():
        assert some <= got[a], (a, some - got[a])
    for a, none in NOT.items():
        assert not none & got.get(a, set()), (a, none & got[a])
