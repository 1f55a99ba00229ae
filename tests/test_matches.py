import datetime as dt

import pytest
from pyspark.sql import functions as F

from antecede.operators import matches as m
from antecede.sources.match_csv import REQUIRED, HeaderError, read_matches

BASE = dict(
    tourney_id="2024-1", tourney_name="Cup", surface="Hard", draw_size="32", tourney_level="A", tourney_date="20240101",
    match_num="7", winner_id="w1", winner_seed="1", winner_entry="", winner_name="Win Ner", winner_hand="R", winner_ht="185",
    winner_ioc="FRA", winner_age="25.5", winner_rank="10", winner_rank_points="1000", loser_id="l1", loser_seed="Q",
    loser_entry="WC", loser_name="Lo Ser", loser_hand="L", loser_ht="", loser_ioc="", loser_age="", loser_rank="20.0",
    loser_rank_points="", score="6-4 6-3", best_of="3", round="QF", minutes="90", w_ace="5", w_df="1", w_svpt="60",
    w_1stIn="40", w_1stWon="30", w_2ndWon="10", w_SvGms="10", w_bpSaved="1", w_bpFaced="2", l_ace="", l_df="3", l_svpt="55",
    l_1stIn="30", l_1stWon="20", l_2ndWon="9", l_SvGms="9", l_bpSaved="0", l_bpFaced="1")


def frame(spark, *changes):
    rows = [{**BASE, **c} for c in changes or [{}]]
    df = spark.createDataFrame([tuple(r[c] for c in REQUIRED) for r in rows], ", ".join(f"`{c}` string" for c in REQUIRED))
    return df.coalesce(1).withColumn("seq", F.monotonically_increasing_id())


def sides(spark, **change):
    out = m.expand_matches(frame(spark, change)).collect()
    assert len(out) == 2
    return {r.player_id: r for r in out}


def test_one_row_becomes_two_and_missing_is_not_zero(spark):
    s = sides(spark)
    w, l = s["w1"], s["l1"]
    assert (w.aces, l.aces) == (5, None)
    assert (w.is_winner, l.is_winner, w.opponent_id, l.opponent_id) == (True, False, "l1", "w1")
    assert w.match_id == "2024-1-7" and w.event_date == dt.date(2024, 1, 5) and w.tourney_date == dt.date(2024, 1, 1)
    assert l.player_seed is None and l.player_rank == 20 and l.player_entry == "WC"
    assert w.match_completed and str(w.player_age) == "25.5000" and l.player_age is None


def test_break_points_cross_sides(spark):
    s = sides(spark)
    assert (s["w1"].break_points_won, s["l1"].break_points_won) == (1, 1)
    s = sides(spark, w_bpSaved="3")  # more saved than faced: the winner's block is impossible
    assert s["w1"].aces is None and s["w1"].minutes == 90 and s["w1"].break_points_won is None
    assert s["l1"].double_faults == 3 and s["l1"].break_points_won is None


@pytest.mark.parametrize("change", [{"w_1stIn": "61"}, {"w_ace": "61"}, {"w_df": "-1"}, {"w_df": "61"}, {"w_1stWon": "41"}])
def test_impossible_stats_null_the_side(spark, change):
    s = sides(spark, **change)
    assert s["w1"].serve_points is None and s["l1"].serve_points == 55


def test_completion_from_score_text(spark):
    cases = [("6-4 6-3", "3", True), ("6-4 2-1 RET", "3", False), ("W/O", "3", False), ("", "3", False), ("6-4 6-3", "", False),
             ("7-6(5) 4-6 6-2", "3", True), ("6-4 6-3", "5", False), ("6-4 3-6", "3", False), ("6-4 Ret.", "3", False),
             ("6-1 6-1 6-1", "5", True)]
    df = frame(spark, *[{"score": s, "best_of": b} for s, b, _ in cases])
    got = {(r.score, r.best_of): r.completed for r in m.with_parsed(df).collect()}
    assert got == {(s, b): want for s, b, want in cases}


def test_rounds_shift_the_date(spark):
    for name, day in (("F", 7), ("r16", 4), ("Q3", 0), ("RR", 1)):
        want = dt.date(2024, 1, 1) + dt.timedelta(days=day - 1)
        assert sides(spark, round=name)["w1"].event_date == want


def test_conflicting_keys_are_kept_and_repeats_dropped(spark):
    df = frame(spark, {}, {}, {"winner_id": "w2"}, {"winner_id": "w2"}, {"match_num": "8"})
    got = sorted(r.unique_id for r in m.unique_match_ids(df, ["seq"]).collect())
    assert got == ["2024-1-7", "2024-1-7-20240101-w2-l1", "2024-1-8"]
    clash = frame(spark, {}, {"winner_id": "w2"}, {"winner_id": "w2", "score": "6-0 6-0"})
    with pytest.raises(Exception, match="cannot disambiguate"):
        m.unique_match_ids(clash, ["seq"]).collect()


def test_latest_profile_last_row_wins_ties(spark):
    df = frame(spark, {"winner_ht": "180"}, {"winner_ht": "181"}, {"tourney_date": "20230101", "winner_ht": "170"})
    got = {r.player_id: r for r in m.latest_profiles(m.player_snapshots(df, ["seq"]), ["seq"]).collect()}
    assert got["w1"].height_cm == 181 and got["w1"].profile_as_of == dt.date(2024, 1, 1)


def test_report_freshness_and_history(spark):
    df = frame(spark, {}, {"winner_id": " "}, {"surface": "", "match_num": "8", "score": "W/O"})
    r = m.season_report(df.withColumn("f", F.lit(1)), ["f"]).first()
    assert (r.source_rows, r.output_rows, r.invalid_rows, r.incomplete_matches, r.null_surface_matches) == (3, 4, 1, 1, 1)
    rows = m.expand_matches(df)
    assert m.require_fresh(rows, 2024, dt.date(2024, 1, 20)) == dt.date(2024, 1, 5)
    m.require_fresh(rows, 2023, dt.date(2024, 3, 20))
    with pytest.raises(ValueError, match="stale"):
        m.require_fresh(rows, 2024, dt.date(2024, 3, 20))
    players = m.latest_profiles(m.player_snapshots(df, ["seq"]), ["seq"])
    assert m.player_history(rows, players, "WIN NER", [2024]).count() == 2
    assert m.player_history(rows, players, "win ner", [2022]).count() == 0


def test_csv_contract(spark, tmp_path):
    head = "﻿" + ",".join(REQUIRED)
    one, two = tmp_path / "a.csv", tmp_path / "b.csv"
    one.write_text(head + ",extra\n" + ",".join(BASE[c] for c in REQUIRED) + ",x\n", encoding="utf-8")
    two.write_text(",".join(REQUIRED) + "\n" + ",".join(BASE[c] for c in REQUIRED) + "\n", encoding="utf-8")
    df = read_matches(spark, [str(one), str(two)])
    assert [r.file_idx for r in df.orderBy("file_idx").collect()] == [0, 1] and df.columns[:1] == ["tourney_id"]
    assert m.unique_match_ids(df, ["file_idx", "row_seq"]).count() == 1
    bad = tmp_path / "c.csv"
    bad.write_text("tourney_id,score\n1,2\n", encoding="utf-8")
    with pytest.raises(HeaderError, match="winner_id"):
        read_matches(spark, [str(bad)])


def test_duplicates_are_counted_where_they_stand(spark):
    cols = ["f", "at", *m.SIGNATURE]
    a, b = ("T", "1", "20240101", "p", "q", "6-0"), ("T", "1", "20240101", "p", "q", None)
    rows = [(0, 0, *a), (0, 1, *a), (1, 0, " T ", *a[1:]), (1, 1, *b), (2, 0, *b), (2, 1, *a), (None, 9, *b)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c in ('f', 'at') else 'string'}" for c in cols))
    got = {r.f: (r.source_rows, r.duplicate_rows) for r in m.duplicate_report(df.where("f IS NOT NULL"), ["f"], ["f", "at"]).collect()}
    assert got == {0: (2, 1), 1: (2, 1), 2: (2, 2)}
    assert m.duplicate_report(df.limit(0), ["f"], ["f", "at"]).count() == 0
