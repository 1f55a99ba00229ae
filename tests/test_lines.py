import datetime as dt

import pytest
from pyspark.sql import functions as F

from antecede.functions import text
from antecede.operators import lines as ops
from antecede.sources.line_csv import read_archive

PLAYERS = [("1", "José Álvarez Núñez", "ATP"), ("2", "Ye Xin", "WTA"), ("3", "John Smith", "ATP"), ("4", "John Smith", "WTA"),
           ("5", "Jane Smith", "ATP"), ("6", "Björn Groß", "ATP")]


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first().y


@pytest.mark.parametrize("raw,want", [
    ("José Álvarez-Núñez", "jose alvarez nunez"), ("YeXin", "ye xin"), ("  O'Neill  ", "o neill"), ("Groß", "gross"),
    ("ﬁne Ⅳ", "fine iv"), ("éa", "ea"), (None, ""), ("ÀÉ", "ae"), ("東京 A1", "a1"), ("Ａb", "ab")])
def test_normalise(spark, raw, want):
    assert one(spark, raw, text.normalise_name) == want


def test_scalars(spark):
    assert [one(spark, v, text.tolerant_int) for v in ("7", " 7.9 ", "Q", "", None, "-2.5", "1e2", "nan")] == [
        7, 7, None, None, None, -2, 100, None]
    assert [one(spark, v, text.prop_key) for v in ("Aces", "Player Double-Faults", "ServiceGames", "games won total", "corners")] == [
        "aces", "double_faults", "service_games", "games_won", None]
    assert [one(spark, v, text.tour_label) for v in ("ATP Challenger", "wta tour", "ITF")] == ["ATP", "WTA", None]
    assert [one(spark, v, lambda c: text.side_of(F.col(c))) for v in ("Over 5.5", "undergo", "UNDER", None)] == [
        "over", None, "under", None]
    ts = spark.createDataFrame([("2026-01-01T10:00:00Z",), ("2026-01-01T12:00:00+02:00",), ("2026-01-01T10:00:00",), ("x",)], "x string")
    assert ts.select(text.utc_timestamp("x").alias("t")).distinct().count() == 2


def test_aliases(spark):
    got = one(spark, "Ana Maria Lopez", lambda c: text.name_aliases(text.normalise_name(c)))
    assert sorted(got) == ["a lopez", "a maria lopez", "ana maria lopez", "lopez a", "maria lopez a"]
    assert one(spark, "", lambda c: text.name_aliases(text.normalise_name(c))) == []


def test_resolution_stages(spark):
    players = spark.createDataFrame(PLAYERS, "player_id string, full_name string, tour string")
    names = spark.createDataFrame(
        [("john smith", "ATP"), ("John Smith", None), ("Nunez J", "ATP"), ("J. Smith", "ATP"), ("YeXin", "WTA"), ("YeXin", "ATP"),
         ("", "ATP"), ("Gross B", "ATP")], "name string, tour string")
    got = {(r.name, r.tour): (r.player_id, r.stage) for r in ops.resolve_names(names, players).collect()}
    assert got == {
        ("john smith", "ATP"): ("3", "raw"), ("John Smith", None): (None, "unresolved"), ("Nunez J", "ATP"): ("1", "normalized"),
        ("J. Smith", "ATP"): (None, "unresolved"), ("YeXin", "WTA"): ("2", "normalized"), ("YeXin", "ATP"): (None, "unresolved"),
        ("", "ATP"): (None, "unresolved"), ("Gross B", "ATP"): ("6", "normalized")}
    shared = {r.alias for r in ops.alias_collisions(players).collect()}
    assert {"john smith", "smith j", "j smith"} <= shared


def raw(spark, *changes):
    base = dict(captured_at="2026-01-01T08:00:00Z", fixture_id="f1", league="ATP", tournament="Cup", start_date="2026-01-01T12:00:00Z",
                home_player="José Álvarez Núñez", away_player="Bjorn Gross", sportsbook="bk", market_id="m1", market="Aces",
                player_id="px", selection="Over", normalized_selection="over", points="5.5", price="1.9", odds_id="o1",
                player_name="", selection_line="over 5.5")
    rows = [tuple({**base, **c}.values()) for c in changes]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in base))
    return df.coalesce(1).withColumn("seq", F.monotonically_increasing_id())


def tables(spark):
    players = spark.createDataFrame(PLAYERS, "player_id string, full_name string, tour string")
    day = dt.date(2026, 1, 1)
    matches = spark.createDataFrame([("m1", day, "CUP", "1", "6"), ("m1", day, "CUP", "6", "1"), ("m2", day, "Cup", "1", "5")],
                                    "match_id string, event_date date, tournament string, player_id string, opponent_id string")
    return players, matches


def test_snapshot_end_to_end(spark):
    players, matches = tables(spark)
    over = dict(selection="Jose Alvarez Nunez")
    df = raw(spark, over, {**over, "selection_line": "under 5.5", "price": "2.0", "odds_id": "o0"},
             {**over, "price": "1.8"},                                  # later price of the same side
             {**over, "captured_at": "2026-01-01T12:00:00Z"},           # not before the start
             {**over, "price": "abc"}, {**over, "market": "corners"}, {**over, "player_id": " "}, {**over, "captured_at": ""},
             {**over, "fixture_id": "f2", "away_player": "Nobody"})
    rows, late, bad = ops.prepare_snapshot(df, players, matches, "prov", ["seq"])
    got = {r.provider_event_id: r for r in rows.collect()}
    assert (got["f1"].match_id, got["f1"].player_id, got["f1"].stage) == ("m1", "1", "raw")  # the home name it stands for
    assert (str(got["f1"].over_price), str(got["f1"].under_price), got["f1"].provider_odds_id) == ("1.800", "2.000", "o0|o1")
    assert got["f1"].resolved_at is not None and got["f1"].prop_type == "aces"
    assert (got["f2"].match_id, got["f2"].player_id, got["f2"].resolved_at) == (None, None, None)
    assert late.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["market", "player id", "price", "timestamp"]


def test_pivot_layout_round_trip(spark):
    cols = ops.PIVOT_COLUMNS
    row = dict.fromkeys(cols, "") | dict(
        captured_at="2026-01-01T08:00:00Z", fixture_id="f1", league="ATP", tournament="Cup", start_date="2026-01-01T12:00:00Z",
        home_player="José Álvarez Núñez", away_player="Björn Groß", book="bk", market_id="m1", market="Aces",
        provider_player_name="Groß B", provider_player_id="px", line="5.5", over_price="1.9", over_odds_id="o1")
    df = spark.createDataFrame([tuple(row[c] for c in cols)], ", ".join(f"`{c}` string" for c in cols)).withColumn("seq", F.lit(1))
    players, matches = tables(spark)
    out = ops.prepare_snapshot(df, players, matches, "prov", ["seq"])[0].collect()
    assert len(out) == 1 and out[0].player_id == "6" and out[0].match_id == "m1"
    assert str(out[0].over_price) == "1.900" and out[0].under_price is None and out[0].provider_odds_id == "o1"


def test_layout_detection():
    assert ops.detect_layout(ops.RAW_COLUMNS) == "raw"
    assert ops.detect_layout([*ops.RAW_COLUMNS, *ops.PIVOT_COLUMNS]) == "pivot"
    with pytest.raises(ValueError, match="raw lacks .*pivot lacks"):
        ops.detect_layout(["captured_at"])


def test_fixture_needs_both_players_date_and_tournament(spark):
    _, matches = tables(spark)
    at = dt.datetime(2026, 1, 1, 12)
    rows = [(1, "1", "6", "1", at, "cup"), (2, "6", "1", "6", at, ""), (3, "1", "6", "5", at, "cup"), (4, "1", None, "1", at, "cup"),
            (5, "1", "6", "1", dt.datetime(2026, 1, 2), "cup"), (6, "1", "6", "1", at, "other"), (7, "1", "1", "1", at, "cup")]
    df = spark.createDataFrame(rows, "rid int, home_id string, away_id string, selected_id string, start_at timestamp, tournament string")
    got = {r.rid: r.match_id for r in ops.resolve_fixtures(df, matches, row_id=["rid"]).collect()}
    assert got == {1: "m1", 2: "m1"}
    twice = matches.unionByName(matches.where("match_id = 'm1'").withColumn("match_id", F.lit("m9")))
    assert ops.resolve_fixtures(df, twice, row_id=["rid"]).count() == 0


def test_archive_reads_every_file(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"tennis_props_{i}.csv").write_text(",".join(ops.RAW_COLUMNS) + "\n" + ",".join("x" for _ in ops.RAW_COLUMNS) + "\n")
    df = read_archive(spark, str(tmp_path))
    assert sorted(r.file_name for r in df.select("file_name").collect()) == ["tennis_props_1.csv", "tennis_props_2.csv"]


def test_archive_takes_columns_by_name_and_mixes_layouts(spark, tmp_path):
    values = dict(captured_at="2026-01-01T08:00:00Z", fixture_id="f1", points="5.5", price="1.9", selection_line="over 5.5")
    for name, columns in (("a", [*ops.RAW_COLUMNS, "selection_line"]), ("b", [*reversed(ops.RAW_COLUMNS), "selection_line"])):
        (tmp_path / f"tennis_props_{name}.csv").write_text(",".join(columns) + "\n" + ",".join(values.get(c, "x") for c in columns) + "\n")
    pivot = dict(captured_at="2026-01-01T08:00:00Z", fixture_id="f2", line="5.5", over_price="1.9", under_price="2.1")
    bom = "\N{ZERO WIDTH NO-BREAK SPACE}"
    (tmp_path / "tennis_props_c.csv").write_text(bom + ",".join(ops.PIVOT_COLUMNS) + "\n" + ",".join(pivot.get(c, "") for c in ops.PIVOT_COLUMNS) + "\n")
    got = sorted((r.file_name[-5], r.fixture_id, r.points, r.price, r.side) for r in read_archive(spark, str(tmp_path)).collect())
    assert got == [("a", "f1", "5.5", "1.9", "over"), ("b", "f1", "5.5", "1.9", "over"), ("c", "f2", "5.5", "1.9", "over"), ("c", "f2", "5.5", "2.1", "under")]
    (tmp_path / "tennis_props_d.csv").write_text("other,columns\n1,2\n")
    with pytest.raises(ValueError, match="tennis_props_d.csv"):
        read_archive(spark, str(tmp_path))


def test_letters_of_all_planes_and_zones(spark):
    assert one(spark, "𝐀lice 𝟙", text.normalise_name) == "alice 1"
    rows = spark.createDataFrame([("2026-01-01T10:00:00Z",), ("2026-01-01T10:00:00",), ("2026-01-01 10:00",), ("2026-01-01T12:00:00+02:00",)], "x string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert rows.select(F.unix_timestamp(text.utc_timestamp("x"))).distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_captured_row_is_parsed_once(spark):
    """Predicates on parsed values must not repeat the parse: each text is normalised by one expression of the plan."""
    raw = spark.createDataFrame([("1", "1", *[""] * 16)], ["file_name", "row_seq", *ops.RAW_COLUMNS])
    usable, late, bad = ops.parse_captures(ops.to_raw_layout(raw, keep=["file_name", "row_seq"]), keep=["file_name", "row_seq"])
    for part in (usable, late, bad):
        plan = part.select("file_name", "captured_at", "line")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("start_date#") and plan.count("try_cast") + plan.lower().count("cast(") < 12, plan


def test_write_tasks_grow_with_the_lines(spark, sf, monkeypatch):
    from antecede.catalog import streams
    path, _, grown = streams._written(spark, sf)
    few = spark.read.option("header", True).csv(path)
    monkeypatch.setattr(streams, "TASK_ROWS", 500)
    path, _, more = streams._written(spark, sf)
    many = spark.read.option("header", True).csv(path)
    assert grown == 1 and more == 4 and sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert len(many.inputFiles()) > 3 * len(few.inputFiles())


def test_aliases_are_made_after_names_of_a_player_met(spark):
    players = spark.createDataFrame(
        [("ATP", "1", "Ann Bee Cee"), ("ATP", "1", "Ánn Bee Cee"), ("ATP", "1", "Ann Cee"), (None, "1", "Ann Cee"), ("WTA", "2", "!!"), ("WTA", "3", None)],
        "tour string, player_id string, full_name string")
    out = ops.alias_table(players)
    assert sorted((r.tour or "", r.player_id, r.alias) for r in out.collect()) == sorted(
        [("ATP", "1", a) for a in ("ann bee cee", "bee cee a", "a bee cee", "cee a", "a cee", "ann cee")]
        + [("", "1", a) for a in ("ann cee", "cee a", "a cee")])
    above, below = out._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert "Aggregate" not in above and "Aggregate" in below
