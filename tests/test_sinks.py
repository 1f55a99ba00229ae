import datetime as dt

import pytest
from pyspark.sql import functions as F

from antecede.operators import pages, quality, sinks, slices
from antecede.operators.skew import lookup as slices_lookup
from antecede.session import ensure_checkpoint_dir

D = dt.date


def test_profile_upsert_guards(spark):
    old = spark.createDataFrame([("a", D(2024, 1, 1), 1), ("b", None, 1), ("c", D(2024, 1, 1), 1), ("d", D(2024, 1, 1), 1)], "id string, as_of date, v int")
    new = spark.createDataFrame([("a", D(2024, 1, 1), 2, 0), ("b", None, 2, 0), ("c", D(2023, 1, 1), 2, 0), ("d", None, 2, 0), ("e", None, 2, 0),
                                 ("a", D(2024, 1, 1), 3, 1)], "id string, as_of date, v int, seq int")
    got = {r.id: r.v for r in sinks.upsert_newer(old, new, ["id"], "as_of", "seq").collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": 1, "e": 2}


def test_two_key_upsert_keeps_unresolved_rows_apart_and_is_idempotent(spark):
    cols = "match_id string, book string, prov string, event string, odds_id string, price double"
    old = spark.createDataFrame([("m1", "b", "p", "e1", "1", 1.0), (None, "b", "p", "e2", None, 2.0), ("m5", "b", "p", "e5", "5", 5.5)], cols)
    new = spark.createDataFrame([
        ("m1", "b", "p", "e1", "1", 5.0, 0), (None, "b", "q", "e2", None, 6.0, 1), ("m2", "b", "p", "e2", "9", 7.0, 2), (None, "b", "p", "e2", None, 8.0, 3),
        (None, "b", "p", "e3", "21", 3.0, 4), (None, "b", "p", "e4", "22", 4.0, 5), ("m1", "b", "q", "e1", None, 9.0, 6)], cols + ", seq int")
    args = (["prov", "odds_id"], ["match_id", "book"], "seq")
    more = {"fixed": ["prov"], "provider": ["prov", "event"]}
    once = sinks.upsert_two_key(old, new, *args, **more)
    key = lambda r: (r.match_id or "", r.prov, r.event, r.odds_id or "")
    want = [(None, "b", "p", "e2", None, 8.0), (None, "b", "p", "e3", "21", 3.0), (None, "b", "p", "e4", "22", 4.0), (None, "b", "q", "e2", None, 6.0),
            ("m1", "b", "p", "e1", None, 9.0), ("m2", "b", "p", "e2", "9", 7.0), ("m5", "b", "p", "e5", "5", 5.5)]
    assert [tuple(r) for r in sorted(once.collect(), key=key)] == want
    again = sinks.upsert_two_key(once, new, *args, **more)
    assert again.count() == len(want) and again.where("match_id IS NULL").count() == 4


def backtest(spark, version="baseline_v1_x_backtest_1", fold=1):
    return spark.createDataFrame([("a", "m", "s", "x", 1.0, version, fold, D(2024, 1, 1), D(2024, 2, 1))],
                                 "player_id string, match_id string, sport string, prop_type string, prediction double, modelversion string, "
                                 "fold_number int, fold_cutoff_date date, fold_test_end_date date")


def test_guarded_appends(spark, tmp_path):
    path = str(tmp_path / "pred")
    sinks.append_backtest(backtest(spark), path)
    for bad in (backtest(spark), backtest(spark, "baseline_v1_x"), backtest(spark, "v_backtest_2", None)):
        with pytest.raises(quality.AuditFailure):
            sinks.append_backtest(bad, path)
    sinks.append_backtest(backtest(spark, "baseline_v1_x_backtest_2"), path)
    assert spark.read.parquet(path).count() == 2
    live = str(tmp_path / "live")
    sinks.write_predictions(backtest(spark, "v1"), live)
    sinks.write_predictions(backtest(spark, "v2"), live)
    sinks.write_predictions(backtest(spark, "v1").withColumn("prediction", F.lit(9.0)), live)
    assert {r.modelversion: r.prediction for r in spark.read.parquet(live).collect()} == {"v1": 9.0, "v2": 1.0}
    with pytest.raises(quality.AuditFailure):
        sinks.write_predictions(backtest(spark), live)


def test_scoped_copy_refuses_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "v1"), ("demo_b", "v2"), (None, "v3")], "player_id string, modelversion string")
    assert sinks.in_scope(df).count() == 1 and sinks.in_scope(df, keep_null_player=True).count() == 2
    assert sinks.in_scope(df, player=None, versions=df.where("modelversion = 'v2'")).count() == 1
    folder = str(tmp_path / "copy")
    out = sinks.scoped_copy({"t": sinks.in_scope(df)}, folder, spark).first()
    assert (out.table_name, out.source_rows, out.copied_rows) == ("t", 1, 1)
    with pytest.raises(quality.AuditFailure):
        sinks.scoped_copy({"t": df}, folder, spark)


def test_checkpoint_folder_comes_from_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() in sinks.scratch_path(spark, "x")


FMT = pages.PageFormat()


def page(winner=True, score="6-4,7-6(5)", date="2026-05-01", number="LS001", second=True):
    people = '{"@id":"https://www.wtatennis.com/players/11/ana-lopez","name":"Ana López"}'
    if second:
        people += ',{"@id":"https://www.wtatennis.com/players/22/bea-ruiz","name":"Bea Ruiz"}'
    blob = ('{"@type":"SportsEvent","startDate":"%s","competitor":[%s],"additionalProperty":[{"name":"Final Score","value":"%s"},'
            '{"name":"Match Number","value":"%s"},{"name":"Round","value":"F"}]}' % (date, people, score, number)).replace('"', "&quot;")
    return (f'<script id="x" type="application/ld+json">{blob}</script><tr class="match-table__row js-team-a{" is-winner" if winner else ""}">\n'
            '<a href="/players/11/ana-lopez"></tr><tr class="match-table__row js-team-b"><a href="/players/22/bea-ruiz"></tr>')


URL = "https://www.wtatennis.com/tournaments/9/cup/2026/scores/LS001"


@pytest.mark.parametrize("html,reason", [
    (page(), None), (page(winner=False), "winner"), (page(score="6-4,2-1 RET"), "sets"), (page(score="4-6,6-4"), "sets"), (page(score=""), "score"),
    (page(date="2026-05-02"), "date"), (page(number="LS002"), "score"), (page(second=False), "competitors"), ("<html>", "event"),
    (page() + page(), "event"), ('<script type="application/ld+json">{broken</script>', "event")])
def test_verification_fails_closed(spark, html, reason):
    fx = spark.createDataFrame([("f1", "Cup", D(2026, 5, 1), "Bea Ruiz", "ANA LOPEZ", URL, None)],
                               "fixture_id string, tournament string, scheduled_date date, home string, away string, url string, reason string")
    out = pages.verify_results(fx, spark.createDataFrame([(URL, html)], "url string, html string"), FMT).first()
    assert out.reason == reason
    if reason is None:
        assert [(p.player_id, p.is_winner, p.games_won, p.sets_won) for p in out.players] == [("11", True, 13, 2), ("22", False, 10, 0)]


def test_links_need_exactly_one_card(spark):
    card = ('<div class="tennis-match js-tennis-match a"><a href="/players/11/ana-lopez"><a href="/players/22/bea-ruiz">'
            '<a href="/tournaments/9/cup/2026/scores/{}">')
    fx = spark.createDataFrame([("f1", "Cup", "Ana López", "Bea Ruiz"), ("f2", "Two", "Ana López", "Bea Ruiz"), ("f3", "Cup", "Ana", "Bea Ruiz")],
                               "fixture_id string, tournament string, home string, away string")
    html = spark.createDataFrame([("Cup", "x" + card.format("LS001") + card.format("LS001")), ("Two", "x" + card.format("LS001") + card.format("LS002"))],
                                 "tournament string, html string")
    got = {r.fixture_id: (r.url, r.reason) for r in pages.fixture_links(fx, html, FMT).collect()}
    assert got == {"f1": (URL, None), "f2": (None, "matching cards: 2"), "f3": (None, "matching cards: 0")}


def test_archive_fixtures(spark):
    cols = "league string, fixture_id string, tournament string, start_date string, home_player string, away_player string"
    row = (" wta ", "f1", "Cup", "2026-05-01T23:30:00-02:00", "A", "B")
    out = pages.archive_fixtures(spark.createDataFrame([row, row], cols)).collect()
    assert [(r.fixture_id, r.scheduled_date) for r in out] == [("f1", D(2026, 5, 2))]
    for bad in (("ATP",) + row[1:], row[:4] + ("C", "B")):
        with pytest.raises(quality.AuditFailure):
            pages.archive_fixtures(spark.createDataFrame([row, bad], cols))


def test_stored_tables(spark, tmp_path):
    from antecede.sources import tables
    path = str(tmp_path / "features")
    df = spark.createDataFrame([("a", "m1", "s", "v1", "aces", None, '{"x":"2.5"}'), ("demo_b", "m1", "s", "v1", "aces", 1.0, "{}"),
                                ("a", "m1", "s", "v2", "aces", 1.0, "{}")],
                               "player_id string, match_id string, sport string, feature_version string, stat_target string, x double, feature_values string")
    sinks.replace_partitions(df, path, ["sport", "feature_version", "stat_target"])
    out = tables.read_features_backfilled(spark, path, "s", "v1", "aces", {"x": "double"}).collect()
    assert [(r.player_id, r.x) for r in out] == [("a", 2.5)]
    assert quality.count_mismatch(df, spark.read.parquet(path)).isEmpty() and not quality.count_mismatch(df, df.limit(1)).isEmpty()
    before = spark.createDataFrame([("t", 3)], "table_name string, demo_rows long")
    assert quality.census_changes(before, before).isEmpty() and not quality.census_changes(before, before.withColumn("demo_rows", F.lit(4))).isEmpty()
    gaps = spark.createDataFrame([(0, None), (1, None), (2, 1.0)], "n int, v double")
    assert quality.history_without_value(gaps, "n", "v").count() == 1


def _sliced(spark, rows):
    return spark.createDataFrame(rows, "mode string, version string, id int")


def test_slices_vanish_stay_and_survive_a_killed_replacement(spark, tmp_path, monkeypatch):
    path, by, real = str(tmp_path / "t"), ["mode", "version"], {"mode": "real"}
    read = lambda: sorted((tuple(r) for r in slices.read_slices(spark, path).collect()), key=repr)
    assert slices.read_slices(spark, path) is None
    demo, first = [("demo", "a", 1), ("demo", None, 2)], [("real", "a", 3), ("real", "b/ =x", 4), ("real", None, 5), ("real", "01", 6)]
    slices.replace_slices(_sliced(spark, demo), path, by, {"mode": "demo"})
    slices.replace_slices(_sliced(spark, first), path, by, real)
    assert read() == sorted(demo + first, key=repr)
    kept = {label: folder for label, folder in slices.slices(spark, path).items() if "demo" in label}

    second = [("real", "a", 7), ("real", "a", 7)]
    with monkeypatch.context() as patch:
        patch.setattr(slices, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            slices.replace_slices(_sliced(spark, second), path, by, real)
    assert read() == sorted(demo + first, key=repr)
    with monkeypatch.context() as patch:
        patch.setattr(slices, "lookup", lambda rows, *a, **k: slices_lookup(rows.limit(1), *a, **k))
        with pytest.raises(quality.AuditFailure, match="stored 1 rows of 2 built"):
            slices.replace_slices(_sliced(spark, second), path, by, real)
    assert read() == sorted(demo + first, key=repr)

    slices.replace_slices(_sliced(spark, second), path, by, real)
    assert read() == sorted(demo + second, key=repr)
    assert {label: folder for label, folder in slices.slices(spark, path).items() if "demo" in label} == kept
    with pytest.raises(quality.AuditFailure, match="already stored"):
        slices.replace_slices(_sliced(spark, first), path, by, real, overwrite=False)
    with pytest.raises(quality.AuditFailure, match="outside"):
        slices.replace_slices(_sliced(spark, demo), path, by, real)
    slices.replace_slices(_sliced(spark, []), path, by, real)
    assert read() == sorted(demo, key=repr)
