import datetime as dt

import pytest
from pyspark.sql import functions as F

from antecede.operators import quality, sinks
from antecede.operators.latest import latest_run
from antecede.plans import report

D = dt.date
T0, T1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
OUT = {"aces": "aces", "df": "df"}


def tables(spark):
    players = spark.createDataFrame([("a", "Ann", "ATP"), ("b", "Bob", "ATP"), ("demo_c", "Cy", "ATP")], "player_id string, full_name string, tour string")
    props = spark.createDataFrame([("aces", "Aces"), ("df", None)], "prop_key string, display_label string")
    matches = spark.createDataFrame(
        [("m1", "a", "b", D(2025, 1, 1), "Cup", "hard", True, 7, 2), ("m2", "a", "zz", D(2027, 1, 1), "Cup", "clay", True, 9, 1),
         ("m1", "b", "a", D(2025, 1, 1), "Cup", "hard", True, 3, 4), ("m3", "demo_c", "a", D(2025, 2, 1), "Cup", "hard", None, None, 1)],
        "match_id string, player_id string, opponent_id string, event_date date, tournament string, surface string, match_completed boolean, aces int, df int")
    pred = [("p1", "m1", "a", "t", "aces", 5.0, 3.0, 7.0, "baseline_v1_aces", T0), ("p2", "m2", "a", "t", "aces", 6.0, 6.0, 6.0, "gbm_v1_aces", T1),
            ("p3", "m1", "b", "t", "df", 2.0, None, None, "baseline_v1_df", T0), ("p4", "m3", "demo_c", "t", "aces", 1.0, 0.0, 2.0, "baseline_v1_aces", T0)]
    predictions = spark.createDataFrame(pred, "prediction_id string, match_id string, player_id string, sport string, prop_type string, prediction double, "
                                              "lowerci double, upperci double, modelversion string, predictiontimestamp timestamp_ntz")
    odds = spark.createDataFrame(
        [("m1", "a", "aces", "prov", "e", bk, line, 1.9, 1.9, T0) for bk, line in (("b1", 5.0), ("b2", 4.0), ("b3", 6.5))]
        + [("m2", "a", "aces", "prov", "e", "b1", 5.5, 1.9, 1.9, T1), ("m1", "b", "aces", "prov", "e", "b1", 5.5, 1.9, 1.9, T0)],
        "match_id string, player_id string, prop_type string, provider string, provider_event_id string, book string, line double, "
        "over_price double, under_price double, captured_at timestamp_ntz")
    features = spark.createDataFrame([("m1", "a", "aces", "v1", 4.0, T0), ("m1", "a", "aces", "v2", 4.5, T1)],
                                     "match_id string, player_id string, stat_target string, feature_version string, rolling_average double, created_at timestamp_ntz")
    injuries = spark.createDataFrame([(1, "a", D(2025, 1, 1), "out", T0), (2, "a", D(2025, 1, 1), "fit", T0)],
                                     "injury_id int, player_id string, event_date date, status string, captured_at timestamp_ntz")
    return predictions, players, props, matches, odds, features, injuries


@pytest.fixture(scope="module")
def fact(spark):
    return report.fact_report(*tables(spark), outcomes=OUT, as_of=D(2026, 6, 1)).cache()


def test_three_books_three_rows_and_no_line_keeps_the_row(fact):
    rows = fact.collect()
    assert len([r for r in rows if r.prediction_id == "p1"]) == 3
    lone = [r for r in rows if r.prediction_id == "p3"]
    assert len(lone) == 1 and lone[0].line is None and lone[0].edge is None and lone[0].side is None and lone[0].actual_value == 4.0
    by = {r.book: r for r in rows if r.prediction_id == "p1"}
    assert (by["b1"].edge, by["b1"].side) == (0.0, "Over") and by["b3"].side == "Under" and by["b2"].normalized_edge == 0.25
    assert (by["b1"].prediction_error, by["b1"].signed_error) == (2.0, -2.0)
    assert (by["b1"].status, by["b1"].feature_version, by["b1"].rolling_average) == ("fit", "v2", 4.5)
    future = [r for r in rows if r.prediction_id == "p2"][0]
    assert future.actual_value is None and future.matchup == "Ann vs TBD" and future.normalized_edge is None
    assert by["b1"].prop_label == "Aces" and lone[0].prop_label == "Df" and by["b1"].matchup == "Ann vs Bob"


def test_queries(fact):
    real = report.only(fact, "real")
    kpi = report.overview(real, 0.25).first()
    assert (kpi.active_prop_markets, kpi.predictions_generated, kpi.value_edges_found, kpi.match_rows, kpi.market_rows, kpi.feature_rows) == (
        3, 3, 1, 2, 5, 1)
    assert [r.prediction_id for r in report.top_edges(real, 1).collect()] == ["p1"]
    assert report.predictions_page(real).first().prediction_id == "p2"
    versions = {r.modelversion: r.prediction_count for r in report.model_versions(real).collect()}
    assert versions == {"baseline_v1_aces": 1, "gbm_v1_aces": 1, "baseline_v1_df": 1}
    assert report.only(fact, "demo").count() == 1 and report.only(fact, None, prop_type="ACES", modelversion=None).count() == 5
    trend = report.player_trend(fact, "a", "aces", list(OUT)).collect()
    assert [(r.match_id, r.posted_line) for r in trend] == [("m2", 5.5)]
    trend = report.player_trend(fact, "a", "aces", list(OUT), model_version="baseline_v1_aces").collect()
    assert [(r.match_id, r.posted_line) for r in trend] == [("m1", 5.0)]
    with pytest.raises(ValueError):
        report.player_trend(fact, "a", "nope", list(OUT))
    with pytest.raises(ValueError):
        report.only(fact, "other")
    assert [r.book for r in report.line_search(fact, "ANN", False).collect()] == ["b1", "b3", "b1", "b2"]
    assert {r.side for r in report.prop_rows(fact).where("line IS NULL").collect()} == {"Over"}


def test_market_comparison(spark):
    predictions, _, _, matches, odds, _, _ = tables(spark)
    r = report.market_comparison(predictions, matches, odds.withColumn("captured_at", F.lit("2024-12-31").cast("timestamp_ntz")), OUT).first()
    assert (r.prediction_line_pairs, r.known_result_pairs, r.providers) == (4, 4, "prov")
    r = report.market_comparison(predictions, matches, odds, OUT).first()
    assert (r.prediction_line_pairs, r.providers) == (1, "prov")
    r = report.market_comparison(predictions, matches, odds.limit(0), OUT).first()
    assert (r.prediction_line_pairs, r.paired_rows, r.providers) == (0, 0, "")


def test_rules_and_references(spark):
    predictions, _, props, matches, _, _, _ = tables(spark)
    rows = predictions.withColumns({"fold_number": F.lit(None).cast("int"), "fold_cutoff_date": F.lit(None).cast("date"),
                                    "fold_test_end_date": F.lit(None).cast("date")})
    sinks.require_rows(rows, sinks.prediction_rules())
    with pytest.raises(quality.AuditFailure):
        sinks.require_rows(rows.withColumn("lowerci", F.lit(99.0)), sinks.prediction_rules())
    with pytest.raises(quality.AuditFailure):
        sinks.require_rows(rows.withColumn("fold_number", F.lit(1)), sinks.prediction_rules())
    with pytest.raises(quality.AuditFailure):
        sinks.require_rows(props.withColumn("prop_key", F.lit("Bad Key")), sinks.key_rule())
    assert sinks.orphans(predictions, matches.where("match_id <> 'm2'"), ["match_id", "player_id"]).count() == 1
    assert report.version_census(predictions, report.expected_versions(["aces"])).count() == 2
    assert quality.missing_columns(predictions, ["modelversion", "nope"]) == ["nope"]


def test_latest_run(spark):
    df = spark.createDataFrame([(1, T0), (2, T1), (3, T1)], "id int, run_timestamp timestamp_ntz")
    assert sorted(r.id for r in latest_run(df).collect()) == [2, 3]


def test_only_the_sides_asked_for_are_joined(spark, fact):
    def part(*columns):
        return report.fact_report(*tables(spark), outcomes=OUT, as_of=D(2026, 6, 1), columns=columns)

    plain = part("prediction_id", "modelversion", "actual_value", "data_mode")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, fact.select(plain.columns).distinct().collect()))
    text = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in text and text.count("Join Inner") == 3
    for columns in (("prediction_id", "matchup", "status"), ("prediction_id", "book", "edge"), ("prediction_id", "rolling_average", "is_demo")):
        assert set(map(tuple, part(*columns).collect())) == set(map(tuple, fact.select(*columns).collect()))
    assert part("prediction_id", "side").count() == fact.count() and plain.count() == 4


def joins_above(node, column):
    """Joins between the root and the deepest relation that brings the column."""
    children = [node.children().apply(i) for i in range(node.children().size())]
    if not children:
        return 0 if column in node.output().toString() else None
    found = [n for n in (joins_above(c, column) for c in children) if n is not None]
    return max(found) + node.nodeName().startswith("Join") if found else None


def test_lines_meet_results_once(spark):
    _, players, _, matches, odds, _, _ = tables(spark)
    won = matches.withColumn("is_winner", F.col("match_completed"))
    sources = spark.createDataFrame([("m1", "6-4", "u")], "match_id string, final_score string, source_url string")
    out = report.odds_results(odds, won, players, sources, tour="ATP", outcomes=OUT)
    assert out.columns == [*odds.columns, "event_date", "tournament", "is_winner", "final_score", "source_url", "player", "opponent", "actual_value"]
    assert sorted((r.player, r.opponent, r.book, r.actual_value) for r in out.collect()) == [
        ("Ann", "Bob", "b1", 7.0), ("Ann", "Bob", "b2", 7.0), ("Ann", "Bob", "b3", 7.0), ("Bob", "Ann", "b1", 3.0)]
    assert joins_above(out._jdf.queryExecution().optimizedPlan(), "provider_event_id") == 1


def test_the_long_tables_of_the_report_are_read_and_joined_once(spark, sf):
    from antecede.catalog import reports
    assert joins_above(reports.odds(spark, sf)._jdf.queryExecution().optimizedPlan(), "l_linenumber") == 1
    made = reports.predictions(spark, sf)
    leaves = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line and "o_orderkey" in line]
    assert len(leaves) == 1
    assert {r.prop_type for r in made.select("prop_type").distinct().collect()} == {"spend", "half_spend"}
