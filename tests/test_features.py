import datetime as dt
import random
from functools import partial

import pytest
from pyspark.sql import Window, functions as F

from antecede.operators import quality
from antecede.operators.pit import Prior
from antecede.plans.features import (
    FeatureConfig, Target, backfill_from_json, build_features, expand_json, feature_json, safe_ratio)
from antecede.plans.recheck import disagreements, recompute_features

CONFIG = FeatureConfig(
    "s", "v1", [Target("aces", "aces", ("aces", "games"), ("first_in", "points"), "rolling_aces_rate"),
                Target("games", "games", ("games", "minutes"), ("first_in", "points"), "rolling_games_rate")],
    rolling_windows=(3, 5), minimum_history=3, category_column="surface", category_window=4, rate_window=3,
    context={"surface": "surface", "rank": "rank"}, derived={"rank_difference": ("rank", "other_rank")})

SCHEMA = ("match_id int, player_id string, opponent_id string, event_date date, surface string, completed boolean, is_winner boolean, aces int, "
          "games int, minutes int, points int, first_in int, rank int, other_rank int")


def rows(n=80, seed=11):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.sample("abcd", 2)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(30))
        done, surface = i % 17 != 0, rng.choice(["clay", "hard", None])
        for me, you, won in ((a, b, True), (b, a, False)):
            out.append((i, me, you, day, surface, done, won, None if rng.random() < 0.1 else rng.randrange(15), rng.choice([0, 8, 10, 12]),
                        rng.choice([None, 60, 90]), rng.choice([0, 50, 60]), rng.randrange(40), rng.choice([None, 5, 9]), 7))
    return out


@pytest.fixture(scope="module")
def matches(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def built(matches):
    return build_features(matches, CONFIG).cache()


def past(data, me, row, key=lambda r: True):
    return sorted((r for r in data if r[1] == me and r[3] < row[3] and r[5] and key(r)), key=lambda r: (r[3], r[0]))


def mean(values, n=None):
    values = [v for v in values if v is not None][-n if n else 0:]
    return sum(values) / len(values) if values else None


def ratio(a, b):
    return a / b if a is not None and b is not None and b > 0 else None


def test_every_feature_against_plain_python(built):
    data = rows()
    lookup = {(r[0], r[1]): r for r in data}
    got = {(r.match_id, r.player_id, r.stat_target): r for r in built.collect()}
    assert len(got) == 2 * len(data)
    near = lambda a, b: a == pytest.approx(b, abs=1e-9) if b is not None else a is None
    for row in data:
        for name, at in (("aces", 7), ("games", 8)):
            f = got[(row[0], row[1], name)]
            own = past(data, row[1], row)
            values = [r[at] for r in own]
            known = [v for v in values if v is not None]
            assert near(f.rolling_mean_3, mean(values, 3)) and near(f.career_to_date_mean, mean(values))
            assert f.history_observations == len(known) and f.has_sufficient_history == (len(known) >= 3)
            assert f.is_training_eligible == (len(known) >= 3 and row[5] and row[at] is not None)
            same = [r[at] for r in own if r[4] == row[4]]
            assert near(f.category_rolling_mean, mean(same, 4))
            assert f.category_rolling_n_observations == min(4, len([v for v in same if v is not None]))
            rate = [ratio(r[7], r[8]) if name == "aces" else ratio(r[8], r[9]) for r in own]
            assert near(f.rolling_aces_rate if name == "aces" else f.rolling_games_rate, mean(rate, 3))
            assert near(f.rolling_percentage, mean([ratio(r[11], r[10]) for r in own], 3))
            h2h = [r for r in own if r[2] == row[2]]
            assert near(f.head_to_head_average, mean([r[at] for r in h2h])) and f.head_to_head_matches == len(h2h)
            assert near(f.head_to_head_win_rate, mean([int(r[6]) for r in h2h]))
            conceded = [lookup[(r[0], r[2])][at] for r in past(data, row[2], row)]
            assert near(f.opponent_conceded_rate, mean(conceded, 3))
            days = [r[3] for r in data if r[1] == row[1] and r[3] < row[3]]
            assert f.rest_days == ((row[3] - max(days)).days if days else None)
            assert near(f.rank_difference, None if row[12] is None else row[12] - 7)


def test_hot_path_builds_the_same(matches, built):
    hot = build_features(matches, CONFIG, hot_rows=10)
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    assert rounded(hot).exceptAll(rounded(built)).isEmpty() and rounded(built).exceptAll(rounded(hot)).isEmpty()


def test_audits(matches, built):
    prior = Prior(("player_id", "stat_target"), "target_value", {"rolling_mean_3": ("mean", 3), "rolling_std_5": ("std", 5)},
                  {"history_observations": None})
    long = built.select("match_id", "player_id", "event_date", "stat_target", "target_value").join(
        matches.select("match_id", "player_id", "completed"), ["match_id", "player_id"])
    check = partial(quality.recomputation_mismatches, history=long, prior=prior, row_id=["match_id", "player_id", "stat_target"],
                    date="event_date", order=["match_id"], eligible="completed")
    sample = quality.hash_sample(built, ["match_id", "player_id"], 3)
    assert 0 < sample.count() < built.count() and check(sample).isEmpty()
    assert not check(sample.withColumn("rolling_mean_3", F.col("rolling_mean_3") + 1)).isEmpty()
    history = ["rolling_mean_3", "career_to_date_mean", "rest_days", "head_to_head_average"]
    assert quality.first_event_violations(built, "player_id", "event_date", history, ["history_observations"]).isEmpty()
    assert not quality.first_event_violations(built, "player_id", "event_date", ["rank_difference"]).isEmpty()
    row = matches.orderBy(F.col("event_date").desc(), "match_id").first().asDict()
    features = [c for c in CONFIG.feature_columns]
    run = partial(quality.perturbation_changes, matches=matches, row=row, value="aces", player="player_id", opponent="opponent_id",
                  date="event_date", row_id=["match_id", "player_id"])
    assert run(lambda m: build_features(m, CONFIG), compare=["stat_target", *features]).isEmpty()
    leaky = lambda m: build_features(m, CONFIG).withColumn("leak", F.col("target_value"))
    assert not run(leaky, compare=["stat_target", "leak"]).isEmpty()
    assert quality.duplicate_keys(built, ["match_id", "player_id", "stat_target"]).isEmpty()
    guard = {(r.stat_target, r.feature): r for r in quality.correlation_guard(
        built.withColumn("copy", F.col("target_value")).withColumn("flat", F.lit(1)), ["copy", "flat", "rank"], "target_value", ["stat_target"]).collect()}
    assert guard[("aces", "copy")].suspicious and guard[("aces", "flat")].abs_correlation is None and not guard[("aces", "rank")].suspicious


def test_json_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.5, None)], "id int, v double, s string")
    packed = df.select("id", feature_json(["v", "s"]).alias("j"))
    assert [r.j for r in packed.orderBy("id").collect()] == ['{"v":null,"s":"x"}', '{"v":2.5,"s":null}']
    assert [tuple(r) for r in expand_json(packed, "j", {"id": "int", "v": "double"}).select("id", "v").orderBy("id").collect()] == [(1, None), (2, 2.5)]
    back = backfill_from_json(packed.withColumn("v", F.lit(None).cast("double")), "j", {"v": "double", "s": "string"})
    assert [(r.v, r.s) for r in back.orderBy("id").collect()] == [(None, "x"), (2.5, None)]
    assert spark.range(1).select(safe_ratio(F.lit(1), F.lit(0)).alias("z"), safe_ratio(F.lit(1), F.lit(2)).alias("h")).first() == (None, 0.5)


def test_config_is_checked():
    with pytest.raises(ValueError):
        FeatureConfig("s", "v", [])
    with pytest.raises(ValueError):
        FeatureConfig("s", "v", [Target("Bad Name", "x", ("a", "b"), ("a", "b"))])


ROW_KEYS = ["match_id", "player_id", "stat_target"]


def test_recheck_agrees_with_the_build_on_every_row(matches, built):
    expected = recompute_features(matches, matches, CONFIG)
    found = disagreements(built, expected, ROW_KEYS).collect()
    assert len(found) == built.count() == 2 * matches.count()
    assert [(r.match_id, r.player_id, r.wrong) for r in found if r.wrong] == []


def test_recheck_names_every_planted_leak(matches, built):
    """A build that sees each row's own day, and columns moved one by one, are found in every kind of history."""
    late = build_features(matches.withColumn("event_date", F.lit(dt.date(2024, 1, 1)) + F.dense_rank().over(
        Window.orderBy("match_id")).cast("int")), CONFIG)
    expected = recompute_features(matches, matches, CONFIG).cache()
    leaking = {name for r in disagreements(late, expected, ROW_KEYS).select("wrong").collect() for name in r.wrong}
    kinds = {"rolling_mean_3", "rolling_std_5", "category_rolling_mean", "category_rolling_n_observations", "rolling_aces_rate",
             "rolling_percentage", "rest_days", "head_to_head_average", "head_to_head_matches", "head_to_head_win_rate",
             "opponent_conceded_rate", "career_to_date_mean", "history_observations", "has_sufficient_history"}
    assert kinds <= leaking
    moved = built.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0)) + 1 for c in CONFIG.feature_columns if c != "surface"})
    moved = moved.withColumn("surface", F.lit("other"))
    named = {name for r in disagreements(moved, expected, ROW_KEYS).select("wrong").collect() for name in r.wrong}
    assert named == set(CONFIG.feature_columns)
    missing = disagreements(built.where("stat_target = 'aces'"), expected, ROW_KEYS).where("array_contains(wrong, 'missing')")
    assert missing.count() == matches.count()


def test_recheck_of_no_rows_is_empty(matches):
    assert recompute_features(matches.limit(0), matches, CONFIG).count() == 0
