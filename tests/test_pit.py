import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import Row, functions as F

from antecede.operators import pit


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def history(seed=7, rows=240):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        player = rng.choice(["a", "a", "a", "b", "c", None])
        out.append(dict(
            match_id=i, player=player, opponent=rng.choice(["x", "y"]), event_date=day(rng.randrange(25)),
            surface=rng.choice(["clay", "hard", None]),
            value=None if rng.random() < 0.15 else round(rng.uniform(0, 30), 2),
            completed=rng.choice([True, True, True, False, None]), won=rng.random() < 0.5))
    return out


def brute(rows, row, keys, value="value"):
    past = [r for r in rows if all(r[k] == row[k] for k in keys) and r["event_date"] < row["event_date"]
            and r["completed"] and r[value] is not None]
    past.sort(key=lambda r: (r["event_date"], r["match_id"]))
    return [float(r[value]) for r in past]


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


PRIORS = [
    pit.Prior(("player",), "value", {"m3": ("mean", 3), "s5": ("std", 5), "d4": ("median", 4),
                                     "all_mean": ("mean", None), "all_std": ("std", None),
                                     "all_median": ("median", None)},
              {"n5": 5, "n": None}),
    pit.Prior(("player", "surface"), "value", {"cat": ("mean", 4)}, {"cat_n": 4}),
]


@pytest.mark.parametrize("hot_rows", [10**6, 30, 1])
def test_strict_prior_matches_brute_force(spark, hot_rows):
    rows = history()
    df = spark.createDataFrame([Row(**r) for r in rows],
                               "match_id int, player string, opponent string, event_date date, surface string, "
                               "value double, completed boolean, won boolean")
    out = pit.strict_prior(df, PRIORS, anchor=["player"], date="event_date", order=["match_id"],
                           eligible="completed", rest={"rest": ("player",)}, hot_rows=hot_rows).collect()
    assert len(out) == len(rows)
    for r in out:
        own = brute(rows, r.asDict(), ["player"])
        cat = brute(rows, r.asDict(), ["player", "surface"])
        assert near(r.m3, statistics.mean(own[-3:]) if own else None)
        assert near(r.all_median, statistics.median(own) if own else None)
        assert near(r.s5, statistics.stdev(own[-5:]) if len(own) > 1 else None)
        assert near(r.d4, statistics.median(own[-4:]) if own else None)
        assert near(r.all_mean, statistics.mean(own) if own else None)
        assert near(r.all_std, statistics.stdev(own) if len(own) > 1 else None)
        assert (r.n5, r.n) == (min(5, len(own)), len(own))
        assert near(r["cat"], statistics.mean(cat[-4:]) if cat else None)
        assert r.cat_n == min(4, len(cat))
        dates = [x["event_date"] for x in rows if x["player"] == r.player and x["event_date"] < r.event_date]
        assert r.rest == ((r.event_date - max(dates)).days if dates else None)


def test_same_date_rows_do_not_see_each_other(spark):
    df = spark.createDataFrame([(1, "p", day(0), 5.0, True), (2, "p", day(0), 100.0, True), (3, "p", day(1), 7.0, True)],
                               "match_id int, player string, event_date date, value double, completed boolean")
    out = pit.rolling_by_category(df.withColumn("g", F.lit(1)), "player", "event_date", "value", "g", 5,
                                  order=["match_id"], eligible="completed")
    got = {r.match_id: (r.value if False else r["n_observations"]) for r in out.collect()}
    assert got == {1: 0, 2: 0, 3: 2}
    value = pit.rolling_stat(df, "player", "event_date", "value", 5, order=["match_id"], out="m").collect()
    assert {r.match_id: r.m for r in value} == {1: None, 2: None, 3: 52.5}


def test_null_date_and_bad_windows_are_errors(spark):
    df = spark.createDataFrame([("p", None, 5.0)], "player string, event_date date, value double")
    with pytest.raises(Exception, match="must not be NULL"):
        pit.rolling_stat(df, "player", "event_date", "value", 5, out="m").collect()
    with pytest.raises(ValueError):
        pit.Prior(("player",), "value", {"x": ("mean", 0)})
    with pytest.raises(ValueError):
        pit.Prior(("player",), "value", {"x": ("mode", 3)})


def test_head_to_head_and_opponent(spark):
    rows = [(1, "a", "b", day(0), 4.0, True, True), (1, "b", "a", day(0), 2.0, True, False),
            (2, "a", "b", day(1), 6.0, True, False), (2, "b", "a", day(1), 8.0, True, True),
            (3, "a", "b", day(2), 1.0, True, True), (3, "b", "a", day(2), 3.0, True, False)]
    df = spark.createDataFrame(rows, "match_id int, player string, opp string, event_date date, value double, "
                                     "completed boolean, won boolean")
    h = {(r.match_id, r.player): r for r in pit.head_to_head(
        df, "player", "opp", "event_date", "value", "won", eligible="completed").collect()}
    assert h[(3, "a")].head_to_head_average == 5.0
    assert h[(3, "a")].head_to_head_matches == 2 and h[(3, "a")].head_to_head_win_rate == 0.5
    o = {(r.match_id, r.player): r for r in pit.opponent_rolling(
        df, "match_id", "player", "opp", "event_date", "value", 1, order=["match_id"],
        eligible="completed", out="form").collect()}
    assert o[(3, "a")].form == 8.0 and o[(1, "a")].form is None and o[(1, "a")].n_observations == 0
    lone = df.where("not (match_id = 3 and player = 'b')")
    o = {(r.match_id, r.player): r for r in pit.opponent_rolling(
        lone, "match_id", "player", "opp", "event_date", "value", 1, eligible="completed", out="form").collect()}
    assert o[(3, "a")].form is None and o[(3, "a")].n_observations == 0


def test_window_tasks_hold_a_stated_number_of_rows(spark):
    df = spark.range(2000).selectExpr("id", "id % 400 AS p", "date_add(DATE'2024-01-01', CAST(id DIV 400 AS INT)) AS d", "CAST(id AS DOUBLE) AS v")
    prior = pit.Prior(("p",), "v", {"m": ("mean", 2)}, {"n": None})
    spark.conf.set("antecede.windowRows", "200")
    try:
        out = pit.strict_prior(df, [prior], anchor=["p"], date="d", order=["id"])
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(tasks) == 2000 and max(tasks) <= 400
        rows = {r.id: (r.m, r.n) for r in out.collect()}
    finally:
        spark.conf.unset("antecede.windowRows")
    assert rows == {i: (None if i < 400 else sum(past := list(range(i % 400, i, 400))[-2:]) / len(past), i // 400) for i in range(2000)}


def test_the_opponents_rows_are_not_broadcast(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 'b', 5), (1, 'b', 'a', 7), (2, 'a', 'c', 9) AS t(m, p, o, v)")
    out = pit.opponent_value(df, "m", "p", "o", {"theirs": "v"})
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.m, r.p): r.theirs for r in out.collect()} == {(1, "a"): 7, (1, "b"): 5, (2, "a"): None}
