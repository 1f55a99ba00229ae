import datetime as dt
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.operators import quality
from antecede.plans import baseline, ensemble, scoring, walkforward as wf

D = dt.date


def test_calendar_chains_and_drifts():
    folds = wf.fold_calendar(D(2024, 1, 31), D(2024, 4, 10), 1)
    assert [(f.cutoff, f.test_end) for f in folds] == [
        (D(2024, 1, 31), D(2024, 2, 29)), (D(2024, 2, 29), D(2024, 3, 29)), (D(2024, 3, 29), D(2024, 4, 10))]
    with pytest.raises(ValueError):
        wf.fold_calendar(D(2024, 1, 1), D(2024, 1, 1))
    with pytest.raises(ValueError):
        wf.fold_calendar(D(2024, 1, 1), D(2024, 2, 1), 0)


SCHEMA = ("player_id string, match_id int, event_date date, target_value double, has_sufficient_history boolean, "
          "is_training_eligible boolean, base double, std double, surface string, level string")


def panel(spark, rows=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        surface = rng.choice(["clay", "hard", "grass", None])
        out.append((f"p{i % 9}", i, D(2024, 1, 1) + dt.timedelta(days=rng.randrange(180)), rng.choice([None, rng.uniform(1, 9)]) if i % 13 == 0
                    else rng.uniform(1, 9), rng.random() < 0.9, rng.random() < 0.7, rng.uniform(1, 9), rng.choice([None, 2.0]),
                    surface, rng.choice(["A", "rare"]) if i % 40 == 0 else "A"))
    out = [r[:5] + (r[5] and r[3] is not None,) + r[6:] for r in out]
    return out, spark.createDataFrame(out, SCHEMA)


SET = baseline.BaselineSettings("t", "baseline_v1_t", "base", "std", ["surface", "level"], minimum_group_size=12)


def naive(rows, cutoff, end):
    train = [r for r in rows if r[5] and r[2] < cutoff]
    if not train:
        return {}
    overall = np.mean([r[3] for r in train])
    out = {}
    for r in rows:
        if not (r[4] and r[3] is not None and cutoff <= r[2] < end):
            continue
        mult = 1.0
        for c in (8, 9):
            group = [t[3] for t in train if t[c] == r[c] and t[c] is not None]
            if r[c] is not None and len(group) >= 12:
                mult *= np.mean(group) / overall
        out[r[1]] = r[6] * mult
    return out


def test_all_folds_in_one_pass_equal_refitting_each(spark):
    rows, df = panel(spark)
    folds = wf.fold_calendar(D(2024, 1, 1), D(2024, 6, 1), 1)
    got = {(r.fold_number, r.match_id): r for r in baseline.fold_predictions(df, folds, SET).collect()}
    want = {(f.number, m): p for f in folds for m, p in naive(rows, f.cutoff, f.test_end).items()}
    assert set(got) == set(want)
    for key, p in want.items():
        assert got[key].prediction == pytest.approx(p, rel=1e-12)
        if got[key].std is None:
            assert got[key].lowerci is None and got[key].upperci is None
        else:
            assert got[key].lowerci == pytest.approx(max(p - 2.0, 0)) and got[key].upperci == pytest.approx(p + 2.0)
    seen = []
    again = wf.run_fitter(df, folds, baseline.fitter(SET), observe=lambda f, _: seen.append(f.number))
    assert {(r.fold_number, r.match_id): round(r.prediction, 9) for r in again.collect()} == {
        k: round(v, 9) for k, v in want.items()}
    assert seen == sorted({k[0] for k in want})


def test_fold_sizes_and_guards(spark):
    rows, df = panel(spark)
    folds = wf.fold_calendar(D(2024, 2, 1), D(2024, 5, 1), 1)
    for r in wf.fold_sizes(df, folds).collect():
        assert r.training_rows == sum(1 for x in rows if x[5] and x[2] < r.cutoff_date)
        assert r.test_rows == sum(1 for x in rows if x[4] and x[3] is not None and r.cutoff_date <= x[2] < r.test_end_date)
    quality.assert_cutoff(df.where("event_date < '2024-02-01'"), "event_date", D(2024, 2, 1))
    with pytest.raises(quality.AuditFailure):
        quality.assert_cutoff(df, "event_date", D(2024, 2, 1))


def test_sabotage_and_large_fold(spark):
    _, df = panel(spark)
    df = df.withColumn("surface", F.when(F.col("target_value") > 5, "clay").otherwise("hard")).withColumn("base", F.lit(5.0))
    folds = wf.fold_calendar(D(2024, 2, 1), D(2024, 6, 1), 1)
    assert wf.first_large_fold(wf.fold_sizes(df, folds), 100) == min(
        r.fold_number for r in wf.fold_sizes(df, folds).collect() if r.training_rows >= 100)
    assert wf.first_large_fold(wf.fold_sizes(df, folds), 10**6) is None
    got = {r.training_target: r.mae for r in wf.sabotage(df, folds[-1], baseline.fitter(SET), ["match_id"]).collect()}
    assert got["shuffled"] > 1.2 * got["ordinary"]


def test_no_training_rows_is_an_error(spark):
    _, df = panel(spark, 20)
    with pytest.raises(Exception, match="must be positive"):
        baseline.predict(df.withColumn("is_training_eligible", F.lit(False)), SET).collect()


def test_time_tail(spark):
    _, df = panel(spark)
    core, held = wf.time_tail_split(df, 0.2)
    dates = sorted({r.event_date for r in df.select("event_date").collect()})
    start = dates[-int(np.ceil(len(dates) * 0.2))]
    assert held.agg(F.min("event_date")).first()[0] == start and core.where(F.col("event_date") >= F.lit(start)).isEmpty()
    with pytest.raises(ValueError):
        wf.time_tail_split(df.where("match_id = 1"), 0.2)


def test_shuffle_keeps_the_multiset(spark):
    rows, df = panel(spark)
    out = wf.shuffle_targets(df, ["match_id"]).select("match_id", "target_value").collect()
    key = lambda v: (v is None, v or 0)
    assert sorted((r.target_value for r in out), key=key) == sorted((r[3] for r in rows), key=key)
    assert sum(r.target_value == rows[r.match_id][3] for r in out) < len(rows) / 4


def scored(spark, rows):
    return spark.createDataFrame([(f"p{i}", i, *r) for i, r in enumerate(rows)],
                                 "player_id string, match_id int, prediction double, lowerci double, upperci double, target_value double")


def test_repair_and_scores(spark):
    df = scored(spark, [(3.0, 5.0, 1.0, 2.0), (-1.0, -2.0, 4.0, 0.0), (2.0, 1.0, None, 5.0), (2.0, 1.0, 3.0, 3.0)])
    r = {x.match_id: x for x in scoring.repair_intervals(df).collect()}
    assert (r[0].lowerci, r[0].prediction, r[0].upperci, r[0].was_crossing) == (1.0, 3.0, 5.0, True)
    assert (r[1].lowerci, r[1].prediction, r[1].upperci, r[1].was_crossing) == (0.0, 0.0, 4.0, False)
    assert (r[2].was_repaired, r[3].was_repaired) == (False, False)
    s = scoring.score(df.withColumn("m", F.lit("x")).withColumn("fold_number", F.lit(1)), by=["m"]).collect()
    assert {x.fold_number for x in s} == {0, 1}
    for x in s:
        assert (x.row_count, x.interval_rows, x.interval_crossing_count, x.interval_repair_count) == (4, 3, 1, 2)
        assert x.mae == pytest.approx((1 + 0 + 3 + 1) / 4) and x.interval_coverage == 1.0
        assert x.rmse == pytest.approx(np.sqrt(11 / 4)) and x.mean_bias == pytest.approx(-3 / 4)


def test_improvement_corner_cases(spark):
    rows = [("t", 1, "baseline", 0.0), ("t", 1, "gbm", 0.0), ("t", 2, "baseline", 0.0), ("t", 2, "gbm", 1.0), ("t", 3, "baseline", 4.0),
            ("t", 3, "gbm", 3.0)]
    df = spark.createDataFrame(rows, "stat_target string, fold_number int, model_family string, mae double")
    got = {r.fold_number: r.mae_improvement_over_baseline for r in scoring.with_improvement(df).where("model_family = 'gbm'").collect()}
    assert got == {1: 0.0, 2: None, 3: 25.0}


def test_tied_predictions_fill_bins(spark):
    df = scored(spark, [(1.0, 0.0, 2.0, 1.0), (1.0, 0.0, 2.0, 9.0), (2.0, 0.0, 3.0, 2.0), (3.0, 0.0, 4.0, 9.0)])
    out = sorted(scoring.calibration_bins(df.withColumn("g", F.lit(1)), by=["g"], bins=2).collect(), key=lambda r: r.bin_number)
    assert [(r.row_count, r.coverage) for r in out] == [(2, 0.5), (2, 0.5)]


def test_bias_tie_is_positive(spark):
    df = spark.createDataFrame([("t", "m", 1, 1.0), ("t", "m", 2, -1.0), ("t", "m", 0, -5.0), ("t", "z", 1, 0.0)],
                               "stat_target string, modelversion string, fold_number int, mean_bias double")
    got = {r.modelversion: (r.positive_folds, r.negative_folds, r.dominant_sign, r.flagged) for r in scoring.bias_signs(df).collect()}
    assert got == {"m": (1, 1, "positive", False), "z": (0, 0, "unavailable", False)}


# --- ensemble ----------------------------------------------------------------------------------------

def members(spark, rows):
    return spark.createDataFrame(rows, "player_id string, match_id int, member string, prediction double, lowerci double, upperci double")


def test_combine_policies(spark):
    df = members(spark, [("a", 1, "x", 2.0, 1.0, 3.0), ("a", 1, "y", 4.0, None, 5.0), ("a", 2, "x", 6.0, 7.0, 5.0),
                         ("a", 3, "x", None, None, None), ("a", 3, "y", None, 1.0, 2.0)])
    got = {r.match_id: r for r in ensemble.combine(df, {"x": 3.0, "y": 1.0}, 2).collect()}
    assert (got[1].prediction, got[1].lowerci, got[1].upperci, got[1].status) == (2.5, 1.0, 3.5, "complete")
    assert (got[2].prediction, got[2].lowerci, got[2].upperci, got[2].status) == (6.0, 6.0, 6.0, "renormalized")
    assert (got[3].prediction, got[3].status) == (None, "skipped")
    none = {r.match_id: r.status for r in ensemble.combine(df, {"x": 1, "y": 1}, 2, policy=ensemble.EMIT_NONE).collect()}
    assert none == {1: "complete", 2: "skipped", 3: "skipped"}
    alone = {r.match_id: r for r in ensemble.combine(df, {"x": 1.0, "y": 0.0}, 2).collect()}
    assert (alone[1].prediction, alone[1].lowerci, alone[1].upperci) == (2.0, 1.0, 3.0)
    with pytest.raises(ValueError):
        ensemble.combine(df, {"x": 0.0, "y": 0.0}, 2)
    with pytest.raises(quality.AuditFailure):
        ensemble.require_unique_members(df.unionByName(df))


def oof(spark, n=600, k=2, seed=4):
    rng = np.random.default_rng(seed)
    y = rng.uniform(0, 20, n)
    p = [y + rng.normal(0.5 * j, 1 + j, n) for j in range(k)]
    fold = rng.integers(1, 5, n)
    rows = [(int(f), float(t), *[float(c[i]) for c in p]) for i, (f, t) in enumerate(zip(fold, y))]
    return rows, spark.createDataFrame(rows, "fold_number int, y double, " + ", ".join(f"p{j} double" for j in range(k)))


def test_absolute_weights_are_optimal_and_use_earlier_folds_only(spark):
    rows, df = oof(spark)
    rows += [(1, 3.0, 5.0, 5.0)]
    df = df.unionByName(spark.createDataFrame(rows[-1:], df.schema))
    cal = spark.createDataFrame([(i,) for i in range(1, 6)], "fold_number int")
    got = {r.fold_number: (r.w0, r.w1) for r in ensemble.absolute_weights(df, cal, ["a", "b"], {"a": 0.3, "b": 0.7}).collect()}
    assert got[1] == (0.3, 0.7)
    for k in range(2, 6):
        past = np.array([r[1:] for r in rows if r[0] < k])
        loss = lambda w: np.abs(w * past[:, 1] + (1 - w) * past[:, 2] - past[:, 0]).sum()
        assert loss(got[k][0]) <= min(loss(w) for w in np.linspace(0, 1, 4001)) + 1e-9
        assert sum(got[k]) == pytest.approx(1.0)


def simplex(step, k):
    """All points with coordinates that are multiples of ``step``."""
    n = round(1 / step)
    if k == 1:
        return np.ones((1, 1))
    return np.array([(*(c / n for c in p), 1 - sum(p) / n) for p in product(range(n + 1), repeat=k - 1) if sum(p) <= n])


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_squared_weights_are_the_minimum(spark, k):
    rows, df = oof(spark, 120, k)
    cal = spark.createDataFrame([(i,) for i in range(1, 6)], "fold_number int")
    conf = {m: w / sum(range(1, k + 1)) for m, w in zip("abcd", range(1, k + 1))}
    got = {r.fold_number: np.array(r[1:]) for r in ensemble.squared_weights(df, cal, list(conf), conf).collect()}
    assert got[1] == pytest.approx(list(conf.values()))
    for fold in range(2, 6):
        past = np.array([r[1:] for r in rows if r[0] < fold])
        loss = lambda w: ((past[:, 1:] @ w - past[:, 0]) ** 2).sum()
        assert (got[fold] >= 0).all() and got[fold].sum() == pytest.approx(1)
        assert loss(got[fold]) <= min(loss(w) for w in simplex(0.02 if k < 4 else 0.05, k)) + 1e-9
    # more of the same rows change nothing
    often = df.crossJoin(spark.range(1000)).drop("id")
    again = {r.fold_number: np.array(r[1:]) for r in ensemble.squared_weights(often, cal, list(conf), conf).collect()}
    assert all(again[f] == pytest.approx(got[f], abs=1e-9) for f in got)


def test_equal_members_keep_the_configured_weights(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0, 2.0), (1, 5.0, 4.0, 4.0)], "fold_number int, y double, p0 double, p1 double")
    cal = spark.createDataFrame([(2,)], "fold_number int")
    row = ensemble.squared_weights(df, cal, ["a", "b"], {"a": 0.3, "b": 0.7}).first()
    assert (row.w0, row.w1) == (0.3, 0.7)


def test_grid_weights_of_three_members(spark):
    rows, df = oof(spark, 200, 3)
    cal = spark.createDataFrame([(1,), (5,)], "fold_number int")
    conf = {"a": 0.2, "b": 0.3, "c": 0.5}
    got = {r.fold_number: (r.w0, r.w1, r.w2) for r in ensemble._grid_weights(df, cal, list(conf), conf, 0.25).collect()}
    past = np.array([r[1:] for r in rows if r[0] < 5])
    points = [(i / 4, j / 4, (4 - i - j) / 4) for i in range(5) for j in range(5 - i)]
    loss = lambda w: np.abs(past[:, 1:] @ np.array(w) - past[:, 0]).sum()
    assert got[1] == (0.2, 0.3, 0.5) and loss(got[5]) == pytest.approx(min(map(loss, points)))


@pytest.mark.parametrize("k", [3, 4])
def test_cut_weights_reach_the_least_absolute_error(spark, k):
    rows, df = oof(spark, 300, k)
    cal = spark.createDataFrame([(1,), (3,), (5,)], "fold_number int")
    conf = {f"m{i}": 1 / k for i in range(k)}
    got = {r.fold_number: r for r in ensemble.cut_weights(df, cal, list(conf), conf).collect()}
    assert got[1].gap is None and [got[1][f"w{i}"] for i in range(k)] == [1 / k] * k
    rng = np.random.default_rng(0)
    for n in (3, 5):
        past = np.array([r[1:] for r in rows if r[0] < n])
        loss = lambda w: np.abs(past[:, 1:] @ w - past[:, 0]).mean()
        w = np.array([got[n][f"w{i}"] for i in range(k)])
        assert w.min() >= 0 and abs(w.sum() - 1) < 1e-9 and got[n].gap <= 1e-6 and got[n].loss == pytest.approx(loss(w))
        tries = rng.dirichlet(np.ones(k), 3000)
        close = np.abs(w + rng.normal(0, 1e-3, (3000, k)))
        assert loss(w) <= min(map(loss, [*tries, *(close / close.sum(axis=1, keepdims=True)), *np.eye(k)])) * (1 + 1e-6)
    same = df.select("fold_number", "y", *[F.col("p0").alias(f"p{i}") for i in range(k)])
    assert all(abs(r[f"w{i}"] - 1 / k) < 1e-12 for r in ensemble.cut_weights(same, cal, list(conf), conf).collect() for i in range(k))
    plain = ensemble.absolute_weights(df, cal, list(conf), conf)
    assert plain.columns == ["fold_number", *[f"w{i}" for i in range(k)]]


def test_lower_envelope_against_many_points():
    rng = np.random.default_rng(3)
    for _ in range(40):
        k = rng.integers(2, 5)
        cuts = rng.normal(0, 10, (rng.integers(1, 12), k))
        value, w = ensemble.lower_envelope(cuts)
        assert w.min() >= -1e-12 and abs(w.sum() - 1) < 1e-9 and value == pytest.approx((cuts @ w).max())
        assert value <= (cuts @ rng.dirichlet(np.ones(k), 4000).T).max(axis=0).min() + 1e-9
