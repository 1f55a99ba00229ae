import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.plans import boost, quantile, walkforward
from antecede.plans.boost import BoostSettings, cell_quantile, split_of
from antecede.plans.report import importance_summary, rank_importance

SCHEMA = ("player_id string, match_id int, event_date date, target_value double, signal double, nullable double, noise double, cat string, "
          "is_training_eligible boolean, has_sufficient_history boolean")
SMALL = dict(numeric=["signal", "nullable", "noise"], categorical=["cat"], rounds=60, patience=8, learning_rate=0.2, depth=3, minimum_rows_per_leaf=10)


def panel(spark, n=1500, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        signal, cat = float(i % 10), rng.choice(["x", "y", "z", None])
        y = 10 + 5 * signal + (8 if cat == "y" else 0) + (20 if i % 3 == 0 else 0) + rng.gauss(0, 1 + signal / 3)
        rows.append((f"p{i % 7}", i, dt.date(2024, 1, 1) + dt.timedelta(days=i // 5), y, signal, 1.0 if i % 3 == 0 else rng.choice([None, float("nan")]),
                     rng.random(), cat, True, True))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def settings():
    return quantile.QuantileSettings("t", "gbm_v1_t", **SMALL)


@pytest.fixture(scope="module")
def fitted(spark, settings):
    return quantile.fit(panel(spark), settings)


def test_answers_keep_their_contract(spark, fitted):
    new = panel(spark, 2000, seed=9)
    out = quantile.predict(fitted, new).collect()
    assert len(out) == 2000 and all(0 <= r.lowerci <= r.prediction <= r.upperci for r in out)
    for level, column in ((0.1, "lowerci"), (0.5, "prediction"), (0.9, "upperci")):
        below = np.mean([r.target_value <= r[column] for r in out])
        assert abs(below - level) < 0.04, (column, below)
    assert np.mean([abs(r.prediction - r.target_value) for r in out]) < 3.5


def test_odd_rows_are_answered(spark, fitted):
    rows = [("p", 1, None, None, None, None, None, None, None, None), ("p", 1, None, None, float("inf"), -1e300, float("nan"), "unseen", None, None)]
    out = quantile.predict(fitted, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 2 and all(0 <= r.lowerci <= r.prediction <= r.upperci for r in out)
    assert quantile.predict(fitted, spark.createDataFrame([], SCHEMA)).count() == 0


def test_importance_counts_the_splits_of_the_trees(spark, fitted):
    rows = quantile.importance_rows(fitted, spark).collect()
    want, gain = Counter(), Counter()
    for b in fitted.ensemble.boosters:
        for tree in b.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    want[b.quantile, int(f)] += 1
                    gain[b.quantile, int(f)] += g
    assert {(r["quantile"], r.feature_index): r.importance_split for r in rows} == {(q, f): want[q, f] for q in (0.1, 0.5, 0.9) for f in range(4)}
    assert all(r.importance_gain == pytest.approx(gain[r["quantile"], r.feature_index]) for r in rows)
    ranked = rank_importance(quantile.importance_rows(fitted, spark)).where("importance_rank = 1").collect()
    assert [r.feature_name for r in ranked] == ["signal"] * 3 and len({r.importance_gain for r in ranked}) == 3
    top = importance_summary(quantile.importance_rows(fitted, spark), 2).collect()
    assert len(top) == 2 and top[0].feature_name == "signal" and top[0].mean_split > 0


def test_stops_at_the_least_held_loss(fitted):
    for b in fitted.ensemble.boosters:
        assert len(b.trees) == 1 + int(np.argmin(b.losses[1:])) and min(b.losses) < b.losses[0]
        assert len(b.losses) - 1 <= len(b.trees) + SMALL["patience"]


def test_folds_equal_fits_of_their_own(spark, settings):
    df = panel(spark, 700)
    folds = [walkforward.Fold(1, dt.date(2024, 2, 1), dt.date(2024, 4, 1)), walkforward.Fold(2, dt.date(2024, 4, 1), dt.date(2024, 5, 20)),
             walkforward.Fold(3, dt.date(2030, 1, 1), dt.date(2030, 2, 1))]
    few = quantile.QuantileSettings("t", "gbm_v1_t", **SMALL | {"rounds": 4})
    together = quantile.fit_folds(df, folds, few)
    assert {b.model for b in together.ensemble.boosters} == {0, 1, 2}  # no rows to score in the third
    out = {(r.match_id, r.fold_number): r for r in quantile.predict_folds(together, df).collect()}
    due = walkforward.test_rows(df, folds).count()
    assert len(out) == due and {k for _, k in out} == {1, 2}
    for fold in folds[:2]:
        alone = quantile.fit_sets({fold.number: df.where(F.col("event_date") < F.lit(fold.cutoff))}, few)
        assert [b.start for b in alone.ensemble.boosters] == [b.start for b in together.ensemble.of(fold.number)]
        for r in quantile.predict(alone, walkforward.test_rows(df, [fold]).drop("fold_number"), fold.number).collect():
            assert out[r.match_id, fold.number].prediction == pytest.approx(r.prediction)


def test_scores_written_down_change_nothing(spark, settings, monkeypatch):
    df = panel(spark, 400)
    few = quantile.QuantileSettings("t", "m", **SMALL | {"rounds": 5})
    want = [r.prediction for r in quantile.predict(quantile.fit(df, few), df).orderBy("match_id").collect()]
    monkeypatch.setattr(boost, "KEEP_SCORES", 2)
    assert [r.prediction for r in quantile.predict(quantile.fit(df.repartition(5), few), df).orderBy("match_id").collect()] == pytest.approx(want)


def test_permuted_targets_make_it_worse(spark, settings):
    df = panel(spark, 900)
    fold = walkforward.Fold(1, dt.date(2024, 5, 1), dt.date(2024, 7, 1))
    got = {r.training_target: r for r in quantile.sabotage(df, fold, quantile.QuantileSettings("t", "m", **SMALL | {"rounds": 15}), ["match_id"]).collect()}
    assert got["ordinary"].rows == got["shuffled"].rows > 0 and got["ordinary"].mae < 0.6 * got["shuffled"].mae


def test_two_dates_are_needed(spark, settings):
    with pytest.raises(ValueError):
        quantile.fit(panel(spark, 3), settings)
    assert quantile.tail_start([dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5, 6)], 0.2) == dt.date(2024, 1, 5)


def test_cell_quantile_against_sorted_values():
    rng = np.random.default_rng(1)
    values = np.sort(rng.choice(10_000, 300, replace=False).astype(float))
    cells = boost._no_cells()
    for k, v in zip(sorted(rng.choice(boost.CELLS, 300, replace=False)), values):
        cells[:, k] = 1, v, v
    for q in (0, 0.1, 0.5, 0.9, 1):
        assert cell_quantile(cells, q) == pytest.approx(np.quantile(values, q))
    one = boost._no_cells()
    one[:, 3] = 5, 2.0, 6.0
    assert cell_quantile(one, 0.5) == 4.0


@pytest.mark.parametrize("categorical", [False, True])
def test_best_split_against_all_splits(categorical):
    rng = np.random.default_rng(5)
    s = BoostSettings(["a"], leaf_rows=3)
    score = lambda g, n: max(abs(g) - s.l1, 0) ** 2 / (n + s.l2)
    for _ in range(50):
        n = rng.integers(0, 6, 6).astype(float)
        g = rng.normal(0, 1, 6) * n
        if categorical:
            masks = [m for m in range(64)]
        else:
            masks = [((1 << k + 1) - 2) | miss for k in range(1, 6) for miss in (0, 1)]
        best = 0
        for m in masks:
            left = np.array([m >> k & 1 for k in range(6)], bool)
            a, b = n[left].sum(), n[~left].sum()
            if min(a, b) >= 3:
                best = max(best, score(g[left].sum(), a) + score(g[~left].sum(), b) - score(g.sum(), n.sum()))
        found = split_of(g, n, categorical, s)
        if not categorical:
            assert (found[0] if found else 0) == pytest.approx(best, abs=1e-9)
        elif found:
            assert found[0] <= best + 1e-9
        if found:
            assert found[2] == n[found[1]].sum() and found[2] + found[3] == n.sum()


@pytest.mark.parametrize("depth", [3, 5])
def test_leaves_and_histograms_against_walked_rows(depth):
    """A pass reads a row's state, not the trees before it; a row's leaf comes from one look-up per feature."""
    rng = np.random.default_rng(3)
    tree = boost.Tree.empty(depth)
    for k in range(len(tree.feature)):
        if rng.random() < 0.8:
            tree.feature[k], tree.left[k] = rng.integers(0, 3), rng.random(6) < 0.5
    bins = rng.integers(0, 6, (3, 400)).astype(np.uint8)
    want = []
    for row in bins.T:
        at = 0
        for level in range(depth):
            k = (1 << level) - 1 + at
            at = 2 * at + int(tree.feature[k] >= 0 and not tree.left[k][row[tree.feature[k]]])
        want.append(at)
    assert tree.leaves(bins, depth).tolist() == want
    y, now, core = rng.normal(0, 1, 400), rng.normal(0, 1, (1, 400)), 300
    block = boost._block(0, core, bins, y, now)
    work = {(0, 0): boost.Work(0.1, tree, [0, 2])}
    got, = boost._histograms(work, 2, {0: [6, 6, 6]}, np.uint8)(iter([block]))
    node = tree.leaves(bins, 2)
    for place, sums in zip(got.column("place").to_pylist(), got.column("sums").to_pylist()):
        g, n = np.frombuffer(sums).reshape(2, 4, 6)
        for a in range(4):
            for b in range(6):
                mine = (node[:core] == a) & (bins[place, :core] == b)
                assert n[a, b] == mine.sum() and g[a, b] == pytest.approx(np.where(y[:core] >= now[0, :core], 0.1, -0.9)[mine].sum())
