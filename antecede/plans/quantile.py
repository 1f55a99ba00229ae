"""Quantile model: one boosted model per quantile and per training set (all rows, every fold), fitted side by side."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from antecede.plans import boost, walkforward
from antecede.plans.walkforward import Fold

#: Number of the model that is fitted to all rows; folds carry their own numbers.
LIVE = 0


@dataclass(frozen=True)
class QuantileSettings:
    """``rounds`` trees at most, fewer where the held rows' loss stops falling for ``patience`` trees."""

    target: str
    modelversion: str
    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    quantiles: Sequence[float] = (0.1, 0.5, 0.9)
    validation_fraction: float = 0.2
    rounds: int = 600
    patience: int = 30
    learning_rate: float = 0.03
    depth: int = 4
    minimum_rows_per_leaf: int = 50
    bins: int = 255
    seed: int = 20250917

    def __post_init__(self) -> None:
        if len(self.quantiles) < 2 or sorted(self.quantiles) != list(self.quantiles):
            raise ValueError("quantiles must be two or more, in ascending order")

    @property
    def boosting(self) -> boost.BoostSettings:
        return boost.BoostSettings(
            numeric=self.numeric, categorical=self.categorical, quantiles=self.quantiles, rounds=self.rounds, patience=self.patience,
            learning_rate=self.learning_rate, depth=self.depth, leaf_rows=self.minimum_rows_per_leaf, bins=self.bins, seed=self.seed)


@dataclass
class QuantileFit:
    settings: QuantileSettings
    ensemble: boost.Ensemble
    folds: Sequence[Fold] = ()


def tail_start(dates: Sequence[dt.date], fraction: float) -> dt.date | None:
    """First of the last ceil(fraction x dates) dates; None where fewer than two dates leave no tail."""
    if len(dates) < 2:
        return None
    held = min(max(1, math.ceil(len(dates) * fraction)), len(dates) - 1)
    return sorted(dates)[-held]


def _dates(rows: DataFrame, date: str) -> list[dt.date]:
    """Distinct dates, as many as the calendar has."""
    return sorted(r[0] for r in rows.where(F.col(date).isNotNull()).select(date).distinct().collect())


def _needed(settings: QuantileSettings, date: str) -> list[str]:
    return [date, "target_value", *settings.numeric, *settings.categorical]


def fit_sets(sets: Mapping[int, DataFrame], settings: QuantileSettings, date: str = "event_date") -> QuantileFit:
    """One model per training set, all grown in the same passes. The last dates of each set are held back for early stopping."""
    parts = []
    for number, rows in sets.items():
        rows = rows.where(F.col("target_value").isNotNull())
        start = tail_start(_dates(rows, date), settings.validation_fraction)
        if start is None:
            raise ValueError("a quantile model needs at least two training dates")
        parts.append(rows.where(F.col(date).isNotNull()).select(
            F.lit(number).alias("model"), (F.col(date) >= F.lit(start)).alias("held"), *_needed(settings, date)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return QuantileFit(settings, boost.fit(rows, settings.boosting))


def fit(training: DataFrame, settings: QuantileSettings, date: str = "event_date") -> QuantileFit:
    return fit_sets({LIVE: training}, settings, date)


def fit_folds(df: DataFrame, folds: Sequence[Fold], settings: QuantileSettings, date: str = "event_date", live: bool = True) -> QuantileFit:
    """A model for every fold that has test rows and two training dates, and with ``live`` one for all eligible rows.

    The rows are read once: a row stands in the training set of every fold whose cutoff lies after it.
    """
    usable = df.where(F.coalesce("is_training_eligible", F.lit(False)) & F.col("target_value").isNotNull() & F.col(date).isNotNull())
    dates = _dates(usable, date)
    scored = {r[0] for r in walkforward.test_rows(df, folds, date).select("fold_number").distinct().collect()}  # one row per fold
    starts = {f.number: tail_start([d for d in dates if d < f.cutoff], settings.validation_fraction) for f in folds if f.number in scored}
    if live:
        starts[LIVE] = tail_start(dates, settings.validation_fraction)
    starts = {k: v for k, v in starts.items() if v is not None}
    if not starts:
        raise ValueError("a quantile model needs at least two training dates")
    ends = {f.number: f.cutoff for f in folds} | {LIVE: dt.date.max}
    sets = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(v).alias("start"), F.lit(ends[k]).alias("end")) for k, v in sorted(starts.items())])
    rows = usable.select(*_needed(settings, date), F.explode(F.filter(sets, lambda s: F.col(date) < s["end"])).alias("set"))
    rows = rows.select(F.col("set.model").alias("model"), (F.col(date) >= F.col("set.start")).alias("held"), *_needed(settings, date))
    return QuantileFit(settings, boost.fit(rows, settings.boosting), folds)


def _answers(fitted: QuantileFit, rows: DataFrame, model: str, kept: Sequence[str]) -> DataFrame:
    """Sorted, nonnegative quantiles: the middle one is the prediction, the ends are the bounds."""
    n = len(fitted.settings.quantiles)
    v = F.transform("quantile_values", lambda x: F.greatest(x, F.lit(0.0)))
    return boost.predict(fitted.ensemble, rows, model).withColumn("quantile_values", v).select(
        *kept, F.col("quantile_values")[n // 2].alias("prediction"), F.col("quantile_values")[0].alias("lowerci"),
        F.col("quantile_values")[n - 1].alias("upperci"), F.lit(fitted.settings.modelversion).alias("modelversion"))


def predict(fitted: QuantileFit, rows: DataFrame, model: int = LIVE) -> DataFrame:
    return _answers(fitted, rows.withColumn("__number", F.lit(model)), "__number", rows.columns)


def predict_folds(fitted: QuantileFit, df: DataFrame, date: str = "event_date") -> DataFrame:
    """Out-of-fold predictions: every fold's test rows by that fold's models."""
    test = walkforward.test_rows(df, fitted.folds, date)
    return _answers(fitted, test, "fold_number", test.columns)


def nodes(fitted: QuantileFit, spark) -> DataFrame:
    return boost.node_table(spark, fitted.ensemble)


def importance_rows(fitted: QuantileFit, spark, model: int = LIVE) -> DataFrame:
    """Gain and number of splits per quantile and feature, each quantile from its own trees; features never split on have zeros."""
    s = fitted.settings
    splits = nodes(fitted, spark).where(F.col("model") == model)
    each = F.struct("quantile", "feature_index")
    found = splits.groupBy(each.alias("k")).agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
    base = spark.createDataFrame([((float(q), i), s.modelversion, float(q), i, name) for q in s.quantiles for i, name in enumerate(s.boosting.features)],
                                 "k struct<quantile: double, feature_index: int>, modelversion string, quantile double, feature_index int, feature_name string")
    return base.join(found, "k", "left").select("modelversion", "quantile", "feature_index", "feature_name",
                                                F.coalesce("gain", F.lit(0.0)).alias("importance_gain"),
                                                F.coalesce("splits", F.lit(0)).cast("double").alias("importance_split"))


def sabotage(df: DataFrame, fold: Fold, settings: QuantileSettings, keys: Sequence[str], date: str = "event_date") -> DataFrame:
    """Error of one fold with the real and with permuted training targets, both fitted in the same passes."""
    names = {0: "ordinary", 1: "shuffled"}
    train = df.where(F.coalesce("is_training_eligible", F.lit(False)) & (F.col(date) < F.lit(fold.cutoff)))
    needed = [*keys, *_needed(settings, date)]
    shuffled = walkforward.shuffle_targets(train.select(*dict.fromkeys(needed)), keys)
    fitted = fit_sets({0: train, 1: shuffled}, settings, date)
    test = walkforward.test_rows(df, [fold], date)
    both = test.withColumn("model", F.explode(F.array(*map(F.lit, names))))
    gap = F.abs(F.col("prediction") - F.col("target_value"))
    answers = _answers(fitted, both, "model", ["model", "target_value"])
    label: Column = F.when(F.col("model") == 0, names[0]).otherwise(names[1])
    return answers.groupBy(label.alias("training_target")).agg(F.count(F.lit(1)).alias("rows"), F.avg(gap).alias("mae"))
