"""Walk-forward folds: a calendar on the driver, equality lookups in the data."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from antecede.operators.ranks import global_rank
from antecede.operators.skew import lookup

PROVENANCE = ["fold_number", "fold_cutoff_date", "fold_test_end_date"]


@dataclass(frozen=True)
class Fold:
    number: int
    cutoff: dt.date
    test_end: dt.date


def add_months(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, min(day.day, last))


def fold_calendar(start: dt.date, end: dt.date, step_months: int = 1) -> list[Fold]:
    """Each cutoff is the previous window's end, so a month-end start drifts; the last window is cut."""
    if end <= start:
        raise ValueError("end must be after start")
    if step_months < 1:
        raise ValueError("step_months must be positive")
    folds: list[Fold] = []
    cutoff = start
    while cutoff < end:
        test_end = min(add_months(cutoff, step_months), end)
        folds.append(Fold(len(folds) + 1, cutoff, test_end))
        cutoff = test_end
    return folds


def calendar_frame(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    return spark.createDataFrame([(f.number, f.cutoff, f.test_end) for f in folds],
                                 "fold_number int, cutoff_date date, test_end_date date")


def fold_of(date: Column, folds: Sequence[Fold]) -> Column:
    """Number of the fold whose half-open test window holds the date, NULL outside all windows."""
    cutoffs = F.array(*[F.lit(f.cutoff) for f in folds])
    number = F.size(F.filter(cutoffs, lambda c: c <= date))
    return F.when((number > 0) & (date < F.lit(folds[-1].test_end)), number)


def first_training_fold(date: Column, folds: Sequence[Fold]) -> Column:
    """First fold whose cutoff lies after the date; NULL when no fold ever trains on it."""
    cutoffs = F.array(*[F.lit(f.cutoff) for f in folds])
    number = F.size(F.filter(cutoffs, lambda c: c <= date)) + 1
    return F.when(number <= len(folds), number)


def with_fold(df: DataFrame, folds: Sequence[Fold], date: str = "event_date") -> DataFrame:
    number = fold_of(F.col(date), folds)
    cut = F.array(*[F.lit(f.cutoff) for f in folds])
    end = F.array(*[F.lit(f.test_end) for f in folds])
    tagged = df.withColumn("fold_number", number)
    return tagged.withColumns({
        "cutoff_date": F.get(cut, F.col("fold_number") - 1), "test_end_date": F.get(end, F.col("fold_number") - 1)})


def test_rows(df: DataFrame, folds: Sequence[Fold], date: str = "event_date") -> DataFrame:
    """Rows scored by some fold: inside a window, enough history, known outcome. Completion is not required."""
    scored = df.where(F.coalesce("has_sufficient_history", F.lit(False)) & F.col("target_value").isNotNull())
    return with_fold(scored, folds, date).where(F.col("fold_number").isNotNull())


def training_rows(df: DataFrame, folds: Sequence[Fold], date: str = "event_date") -> DataFrame:
    """Rows any fold may train on, tagged with the first fold that sees them."""
    usable = df.where(F.coalesce("is_training_eligible", F.lit(False)))
    tagged = usable.withColumn("first_fold", first_training_fold(F.col(date), folds))
    return tagged.where(F.col("first_fold").isNotNull())


def fold_sizes(df: DataFrame, folds: Sequence[Fold], date: str = "event_date") -> DataFrame:
    """Training and test rows per fold; training is a running total, so the data is read once."""
    from pyspark.sql import Window as W

    train = training_rows(df, folds, date).groupBy("first_fold").agg(F.count(F.lit(1)).alias("n"))
    test = test_rows(df, folds, date).groupBy("fold_number").agg(F.count(F.lit(1)).alias("test_rows"))
    cal = calendar_frame(df.sparkSession, folds)
    both = lookup(cal, train, {"fold_number": "first_fold"}, ["n"])
    both = lookup(both, test, ["fold_number"], ["test_rows"])
    run = W.orderBy("fold_number").rowsBetween(W.unboundedPreceding, 0)  # one row per fold
    return both.select("fold_number", "cutoff_date", "test_end_date",
                       F.coalesce(F.sum("n").over(run), F.lit(0)).alias("training_rows"),
                       F.coalesce("test_rows", F.lit(0)).alias("test_rows"))


def time_tail_split(training: DataFrame, fraction: float = 0.2, date: str = "event_date") -> tuple[DataFrame, DataFrame]:
    """Core and validation rows: validation is the last ceil(fraction x dates) distinct dates.

    Distinct dates are bounded by the calendar; only their threshold reaches the driver.
    """
    import math

    dates = training.select(date).where(F.col(date).isNotNull()).distinct()
    total = dates.count()
    if total < 2:
        raise ValueError("a time-tail split needs at least two dates")
    held = min(max(1, math.ceil(total * fraction)), total - 1)
    start = dates.orderBy(F.col(date).desc()).limit(held).agg(F.min(date).alias("d")).first().d
    return training.where(F.col(date) < F.lit(start)), training.where(F.col(date) >= F.lit(start))


def run_version(prefix: str, target: str, run_timestamp: dt.datetime) -> str:
    """Run-specific version name that no live version can equal."""
    stamp = run_timestamp.astimezone(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    return f"{prefix}_{target}_backtest_{stamp}"


def oof_frame(scored: DataFrame, *, sport: str, target: str, prefix: str, run_timestamp: dt.datetime) -> DataFrame:
    """Out-of-fold predictions ready to store: the stored cutoff is the last training day."""
    return scored.select(
        "player_id", "match_id", F.lit(sport).alias("sport"), F.lit(target).alias("prop_type"), "prediction",
        "lowerci", "upperci", F.lit(run_version(prefix, target, run_timestamp)).alias("modelversion"),
        F.lit(run_timestamp).alias("predictiontimestamp"), "fold_number",
        F.date_sub("cutoff_date", 1).alias("fold_cutoff_date"), F.col("test_end_date").alias("fold_test_end_date"))


Fitter = Callable[[DataFrame, DataFrame], DataFrame]


def run_fitter(df: DataFrame, folds: Sequence[Fold], fitter: Fitter, date: str = "event_date",
               observe: Callable[[Fold, DataFrame], None] | None = None) -> DataFrame | None:
    """Pluggable model, one fit per fold: for models whose training is not a running total."""
    out: DataFrame | None = None
    for fold in folds:
        train = df.where(F.coalesce("is_training_eligible", F.lit(False)) & (F.col(date) < F.lit(fold.cutoff)))
        test = test_rows(df, [fold], date)
        if train.isEmpty() or test.isEmpty():
            continue
        predicted = fitter(train, test).withColumns({
            "fold_number": F.lit(fold.number), "cutoff_date": F.lit(fold.cutoff),
            "test_end_date": F.lit(fold.test_end)})
        if observe is not None:
            observe(fold, predicted)
        out = predicted if out is None else out.unionByName(predicted)
    return out


def shuffle_targets(training: DataFrame, keys: Sequence[str], target: str = "target_value",
                    seed: int = 20250917) -> DataFrame:
    """Permute the target over rows: row i of the key order gets the target ranked i by a seeded hash."""
    base = training.withColumn("__h", F.xxhash64(*keys, F.lit(seed)))
    rows = global_rank(base.drop(target, "__h"), [], keys, "__i")
    values = global_rank(base.select("__h", *keys, F.col(target).alias("__t")), [], ["__h", *keys], "__j")
    return lookup(rows, values, {"__i": "__j"}, {target: "__t"}).drop("__i")


def first_large_fold(sizes: DataFrame, minimum_training_rows: int = 5000) -> int | None:
    """First fold with enough training rows and a test row; ``sizes`` has one row per fold."""
    enough = (F.col("training_rows") >= minimum_training_rows) & (F.col("test_rows") > 0)
    return sizes.where(enough).agg(F.min("fold_number").alias("n")).first().n


def sabotage(df: DataFrame, fold: Fold, predict: Fitter, keys: Sequence[str], date: str = "event_date") -> DataFrame:
    """Error of one fold with the real and with permuted training targets; a sound model gets worse."""
    train = df.where(F.coalesce("is_training_eligible", F.lit(False)) & (F.col(date) < F.lit(fold.cutoff)))
    test = test_rows(df, [fold], date).drop("fold_number", "cutoff_date", "test_end_date")

    def error(training: DataFrame, name: str) -> DataFrame:
        gap = F.abs(F.col("prediction") - F.col("target_value"))
        return predict(training, test).agg(F.lit(name).alias("training_target"), F.count(F.lit(1)).alias("rows"),
                                           F.avg(gap).alias("mae"))

    return error(train, "ordinary").unionByName(error(shuffle_targets(train, keys), "shuffled"))
