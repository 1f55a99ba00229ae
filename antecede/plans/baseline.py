"""Context-ratio baseline: base value times training-only context multipliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from antecede.operators.skew import checked_broadcast, lookup
from antecede.plans.walkforward import Fold, test_rows, training_rows


@dataclass(frozen=True)
class BaselineSettings:
    target: str
    modelversion: str
    base_column: str
    std_column: str
    context_columns: Sequence[str]
    minimum_group_size: int = 30


def _training(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("is_training_eligible", F.lit(False)) & F.col("target_value").isNotNull())


def _by_context(df: DataFrame, contexts: Sequence[str]) -> DataFrame:
    """One row per row and context; values as text. NULL values carry no multiplier."""
    pairs = F.array(*[F.struct(F.lit(c).alias("context"), F.col(c).cast("string").alias("value")) for c in contexts])
    return df.withColumn("__c", F.explode(pairs)).where(F.col("__c.value").isNotNull())


def _checked(overall: Column) -> Column:
    problem = F.raise_error(F.lit("training target mean must be positive and there must be training rows"))
    return F.when(F.coalesce(overall, F.lit(0.0)) > 0, overall).otherwise(problem)


def _overall(df: DataFrame) -> DataFrame:
    """One row: the training mean, an error unless positive."""
    return F.broadcast(_training(df).agg(_checked(F.avg("target_value")).alias("__overall")))


def context_ratios(df: DataFrame, settings: BaselineSettings) -> DataFrame:
    """(context, value, rows, multiplier) for groups of at least the minimum size."""
    train = _training(df)
    groups = _by_context(train, settings.context_columns).groupBy(
        F.col("__c.context").alias("context"), F.col("__c.value").alias("value")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("target_value").alias("__mean"))
    found = groups.where(F.col("rows") >= settings.minimum_group_size).crossJoin(_overall(df))
    return found.select("context", "value", "rows", (F.col("__mean") / F.col("__overall")).alias("multiplier"))


def _multiplied(rows: DataFrame, ratios: DataFrame, contexts: Sequence[str], fold: str | None) -> DataFrame:
    """Left lookup per context with default 1.0: NULL, unseen and undersized values keep 1.0."""
    ratios = checked_broadcast(ratios)
    for c in contexts:
        side = ratios.where(F.col("context") == c)
        keys = {f"__v_{c}": "value", **({fold: fold} if fold else {})}
        rows = lookup(rows.withColumn(f"__v_{c}", F.col(c).cast("string")), side, keys, {f"__m_{c}": "multiplier"})
    adjust = reduce(lambda a, b: a * b, [F.coalesce(f"__m_{c}", F.lit(1.0)) for c in contexts], F.lit(1.0))
    rows = rows.withColumn("context_adjustment", adjust)
    return rows.drop(*[f"__v_{c}" for c in contexts], *[f"__m_{c}" for c in contexts])


def interval(prediction: Column, std: Column) -> tuple[Column, Column]:
    """One standard deviation each side, lower end at least zero; NULL without a deviation."""
    return F.when(std.isNotNull(), F.greatest(prediction - std, F.lit(0.0))), prediction + std


def _predicted(rows: DataFrame, settings: BaselineSettings) -> DataFrame:
    prediction = F.col(settings.base_column) * F.col("context_adjustment")
    lower, upper = interval(prediction, F.col(settings.std_column))
    return rows.where(F.col(settings.base_column).isNotNull()).withColumns({
        "prediction": prediction, "lowerci": lower, "upperci": upper,
        "modelversion": F.lit(settings.modelversion)})


def predict(df: DataFrame, settings: BaselineSettings) -> DataFrame:
    """Live predictions: ratios from all training rows, one row per row with history and a base value."""
    rows = df.where(F.coalesce("has_sufficient_history", F.lit(False)))
    rows = rows.crossJoin(_overall(df)).where("__overall IS NOT NULL").drop("__overall")  # the check must run
    rows = _multiplied(rows, context_ratios(df, settings), settings.context_columns, None)
    return _predicted(rows, settings)


def fitter(settings: BaselineSettings):
    """The baseline as a pluggable fold model: ratios from the training rows, predictions for the test rows."""
    def run(training: DataFrame, test: DataFrame) -> DataFrame:
        rows = test.select(*training.columns).withColumn("is_training_eligible", F.lit(False))
        both = training.withColumn("has_sufficient_history", F.lit(False)).unionByName(rows)
        return predict(both, settings)
    return run


def prediction_census(df: DataFrame, settings: BaselineSettings) -> DataFrame:
    trains = F.coalesce("is_training_eligible", F.lit(False))
    history = F.coalesce("has_sufficient_history", F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(trains).alias("training_rows"),
        F.count_if(~trains).alias("training_rows_excluded"), F.count_if(~history).alias("prediction_rows_excluded"),
        F.count_if(history & F.col(settings.base_column).isNull()).alias("missing_base_rows"))


_ALL = ""  # the pseudo context whose groups are all training rows


def fold_statistics(df: DataFrame, folds: Sequence[Fold], settings: BaselineSettings) -> DataFrame:
    """(first_fold, context, value, s, n): the one pass over the training rows, persisted.

    Its rows are at most (context values + 1) x folds.
    """
    train = training_rows(df, folds).where(F.col("target_value").isNotNull())
    pairs = F.array(F.struct(F.lit(_ALL).alias("context"), F.lit("").alias("value")), *[
        F.struct(F.lit(c).alias("context"), F.col(c).cast("string").alias("value")) for c in settings.context_columns])
    rows = train.select("first_fold", "target_value", F.explode(pairs).alias("c")).where("c.value IS NOT NULL")
    return rows.groupBy("first_fold", F.col("c.context").alias("context"), F.col("c.value").alias("value")).agg(
        F.sum("target_value").alias("s"), F.count(F.lit(1)).alias("n")).persist()


def ratios_from_statistics(stats: DataFrame, folds: Sequence[Fold], settings: BaselineSettings) -> DataFrame:
    """Multipliers of every fold: a row counts from the first fold that may see it, so a running sum over
    folds gives each fold's training statistics. The dense grid is context values x folds, not rows."""
    grid = stats.select("context", "value").distinct().withColumn(
        "fold_number", F.explode(F.sequence(F.lit(1), F.lit(len(folds)))))
    grid = lookup(grid, stats, {"fold_number": "first_fold", "context": "context", "value": "value"}, ["s", "n"])
    run = W.partitionBy("context", "value").orderBy("fold_number").rowsBetween(W.unboundedPreceding, 0)
    grid = grid.withColumns({"s": F.sum("s").over(run), "n": F.sum("n").over(run)})
    fold = W.partitionBy("fold_number")  # one row per context value
    overall = F.max(F.when(F.col("context") == _ALL, F.col("s") / F.col("n"))).over(fold)
    positive = F.when(overall.isNull() | (overall > 0), overall).otherwise(_checked(overall))
    grid = grid.withColumn("overall", positive).where(F.col("context") != _ALL)
    big = F.col("n") >= settings.minimum_group_size
    return grid.where(big).select("fold_number", "context", "value", F.col("n").alias("rows"),
                                  (F.col("s") / F.col("n") / F.col("overall")).alias("multiplier"))


def fold_ratios(df: DataFrame, folds: Sequence[Fold], settings: BaselineSettings) -> DataFrame:
    return ratios_from_statistics(fold_statistics(df, folds, settings), folds, settings)


def fold_predictions(df: DataFrame, folds: Sequence[Fold], settings: BaselineSettings) -> DataFrame:
    """Out-of-fold baseline for every fold in one job; folds without training rows are skipped."""
    stats = fold_statistics(df, folds, settings)
    first = stats.agg(F.min("first_fold").alias("__first"))
    rows = test_rows(df, folds).crossJoin(F.broadcast(first)).where("fold_number >= __first").drop("__first")
    ratios = ratios_from_statistics(stats, folds, settings)
    return _predicted(_multiplied(rows, ratios, settings.context_columns, "fold_number"), settings)
