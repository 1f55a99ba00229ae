"""Scores, calibration and the evaluation tables derived from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from antecede.operators.ranks import global_rank
from antecede.operators.skew import lookup

POOLED = 0
BINS = 10
METRICS = ["mae", "rmse", "mean_bias", "interval_coverage", "interval_crossing_count", "interval_repair_count",
           "mae_improvement_over_baseline"]


def both_bounds() -> Column:
    return F.col("lowerci").isNotNull() & F.col("upperci").isNotNull()


def repair_intervals(df: DataFrame) -> DataFrame:
    """Order crossed, negative or off-centre intervals; untouched rows keep their values.

    Adds ``was_crossing`` and ``was_repaired``.
    """
    p, lo, hi = F.col("prediction"), F.col("lowerci"), F.col("upperci")
    known = both_bounds()
    crossing = F.coalesce(known & (lo > hi), F.lit(False))
    fix = F.coalesce(known & (crossing | (p < 0) | (lo < 0) | (lo > p) | (hi < p)), F.lit(False))
    point = F.greatest(p, F.lit(0.0))
    low = F.greatest(F.least(lo, point, hi), F.lit(0.0))
    high = F.greatest(lo, point, hi, F.lit(0.0))
    flagged = df.withColumns({"was_crossing": crossing, "was_repaired": fix})
    return flagged.withColumns({
        "prediction": F.when(F.col("was_repaired"), point).otherwise(p),
        "lowerci": F.when(F.col("was_repaired"), low).otherwise(lo),
        "upperci": F.when(F.col("was_repaired"), high).otherwise(hi)})


def score(df: DataFrame, by: Sequence[str] = ("modelversion", "stat_target"), fold: str = "fold_number") -> DataFrame:
    """Errors per fold and pooled (fold 0) over all rows.

    Rows are reduced to sums per fold first; the pooled scores are sums of sums, so no row is
    multiplied for the second grouping set.
    """
    error = F.col("prediction") - F.col("target_value")
    inside = F.col("target_value").between(F.col("lowerci"), F.col("upperci"))
    sums = repair_intervals(df).groupBy(*by, fold).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(both_bounds()).alias("i"), F.sum(F.abs(error)).alias("ae"),
        F.sum(error * error).alias("se"), F.sum(error).alias("e"), F.count_if(both_bounds() & inside).alias("c"),
        F.count_if("was_crossing").alias("x"), F.count_if("was_repaired").alias("r"))
    sets = [[F.col(c) for c in [*by, fold]], [F.col(c) for c in by]]
    n = F.sum("n")
    out = sums.groupingSets(sets, *by, fold).agg(
        n.alias("row_count"), F.sum("i").alias("interval_rows"), (F.sum("ae") / n).alias("mae"),
        F.sqrt(F.sum("se") / n).alias("rmse"), (F.sum("e") / n).alias("mean_bias"),
        F.try_divide(F.sum("c"), F.sum("i")).alias("interval_coverage"), F.sum("x").alias("interval_crossing_count"),
        F.sum("r").alias("interval_repair_count"), F.grouping(fold).alias("__pooled"))
    return out.withColumn(fold, F.when(F.col("__pooled") == 1, F.lit(POOLED)).otherwise(F.col(fold))).drop("__pooled")


def with_improvement(scores: DataFrame, family: str = "model_family", baseline: str = "baseline",
                     by: Sequence[str] = ("stat_target", "fold_number")) -> DataFrame:
    """Percent MAE below the baseline's; 0 when both are 0, NULL when only the baseline is 0.

    The window runs over score rows (one per model); a self-join would score everything twice.
    """
    peers = W.partitionBy(*by)
    out = scores.withColumn("baseline_mae", F.max(F.when(F.col(family) == baseline, F.col("mae"))).over(peers))
    b, m = F.col("baseline_mae"), F.col("mae")
    gain = F.when(b == 0, F.when(m == 0, 0.0)).otherwise((b - m) / b * 100)
    return out.withColumn("mae_improvement_over_baseline", gain)


def calibration_bins(df: DataFrame, by: Sequence[str] = ("modelversion", "stat_target", "fold_number"),
                     keys: Sequence[str] = ("player_id", "match_id"), bins: int = BINS) -> DataFrame:
    """Coverage per prediction-ranked bin; ties are split by key so that bins stay filled."""
    rows = df.where(both_bounds() & F.col("prediction").isNotNull() & F.col("target_value").isNotNull())
    covered = F.col("target_value").between(F.col("lowerci"), F.col("upperci")).cast("double")
    rows = rows.select(*by, "prediction", *keys, covered.alias("__covered"))
    ranked = global_rank(rows, by, ["prediction", *keys], "__rank", "__size")
    # integer ceiling of rank * count / size
    number = F.expr(f"(__rank * least({bins}, __size) + __size - 1) div __size")
    return ranked.withColumn("bin_number", number).groupBy(*by, "bin_number").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("prediction").alias("prediction_min"),
        F.max("prediction").alias("prediction_max"), F.avg("__covered").alias("coverage"))


def bias_signs(scores: DataFrame, by: Sequence[str] = ("stat_target", "modelversion"), flag: float = 0.6) -> DataFrame:
    """Folds with positive and negative bias; a tie counts as positive."""
    folds = scores.where((F.col("fold_number") > POOLED) & F.col("mean_bias").isNotNull())
    out = folds.groupBy(*by).agg(F.count_if(F.col("mean_bias") > 0).alias("positive_folds"),
                                 F.count_if(F.col("mean_bias") < 0).alias("negative_folds"))
    total = F.col("positive_folds") + F.col("negative_folds")
    share = F.try_divide(F.greatest("positive_folds", "negative_folds"), total)
    sign = F.when(total == 0, "unavailable").when(F.col("positive_folds") >= F.col("negative_folds"), "positive") \
        .otherwise("negative")
    return out.withColumns({"dominant_sign": sign, "dominant_share": share,
                            "flagged": F.coalesce(share >= flag, F.lit(False))})


def melt_metrics(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Long metric rows; interval metrics carry the number of rows with both bounds."""
    wide = scores.select(*keys, "row_count", "interval_rows", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot([*keys, "row_count", "interval_rows"], list(metrics), "metric", "metric_value")
    rows = F.when(F.col("metric").startswith("interval_"), F.col("interval_rows")).otherwise(F.col("row_count"))
    return long.withColumn("row_count", rows).drop("interval_rows")


def melt_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    name = F.concat(F.lit("prediction_bin_"), F.lpad(F.col("bin_number").cast("string"), 2, "0"), F.lit("_coverage"))
    return bins.select(*keys, name.alias("metric"), F.col("coverage").alias("metric_value"), "row_count")


def melt_weights(weights: DataFrame, keys: Sequence[str], objective: str, members: Mapping[str, str]) -> DataFrame:
    """weight_<objective>_<member> rows; ``members`` maps member name to its weight column."""
    wide = weights.select(*keys, *[F.col(c).cast("double").alias(f"weight_{objective}_{m}") for m, c in members.items()])
    return wide.unpivot(list(keys), [f"weight_{objective}_{m}" for m in members], "metric", "metric_value")


def summary_table(log: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """One wide row per target and model from the pooled metric rows."""
    pooled = log.where(F.col("fold_number") == POOLED)
    return pooled.groupBy("stat_target", "modelversion").agg(
        F.max(F.when(F.col("metric") == "mae", F.col("row_count"))).alias("rows"),
        *[F.max(F.when(F.col("metric") == m, F.col("metric_value"))).alias(m) for m in metrics])


def fold_coverage(log: DataFrame) -> DataFrame:
    return log.where((F.col("fold_number") > POOLED) & (F.col("metric") == "interval_coverage")).select(
        "stat_target", "modelversion", "fold_number", "metric_value", "row_count")


def weight_summary(log: DataFrame) -> DataFrame:
    """Folds, mean and range of the fitted weight per (target, objective, member)."""
    rows = log.where(F.col("metric").startswith("weight_") & (F.col("fold_number") > POOLED))
    parts = F.split("metric", "_", 3)
    rows = rows.where(F.size(parts) == 3).select(
        "stat_target", parts[1].alias("objective"), parts[2].alias("member"), "metric_value")
    return rows.groupBy("stat_target", "objective", "member").agg(
        F.count("metric_value").alias("folds"), F.avg("metric_value").alias("mean_weight"),
        F.min("metric_value").alias("min_weight"), F.max("metric_value").alias("max_weight"))


def objective_comparison(log: DataFrame, objectives: Sequence[str] = ("absolute", "squared")) -> DataFrame:
    pooled = log.where(F.col("fold_number") == POOLED)
    return pooled.groupBy("stat_target").agg(*[
        F.max(F.when(F.col("metric") == f"mae_{o}_objective", F.col("metric_value"))).alias(f"mae_{o}")
        for o in objectives])


def expectation_checks(log: DataFrame, expectations: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """(modelversion, metric, low, high) ranges on pooled metrics; a missing value fails."""
    wanted = log.sparkSession.createDataFrame(list(expectations),
                                              "modelversion string, metric string, low double, high double")
    pooled = log.where(F.col("fold_number") == POOLED)
    out = lookup(wanted, pooled, ["modelversion", "metric"], ["metric_value"])
    passed = F.coalesce(F.col("metric_value").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("result", F.when(passed, "PASS").otherwise("FAIL"))


def scored_folds(log: DataFrame) -> DataFrame:
    rows = log.where(F.col("fold_number") > POOLED)
    return rows.groupBy("stat_target").agg(F.count_distinct("fold_number").alias("scored_folds"))
