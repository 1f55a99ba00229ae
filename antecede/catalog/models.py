"""Quantile model and sabotage check over the B panel; SQL states what they must hold, not their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog.evaluation import FOLDS, r3
from antecede.catalog.registry import query
from antecede.catalog.views import FOLD_END, FOLD_START, PANEL_SQL, TARGET, panel
from antecede.plans import quantile, report, walkforward

#: Refitted for windows of a year.
YEARS = walkforward.fold_calendar(FOLD_START, FOLD_END, 12)
SETUP = quantile.QuantileSettings(
    target=TARGET, modelversion=f"gbm_v1_{TARGET}",
    numeric=["rolling_mean_3", "rolling_std_3", "rolling_mean_5", "rolling_std_5", "history_observations"],
    categorical=["priority", "status"], learning_rate=0.1)
#: The last fits of this session by input folder: five queries ask for the same models.
_FITS: dict[tuple[str, str], quantile.QuantileFit] = {}


def _fit(spark, sf) -> quantile.QuantileFit:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        _FITS.clear()
        _FITS[key] = quantile.fit_folds(panel(spark, sf), YEARS, SETUP)
    return _FITS[key]


@query("quantile_model")
def quantile_model(spark, sf):
    """Live predictions of every row with enough history."""
    rows = panel(spark, sf).where("has_sufficient_history")
    return quantile.predict(_fit(spark, sf), rows).select("player_id", "match_id", "modelversion", "prediction", "lowerci", "upperci")


def _fold_predictions(spark, sf):
    return quantile.predict_folds(_fit(spark, sf), panel(spark, sf))


@query("quantile_folds")
def quantile_folds(spark, sf):
    """Out-of-fold predictions: each year's rows by models that saw earlier rows only."""
    return _fold_predictions(spark, sf).select("player_id", "match_id", "fold_number", "modelversion", "prediction", "lowerci", "upperci")


# what the fitted models must hold, whatever their numbers: the key set, ordered and nonnegative bounds, both bounds on their sides
@query("quantile_contract", f"""WITH {PANEL_SQL},
cal(fold_number, cutoff_date, test_end_date) AS (VALUES {", ".join(f"({f.number}, DATE '{f.cutoff}', DATE '{f.test_end}')" for f in YEARS)}),
te AS (SELECT fold_number FROM b JOIN cal ON event_date >= cutoff_date AND event_date < test_end_date
       WHERE has_sufficient_history AND target_value IS NOT NULL),
lv AS (SELECT 0 AS fold_number FROM b WHERE has_sufficient_history)
SELECT fold_number, count(*) AS rows, 0::BIGINT AS unordered, 0::BIGINT AS negative, 0::BIGINT AS missing, 0::BIGINT AS repeated_keys, 0::BIGINT AS unknown_keys
FROM (SELECT * FROM te UNION ALL SELECT * FROM lv) GROUP BY 1""")
def quantile_contract(spark, sf):
    """Counts of broken promises per fold (0: the live model), each key looked up in the rows that were to be predicted."""
    rows = panel(spark, sf)
    columns = ["fold_number", "player_id", "match_id", "prediction", "lowerci", "upperci"]
    live = quantile_model(spark, sf).withColumn("fold_number", F.lit(quantile.LIVE)).select(*columns)
    made = live.unionByName(_fold_predictions(spark, sf).select(*columns))
    due = walkforward.test_rows(rows, YEARS).select("fold_number", "match_id").unionByName(
        rows.where("has_sufficient_history").select(F.lit(quantile.LIVE).alias("fold_number"), "match_id")).withColumn("due", F.lit(True))
    per_key = made.groupBy("fold_number", "match_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isNull() | F.col("lowerci").isNull() | F.col("upperci").isNull()).alias("missing"),
        F.count_if(~((F.col("lowerci") <= F.col("prediction")) & (F.col("prediction") <= F.col("upperci")))).alias("unordered"),
        F.count_if(F.col("lowerci") < 0).alias("negative"))
    both = per_key.join(due, ["fold_number", "match_id"], "full")
    return both.groupBy("fold_number").agg(
        F.count_if(F.col("due") & (F.col("n") >= 1)).alias("rows"), F.coalesce(F.sum("unordered"), F.lit(0)).alias("unordered"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"), (F.coalesce(F.sum("missing"), F.lit(0)) + F.count_if(F.col("n").isNull())).alias("missing"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(F.col("due").isNull()).alias("unknown_keys"))


@query("feature_importance")
def feature_importance(spark, sf):
    return report.rank_importance(quantile.importance_rows(_fit(spark, sf), spark))


@query("importance_summary")
def importance_summary(spark, sf):
    return report.importance_summary(quantile.importance_rows(_fit(spark, sf), spark))


# every quantile ranks every feature once, by falling gain; rows of a node's children add up to the node's
@query("importance_contract", f"""SELECT q AS quantile, {len(SETUP.numeric) + len(SETUP.categorical)}::BIGINT AS features, {len(SETUP.numeric) + len(SETUP.categorical)}::BIGINT AS ranks,
  0::BIGINT AS out_of_order, 0::BIGINT AS bad_nodes, true AS splits_agree FROM (VALUES {", ".join(f"({q}::DOUBLE)" for q in SETUP.quantiles)}) AS t(q)""")
def importance_contract(spark, sf):
    fitted = _fit(spark, sf)
    ranked = report.rank_importance(quantile.importance_rows(fitted, spark))
    later = ranked.select("quantile", (F.col("importance_rank") - 1).alias("importance_rank"), F.col("importance_gain").alias("next_gain"))
    kept = ranked.join(later, ["quantile", "importance_rank"], "left").groupBy("quantile").agg(
        F.count(F.lit(1)).alias("features"), F.countDistinct("importance_rank").alias("ranks"),
        F.count_if(F.col("next_gain") > F.col("importance_gain")).alias("out_of_order"), F.sum("importance_split").alias("splits"))
    splits = quantile.nodes(fitted, spark).where(F.col("model") == quantile.LIVE)
    parent = splits.select("quantile", "tree", F.col("node").alias("parent"), "left_rows", "right_rows")
    child = splits.where("node > 0").select("quantile", "tree", F.expr("(node - 1) div 2").cast("int").alias("parent"), (F.col("node") % 2 == 1).alias("is_left"),
                                            (F.col("left_rows") + F.col("right_rows")).alias("rows"))
    walked = child.join(parent, ["quantile", "tree", "parent"], "left")
    expected = F.when(F.col("is_left"), F.col("left_rows")).otherwise(F.col("right_rows"))
    bad = walked.groupBy("quantile").agg(F.count_if(expected.isNull() | (expected != F.col("rows"))).alias("bad"))
    total = splits.groupBy("quantile").agg(F.count(F.lit(1)).alias("walked"))
    out = kept.join(bad, "quantile", "left").join(total, "quantile", "left")
    return out.select("quantile", "features", "ranks", "out_of_order", F.coalesce("bad", F.lit(0)).alias("bad_nodes"),
                      (F.coalesce("walked", F.lit(0)) == F.col("splits")).alias("splits_agree"))


@query("time_tail_split", f"""WITH {PANEL_SQL},
t AS (SELECT * FROM b WHERE is_training_eligible),
d AS (SELECT event_date, row_number() OVER (ORDER BY event_date DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT event_date FROM t)),
s AS (SELECT min(event_date) AS start FROM d WHERE r <= least(greatest(1, ceil(n * 0.2)), n - 1))
SELECT event_date >= start AS held_out, count(*) AS rows, min(event_date) AS first_date, max(event_date) AS last_date FROM t, s GROUP BY 1""")
def time_tail_split(spark, sf):
    core, held = walkforward.time_tail_split(panel(spark, sf).where("is_training_eligible"), 0.2)
    both = core.withColumn("held_out", F.lit(False)).unionByName(held.withColumn("held_out", F.lit(True)))
    return both.groupBy("held_out").agg(F.count(F.lit(1)).alias("rows"), F.min("event_date").alias("first_date"),
                                        F.max("event_date").alias("last_date"))


@query("shuffled_target")
def shuffled_target(spark, sf):
    """Boosted model's error on the first fold with enough training rows (else the last) with the real and with permuted training targets."""
    rows = panel(spark, sf)
    large = walkforward.first_large_fold(walkforward.fold_sizes(rows, FOLDS))
    fold = next((f for f in FOLDS if f.number == large), FOLDS[-1])
    return quantile.sabotage(rows, fold, SETUP, ["match_id"]).select("training_target", "rows", r3("mae").alias("mae"))
