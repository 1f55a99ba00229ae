"""Walk-forward evaluation over the B panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from antecede.catalog.registry import query, r6, s6
from antecede.catalog.views import BASE_WINDOW, FOLD_END, FOLD_START, MINIMUM_GROUP, PANEL_SQL, TARGET, panel
from antecede.operators import quality
from antecede.plans import baseline, scoring, walkforward

FOLDS = walkforward.fold_calendar(FOLD_START, FOLD_END, 1)
SETTINGS = baseline.BaselineSettings(
    target=TARGET, modelversion=f"baseline_v1_{TARGET}", base_column=f"rolling_mean_{BASE_WINDOW}",
    std_column=f"rolling_std_{BASE_WINDOW}", context_columns=["priority", "status"],
    minimum_group_size=MINIMUM_GROUP)
RUN_AT = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
RUN_STAMP = "20260102T030405000000Z"


def r3(col):
    """Money-sized values: three places keep float noise away from the rounding edge."""
    return F.round(F.col(col) + 1e-7, 3)


def s3(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-7, 3)"


CAL_SQL = f"""
cal AS (SELECT CAST(row_number() OVER (ORDER BY c) AS INT) AS fold_number, CAST(c AS DATE) AS cutoff_date,
               least(CAST(c + INTERVAL 1 MONTH AS DATE), DATE '{FOLD_END}') AS test_end_date
        FROM generate_series(TIMESTAMP '{FOLD_START}', TIMESTAMP '{FOLD_END}' - INTERVAL 1 DAY, INTERVAL 1 MONTH) t(c))
"""

TEST_SQL = """
te AS (SELECT b.*, cal.* FROM b JOIN cal ON event_date >= cutoff_date AND event_date < test_end_date
       WHERE has_sufficient_history AND target_value IS NOT NULL)
"""


def _ratio_sql(ctx: str) -> str:
    return (f"SELECT fold_number, '{ctx}' AS context, {ctx} AS value, count(*) AS n, avg(target_value) AS m FROM cal "
            f"JOIN b ON is_training_eligible AND event_date < cutoff_date WHERE {ctx} IS NOT NULL GROUP BY ALL "
            f"HAVING count(*) >= {MINIMUM_GROUP}")


# the naive form: every fold rescans its own training rows
BASELINE_SQL = f"""{PANEL_SQL}, {CAL_SQL}, {TEST_SQL},
ov AS (SELECT fold_number, avg(target_value) AS ov FROM cal JOIN b ON is_training_eligible AND event_date < cutoff_date
       GROUP BY 1),
g AS ({_ratio_sql('priority')} UNION ALL {_ratio_sql('status')}),
mult AS (SELECT fold_number, context, value, n, m / ov AS multiplier FROM g JOIN ov USING (fold_number)),
bp AS (SELECT te.*, rolling_mean_5 * (coalesce(p.multiplier, 1) * coalesce(s.multiplier, 1)) AS prediction
       FROM te JOIN ov USING (fold_number)
       LEFT JOIN mult p ON p.fold_number = te.fold_number AND p.context = 'priority' AND p.value = te.priority
       LEFT JOIN mult s ON s.fold_number = te.fold_number AND s.context = 'status' AND s.value = te.status
       WHERE rolling_mean_5 IS NOT NULL),
base AS (SELECT *, CASE WHEN rolling_std_5 IS NOT NULL THEN greatest(prediction - rolling_std_5, 0) END AS lowerci,
                prediction + rolling_std_5 AS upperci FROM bp)
"""

# second model: short form with wide, unclipped bounds; no prediction for one context value
FORM_SQL = """
form AS (SELECT te.*, rolling_mean_3 AS prediction, rolling_mean_3 - 1.5 * rolling_std_3 AS lowerci,
                CASE WHEN status = 'F' THEN rolling_mean_3 - 2 * rolling_std_3
                     ELSE rolling_mean_3 + 1.5 * rolling_std_3 END AS upperci FROM te)
"""

SCORED_SQL = BASELINE_SQL + "," + FORM_SQL + f""",
al AS (SELECT 'baseline_v1_{TARGET}' AS modelversion, player_id, match_id, fold_number, cutoff_date, test_end_date,
              event_date, target_value, prediction AS p0, lowerci AS l0, upperci AS u0 FROM base
       UNION ALL SELECT 'form_v1_{TARGET}', player_id, match_id, fold_number, cutoff_date, test_end_date, event_date,
              target_value, prediction, lowerci, upperci FROM form),
fl AS (SELECT *, coalesce(l0 > u0, false) AS crossing,
              coalesce(l0 > u0 OR p0 < 0 OR l0 < 0 OR l0 > p0 OR u0 < p0, false) AND l0 IS NOT NULL AND u0 IS NOT NULL
                AS fixed FROM al),
sc AS (SELECT *, '{TARGET}' AS stat_target, CASE WHEN fixed THEN greatest(p0, 0) ELSE p0 END AS prediction,
              CASE WHEN fixed THEN greatest(least(l0, greatest(p0, 0), u0), 0) ELSE l0 END AS lowerci,
              CASE WHEN fixed THEN greatest(l0, greatest(p0, 0), u0, 0) ELSE u0 END AS upperci FROM fl)
"""

SCORES_SQL = SCORED_SQL + """,
s0 AS (SELECT modelversion, stat_target, coalesce(fold_number, 0) AS fold_number, count(*) AS row_count,
  count(*) FILTER (lowerci IS NOT NULL AND upperci IS NOT NULL) AS interval_rows,
  avg(abs(prediction - target_value)) AS mae, sqrt(avg((prediction - target_value) ** 2)) AS rmse,
  avg(prediction - target_value) AS mean_bias,
  avg((target_value BETWEEN lowerci AND upperci)::INT) FILTER (lowerci IS NOT NULL AND upperci IS NOT NULL)
    AS interval_coverage,
  count(*) FILTER (crossing) AS interval_crossing_count, count(*) FILTER (fixed) AS interval_repair_count
  FROM sc GROUP BY GROUPING SETS ((modelversion, stat_target, fold_number), (modelversion, stat_target))),
scores AS (SELECT s0.*, CASE WHEN b.mae = 0 THEN CASE WHEN s0.mae = 0 THEN 0.0 END
                             ELSE (b.mae - s0.mae) / b.mae * 100 END AS mae_improvement_over_baseline
           FROM s0 LEFT JOIN s0 b ON b.modelversion LIKE 'baseline%' AND b.fold_number = s0.fold_number)
"""

SHOWN = f"""row_count, interval_rows, {s3('mae')} AS mae, {s3('rmse')} AS rmse, {s3('mean_bias')} AS mean_bias,
  {s6('interval_coverage')} AS interval_coverage, interval_crossing_count, interval_repair_count,
  {s6('mae_improvement_over_baseline')} AS mae_improvement_over_baseline"""


def baseline_oof(spark, sf, rows=None):
    rows = rows if rows is not None else panel(spark, sf)
    return baseline.fold_predictions(rows, FOLDS, SETTINGS)


def form_oof(spark, sf, rows=None):
    """A pluggable model: anything that returns prediction and bounds for the test rows."""
    rows = walkforward.test_rows(rows if rows is not None else panel(spark, sf), FOLDS)
    mean, std = F.col("rolling_mean_3"), F.col("rolling_std_3")
    return rows.withColumns({
        "prediction": mean, "lowerci": mean - 1.5 * std,
        "upperci": F.when(F.col("status") == "F", mean - 2 * std).otherwise(mean + 1.5 * std),
        "modelversion": F.lit(f"form_v1_{TARGET}")})


KEPT = ["modelversion", "player_id", "match_id", "event_date", "fold_number", "cutoff_date", "test_end_date",
        "target_value", "prediction", "lowerci", "upperci"]


def scored_rows(spark, sf):
    rows = panel(spark, sf)  # one frame: both models share its exchange
    both = baseline_oof(spark, sf, rows).select(*KEPT).unionByName(form_oof(spark, sf, rows).select(*KEPT))
    return both.withColumn("stat_target", F.lit(TARGET))


def family():
    return F.when(F.col("modelversion").startswith("baseline"), "baseline").otherwise("form")


def scores(spark, sf):
    out = scoring.score(scored_rows(spark, sf)).withColumn("model_family", family())
    return scoring.with_improvement(out)


def shown(df, *keys):
    return df.select(
        *keys, "row_count", "interval_rows", r3("mae").alias("mae"), r3("rmse").alias("rmse"),
        r3("mean_bias").alias("mean_bias"), r6("interval_coverage").alias("interval_coverage"),
        "interval_crossing_count", "interval_repair_count",
        r6("mae_improvement_over_baseline").alias("mae_improvement_over_baseline"))


@query("panel_features", f"""WITH {PANEL_SQL} SELECT match_id, player_id, event_date, history_observations,
  {s3('rolling_mean_3')} AS rolling_mean_3, {s3('rolling_std_3')} AS rolling_std_3,
  {s3('rolling_mean_5')} AS rolling_mean_5, {s3('rolling_std_5')} AS rolling_std_5, has_sufficient_history,
  is_training_eligible FROM b""")
def panel_features(spark, sf):
    cols = ["rolling_mean_3", "rolling_std_3", "rolling_mean_5", "rolling_std_5"]
    return panel(spark, sf).select("match_id", "player_id", "event_date", "history_observations",
                                   *[r3(c).alias(c) for c in cols], "has_sufficient_history", "is_training_eligible")


@query("walk_forward_folds", f"""WITH {PANEL_SQL}, {CAL_SQL}, {TEST_SQL}
SELECT player_id, match_id, event_date, fold_number, cutoff_date, test_end_date FROM te""")
def walk_forward_folds(spark, sf):
    return walkforward.test_rows(panel(spark, sf), FOLDS).select(
        "player_id", "match_id", "event_date", "fold_number", "cutoff_date", "test_end_date")


@query("fold_sizes", f"""WITH {PANEL_SQL}, {CAL_SQL}, {TEST_SQL}
SELECT fold_number, cutoff_date, test_end_date,
  (SELECT count(*) FROM b WHERE is_training_eligible AND event_date < cutoff_date) AS training_rows,
  (SELECT count(*) FROM te WHERE te.fold_number = cal.fold_number) AS test_rows FROM cal""")
def fold_sizes(spark, sf):
    return walkforward.fold_sizes(panel(spark, sf), FOLDS)


@query("context_ratios", f"""WITH {PANEL_SQL}, t AS (SELECT * FROM b WHERE is_training_eligible),
g AS (SELECT 'priority' AS context, priority AS value, count(*) AS rows, avg(target_value) AS m FROM t GROUP BY 2
      UNION ALL SELECT 'status', status, count(*), avg(target_value) FROM t GROUP BY 2)
SELECT context, value, rows, {s6('m / (SELECT avg(target_value) FROM t)')} AS multiplier FROM g
WHERE rows >= {MINIMUM_GROUP}""")
def context_ratios(spark, sf):
    out = baseline.context_ratios(panel(spark, sf), SETTINGS)
    return out.select("context", "value", "rows", r6("multiplier").alias("multiplier"))


@query("baseline_predictions", f"""WITH {PANEL_SQL}, t AS (SELECT * FROM b WHERE is_training_eligible),
o AS (SELECT avg(target_value) AS ov FROM t),
p AS (SELECT priority, avg(target_value) / any_value(ov) AS m FROM t, o GROUP BY 1 HAVING count(*) >= {MINIMUM_GROUP}),
s AS (SELECT status, avg(target_value) / any_value(ov) AS m FROM t, o GROUP BY 1 HAVING count(*) >= {MINIMUM_GROUP}),
x AS (SELECT b.*, rolling_mean_5 * (coalesce(p.m, 1) * coalesce(s.m, 1)) AS prediction FROM b
      LEFT JOIN p USING (priority) LEFT JOIN s USING (status)
      WHERE has_sufficient_history AND rolling_mean_5 IS NOT NULL)
SELECT player_id, match_id, 'baseline_v1_{TARGET}' AS modelversion, {s3('prediction')} AS prediction,
  {s3('CASE WHEN rolling_std_5 IS NOT NULL THEN greatest(prediction - rolling_std_5, 0) END')} AS lowerci,
  {s3('prediction + rolling_std_5')} AS upperci FROM x""")
def baseline_predictions(spark, sf):
    out = baseline.predict(panel(spark, sf), SETTINGS)
    return out.select("player_id", "match_id", "modelversion", r3("prediction").alias("prediction"),
                      r3("lowerci").alias("lowerci"), r3("upperci").alias("upperci"))


@query("prediction_census", f"""WITH {PANEL_SQL}
SELECT count(*) AS rows_read, count(*) FILTER (is_training_eligible) AS training_rows,
  count(*) FILTER (NOT is_training_eligible) AS training_rows_excluded,
  count(*) FILTER (NOT has_sufficient_history) AS prediction_rows_excluded,
  count(*) FILTER (has_sufficient_history AND rolling_mean_5 IS NULL) AS missing_base_rows FROM b""")
def prediction_census(spark, sf):
    return baseline.prediction_census(panel(spark, sf), SETTINGS)


@query("fold_ratios", f"""WITH {BASELINE_SQL}
SELECT fold_number, context, value, n AS rows, {s6('multiplier')} AS multiplier FROM mult""")
def fold_ratios(spark, sf):
    out = baseline.fold_ratios(panel(spark, sf), FOLDS, SETTINGS)
    return out.select("fold_number", "context", "value", "rows", r6("multiplier").alias("multiplier"))


@query("baseline_fold_predictions", f"""WITH {BASELINE_SQL}
SELECT player_id, match_id, fold_number, cutoff_date, test_end_date, {s3('prediction')} AS prediction,
  {s3('lowerci')} AS lowerci, {s3('upperci')} AS upperci FROM base""")
def baseline_fold_predictions(spark, sf):
    return baseline_oof(spark, sf).select(
        "player_id", "match_id", "fold_number", "cutoff_date", "test_end_date", r3("prediction").alias("prediction"),
        r3("lowerci").alias("lowerci"), r3("upperci").alias("upperci"))


@query("interval_repair", f"""WITH {SCORED_SQL}
SELECT modelversion, player_id, match_id, crossing AS was_crossing, fixed AS was_repaired,
  {s3('prediction')} AS prediction, {s3('lowerci')} AS lowerci, {s3('upperci')} AS upperci FROM sc""")
def interval_repair(spark, sf):
    out = scoring.repair_intervals(scored_rows(spark, sf))
    return out.select("modelversion", "player_id", "match_id", "was_crossing", "was_repaired",
                      *[r3(c).alias(c) for c in ("prediction", "lowerci", "upperci")])


@query("fold_scores", f"WITH {SCORES_SQL} SELECT modelversion, stat_target, fold_number, {SHOWN} FROM scores")
def fold_scores(spark, sf):
    return shown(scores(spark, sf), "modelversion", "stat_target", "fold_number")


@query("calibration_bins", f"""WITH {SCORED_SQL},
x AS (SELECT modelversion, stat_target, unnest([fold_number, 0]) AS fold_number, player_id, match_id, prediction,
             (target_value BETWEEN lowerci AND upperci)::INT AS c FROM sc
      WHERE lowerci IS NOT NULL AND upperci IS NOT NULL AND prediction IS NOT NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY modelversion, fold_number ORDER BY prediction, player_id, match_id) AS r,
             count(*) OVER (PARTITION BY modelversion, fold_number) AS n FROM x)
SELECT modelversion, stat_target, fold_number, CAST(ceil(r * least(10, n)::DOUBLE / n) AS BIGINT) AS bin_number,
  count(*) AS row_count, {s3('min(prediction)')} AS prediction_min, {s3('max(prediction)')} AS prediction_max,
  {s6('avg(c)')} AS coverage FROM y GROUP BY ALL""")
def calibration_bins(spark, sf):
    rows = scoring.repair_intervals(scored_rows(spark, sf))
    both = rows.withColumn("fold_number", F.explode(F.array("fold_number", F.lit(scoring.POOLED))))
    out = scoring.calibration_bins(both)
    return out.select("modelversion", "stat_target", "fold_number", "bin_number", "row_count",
                      r3("prediction_min").alias("prediction_min"), r3("prediction_max").alias("prediction_max"),
                      r6("coverage").alias("coverage"))


@query("bias_signs", f"""WITH {SCORES_SQL},
c AS (SELECT stat_target, modelversion, count(*) FILTER (mean_bias > 0) AS positive_folds,
             count(*) FILTER (mean_bias < 0) AS negative_folds FROM scores WHERE fold_number > 0 GROUP BY ALL)
SELECT *, CASE WHEN positive_folds + negative_folds = 0 THEN 'unavailable'
               WHEN positive_folds >= negative_folds THEN 'positive' ELSE 'negative' END AS dominant_sign,
  {s6('greatest(positive_folds, negative_folds) / nullif(positive_folds + negative_folds, 0)')} AS dominant_share,
  coalesce(greatest(positive_folds, negative_folds) / nullif(positive_folds + negative_folds, 0) >= 0.6, false)
    AS flagged FROM c""")
def bias_signs(spark, sf):
    return scoring.bias_signs(scores(spark, sf)).withColumn("dominant_share", r6("dominant_share"))


LOG_SQL = SCORES_SQL + """,
log AS (SELECT modelversion, stat_target, fold_number, metric, metric_value,
               CASE WHEN metric LIKE 'interval%' THEN interval_rows ELSE row_count END AS row_count
        FROM (""" + " UNION ALL ".join(
    f"SELECT modelversion, stat_target, fold_number, row_count, interval_rows, '{m}' AS metric, "
    f"CAST({m} AS DOUBLE) AS metric_value FROM scores" for m in scoring.METRICS) + "))"


def metric_log(spark, sf):
    return scoring.melt_metrics(scores(spark, sf), ["modelversion", "stat_target", "fold_number"])


@query("metric_melt", f"""WITH {LOG_SQL} SELECT modelversion, stat_target, fold_number, metric,
  {s3('metric_value')} AS metric_value, row_count FROM log""")
def metric_melt(spark, sf):
    return metric_log(spark, sf).select("modelversion", "stat_target", "fold_number", "metric",
                                        r3("metric_value").alias("metric_value"), "row_count")


@query("calibration_metric_rows", f"""WITH {SCORED_SQL},
x AS (SELECT modelversion, fold_number, player_id, match_id, prediction,
             (target_value BETWEEN lowerci AND upperci)::INT AS c FROM sc
      WHERE lowerci IS NOT NULL AND upperci IS NOT NULL AND prediction IS NOT NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY modelversion, fold_number ORDER BY prediction, player_id, match_id) AS r,
             count(*) OVER (PARTITION BY modelversion, fold_number) AS n FROM x),
z AS (SELECT modelversion, fold_number, CAST(ceil(r * least(10, n)::DOUBLE / n) AS INT) AS b, avg(c) AS v, count(*) AS k
      FROM y GROUP BY ALL)
SELECT modelversion, fold_number, 'prediction_bin_' || lpad(b::VARCHAR, 2, '0') || '_coverage' AS metric,
  {s6('v')} AS metric_value, k AS row_count FROM z""")
def calibration_metric_rows(spark, sf):
    rows = scoring.repair_intervals(scored_rows(spark, sf))
    bins = scoring.calibration_bins(rows, by=["modelversion", "fold_number"])
    return scoring.melt_bins(bins, ["modelversion", "fold_number"]).withColumn("metric_value", r6("metric_value"))


@query("metric_summary", f"""WITH {SCORES_SQL} SELECT stat_target, modelversion, row_count AS rows,
  {s3('mae')} AS mae, {s3('rmse')} AS rmse, {s3('mean_bias')} AS mean_bias,
  {s6('interval_coverage')} AS interval_coverage, CAST(interval_crossing_count AS DOUBLE) AS interval_crossing_count,
  CAST(interval_repair_count AS DOUBLE) AS interval_repair_count,
  {s6('mae_improvement_over_baseline')} AS mae_improvement_over_baseline FROM scores WHERE fold_number = 0""")
def metric_summary(spark, sf):
    out = scoring.summary_table(metric_log(spark, sf))
    return out.withColumns({c: r3(c) for c in ("mae", "rmse", "mean_bias")}).withColumns(
        {c: r6(c) for c in ("interval_coverage", "mae_improvement_over_baseline")})


@query("fold_coverage", f"""WITH {SCORES_SQL} SELECT stat_target, modelversion, fold_number,
  {s6('interval_coverage')} AS metric_value, interval_rows AS row_count FROM scores WHERE fold_number > 0""")
def fold_coverage(spark, sf):
    return scoring.fold_coverage(metric_log(spark, sf)).withColumn("metric_value", r6("metric_value"))


EXPECTED = [(f"baseline_v1_{TARGET}", "interval_coverage", 0.75, 0.85), (f"form_v1_{TARGET}", "mae", 1000.0, 200000.0),
            (f"form_v1_{TARGET}", "interval_coverage", 0.75, 0.85), (f"absent_v1_{TARGET}", "mae", 0.0, 1.0)]


@query("expectation_checks", f"""WITH {LOG_SQL},
e(modelversion, metric, low, high) AS (VALUES """ + ", ".join(
    f"('{m}', '{k}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for m, k, lo, hi in EXPECTED) + f""")
SELECT e.*, {s3('metric_value')} AS metric_value,
  CASE WHEN metric_value BETWEEN low AND high THEN 'PASS' ELSE 'FAIL' END AS result
FROM e LEFT JOIN log ON log.modelversion = e.modelversion AND log.metric = e.metric AND fold_number = 0""")
def expectation_checks(spark, sf):
    out = scoring.expectation_checks(metric_log(spark, sf), EXPECTED)
    return out.withColumn("metric_value", r3("metric_value"))


@query("scored_folds", f"""WITH {SCORES_SQL}
SELECT stat_target, count(DISTINCT fold_number) AS scored_folds FROM scores WHERE fold_number > 0 GROUP BY 1""")
def scored_folds(spark, sf):
    return scoring.scored_folds(metric_log(spark, sf))


@query("oof_frame", f"""WITH {SCORED_SQL}
SELECT player_id, match_id, 'orders' AS sport, stat_target AS prop_type, {s3('prediction')} AS prediction,
  {s3('lowerci')} AS lowerci, {s3('upperci')} AS upperci,
  'baseline_v1_{TARGET}_backtest_{RUN_STAMP}' AS modelversion, fold_number,
  CAST(cutoff_date - INTERVAL 1 DAY AS DATE) AS fold_cutoff_date, test_end_date AS fold_test_end_date
FROM sc WHERE modelversion LIKE 'baseline%'""")
def oof_frame(spark, sf):
    rows = scoring.repair_intervals(baseline_oof(spark, sf))
    out = walkforward.oof_frame(rows, sport="orders", target=TARGET, prefix="baseline_v1", run_timestamp=RUN_AT)
    return out.drop("predictiontimestamp").withColumns({c: r3(c) for c in ("prediction", "lowerci", "upperci")})


@query("key_set_equality", f"""WITH {SCORED_SQL}
SELECT CASE WHEN f.match_id IS NULL THEN 'left' ELSE 'right' END AS only_in, count(*) AS keys
FROM (SELECT * FROM sc WHERE modelversion LIKE 'baseline%' AND upperci IS NOT NULL) a
FULL JOIN (SELECT * FROM sc WHERE modelversion LIKE 'form%' AND status_is_p IS NULL) f USING (player_id, match_id)
WHERE f.match_id IS NULL OR a.match_id IS NULL GROUP BY 1""".replace(" AND status_is_p IS NULL", " AND lowerci >= 1000"))
def key_set_equality(spark, sf):
    """Keys only one of two row sets covers."""
    rows = scoring.repair_intervals(scored_rows(spark, sf))
    left = rows.where("modelversion LIKE 'baseline%' AND upperci IS NOT NULL")
    right = rows.where("modelversion LIKE 'form%' AND lowerci >= 1000")
    diff = quality.key_difference(left, right, ["player_id", "match_id"])
    return diff.groupBy("only_in").agg(F.count(F.lit(1)).alias("keys"))


@query("training_cutoff_audit", f"""WITH {PANEL_SQL}, {CAL_SQL}, {TEST_SQL}
SELECT fold_number, max(b.event_date) AS last_training_date, min(te_first) AS first_test_date,
       max(b.event_date) < min(te_first) AS strictly_before
FROM cal JOIN b ON is_training_eligible AND b.event_date < cutoff_date
JOIN (SELECT fold_number, min(event_date) AS te_first FROM te GROUP BY 1) USING (fold_number) GROUP BY fold_number""")
def training_cutoff_audit(spark, sf):
    """Newest training date of every fold against its oldest test date, from two small aggregates."""
    from pyspark.sql import Window as W

    df = panel(spark, sf)
    newest = walkforward.training_rows(df, FOLDS).groupBy("first_fold").agg(F.max("event_date").alias("d"))
    oldest = walkforward.test_rows(df, FOLDS).groupBy("fold_number").agg(F.min("event_date").alias("first_test_date"))
    cal = walkforward.calendar_frame(spark, FOLDS).select("fold_number")
    both = cal.join(newest, cal["fold_number"] == newest["first_fold"], "left").select("fold_number", "d")
    run = W.orderBy("fold_number").rowsBetween(W.unboundedPreceding, 0)  # one row per fold
    both = both.withColumn("last_training_date", F.max("d").over(run)).where("last_training_date IS NOT NULL")
    return both.join(oldest, "fold_number").select(
        "fold_number", "last_training_date", "first_test_date",
        (F.col("last_training_date") < F.col("first_test_date")).alias("strictly_before"))
