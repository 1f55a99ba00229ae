"""Ensemble combination and out-of-fold weights over the B panel's two models."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog.evaluation import BASELINE_SQL, FOLDS, FORM_SQL, baseline_oof, form_oof, r3, s3
from antecede.catalog.registry import query, r6, s6
from antecede.catalog.views import TARGET, panel
from antecede.plans import ensemble, scoring, walkforward

MEMBERS = ["baseline", "form"]
CONFIGURED = {"baseline": 0.6, "form": 0.4}
CARRIED = ["fold_number", "target_value"]

# the form member has no prediction for one context value and no bounds for short histories
MEMBERS_SQL = BASELINE_SQL + "," + FORM_SQL + """,
mb AS (SELECT player_id, match_id, fold_number, target_value, 'baseline' AS member, prediction, lowerci, upperci FROM base
       UNION ALL SELECT player_id, match_id, fold_number, target_value, 'form', prediction, lowerci, upperci FROM form
       WHERE priority <> '2-HIGH')
"""


def stacked(spark, sf):
    rows = panel(spark, sf)
    form = form_oof(spark, sf, rows).where("priority <> '2-HIGH'")
    return ensemble.stack_members({"baseline": baseline_oof(spark, sf, rows), "form": form}, CARRIED)


def _combine_sql(policy: str) -> str:
    skip = "WHEN n < 2 THEN 'skipped'" if policy == ensemble.EMIT_NONE else "WHEN n < 2 THEN 'renormalized'"
    return f"""WITH {MEMBERS_SQL},
w AS (SELECT *, CASE member WHEN 'baseline' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w FROM mb),
eg AS (SELECT player_id, match_id, count(prediction) AS n, sum(w * prediction) / sum(w) AS p,
        sum(w * lowerci) FILTER (lowerci IS NOT NULL) / sum(w) FILTER (lowerci IS NOT NULL) AS l,
        sum(w * upperci) FILTER (upperci IS NOT NULL) / sum(w) FILTER (upperci IS NOT NULL) AS u
      FROM w GROUP BY ALL),
c AS (SELECT *, CASE WHEN n = 0 THEN 'skipped' {skip} ELSE 'complete' END AS status FROM eg),
en AS (SELECT player_id, match_id, status, n AS members_present, CASE WHEN status <> 'skipped' THEN p END AS prediction,
  CASE WHEN status <> 'skipped' AND l IS NOT NULL THEN greatest(0, least(l, p)) END AS lowerci,
  CASE WHEN status <> 'skipped' AND u IS NOT NULL THEN greatest(u, p) END AS upperci FROM c)"""


SHOWN = f"player_id, match_id, status, members_present, {s3('prediction')} AS prediction, {s3('lowerci')} AS lowerci, " \
        f"{s3('upperci')} AS upperci"


def _shown(df):
    return df.withColumns({c: r3(c) for c in ("prediction", "lowerci", "upperci")})


@query("ensemble_combine", f"{_combine_sql('renormalize')} SELECT {SHOWN} FROM en")
def ensemble_combine(spark, sf):
    return _shown(ensemble.combine(stacked(spark, sf), CONFIGURED, 2))


@query("ensemble_combine_emit_none", f"{_combine_sql('emit_none')} SELECT {SHOWN} FROM en")
def ensemble_combine_emit_none(spark, sf):
    return _shown(ensemble.combine(stacked(spark, sf), CONFIGURED, 2, policy=ensemble.EMIT_NONE))


@query("ensemble_census", f"""{_combine_sql('renormalize')} SELECT count(*) AS rows_read,
  count(*) FILTER (status = 'complete') AS complete_rows, count(*) FILTER (status = 'renormalized') AS renormalized_rows,
  count(*) FILTER (status = 'skipped') AS skipped_rows FROM en""")
def ensemble_census(spark, sf):
    return ensemble.combine_census(ensemble.combine(stacked(spark, sf), CONFIGURED, 2))


COMPLETE_SQL = MEMBERS_SQL + """,
cr AS (SELECT a.player_id, a.match_id, a.fold_number, a.target_value AS y, a.prediction AS a, f.prediction AS b
       FROM mb a JOIN mb f ON f.member = 'form' AND a.member = 'baseline' AND a.player_id = f.player_id
            AND a.match_id = f.match_id WHERE a.prediction IS NOT NULL AND f.prediction IS NOT NULL)
"""

# two members: the minimum of a parabola in the first weight, kept within [0, 1]
SQUARED_SQL = COMPLETE_SQL + """,
gs AS (SELECT cal.fold_number, coalesce(sum(a * a), 0) AS aa, coalesce(sum(a * b), 0) AS ab,
              coalesce(sum(b * b), 0) AS bb, coalesce(sum(a * y), 0) AS ay, coalesce(sum(b * y), 0) AS cy
       FROM cal LEFT JOIN cr ON cr.fold_number < cal.fold_number GROUP BY 1),
sq AS (SELECT fold_number, CASE WHEN aa - 2 * ab + bb > 1e-12 * (aa + bb)
         THEN least(greatest((ay - cy + bb - ab) / (aa - 2 * ab + bb), 0), 1) ELSE 0.6::DOUBLE END AS w0 FROM gs),
sw AS (SELECT fold_number, w0, 1 - w0 AS w1 FROM sq)
"""


def _complete(spark, sf):
    return ensemble.complete_rows(stacked(spark, sf), MEMBERS)


def _weights(spark, sf, fit):
    cal = walkforward.calendar_frame(spark, FOLDS)
    return fit(_complete(spark, sf), cal, MEMBERS, CONFIGURED)


@query("oof_weights_squared", f"""WITH RECURSIVE {SQUARED_SQL}
SELECT fold_number, {s6('w0')} AS w0, {s6('w1')} AS w1 FROM sw""")
def oof_weights_squared(spark, sf):
    out = _weights(spark, sf, ensemble.squared_weights)
    return out.select("fold_number", r6("w0").alias("w0"), r6("w1").alias("w1"))


ABSOLUTE_SQL = COMPLETE_SQL + """,
ar AS (SELECT cal.fold_number, greatest(0, least(1, (y - b) / (a - b))) AS r, abs(a - b) AS wt
       FROM cal JOIN cr ON cr.fold_number < cal.fold_number AND a <> b),
ac AS (SELECT fold_number, r, sum(wt) OVER (PARTITION BY fold_number ORDER BY r) AS upto,
              sum(wt) OVER (PARTITION BY fold_number) AS total FROM ar),
am AS (SELECT fold_number, min(r) AS w FROM ac WHERE upto >= total / 2 GROUP BY 1),
aw AS (SELECT cal.fold_number, coalesce(w, 0.6) AS w0, coalesce(1 - w, 0.4) AS w1 FROM cal LEFT JOIN am USING (fold_number))
"""


@query("oof_weights_absolute", f"WITH {ABSOLUTE_SQL} SELECT fold_number, {s6('w0')} AS w0, {s6('w1')} AS w1 FROM aw")
def oof_weights_absolute(spark, sf):
    out = _weights(spark, sf, ensemble.absolute_weights)
    return out.select("fold_number", r6("w0").alias("w0"), r6("w1").alias("w1"))


# w0 over a grid of 21 points for each earlier-fold set: the general form used for three or more members
@query("oof_weights_grid", f"""WITH {COMPLETE_SQL},
gp AS (SELECT range AS i, range / 20.0::DOUBLE AS w FROM range(21)),
gl AS (SELECT cal.fold_number, i, w, sum(abs(w * a + (1 - w) * b - y)) AS loss
       FROM cal JOIN cr ON cr.fold_number < cal.fold_number CROSS JOIN gp GROUP BY ALL),
gb AS (SELECT fold_number, arg_min(w, loss) AS w FROM gl GROUP BY 1)
SELECT cal.fold_number, {s6('coalesce(w, 0.6)')} AS w0, {s6('coalesce(1 - w, 0.4)')} AS w1
FROM cal LEFT JOIN gb USING (fold_number)""")
def oof_weights_grid(spark, sf):
    cal = walkforward.calendar_frame(spark, FOLDS)
    out = ensemble._grid_weights(_complete(spark, sf), cal, MEMBERS, CONFIGURED, 0.05)
    return out.select("fold_number", r6("w0").alias("w0"), r6("w1").alias("w1"))


# three members: the fitted loss lies within the gap of the least one, never above the best single member
@query("oof_weights_three", f"""WITH {MEMBERS_SQL},
c3 AS (SELECT a.fold_number, a.target_value AS y, a.prediction AS a, b.rolling_mean_3 AS m, b.rolling_mean_5 AS l
       FROM base a JOIN b USING (match_id) WHERE a.prediction IS NOT NULL AND a.target_value IS NOT NULL AND b.rolling_mean_3 IS NOT NULL AND b.rolling_mean_5 IS NOT NULL)
SELECT cal.fold_number, count(y) AS rows, round(least(avg(abs(a - y)), avg(abs(m - y)), avg(abs(l - y))) + 1e-9, 3) AS best_single,
  true AS on_simplex, true AS within_gap, CASE WHEN count(y) > 0 THEN true END AS no_worse
FROM cal LEFT JOIN c3 ON c3.fold_number < cal.fold_number GROUP BY 1""")
def oof_weights_three(spark, sf):
    rows = panel(spark, sf)
    tested = walkforward.test_rows(rows, FOLDS)

    def member(column):
        return tested.select("player_id", "match_id", *CARRIED, F.col(column).alias("prediction"), F.lit(None).alias("lowerci"), F.lit(None).alias("upperci"))

    names = ["baseline", "short", "long"]
    frames = {"baseline": baseline_oof(spark, sf, rows), "short": member("rolling_mean_3"), "long": member("rolling_mean_5")}
    complete = ensemble.complete_rows(ensemble.stack_members(frames, CARRIED), names)
    cal = walkforward.calendar_frame(spark, FOLDS)
    fitted = ensemble.cut_weights(complete, cal, names, {"baseline": 0.4, "short": 0.3, "long": 0.3})
    errors = complete.groupBy("fold_number").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.abs(F.col(f"p{i}") - F.col("y"))).alias(f"e{i}") for i in range(3)])
    earlier = fitted.join(errors.withColumnRenamed("fold_number", "past"), F.col("past") < F.col("fold_number"), "left")  # one row per pair of folds
    out = earlier.groupBy("fold_number", "w0", "w1", "w2", "loss", "gap").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *[(F.sum(f"e{i}") / F.sum("n")).alias(f"e{i}") for i in range(3)])
    single = F.col("single")
    return out.withColumn("single", F.least("e0", "e1", "e2")).select("fold_number", "rows", r3("single").alias("best_single"), ((F.abs(F.col("w0") + F.col("w1") + F.col("w2") - 1) < 1e-9) & (F.least("w0", "w1", "w2") >= -1e-12)).alias("on_simplex"),
                      F.coalesce(F.col("gap") <= 1e-6, F.lit(True)).alias("within_gap"), (F.col("loss") <= single * (1 + 1e-9)).alias("no_worse"))


FOLD_ENSEMBLE_SQL = ABSOLUTE_SQL + """,
fw AS (SELECT mb.*, CASE member WHEN 'baseline' THEN w0 ELSE w1 END AS w FROM mb JOIN aw USING (fold_number)),
fg AS (SELECT player_id, match_id, fold_number, max(target_value) AS target_value, sum(w * prediction) AS sp,
         sum(w) AS wp, sum(w * lowerci) FILTER (lowerci IS NOT NULL) AS sl, sum(w) FILTER (lowerci IS NOT NULL) AS wl,
         sum(w * upperci) FILTER (upperci IS NOT NULL) AS su, sum(w) FILTER (upperci IS NOT NULL) AS wu
       FROM fw GROUP BY ALL),
fr AS (SELECT *, sp / nullif(wp, 0) AS prediction, sl / nullif(wl, 0) AS l, su / nullif(wu, 0) AS u FROM fg),
fe AS (SELECT player_id, match_id, fold_number, target_value, prediction,
         CASE WHEN l IS NOT NULL THEN greatest(0, least(l, prediction)) END AS lowerci,
         CASE WHEN u IS NOT NULL THEN greatest(u, prediction) END AS upperci FROM fr)
"""


def fold_ensemble(spark, sf):
    rows = stacked(spark, sf)
    cal = walkforward.calendar_frame(spark, FOLDS)
    weights = ensemble.absolute_weights(ensemble.complete_rows(rows, MEMBERS), cal, MEMBERS, CONFIGURED)
    keys = [*ensemble.KEYS, *CARRIED]
    return ensemble.combine(rows, ensemble.long_weights(weights, MEMBERS), 2, keys=keys)


@query("ensemble_fold_predictions", f"""WITH {FOLD_ENSEMBLE_SQL}
SELECT player_id, match_id, fold_number, {s3('prediction')} AS prediction, {s3('lowerci')} AS lowerci,
  {s3('upperci')} AS upperci FROM fe""")
def ensemble_fold_predictions(spark, sf):
    return _shown(fold_ensemble(spark, sf).drop("status", "members_present", "target_value"))


@query("ensemble_fold_scores", f"""WITH {FOLD_ENSEMBLE_SQL}
SELECT coalesce(fold_number, 0) AS fold_number, count(*) AS row_count, {s3('avg(abs(prediction - target_value))')} AS mae,
  {s3('avg(prediction - target_value)')} AS mean_bias FROM fe WHERE prediction IS NOT NULL
GROUP BY GROUPING SETS ((fold_number), ())""")
def ensemble_fold_scores(spark, sf):
    rows = fold_ensemble(spark, sf).where("prediction IS NOT NULL").withColumn("modelversion", F.lit("ensemble"))
    out = scoring.score(rows, by=["modelversion"])
    return out.select("fold_number", "row_count", r3("mae").alias("mae"), r3("mean_bias").alias("mean_bias"))


@query("weight_summary", f"""WITH RECURSIVE {ABSOLUTE_SQL}, {SQUARED_SQL.removeprefix(COMPLETE_SQL).lstrip(', ')},
x AS (SELECT 'absolute' AS objective, * FROM aw UNION ALL SELECT 'squared', * FROM sw),
y AS (SELECT objective, 'baseline' AS member, w0 AS w FROM x UNION ALL SELECT objective, 'form', w1 FROM x)
SELECT '{TARGET}' AS stat_target, objective, member, count(*) AS folds, {s6('avg(w)')} AS mean_weight,
  {s6('min(w)')} AS min_weight, {s6('max(w)')} AS max_weight FROM y GROUP BY ALL""")
def weight_summary(spark, sf):
    cal = walkforward.calendar_frame(spark, FOLDS)
    rows = _complete(spark, sf)
    log = None
    for objective, fit in (("absolute", ensemble.absolute_weights), ("squared", ensemble.squared_weights)):
        w = fit(rows, cal, MEMBERS, CONFIGURED).withColumn("stat_target", F.lit(TARGET))
        part = scoring.melt_weights(w, ["stat_target", "fold_number"], objective, {"baseline": "w0", "form": "w1"})
        log = part if log is None else log.unionByName(part)
    out = scoring.weight_summary(log)
    return out.withColumns({c: r6(c) for c in ("mean_weight", "min_weight", "max_weight")})


@query("objective_comparison", f"""WITH RECURSIVE {ABSOLUTE_SQL}, {SQUARED_SQL.removeprefix(COMPLETE_SQL).lstrip(', ')},
e AS (SELECT 'absolute' AS o, abs((w0 * a + w1 * b) / (w0 + w1) - y) AS e FROM cr JOIN aw USING (fold_number)
      UNION ALL SELECT 'squared', abs((w0 * a + w1 * b) / (w0 + w1) - y) FROM cr JOIN sw USING (fold_number))
SELECT '{TARGET}' AS stat_target, {s3("avg(e) FILTER (o = 'absolute')")} AS mae_absolute,
  {s3("avg(e) FILTER (o = 'squared')")} AS mae_squared FROM e""")
def objective_comparison(spark, sf):
    """Pooled error of each objective's fold weights on the rows every member predicts."""
    cal = walkforward.calendar_frame(spark, FOLDS)
    rows = _complete(spark, sf)
    log = None
    for objective, fit in (("absolute", ensemble.absolute_weights), ("squared", ensemble.squared_weights)):
        w = F.broadcast(fit(rows, cal, MEMBERS, CONFIGURED))  # one row per fold
        error = F.abs((F.col("w0") * F.col("p0") + F.col("w1") * F.col("p1")) / (F.col("w0") + F.col("w1")) - F.col("y"))
        part = rows.join(w, "fold_number").agg(F.avg(error).alias("metric_value")).select(
            F.lit(TARGET).alias("stat_target"), F.lit(0).alias("fold_number"),
            F.lit(f"mae_{objective}_objective").alias("metric"), "metric_value")
        log = part if log is None else log.unionByName(part)
    out = scoring.objective_comparison(log)
    return out.withColumns({c: r3(c) for c in ("mae_absolute", "mae_squared")})
