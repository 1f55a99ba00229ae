"""Strictly-prior features and their audits over the H view."""

from __future__ import annotations

from pyspark.sql import functions as F

from antecede.catalog.registry import query, r6, s6
from antecede.catalog.views import H_SQL, history
from antecede.operators import pit, quality
from antecede.plans.features import FeatureConfig, Target, backfill_from_json, build_features, expand_json, \
    feature_json, safe_ratio
from antecede.plans.recheck import disagreements, recompute_features
from antecede.session import ensure_checkpoint_dir

ORDER = ["match_id"]
PIT = dict(order=ORDER, eligible="completed")

CONFIG = FeatureConfig(
    sport="events", feature_version="v1", rolling_windows=(3, 5, 10, 20), minimum_history=5,
    category_column="category", category_window=20, rate_window=10,
    targets=[
        Target("amount", "amount", ("amount", "units"), ("units", "k"), rate_output="rolling_amount_per_unit",
               opponent_output="opponent_amount_conceded_rate"),
        Target("units", "units", ("units", "amount"), ("units", "k"), rate_output="rolling_units_per_amount",
               opponent_output="opponent_units_conceded_rate"),
    ],
    context={"slot": "slot", "category": "category", "rating": "k", "opponent_rating": "opponent_k"},
    derived={"rating_difference": ("k", "opponent_k")},
)


def _prior_sql(columns: str, where: str, extra: str = "") -> str:
    """One row per H row: aggregates of its eligible prior rows passing ``where``, newest first."""
    return f"""WITH {H_SQL},
p AS (SELECT r.match_id, r.player_id, x.amount, x.units, x.k AS x_k, x.is_winner,
             row_number() OVER (PARTITION BY r.match_id, r.player_id
                                ORDER BY x.event_date DESC, x.match_id DESC) AS k
      FROM h r JOIN h x ON x.player_id = r.player_id AND x.event_date < r.event_date AND x.completed AND {where}),
a AS (SELECT match_id, player_id, {columns} FROM p GROUP BY match_id, player_id)
SELECT h.match_id, h.player_id, {extra} FROM h LEFT JOIN a USING (match_id, player_id)"""


def _both(names: list[str]) -> str:
    return ", ".join(f"{s6(n)} AS {n}" for n in names)


WINDOWS = (3, 5, 10, 20)


def _rolling(agg: str, sql_agg: str):
    names = [f"rolling_{agg}_{n}" for n in WINDOWS]
    sql = _prior_sql(", ".join(f"{sql_agg}(units) FILTER (k <= {n}) AS rolling_{agg}_{n}" for n in WINDOWS),
                     "x.units IS NOT NULL", _both(names))

    def run(spark, sf):
        prior = pit.Prior(("player_id",), "units", {f"rolling_{agg}_{n}": (agg, n) for n in WINDOWS})
        out = pit.strict_prior(history(spark, sf), [prior], anchor=["player_id"], date="event_date", **PIT)
        return out.select("match_id", "player_id", *[r6(n).alias(n) for n in names])

    query(f"rolling_{agg}", sql)(run)


_rolling("mean", "avg")
_rolling("std", "stddev_samp")
_rolling("median", "median")


@query("rolling_by_category", _prior_sql(
    "avg(amount) FILTER (k <= 5) AS category_mean, count(*) FILTER (k <= 5) AS n",
    "x.category = r.category", f"{s6('category_mean')} AS category_mean, coalesce(n, 0) AS n_observations"))
def rolling_by_category(spark, sf):
    out = pit.rolling_by_category(history(spark, sf), "player_id", "event_date", "amount", "category", 5,
                                  out="category_mean", **PIT)
    return out.select("match_id", "player_id", r6("category_mean").alias("category_mean"), "n_observations")


@query("rest_days", f"""WITH {H_SQL}
SELECT r.match_id, r.player_id, (r.event_date - max(x.event_date))::INT AS rest_days
FROM h r LEFT JOIN h x ON x.player_id = r.player_id AND x.event_date < r.event_date
GROUP BY r.match_id, r.player_id, r.event_date""")
def rest_days(spark, sf):
    out = pit.days_since_previous(history(spark, sf), "player_id", "event_date")
    return out.select("match_id", "player_id", "rest_days")


@query("head_to_head", _prior_sql(
    "avg(units) AS a, avg(is_winner::INT) AS w, count(*) AS n", "x.opponent_id = r.opponent_id",
    f"{s6('a')} AS head_to_head_average, {s6('w')} AS head_to_head_win_rate, "
    "coalesce(n, 0) AS head_to_head_matches"))
def head_to_head(spark, sf):
    out = pit.head_to_head(history(spark, sf), "player_id", "opponent_id", "event_date", "units", "is_winner",
                           eligible="completed")
    return out.select("match_id", "player_id", r6("head_to_head_average").alias("head_to_head_average"),
                      r6("head_to_head_win_rate").alias("head_to_head_win_rate"), "head_to_head_matches")


@query("opponent_form", f"""WITH {H_SQL},
c AS (SELECT r.*, o.units AS conceded FROM h r LEFT JOIN h o
      ON o.match_id = r.match_id AND o.player_id = r.opponent_id),
p AS (SELECT r.match_id, r.player_id, x.conceded, row_number() OVER (
             PARTITION BY r.match_id, r.player_id ORDER BY x.event_date DESC, x.match_id DESC) AS k
      FROM c r JOIN c x ON x.player_id = r.player_id AND x.event_date < r.event_date AND x.completed
           AND x.conceded IS NOT NULL),
f AS (SELECT match_id, player_id, avg(conceded) AS form, count(*) AS n FROM p WHERE k <= 10 GROUP BY ALL)
SELECT c.match_id, c.player_id, c.conceded, {s6('f.form')} AS opponent_form, coalesce(f.n, 0) AS n_observations
FROM c LEFT JOIN f ON f.match_id = c.match_id AND f.player_id = c.opponent_id""")
def opponent_form(spark, sf):
    h = pit.opponent_value(history(spark, sf), "match_id", "player_id", "opponent_id", {"conceded": "units"})
    out = pit.opponent_rolling(h, "match_id", "player_id", "opponent_id", "event_date", "conceded", 10,
                               out="opponent_form", **PIT)
    return out.select("match_id", "player_id", "conceded", r6("opponent_form").alias("opponent_form"),
                      "n_observations")


@query("career_to_date", _prior_sql(
    "avg(units) AS m, stddev_samp(units) AS s, count(units) AS n", "true",
    f"{s6('m')} AS career_mean, {s6('s')} AS career_std, coalesce(n, 0) AS n_observations"))
def career_to_date(spark, sf):
    prior = pit.Prior(("player_id",), "units", {"career_mean": ("mean", None), "career_std": ("std", None)},
                      {"n_observations": None})
    out = pit.strict_prior(history(spark, sf), [prior], anchor=["player_id"], date="event_date", **PIT)
    return out.select("match_id", "player_id", r6("career_mean").alias("career_mean"),
                      r6("career_std").alias("career_std"), "n_observations")


@query("career_median", _prior_sql(
    "median(amount) AS m, median(units) AS u", "true", f"{s6('m')} AS career_median, {s6('u')} AS units_median"))
def career_median(spark, sf):
    priors = [pit.Prior(("player_id",), "amount", {"career_median": ("median", None)}),
              pit.Prior(("player_id",), "units", {"units_median": ("median", None)})]
    out = pit.strict_prior(history(spark, sf), priors, anchor=["player_id"], date="event_date", **PIT)
    return out.select("match_id", "player_id", r6("career_median").alias("career_median"), r6("units_median").alias("units_median"))


@query("rolling_rate", _prior_sql(
    "avg(amount / units) FILTER (k <= 10) AS r", "x.units > 0", f"{s6('r')} AS rolling_rate"))
def rolling_rate(spark, sf):
    h = history(spark, sf).withColumn("ratio", safe_ratio("amount", "units"))
    out = pit.rolling_stat(h, "player_id", "event_date", "ratio", 10, "mean", out="rolling_rate", **PIT)
    return out.select("match_id", "player_id", r6("rolling_rate").alias("rolling_rate"))


@query("rolling_percentage", _prior_sql(
    "avg(100.0 * units / x_k) FILTER (k <= 10) AS r", "x.units IS NOT NULL AND x.k > 0",
    f"{s6('r')} AS rolling_percentage"))
def rolling_percentage(spark, sf):
    h = history(spark, sf).withColumn("ratio", safe_ratio(F.col("units") * 100.0, F.col("k")))
    out = pit.rolling_stat(h, "player_id", "event_date", "ratio", 10, "mean", out="rolling_percentage", **PIT)
    return out.select("match_id", "player_id", r6("rolling_percentage").alias("rolling_percentage"))


@query("hot_key_history", _prior_sql(
    "avg(amount) FILTER (k <= 10) AS m, stddev_samp(amount) AS s, count(*) AS n", "true",
    f"{s6('m')} AS rolling_mean_10, {s6('s')} AS career_std, coalesce(n, 0) AS n_observations"))
def hot_key_history(spark, sf):
    """The same operator with every key above the size limit: the (key, day) path."""
    prior = pit.Prior(("player_id",), "amount", {"rolling_mean_10": ("mean", 10), "career_std": ("std", None)},
                      {"n_observations": None})
    out = pit.strict_prior(history(spark, sf), [prior], anchor=["player_id"], date="event_date", hot_rows=1, **PIT)
    return out.select("match_id", "player_id", r6("rolling_mean_10").alias("rolling_mean_10"),
                      r6("career_std").alias("career_std"), "n_observations")


# --- full build -----------------------------------------------------------------------------------

def _target_sql(name: str, value: str, rate: str, rate_ok: str, rate_out: str, other_rate: str, opp_out: str,
                other_opp: str) -> str:
    rolls = ", ".join(
        f"{fn}(v) FILTER (v IS NOT NULL AND kv <= {n}) AS rolling_{a}_{n}"
        for a, fn in (("mean", "avg"), ("std", "stddev_samp")) for n in WINDOWS)
    roll_names = ", ".join(f"{s6(f'a.rolling_{a}_{n}')} AS rolling_{a}_{n}" for a in ("mean", "std") for n in WINDOWS)
    order = "ORDER BY x.event_date DESC, x.match_id DESC"
    me = "r.match_id, r.player_id"
    return f"""
{name}_p AS (
  SELECT {me}, x.event_date AS xd, x.{value} AS v, x.opponent_id = r.opponent_id AS same_opp, x.is_winner,
    x.category = r.category AS same_cat, CASE WHEN {rate_ok} THEN {rate} END AS rate,
    CASE WHEN x.k > 0 THEN x.units / CAST(x.k AS DOUBLE) END AS pct, o.{value} AS conceded,
    row_number() OVER (PARTITION BY {me}, x.{value} IS NOT NULL {order}) AS kv,
    row_number() OVER (PARTITION BY {me}, x.{value} IS NOT NULL, x.category = r.category {order}) AS kc,
    row_number() OVER (PARTITION BY {me}, coalesce({rate_ok} AND x.units IS NOT NULL, false) {order}) AS kr,
    row_number() OVER (PARTITION BY {me}, coalesce(x.k > 0 AND x.units IS NOT NULL, false) {order}) AS kp,
    row_number() OVER (PARTITION BY {me}, o.{value} IS NOT NULL {order}) AS ko
  FROM h r JOIN h x ON x.player_id = r.player_id AND x.event_date < r.event_date AND x.completed
  LEFT JOIN h o ON o.match_id = x.match_id AND o.player_id = x.opponent_id),
{name}_a AS (
  SELECT match_id, player_id, {rolls},
    avg(v) FILTER (same_cat AND v IS NOT NULL AND kc <= 20) AS cm,
    count(v) FILTER (same_cat AND kc <= 20) AS cn,
    avg(rate) FILTER (rate IS NOT NULL AND kr <= 10) AS rr,
    avg(pct) FILTER (pct IS NOT NULL AND kp <= 10) AS pp,
    avg(v) FILTER (same_opp) AS ha, avg(is_winner::INT) FILTER (same_opp) AS hw, count(*) FILTER (same_opp) AS hm,
    avg(conceded) FILTER (conceded IS NOT NULL AND ko <= 10) AS form, avg(v) AS cd, count(v) AS n
  FROM {name}_p GROUP BY match_id, player_id),
{name}_d AS (SELECT r.match_id, r.player_id, (r.event_date - max(x.event_date))::INT AS rest
  FROM h r LEFT JOIN h x ON x.player_id = r.player_id AND x.event_date < r.event_date
  GROUP BY r.match_id, r.player_id, r.event_date),
{name}_o AS (
  SELECT h.player_id, h.match_id, h.event_date, 'events' AS sport, 'v1' AS feature_version, '{name}' AS stat_target,
    {roll_names}, {s6('a.cm')} AS category_rolling_mean, coalesce(a.cn, 0) AS category_rolling_n_observations,
    {s6('a.rr')} AS {rate_out}, CAST(NULL AS DOUBLE) AS {other_rate}, {s6('a.pp')} AS rolling_percentage,
    d.rest AS rest_days, {s6('a.ha')} AS head_to_head_average, coalesce(a.hm, 0) AS head_to_head_matches,
    {s6('a.hw')} AS head_to_head_win_rate, {s6('f.form')} AS {opp_out}, CAST(NULL AS DOUBLE) AS {other_opp},
    {s6('a.cd')} AS career_to_date_mean, coalesce(a.n, 0) AS history_observations, h.slot, h.category,
    h.k AS rating, h.opponent_k AS opponent_rating, CAST(h.k - h.opponent_k AS DOUBLE) AS rating_difference,
    CAST(h.{value} AS DOUBLE) AS target_value, coalesce(a.n, 0) >= 5 AS has_sufficient_history,
    coalesce(a.n, 0) >= 5 AND h.completed AND h.{value} IS NOT NULL AS is_training_eligible
  FROM h JOIN {name}_d d ON d.match_id = h.match_id AND d.player_id = h.player_id
  LEFT JOIN {name}_a a ON a.match_id = h.match_id AND a.player_id = h.player_id
  LEFT JOIN {name}_a f ON f.match_id = h.match_id AND f.player_id = h.opponent_id)"""


BUILD_SQL = H_SQL + "," + _target_sql(
    "amount", "amount", "x.amount / x.units", "x.units > 0", "rolling_amount_per_unit", "rolling_units_per_amount",
    "opponent_amount_conceded_rate", "opponent_units_conceded_rate") + "," + _target_sql(
    "units", "units", "x.units / x.amount", "x.amount > 0", "rolling_units_per_amount", "rolling_amount_per_unit",
    "opponent_units_conceded_rate", "opponent_amount_conceded_rate")

FLOATS = [c for c in CONFIG.feature_columns if c not in (
    "category_rolling_n_observations", "rest_days", "head_to_head_matches", "history_observations", "slot",
    "category", "rating", "opponent_rating")]


def built(spark, sf):
    return build_features(history(spark, sf), CONFIG)


@query("feature_build", f"WITH {BUILD_SQL} SELECT * FROM amount_o UNION ALL BY NAME SELECT * FROM units_o")
def feature_build(spark, sf):
    return built(spark, sf).withColumns({c: r6(c) for c in FLOATS})


@query("feature_vector_json", f"""WITH {H_SQL},
n AS (SELECT r.match_id, r.player_id, count(x.units) AS n, (r.event_date - max(x.event_date))::INT AS d
      FROM h r LEFT JOIN (SELECT * FROM h) x ON x.player_id = r.player_id AND x.event_date < r.event_date
      GROUP BY r.match_id, r.player_id, r.event_date)
SELECT h.match_id, h.player_id, '{{"rest_days":' || coalesce(d::VARCHAR, 'null') || ',"units":'
       || coalesce(units::VARCHAR, 'null') || ',"category":"' || category || '"}}' AS feature_values,
       d AS rest_days, units, category
FROM h JOIN n ON n.match_id = h.match_id AND n.player_id = h.player_id""")
def feature_vector_json(spark, sf):
    """Vector to JSON, and the keys read back out of it."""
    h = pit.days_since_previous(history(spark, sf), "player_id", "event_date")
    packed = h.select("match_id", "player_id", feature_json(["rest_days", "units", "category"]).alias("feature_values"))
    return expand_json(packed, "feature_values", {"rest_days": "int", "units": "int", "category": "string"})


@query("feature_backfill", f"""WITH {H_SQL}
SELECT match_id, player_id, coalesce(units, k) AS k, category FROM h""")
def feature_backfill(spark, sf):
    """Typed column where it has a value, else out of the JSON vector."""
    h = history(spark, sf).withColumn("feature_values", feature_json(["k", "category"]))
    typed = h.select("match_id", "player_id", F.col("units").alias("k"), "feature_values")
    out = backfill_from_json(typed, "feature_values", {"k": "int", "category": "string"})
    return out.select("match_id", "player_id", "k", "category")


# --- audits ---------------------------------------------------------------------------------------

@query("leakage_recompute", f"""WITH {H_SQL},
r AS (SELECT * FROM h ORDER BY md5(match_id || '-' || player_id), match_id, player_id LIMIT 50),
p AS (SELECT r.match_id, r.player_id, x.units,
             row_number() OVER (PARTITION BY r.match_id, r.player_id ORDER BY x.event_date DESC, x.match_id DESC) AS k
      FROM r JOIN h x ON x.player_id = r.player_id AND x.event_date < r.event_date AND x.completed AND x.units IS NOT NULL),
a AS (SELECT match_id, player_id, avg(units) FILTER (k <= 5) AS m, stddev_samp(units) AS s, count(*) AS n FROM p GROUP BY ALL)
SELECT r.match_id, r.player_id, {s6('m')} AS rolling_mean_5, {s6('s')} AS career_std, coalesce(n, 0) AS n, true AS agrees
FROM r LEFT JOIN a USING (match_id, player_id)""")
def leakage_recompute(spark, sf):
    """Fifty sampled rows recomputed by a join, next to the window result over the whole table."""
    prior = pit.Prior(("player_id",), "units", {"rolling_mean_5": ("mean", 5), "career_std": ("std", None)}, {"n": None})
    h = history(spark, sf)
    built_rows = pit.strict_prior(h, [prior], anchor=["player_id"], date="event_date", **PIT)
    rows = quality.ordered_sample(built_rows, ["match_id", "player_id"], 50)
    again = quality.recompute(rows, h, prior, row_id=["match_id", "player_id"], date="event_date", **PIT)
    again = again.toDF("match_id", "player_id", *[f"x_{c}" for c in again.columns[2:]])
    both = rows.join(again, ["match_id", "player_id"])
    agrees = (quality.close(F.col("rolling_mean_5"), F.col("x_rolling_mean_5"))
              & quality.close(F.col("career_std"), F.col("x_career_std")) & (F.col("n") == F.col("x_n")))
    return both.select("match_id", "player_id", r6("x_rolling_mean_5").alias("rolling_mean_5"),
                       r6("x_career_std").alias("career_std"), F.col("x_n").alias("n"), agrees.alias("agrees"))


@query("leakage_every_feature", f"""WITH {BUILD_SQL},
s AS (SELECT match_id, player_id FROM h ORDER BY md5(match_id || '-' || player_id), match_id, player_id LIMIT 50),
f AS (SELECT * FROM amount_o UNION ALL BY NAME SELECT * FROM units_o)
SELECT f.* EXCLUDE (event_date, sport, feature_version), '' AS wrong FROM f JOIN s USING (match_id, player_id)""")
def leakage_every_feature(spark, sf):
    """Every feature and flag of both targets for fifty sampled rows, recomputed by as-of joins, next to the built table."""
    h = history(spark, sf)
    keys = ["match_id", "player_id"]
    ensure_checkpoint_dir(spark)
    rows = F.broadcast(quality.ordered_sample(h, keys, 50).select(*keys).checkpoint())  # fifty rows, read by several joins
    expected = recompute_features(rows, h, CONFIG).checkpoint()
    out = disagreements(built(spark, sf).join(rows, keys, "left_semi"), expected, [*keys, "stat_target"])
    return out.withColumns({**{c: r6(c) for c in FLOATS}, "wrong": F.concat_ws(",", "wrong")})


@query("history_without_value", _prior_sql(
    "avg(units) FILTER (k <= 5) AS m, stddev_samp(units) FILTER (k <= 5) AS s, count(units) AS n", "x.units IS NOT NULL",
    "coalesce(n, 0) AS n").replace("SELECT h.match_id, h.player_id, coalesce(n, 0) AS n FROM", """SELECT
  count(*) FILTER (n >= 1 AND m IS NULL) AS no_mean, count(*) FILTER (n >= 2 AND s IS NULL) AS no_std,
  count(*) FILTER (n >= 1 AND s IS NULL) AS one_observation FROM"""))
def history_without_value(spark, sf):
    """Rows with history but without its mean or deviation: none; a single observation has no deviation and shows that rows are counted."""
    prior = pit.Prior(("player_id",), "units", {"m": ("mean", 5), "s": ("std", 5)}, {"n": None})
    rows = pit.strict_prior(history(spark, sf), [prior], anchor=["player_id"], date="event_date", **PIT)
    checks = {"no_mean": ("m", 1), "no_std": ("s", 2), "one_observation": ("s", 1)}
    found = [quality.history_without_value(rows, "n", value, least).select(F.lit(name).alias("name")) for name, (value, least) in checks.items()]
    found = found[0].unionByName(found[1]).unionByName(found[2])
    return found.agg(*[F.count_if(F.col("name") == name).alias(name) for name in checks])


@query("first_event_null", f"""WITH {H_SQL},
first AS (SELECT player_id, min(event_date) AS d FROM h GROUP BY 1)
SELECT count(*) AS first_rows, 0 AS violations FROM h JOIN first USING (player_id) WHERE event_date = d""")
def first_event_null(spark, sf):
    prior = pit.Prior(("player_id",), "units", {"m": ("mean", 5)}, {"n": None})
    rows = pit.strict_prior(history(spark, sf), [prior], anchor=["player_id"], date="event_date",
                            rest={"rest_days": ("player_id",)}, **PIT)
    first = rows.groupBy("player_id").agg(F.min("event_date").alias("first_date"))
    bad = quality.first_event_violations(rows, "player_id", "event_date", ["m", "rest_days"], ["n"])
    n_bad = bad.agg(F.count(F.lit(1)).cast("int").alias("violations"))
    n_first = rows.join(first, "player_id").where("event_date = first_date").agg(F.count(F.lit(1)).alias("first_rows"))
    return n_first.crossJoin(n_bad)


@query("perturbation_invariance", "SELECT 0 AS changed_rows, 2 AS compared_rows")
def perturbation_invariance(spark, sf):
    """Shift the newest row's target by 10,000: none of its own features may move."""
    h = history(spark, sf)
    row = h.agg(F.max_by(F.struct("match_id", "player_id", "opponent_id", "event_date"),
                         F.struct("event_date", "match_id", "player_id")).alias("r")).first().r.asDict()
    changed = quality.perturbation_changes(
        lambda m: build_features(m, CONFIG), h, row, "amount", player="player_id", opponent="opponent_id",
        date="event_date", row_id=["match_id", "player_id"],
        compare=["stat_target", *CONFIG.feature_columns])
    # the row has one feature row per target; without them nothing would be compared
    compared = build_features(h, CONFIG).where((F.col("match_id") == row["match_id"]) & (F.col("player_id") == row["player_id"]))
    return changed.agg(F.count(F.lit(1)).cast("int").alias("changed_rows")).crossJoin(
        compared.agg(F.count(F.lit(1)).cast("int").alias("compared_rows")))


GUARDED = [c for c in CONFIG.feature_columns if c != "category"]  # every number; the category is text


_CORR = "nullif(corr({0}, target_value), 'nan'::DOUBLE)"  # a constant column has no correlation


@query("target_correlation", f"""WITH {BUILD_SQL},
f AS (SELECT * FROM amount_o UNION ALL BY NAME SELECT * FROM units_o)
""" + " UNION ALL ".join(
    f"SELECT stat_target, '{c}' AS feature, {s6(f'abs({_CORR.format(c)})')} AS abs_correlation, "
    f"coalesce(abs({_CORR.format(c)}) > 0.99, false) AS suspicious FROM f GROUP BY stat_target"
    for c in GUARDED))
def target_correlation(spark, sf):
    out = quality.correlation_guard(built(spark, sf), GUARDED, "target_value", ["stat_target"])
    return out.withColumn("abs_correlation", r6("abs_correlation"))


@query("feature_null_rates", f"""WITH {BUILD_SQL},
f AS (SELECT * FROM amount_o UNION ALL BY NAME SELECT * FROM units_o)
""" + " UNION ALL ".join(
    f"SELECT stat_target, '{c}' AS feature, {s6(f'100.0 * avg(({c} IS NULL)::INT)')} AS null_pct FROM f "
    "GROUP BY stat_target" for c in CONFIG.feature_columns))
def feature_null_rates(spark, sf):
    return quality.null_rates(built(spark, sf), CONFIG.feature_columns, ["stat_target"]).withColumn("null_pct", r6("null_pct"))


@query("target_distribution", f"""WITH {H_SQL},
t AS (SELECT 'amount' AS stat_target, amount AS v FROM h UNION ALL SELECT 'units', units FROM h)
SELECT stat_target, count(v) AS count, {s6('avg(v)')} AS mean, {s6('stddev_samp(v)')} AS std,
       {s6('min(v)')} AS min, {s6('quantile_cont(v, 0.25)')} AS q25, {s6('quantile_cont(v, 0.5)')} AS q50,
       {s6('quantile_cont(v, 0.75)')} AS q75, {s6('max(v)')} AS max FROM t GROUP BY stat_target""")
def target_distribution(spark, sf):
    from antecede.plans.features import by_target
    long = by_target(history(spark, sf), CONFIG)
    out = quality.distribution(long, "target_value", ["stat_target"])
    return out.select("stat_target", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])
